"""Plain Python versions of the general problems, written from their statements, for small tables."""

from __future__ import annotations

import json
from collections import defaultdict


def snapshot_rows(snapshots: list[dict], commits: list[dict], parent_of: dict[str, str]) -> set[tuple]:
    """p2: snapshots (id, store, version, json), commits (commit_id, repo, snapshot), resolved parents."""

    def load(text, inner):
        try:
            value = json.loads(text)
        except (ValueError, TypeError):
            return None
        return value[inner] if inner else value

    def by_id(o):
        keep = ("iri", "types", "label", "source", "target")
        out = {}
        for e in [*o.get("nodes", []), *o.get("edges", [])]:
            props = {k: (v.get("type"), "value" in v, typed(v.get("value"))) for k, v in e.get("properties", {}).items()}
            out[e["id"]] = ({k: e[k] for k in keep if k in e}, props)
        return out

    def typed(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return (type(v).__name__, v)
        if isinstance(v, (int, float)):
            return ("number", v)
        if isinstance(v, list):
            return ("list", [typed(x) for x in v])
        return ("dict", {k: typed(x) for k, x in v.items()})

    def diff(a, b):
        for i in a.keys() | b.keys():
            if i not in a:
                yield i, "added"
            elif i not in b:
                yield i, "removed"
            elif a[i] != b[i]:
                yield i, "changed"

    out = set()
    saves: dict = defaultdict(dict)
    for s in sorted(snapshots, key=lambda s: s["id"]):
        o = load(s["json"], "ontology")
        if o is not None:
            saves[s["store"]][s["version"]] = by_id(o)
    for store, versions in saves.items():
        order = sorted(versions)
        for before, now in zip(order, order[1:], strict=False):
            out |= {(store, str(now), i, c) for i, c in diff(versions[before], versions[now])}
    snaps = {c["commit_id"].strip().lower(): (c["repo"], by_id(o)) for c in commits if (o := load(c["snapshot"], None)) is not None}
    for cid, (repo, items) in snaps.items():
        if (p := parent_of.get(cid)) in snaps and p != cid:
            out |= {(repo, cid, i, c) for i, c in diff(snaps[p][1], items)}
    return out


def resolve_commits(rows: list[dict]) -> dict[str, str]:
    """Commit id to the parent in the table it means."""
    ids = {r["commit_id"].strip().lower() for r in rows}
    out = {}
    for r in rows:
        p = "".join((r["parent"] or "").split()).lower()
        hits = [i for i in ids if p and i.startswith(p)]
        if p in ids:
            out[r["commit_id"].strip().lower()] = p
        elif len(hits) == 1:
            out[r["commit_id"].strip().lower()] = hits[0]
    return out


def resolve_types(rows: list[dict]) -> dict[str, set[str]]:
    """Type name to the declared supertypes."""
    names, iris = {r["name"] for r in rows}, {r["iri"]: r["name"] for r in rows if r["iri"]}
    out: dict = {n: set() for n in names}
    for r in rows:
        for ref in r["supertypes"] if r["supertypes"] is not None else ():
            ref = "".join((ref or "").split())
            local = r["name"].split(":")[0] + ":" + ref
            hit = ref if ref in names else iris.get(ref) or (local if local in names else None)
            if ref and hit:
                out[r["name"]].add(hit)
    return out


def tree_rows(tree: str, parents: dict[str, set[str]]) -> set[tuple]:
    """p3 rows by breadth-first search upwards from every node."""
    out = set()

    def above(v):
        seen, level, d = {v: 0}, [v], 0
        while level:
            d += 1
            level = [p for p in {p for x in level for p in parents.get(x, ())} if p not in seen]
            seen |= dict.fromkeys(level, d)
        return seen

    ups = {v: above(v) for v in parents}
    loop = {v for v in parents if any(v in ups[p] for p in parents[v])}
    for v in parents:
        out |= {(tree, v, r, d) for r, d in ups[v].items() if not parents.get(r)}
        if any(x in loop for x in ups[v]):
            out.add((tree, v, "<cycle>", -1))
    return out


def path_rows(rows: list[dict]) -> set[tuple]:
    """p3 rows of paths."""
    out = set()
    for r in rows:
        s = r["segments"] if r["segments"] is not None else (r["path"] or "").split("/")
        s = [x for x in s if x]
        out |= {("paths", "/" + "/".join(s[: k + 1]), "/" + s[0], k) for k in range(len(s))}
    return out


def object_rows(origin: str, record: int, text: str | None, base: str = "$", unwrap: bool = True) -> set[tuple]:
    """p4 rows of one text, by walking the parsed JSON."""
    try:
        value = json.loads(text)
        if unwrap and isinstance(value, str):
            value = json.loads(value)
    except (ValueError, TypeError):
        return set()
    out = set()

    def walk(v, path, near):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}.{k}", near)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                here = f"{path}[{i}]"
                if isinstance(x, dict):
                    out.add((origin, record, near, here))
                walk(x, here, here if isinstance(x, dict) else near)

    walk(value, base, "$")
    return out
