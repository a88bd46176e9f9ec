"""Actor queries read every row of paths: by its segments, or by its text where there are none."""

import hashlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def render(parts):
    return "/" + "/".join(parts)


@pytest.fixture(scope="module")
def given():
    """The segments of each row of paths, and those of the journal."""
    rows = duckdb.sql(f"SELECT path, segments FROM '{SF}/paths.parquet'").fetchall()
    assert any(p is None for p, _ in rows) and any(p and not p.startswith("/") for p, _ in rows) and any(p and "//" in p for p, _ in rows)
    paths = [[x for x in (s if s is not None else p.split("/")) if x] for p, s in rows if not (p is None and s is None)]
    journal = duckdb.sql(f"SELECT DISTINCT path FROM '{SF}/journal.parquet' WHERE path IS NOT NULL AND version IS NOT NULL AND trim(actor, ' ' || chr(9) || chr(10) || chr(13)) <> ''").fetchall()
    return [p for p in paths if p], [p.removeprefix("/").split("/") for (p,) in journal if p != "/"]


def result(spark, name):
    return Counter(tuple(r) for r in entry.queries()[name](spark, SF).collect())


def run_of(parts):
    found, waits = {"workflow": None, "run": None}, ""
    for x in parts:
        if waits:
            found[waits], waits = x, ""
        elif x in found:
            found[x], waits = None, x
    return found["workflow"] and (found["workflow"], found["run"] or "<no-run>")


def test_nodes_and_edges(spark, given):
    ends = {tuple(p[:n]) for p in given[0] + given[1] for n in range(1, len(p) + 1)}
    types = {"workflow": "Workflow", "run": "Run", "step": "Step"}
    want = {(sha("NodeId|" + render(p)), types.get(p[-1], "ActorPathSegment"), render(p), len(p) - 1, p[-1]) for p in ends}
    assert result(spark, "actor_hierarchical_nodes") == Counter(want)
    pairs = {(sha("NodeId|" + render(p[:-1])), sha("NodeId|" + render(p))) for p in ends if len(p) > 1}
    assert result(spark, "actor_supervises_edges") == Counter((sha(f"EdgeId|{s}|supervises|{t}"), s, t) for s, t in pairs)


def test_runs(spark, given):
    keys = {render(p): run_of(p) or (None, None) for p in given[0]}
    assert result(spark, "actor_run_keys") == Counter((p, *k) for p, k in keys.items())
    counts = Counter(k for p in given[0] if (k := run_of(p)))
    flat = {(r.workflow, r.run): r.path_count for r in entry.queries()["actor_flat"](spark, SF).collect()}
    assert {k: n for k, n in flat.items() if n} == counts


def test_first_pass(spark, given):
    assert dict(result(spark, "actor_snapshot_diff").keys())["Actor"] == len({render(p) for p in given[0]})
