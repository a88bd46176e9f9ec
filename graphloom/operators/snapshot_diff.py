"""What changed between full snapshots: Merkle trees over hash ranges of the keys.

Every snapshot is read once and written as a list of elements, ordered by the
hash of their ids, with a tree of digests over the ranges of that hash.  Trees of
neighbouring snapshots are compared from the root down; only the elements in
ranges whose digests differ are joined by id.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import squeezed
from graphloom.operators.references import commit_parents
from graphloom.session import written

FIELDS = ("iri", "types", "label", "source", "target", "properties")
LEAF = 4  # elements in a leaf range, on average
DEEPEST = 20
BLOCK_BITS = 8

_READ = "holder string, vkey string, version bigint, rid bigint, tree array<bigint>, elements array<struct<place bigint, id string, digest bigint>>"


def _number(text: str) -> int | float | str:
    """A number such that 121, 121.0 and 1.21e2 are equal; one too long for the machine stays text."""
    if len(text) > 400:
        return text
    if text.lstrip("-").isdigit():
        return int(text)
    value = float(text)
    return int(value) if abs(value) < 2**53 and value == int(value) else value


def _refuse(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=_number, parse_float=_number, parse_constant=_refuse)


def _h64(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "big", signed=True)


def _properties(given: object) -> object:
    """Properties reduced to type tag and value, a value that is missing apart from one that is null."""
    if not isinstance(given, dict):
        return given
    return {k: [v.get("type"), [v["value"]] if "value" in v else []] if isinstance(v, dict) else ["", [v]] for k, v in given.items()}


def elements(ontology: object) -> list[tuple[int, str, int]]:
    """(hash, id, digest) of the nodes and edges of an ontology, ordered; of several with one id the last counts."""
    found: dict[str, int] = {}
    for part in ("nodes", "edges"):
        items = ontology.get(part) if isinstance(ontology, dict) else None
        for e in items.values() if isinstance(items, dict) else items if isinstance(items, list) else ():
            if isinstance(e, dict) and isinstance(e.get("id"), str):
                kept = {k: _properties(e[k]) if k == "properties" else e[k] for k in FIELDS if k in e}
                found[e["id"]] = _h64(json.dumps([e["id"], kept], sort_keys=True).encode())
    return sorted((zlib.crc32(i.encode("utf-8", "surrogatepass")), i, d) for i, d in found.items())


def merkle(items: list[tuple[int, str, int]]) -> list[int]:
    """Digests in heap order, root first; each leaf covers an equal range of the 32-bit hash.

    A digest is the sum of the elements' digests (modulo 2**64, offset to be
    signed), so that a range has one digest however deep its tree goes on.
    """
    depth = min(DEEPEST, max(0, (len(items) // LEAF).bit_length()))
    level = [0] * (1 << depth)
    for place, _, digest in items:
        level[place >> (32 - depth)] += digest
    levels = [level]
    while len(level) > 1:
        level = [a + b for a, b in zip(level[0::2], level[1::2], strict=True)]
        levels.append(level)
    return [(d + (1 << 63)) % (1 << 64) - (1 << 63) for level in reversed(levels) for d in level]


def differing(a: list[int], b: list[int]) -> list[bool] | None:
    """Which of the ranges at the depth both trees have may hold differences, going down only below digests that differ; None if none."""
    depth = min(len(a) + 1, len(b) + 1).bit_length() - 2
    at = [0] if a[0] != b[0] else []
    for level in range(1, depth + 1):
        first = (1 << level) - 1
        at = [c for n in at for c in (2 * n, 2 * n + 1) if a[first + c] != b[first + c]]
    if not at:
        return None
    mask = [False] * (1 << depth)
    for n in at:
        mask[n] = True
    return mask


def decoded(text: str, inner: str | None) -> list[tuple[int, str, int]] | None:
    """The elements of a snapshot's JSON; None if it is broken or no object."""
    try:
        value, end = _DECODER.raw_decode(text, len(text) - len(text.lstrip()))
        if text[end:].strip() or not isinstance(value, dict):
            return None
        return elements(value.get(inner) if inner else value)
    except (ValueError, RecursionError, OverflowError):
        return None


def read_snapshots(df: DataFrame, holder: Column, vkey: Column, version: Column, rid: Column, text: Column, inner: str | None) -> DataFrame:
    """Snapshots with their elements and trees; a null or broken text is no snapshot.  ``inner``: the key the ontology lies under."""
    given = df.select(holder.cast("string").alias("holder"), vkey.cast("string").alias("vkey"), version.cast("bigint").alias("version"), rid.cast("bigint").alias("rid"), text.alias("text"))
    given = given.where("text is not null and vkey is not null")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def row(r: tuple) -> dict | None:
            items = decoded(r.text, inner)
            if items is None:
                return None
            safe = lambda i: i if i.isascii() else i.encode("utf-8", "replace").decode()
            return {"holder": r.holder, "vkey": r.vkey, "version": r.version, "rid": r.rid, "tree": merkle(items), "elements": [{"place": p, "id": safe(i), "digest": d} for p, i, d in items]}

        for batch in batches:
            for start in range(0, len(batch), 256):
                out = [x for r in batch.iloc[start : start + 256].itertuples(index=False) if (x := row(r))]
                frame = pd.DataFrame(out, columns=["holder", "vkey", "version", "rid", "tree", "elements"])
                yield frame.astype({"version": "Int64", "rid": "Int64"})

    parsed = given.mapInPandas(rows, _READ)
    small = F.transform("elements", lambda e: F.struct(e["place"].alias("place"), packed(e["id"]).alias("id"), e["digest"].alias("digest")))
    return parsed.withColumn("elements", small)


def packed(c: Column) -> Column:
    """Text as bytes; 64 lower-case hexadecimal digits, the form of content addresses, take half the space."""
    return F.when(c.rlike("^[0-9a-f]{64}$"), F.concat(F.encode(F.lit("h"), "UTF-8"), F.unhex(c))).otherwise(F.concat(F.encode(F.lit("t"), "UTF-8"), F.encode(c, "UTF-8")))


def unpacked(c: Column) -> Column:
    """What ``packed`` has packed."""
    rest = F.substring(c, 2, (1 << 31) - 1)
    return F.when(F.decode(F.substring(c, 1, 1), "UTF-8") == "h", F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def latest_saves(read: DataFrame) -> DataFrame:
    """(holder, vkey, version, rid, tree) of the save with the greatest rid of each holder and key, without its elements."""
    return read.groupBy("holder", "vkey").agg(F.max("version").alias("version"), F.max("rid").alias("rid"), F.max_by("tree", "rid").alias("tree"))


def previous_versions(found: DataFrame) -> DataFrame:
    """(holder, version, before): the next lower version of the holder.

    Versions are first looked up within blocks, then between the blocks, so that
    a holder with very many snapshots is spread over tasks.
    """
    v = found.select("holder", "version", F.shiftright("version", BLOCK_BITS).alias("block")).distinct()
    near = v.withColumn("before", F.lag("version").over(W.partitionBy("holder", "block").orderBy("version")))
    tops = v.groupBy("holder", "block").agg(F.max("version").alias("top"))
    tops = tops.select("holder", "block", F.lag("top").over(W.partitionBy("holder").orderBy("block")).alias("top"))
    return near.join(tops, ["holder", "block"]).select("holder", "version", F.coalesce("before", "top").alias("before")).where("before is not null")


def changes(read: DataFrame, pairs: DataFrame) -> DataFrame:
    """(holder, version_key, element_id, change) between the snapshots of each pair.

    ``read``: what ``read_snapshots`` gives, written as a table, since its
    columns are read at different times: first only keys and trees, then the
    elements of the snapshots that differ.  ``pairs``: holder, version_key,
    at_holder, before_holder, before: the snapshot and the one before it.
    change is added, removed or changed.
    """
    trees = latest_saves(read)
    now = trees.select(F.col("holder").alias("at_holder"), F.col("vkey").alias("version_key"), F.col("rid").alias("now_rid"), F.col("tree").alias("new"))
    old = trees.select(F.col("holder").alias("before_holder"), F.col("vkey").alias("before"), F.col("rid").alias("old_rid"), F.col("tree").alias("old"))
    both = pairs.join(now, ["at_holder", "version_key"]).join(old, ["before_holder", "before"])

    @F.pandas_udf("array<boolean>")
    def mask(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([differing(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], dtype=object)

    asked = both.withColumn("mask", mask("new", "old")).where("mask is not null")
    side = lambda h, k, r, new: F.struct(F.col(h).alias("h"), F.col(k).alias("k"), F.col(r).alias("r"), F.lit(new).alias("is_new"))
    sides = F.explode(F.array(side("at_holder", "version_key", "now_rid", True), side("before_holder", "before", "old_rid", False)))
    asked = asked.select("holder", packed(F.col("version_key")).alias("version_key"), "mask", sides.alias("s")).select("holder", "version_key", "mask", "s.*")
    held = read.select(F.col("holder").alias("h"), F.col("vkey").alias("k"), F.col("rid").alias("r"), "elements")
    bits = F.expr("cast(round(log2(size(mask))) as int)")
    inside = F.filter("elements", lambda e: F.get(F.col("mask"), (e["place"] / F.pow(F.lit(2.0), F.lit(32) - F.col("bits"))).cast("int")))
    rows = asked.withColumn("bits", bits).join(held, ["h", "k", "r"]).select("holder", "version_key", "is_new", F.explode(inside).alias("e"))
    digest = lambda new: F.max(F.when(F.col("is_new") == new, F.col("e.digest")))
    diff = rows.groupBy("holder", "version_key", F.col("e.id").alias("element_id")).agg(digest(True).alias("now"), digest(False).alias("then"))
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("then") != F.col("now"), "changed")
    return diff.select("holder", unpacked(F.col("version_key")).alias("version_key"), unpacked(F.col("element_id")).alias("element_id"), change.alias("change")).where("change is not null")


def store_changes(snapshots: DataFrame) -> DataFrame:
    """Changes between neighbouring versions of each store."""
    read = read_snapshots(snapshots.where("store is not null and version is not null"), F.col("store"), F.col("version"), F.col("version"), F.col("id"), F.col("json"), "ontology")
    read = written(read, "snapshots")
    before = previous_versions(read)
    pairs = before.select("holder", F.col("version").cast("string").alias("version_key"), F.col("holder").alias("at_holder"), F.col("holder").alias("before_holder"), F.col("before").cast("string").alias("before"))
    return changes(read, pairs)


def commit_changes(commits: DataFrame) -> DataFrame:
    """Changes of each commit against its parent."""
    own = F.lower(squeezed(F.col("commit_id")))
    read = read_snapshots(commits, F.lit(""), own, F.lit(None), F.xxhash64("snapshot"), F.col("snapshot"), None)
    read = written(read, "commits")
    repos = commits.groupBy(own.alias("version_key")).agg(F.max("repo").alias("holder"))
    pairs = commit_parents(commits).where("parent_id is not null and parent_id <> commit_id").select(F.col("commit_id").alias("version_key"), F.col("parent_id").alias("before"))
    pairs = pairs.join(repos, "version_key").select("holder", "version_key", F.lit("").alias("at_holder"), F.lit("").alias("before_holder"), "before")
    return changes(read, pairs)
