"""Identifiers once: sorted runs, binary search, merging."""

import numpy as np

from graphloom.operators.once import OnceIndex, _found, identifier
from graphloom.session import scratch


def test_found_tells_equal_hashes_apart():
    hashes, ids = np.array([1, 5, 5, 5, 9]), np.array(["a", "b", "c", "d", "e"], object)
    want_hash, want = np.array([5, 5, 5, 1, 9, 0, 10]), np.array(["d", "x", "b", "a", "f", "g", "h"], object)
    assert _found(hashes, ids, want_hash, want).tolist() == [True, False, True, True, False, False, False]
    assert _found(hashes[:0], ids[:0], want_hash, want).tolist() == [False] * 7


def test_identifier_is_injective(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a:1", "x"), (None, "x")], "x string, y string")
    ids = [r[0] for r in rows.select(identifier("x", "y")).collect()]
    assert ids[3] is None and len(set(ids[:3])) == 3


def test_each_identifier_is_new_once_over_many_batches(spark):
    index = OnceIndex(spark, scratch(spark, "o"), merge_at=3, per_array=1)
    batches = [["a", "b", "a", None], ["b", "c"], [], ["a", "d", "d"], ["e" * 10_000, "a"], ["e" * 10_000]]
    seen = set()
    for i, batch in enumerate(batches):
        answer = index.ingest(spark.createDataFrame([(x,) for x in batch], "id string"), f"b{i}").collect()
        assert {(r.id, r.copies, r.known) for r in answer} == {(x, batch.count(x), x in seen) for x in batch if x is not None}
        new = [r.id for r in answer if not r.known]
        want = {x for x in batch if x is not None} - seen
        assert sorted(new) == sorted(want)
        seen |= want
    assert len(index.log.latest()[1]["parts"]) < 4


def test_probe_keeps_other_columns(spark):
    index = OnceIndex(spark, scratch(spark, "o"))
    index.add(spark.createDataFrame([("a",), ("a",)], "id string"), "b0")
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("b", None, "y"), ("b", 2, "a")], "id string, n int, ids string")
    assert {(r.id, r.n, r.ids, r.copies, r.known) for r in index.probe(rows, ["n", "ids"]).collect()} == {("a", 1, None, 1, True), ("b", None, "y", 3, False)}
    assert OnceIndex(spark, scratch(spark, "o")).probe(rows).where("known").count() == 0


def test_runs_of_many_lengths_of_prefix(spark):
    index = OnceIndex(spark, scratch(spark, "o"), merge_at=3, per_array=2)
    frame = lambda a, b: spark.range(a, b).selectExpr("cast(id as string) as id")
    for i, (a, b) in enumerate([(0, 500), (500, 510), (490, 2000), (1990, 2001), (5, 6)]):
        index.ingest(frame(a, b), f"b{i}")
    assert len({p[1] for p in index.log.latest()[1]["parts"]}) > 1
    assert index.probe(frame(0, 2500)).where("known").count() == 2001
