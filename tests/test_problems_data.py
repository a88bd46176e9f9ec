"""The general problems on the driver's smallest tables against plain Python."""

import os

import pytest

import brute
from graphloom.queries import processing

SF = os.environ.get("GRAPHLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows_of(spark, name):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()]


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_p2_found(spark):
    commits = rows_of(spark, "commits")
    assert found(processing.p2_found(spark, SF)) == brute.snapshot_rows(rows_of(spark, "snapshots"), commits, brute.resolve_commits(commits))


def test_p3_found(spark):
    commits = rows_of(spark, "commits")
    parents = brute.resolve_commits(commits)
    ups = {r["commit_id"].strip().lower(): ({parents[i]} if (i := r["commit_id"].strip().lower()) in parents else set()) for r in commits}
    want = brute.tree_rows("node_types", brute.resolve_types(rows_of(spark, "node_types"))) | brute.tree_rows("commits", ups) | brute.path_rows(rows_of(spark, "paths"))
    assert found(processing.p3_found(spark, SF)) == want


def test_p4_found(spark):
    want = set()
    for origin, name, key in (("journal", "journal", "delivery_id"), ("states", "states", "state_id")):
        for r in rows_of(spark, name):
            want |= brute.object_rows(origin, r[key], r["payload"])
    for r in rows_of(spark, "paths"):
        for k, text in (r["attributes"] or {}).items():
            want |= brute.object_rows("paths", r["path_id"], text, f"$.{k}", False)
    assert found(processing.p4_found(spark, SF)) == want
