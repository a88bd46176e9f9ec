"""Hierarchies by peeling: random graphs against breadth-first search, in one block and in many."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from graphloom.operators.hierarchy import descendants, full_paths, hierarchy, lineage, path_links, peel
from graphloom.operators.references import commit_parents, type_parents

LINKS = "tree string, node string, parent string, coarse string, fine string"


def test_peel_leaves_loops_and_what_is_above_them():
    # 0 <- 1 <- 2, 3 <-> 4 below 5
    order, rest = peel([[], [0], [1], [4], [3, 5], []])
    assert order == [2, 1, 0] and sorted(rest) == [3, 4, 5]


@pytest.mark.parametrize("seed,max_block", [(1, 1000), (2, 4), (3, 1), (4, 3), (5, 6)])
def test_random_graphs(spark, seed, max_block):
    rng = random.Random(seed)
    rows, want = [], set()
    for tree in ("x", "y"):
        n = 40
        parents = {f"{i}": {str(rng.randrange(n)) for _ in range(rng.choice([0, 1, 1, 1, 2]))} if rng.random() < 0.25 else {str(rng.randrange(i))} if i and rng.random() < 0.9 else set() for i in range(n)}
        want |= brute.tree_rows(tree, parents)
        for v, ps in parents.items():
            for p in [*ps, None, next(iter(ps), None)]:
                rows.append((tree, v, p, rng.choice(["g", "g", None]), str(int(v) // 7)))
    df = spark.createDataFrame(rows, LINKS).withColumn("depth", F.lit("clash")).withColumn("root", F.lit(1))
    got = [tuple(r) for r in hierarchy(df, F.col("coarse"), F.col("fine"), max_block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_long_chain_over_many_blocks(spark):
    n = 20_000
    df = spark.range(n).selectExpr("'t' as tree", "cast(id as string) as node", "if(id > 0, cast(id - 1 as string), null) as parent", "'c' as coarse", "'' as fine")
    got = hierarchy(df, F.col("coarse"), F.col("fine"), 400)
    assert got.where("root = '0' and cast(node as bigint) = depth").count() == n == got.count()


def test_loops_over_many_blocks(spark):
    n = 200
    rows = [("t", f"l{i}", f"l{(i + 1) % n}", "c", "") for i in range(n)] + [("t", f"b{i}", f"b{i - 1}" if i else "l7", "c", "") for i in range(n)] + [("t", "r", None, "c", ""), ("t", "b5", "r", "c", "")]
    got = {tuple(r) for r in hierarchy(spark.createDataFrame(rows, LINKS), F.col("coarse"), F.col("fine"), 10).collect()}
    assert got == {("t", f"{k}{i}", "<cycle>", -1) for k in "lb" for i in range(n)} | {("t", f"b{i}", "r", i - 4) for i in range(5, n)} | {("t", "r", "r", 0)}


def test_empty_and_null(spark):
    assert hierarchy(spark.createDataFrame([], LINKS), F.col("coarse")).count() == 0
    df = spark.createDataFrame([("t", None, "a", None, None), ("t", "a", "", None, None), ("t", "s", "s", None, None)], LINKS)
    assert {tuple(r) for r in hierarchy(df, F.col("coarse")).collect()} == {("t", "a", "a", 0), ("t", "s", "<cycle>", -1)}


def test_references(spark):
    ids = ["ab" * 32, "ac" * 32, "cd" * 32]
    rows = [(ids[0], None), (ids[1], "AB" * 8), (ids[1], " " + ids[0]), (ids[2], "a"), (ids[2], "zz"), ("", "x"), (None, ids[0])]
    got = {tuple(r) for r in commit_parents(spark.createDataFrame(rows, "commit_id string, parent string")).collect()}
    assert got == {(ids[0], None), (ids[1], ids[0]), (ids[2], None)}
    types = [("v:A", "http://v/A", None), ("v:B", None, ["A", " v:A", "http://v/A", "w:A", None, ""]), ("w:A", "http://w/A", ["A"]), ("x", None, ["x", "v:B"]), (None, None, ["v:A"])]
    got = {tuple(r) for r in type_parents(spark.createDataFrame(types, "name string, iri string, supertypes array<string>")).collect()}
    assert got == {("v:A", None), ("v:B", "v:A"), ("v:B", "w:A"), ("w:A", "w:A"), ("x", "x"), ("x", "v:B")}


def test_path_links(spark):
    df = spark.createDataFrame([("a//b/", None), (None, ["a", "", "c"]), (None, None), ("", []), ("/a/b", ["z", None])], "path string, segments array<string>")
    assert {(r.node, r.parent) for r in path_links(df).collect()} == {("/a", None), ("/a/b", "/a"), ("/a/c", "/a"), ("/z", None)}


@pytest.mark.parametrize("max_block", [1000, 3])
def test_lineage_descendants_and_paths(spark, max_block):
    rng = random.Random(9)
    parents = {str(i): {str(rng.randrange(i)) for _ in range(rng.choice([1, 1, 2]))} if i > 1 else set() for i in range(40)}
    parents |= {"l1": {"l2"}, "l2": {"l1"}, "l3": {"l1", "0"}}
    rows = [("t", v, p, "g", "") for v, ps in parents.items() for p in [*ps, None]]
    df = spark.createDataFrame(rows, LINKS)

    def above(v):
        seen, level, d = {v: 0}, [v], 0
        while level:
            d += 1
            level = [p for p in {p for x in level for p in parents[x]} if p not in seen]
            seen |= dict.fromkeys(level, d)
        return seen

    want = {("t", v, a, d) for v in parents for a, d in above(v).items()}
    lines = lineage(df, F.col("coarse"), F.col("fine"), max_block)
    got = [tuple(r) for r in lines.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    below = {v: sum(1 for _, n, a, _ in want if a == v and n != v) for v in parents}
    assert {(r.node, r.descendants) for r in descendants(lines).collect()} == set(below.items())
    least = {v: min((d for a, d in above(v).items() if not parents[a]), default=None) for v in parents}
    for r in full_paths(df, F.col("coarse"), F.col("fine"), max_block).collect():
        assert len(r.path) == least[r.node] + 1 and r.path[-1] == r.node and not parents[r.path[0]]
        assert all(a in parents[b] for a, b in zip(r.path, r.path[1:], strict=False))
        least.pop(r.node)
    assert {v for v, d in least.items() if d is not None} == set()
