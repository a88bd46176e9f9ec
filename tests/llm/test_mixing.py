"""Mixing: shares, repeats, exactness of the splitting tree."""

import random

import numpy as np

from graphloom.llm.mixing import Target, mixture, quotas, shares, split

SIZES, TARGETS = "doc_id bigint, source string, n_tokens bigint, shard string", "source string, target_share double, max_repeats int"


def test_quotas_use_the_scarcest_source_up():
    targets = [Target("a", 0.5, 1), Target("b", 0.3, 2), Target("c", 0.2, 4), Target("gone", 0.5, 3)]
    got = quotas({"a": 1000, "b": 100, "c": 1000}, targets)
    assert got["b"] == 200 and abs(got["a"] - 333) <= 1 and abs(got["c"] - 133) <= 1
    assert quotas({}, targets) == {}


def test_split_is_exact_and_even():
    for shards in (1, 2, 5, 16):
        parts = split([100, 7, 0, 53], shards, np.random.default_rng(1))
        assert [sum(c) for c in zip(*parts, strict=True)] == [100, 7, 0, 53] and len(parts) == shards
        sizes = [sum(p) for p in parts]
        assert max(sizes) - min(sizes) <= shards.bit_length()


def test_shares_repeats_and_draws(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else rng.choice(["b", "c", "none"]), rng.randrange(0, 60), "x") for i in range(3000)]
    rows += [(7, "hot", 3, "x"), (None, "hot", 5, "x"), (9_000, None, 5, "x"), (9_001, "c", None, "x")]
    sizes = spark.createDataFrame(rows, SIZES)
    targets = spark.createDataFrame([("hot", 0.4, 1), ("b", 0.35, 2), ("c", 0.25, 3), ("missing", 0.1, 2), (None, 0.1, 1), ("none", 0.0, 1)], TARGETS)
    mixed = mixture(sizes, targets, shards=4)
    got = mixed.collect()
    assert len({(r.doc_id, r.copy) for r in got}) == len(got) and all(r.n_tokens > 0 for r in got)
    assert {r.source for r in got} == {"hot", "b", "c"} and {r.shard for r in got} == set(range(4))
    report = {r.source: r for r in shares(mixed, sizes, targets).collect()}
    for source, share, repeats in (("hot", 0.4, 1), ("b", 0.35, 2), ("c", 0.25, 3)):
        assert abs(report[source].share - share) < 0.01
        assert max(r.copy for r in got if r.source == source) < repeats
    assert report["missing"].tokens == 0
    assert sorted(map(tuple, mixture(sizes, targets, shards=4).collect())) == sorted(map(tuple, got))


def test_nothing_to_mix(spark):
    sizes, targets = spark.createDataFrame([], SIZES), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixture(sizes, targets).count() == 0 and shares(mixture(sizes, targets), sizes, targets).first().tokens == 0
    assert mixture(sizes, targets.where("false")).count() == 0
