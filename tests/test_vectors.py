"""Nearest vectors: queries answered in their own direction and those compared with all rows."""

import random

import pytest

from graphloom.functions import vectors


@pytest.mark.parametrize("k", [1, 2])
def test_same_direction_first_changes_nothing(spark, monkeypatch, k):
    rng = random.Random(k)
    made = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(60)]
    made += [[2 * a for a in v] for v in made[:20]] + [[a + 1e-7 for a in v] for v in made[20:30]] + [[a + 1e-5 for a in v] for v in made[30:40]]
    made += [[0.0] * 6, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0], [1.0, 1e-8, -1e-8, 0.0, 0.0, 0.0], [1.0, -1e-8, 1e-8, 0.0, 0.0, 0.0], [3.0], [1.0, 2.0], []]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(made)] + [(500, None)], "id bigint, vector array<double>")
    got = lambda: sorted(map(tuple, vectors.nearest(df.where("id % 3 > 0"), df.where("id % 2 = 0 or id > 50"), k).collect()))
    want = got()
    monkeypatch.setattr(vectors, "FEW_PAIRS", 0)
    assert got() == want
    monkeypatch.setattr(vectors, "CROWD", 0)
    assert got() == want


def test_equal_vectors_are_not_compared_with_all(spark, monkeypatch):
    rng = random.Random(3)
    df = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)], "id bigint, vector array<double>")
    monkeypatch.setattr(vectors, "FEW_PAIRS", 0)
    monkeypatch.setattr(vectors, "_compared", None)
    assert sorted(map(tuple, vectors.nearest(df, df, 1).collect())) == [(i, i, 1.0, 1) for i in range(300)]
