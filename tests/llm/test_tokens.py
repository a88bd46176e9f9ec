"""Encoding against the tokenizer's own library, and back."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.llm.tokens import TOKENIZERS, Vocabulary, decoded, encoded
from graphloom.session import ship

pytestmark = pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizer files")
TEXTS = [
    None, "", " ", "\n\n  x", "a" * 1000, "ab" * 333 + " " * 50, "<|endoftext|> it's 12345 I'LL don't we've", "漢字かな交じり文" * 20, "\U0001f600" * 30, "é    x\x1c\x1d y\x85z​　 q",
    "x" * 30_000, "!?#%&*" * 400, "tab\tand\r\nline", "it''s '' 's", "MATCH (a:Person)-[:x]->(b) {\"k\": [1, 2.5e3]}",
]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return [t.encode(x, add_special_tokens=False).ids if x else [] for x in texts]


@pytest.mark.parametrize("most", [65536, 3, 0])
def test_equal_to_the_library_whatever_is_encoded_ahead(spark, most):
    ship(spark)
    df = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, words string, ids int").repartition(3)
    got = {r.doc_id: (r.ids, r.words) for r in encoded(df, most=most).collect()}
    assert [got[i] for i in range(len(TEXTS))] == [(ids, "clash") for ids in reference(TEXTS)]


def test_round_trip(spark):
    ship(spark)
    df = encoded(spark.createDataFrame([(t,) for t in TEXTS if t], "text string"))
    assert df.where(decoded(F.col("ids")) != F.col("text")).count() == 0


def test_empty_and_repeated(spark):
    ship(spark)
    df = spark.createDataFrame([("a b",), ("a b",)], "text string")
    assert encoded(df).count() == 2 and encoded(df.where("false")).count() == 0


def test_merges_follow_the_ranks():
    v = Vocabulary()
    merges = v.merges()
    assert len(merges) == len(v.piece) - 256
    assert all(v.piece[a] + v.piece[b] == v.piece[new] for (a, b), new in merges.items())
