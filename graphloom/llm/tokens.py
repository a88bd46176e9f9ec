"""Encoding a corpus with a byte-level BPE tokenizer.

The words of the corpus (as the tokenizer's pattern cuts them) are counted, and
the most frequent ones, a fixed number, are encoded once each by higher-order
functions: a fold that in every step merges the pair of least rank, all its
occurrences at once, looking ranks up in a literal hash table.  Their ids, of
bounded size, go to all executors.  Each text is then put together where it is
read; a word that is not among the frequent ones is encoded there by the same
fold.  Nothing but word counts is shuffled.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
FREQUENT = 1 << 16  # words encoded once for all, of at most LONGEST bytes: some 8 MB
LONGEST = 64
BUCKETS = 32749

# fixed values: the tokenizer's pattern, white space being Unicode's
_S = r"\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class Vocabulary:
    """Ranks and byte ids of a byte-level BPE file: ``folder``/``name`` in the tiktoken form."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
        lines = [x.split() for x in open(f"{folder}/{name}.tiktoken", "rb")]
        self.piece = {int(rank): base64.b64decode(text) for text, rank in lines}
        self.id = {p: i for i, p in self.piece.items()}
        self.byte = [self.id[bytes([b])] for b in range(256)]

    def merges(self) -> dict[tuple[int, int], int]:
        """Pairs of ids to the id they merge to; a lower id merges first.

        The pair that made a piece is what the piece falls into when only lower
        ranks may merge.
        """
        out = {}
        for rank in sorted(self.piece):
            parts = [bytes([b]) for b in self.piece[rank]]
            while len(parts) > 2:
                ranks = [self.id.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[best] >= rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2:
                out[self.id[parts[0]], self.id[parts[1]]] = rank
        return out


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with value computed once."""
    return F.transform(F.array(value), then)[0]


def encoder(vocabulary: Vocabulary) -> Callable[[Column], Column]:
    """A column function: the ids of one word, as array<int>."""
    buckets: list[dict] = [{"k": [], "v": []} for _ in range(BUCKETS)]
    for (a, b), new in vocabulary.merges().items():
        pair = (a << 16) + b
        buckets[pair % BUCKETS]["k"].append(pair)
        buckets[pair % BUCKETS]["v"].append(new)
    table = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<struct<k: array<bigint>, v: array<int>>>")
    first = F.from_json(F.lit(json.dumps(vocabulary.byte)), "array<int>")

    def merged(pair: Column) -> Column:
        return _let(F.get(table, (pair % BUCKETS).cast("int")), lambda b: F.get(b["v"], (F.array_position(b["k"], pair) - 1).cast("int")))

    def state(tokens: Column) -> Column:
        pairs = F.transform(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t, i: t.cast("bigint") * 65536 + F.get(tokens, i + 1))
        return _let(F.transform(pairs, merged), lambda m: F.struct(tokens.alias("tokens"), m.alias("m"), F.array_min(m).alias("best")))

    def step(s: Column, _: Column) -> Column:
        # where the best pair stands; of overlapping ones (a a a) the first, third, ... merge
        marks = F.split(F.regexp_replace(F.array_join(F.transform(s["m"], lambda x: F.when(x == s["best"], "b").otherwise("-")), ""), "bb", "b-"), "")
        new = _let(marks, lambda f: F.array_compact(F.transform(s["tokens"], lambda t, i: F.when(F.get(f, i - 1) == "b", F.lit(None)).when(F.get(f, i) == "b", s["best"]).otherwise(t))))
        return F.when(s["best"].isNull(), s).otherwise(_let(new, state))

    def encode(word: Column) -> Column:
        digits = F.hex(F.encode(word, "UTF-8"))
        tokens = _let(digits, lambda h: F.transform(F.sequence(F.lit(0), (F.length(h) / 2 - 1).cast("int")), lambda i: F.get(first, F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))))
        steps = F.slice(F.sequence(F.lit(0), F.octet_length(word)), F.lit(2), F.greatest(F.octet_length(word) - 1, F.lit(0)))
        return F.aggregate(steps, _let(tokens, state), step, lambda s: s["tokens"])

    return encode


def words(text: Column) -> Column:
    """The words of a text in order; none of a null or empty text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def frequent_words(df: DataFrame, text: str, encode: Callable[[Column], Column], most: int = FREQUENT) -> dict[str, list[int]]:
    """The ``most`` most frequent words of at most LONGEST bytes with their ids."""
    counted = df.select(F.explode(words(F.col(text))).alias("word")).where(F.octet_length("word") <= LONGEST).groupBy("word").count()
    top = counted.orderBy(F.desc("count"), "word").limit(most).select("word")
    spread = top.repartition(df.sparkSession.sparkContext.defaultParallelism).select("word", encode(F.col("word")).alias("ids"))
    return {r.word: r.ids for r in spread.collect()}  # ``most`` rows, each of LONGEST ids at most


def encoded(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: Vocabulary | None = None, most: int = FREQUENT) -> DataFrame:
    """``df`` with the column ``ids`` (array<int>): the token ids of ``text``, without special tokens.

    An empty and a null text give an empty array.  Special tokens' strings are
    ordinary text.  Repeated rows stay, other columns pass through; a column
    named as ``ids`` is replaced.  Of an empty table the result is empty.
    ``most`` sets how many words are encoded ahead; it changes the speed, not
    the result.
    """
    encode = encoder(vocabulary or Vocabulary())
    known = frequent_words(df, text, encode, most)
    at = {w: i for i, w in enumerate(known)}
    sizes = np.array([len(x) for x in known.values()], np.int64)
    flat = np.array([t for x in known.values() for t in x], np.int32)
    held = df.sparkSession.sparkContext.broadcast((at, sizes, flat))
    rest = [c for c in df.columns if c != ids]
    given = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), words(F.col(f"`{text}`")).alias("words"))
    fields = given.drop("words").schema
    schema = T.StructType([*fields.fields, T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("missing", T.ArrayType(T.StringType()))])
    put = assembler(held, len(rest))
    out = given.mapInArrow(put, schema)
    filled = _let(F.transform("missing", encode), lambda e: F.flatten(F.transform("tokens", lambda t: F.when(t >= 0, F.array(t)).otherwise(F.get(e, -t - 1)))))
    result = F.when(F.size("missing") == 0, F.col("tokens")).otherwise(filled)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), result.alias(ids))


def assembler(held: object, columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Replaces each text's words by their ids; a word that is not held becomes -1 - its place among the text's missing words."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sizes, flat = held.value
        begins = np.cumsum(np.append(0, sizes))[:-1]
        for batch in batches:
            lists = batch.column(columns)
            ends = lists.offsets.to_numpy()
            ends = ends - ends[0]
            coded = lists.flatten().dictionary_encode()
            uniques = coded.dictionary.to_pylist()
            place = coded.indices.to_numpy(zero_copy_only=False)
            held_at = np.array([at.get(w, -1) for w in uniques], np.int64)
            size_u = np.where(held_at >= 0, sizes[held_at] if len(sizes) else 1, 1)
            begin_u = np.where(held_at >= 0, begins[held_at] if len(sizes) else 0, -1)
            size, begin = size_u[place], begin_u[place]
            out_ends = np.append(0, np.cumsum(size))
            out = np.full(out_ends[-1], -1, np.int32)
            known = begin >= 0
            where = np.repeat(begin - out_ends[:-1], size) + np.arange(len(out))
            taken = np.repeat(known, size)
            out[taken] = flat[where[taken]]
            missing: list[list[str]] = [[] for _ in range(len(batch))]
            gaps = np.flatnonzero(~known)
            rows = np.searchsorted(ends, gaps, side="right") - 1
            number: dict[tuple[int, int], int] = {}
            for g, r in zip(gaps.tolist(), rows.tolist(), strict=True):
                k = number.get((r, place[g]))
                if k is None:
                    k = number[r, place[g]] = len(missing[r])
                    missing[r].append(uniques[place[g]])
                out[out_ends[g]] = -1 - k
            tokens = pa.ListArray.from_arrays(pa.array(out_ends[ends].astype(np.int32)), pa.array(out))
            names = [f"c{i}" for i in range(columns)] + ["tokens", "missing"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(columns)), tokens, pa.array(missing, pa.list_(pa.string()))], names=names)

    return put


def decoded(ids: Column, vocabulary: Vocabulary | None = None) -> Column:
    """The text of an array of ids: their binary pieces concatenated.  Null gives null, an id outside the vocabulary nothing."""
    piece = (vocabulary or Vocabulary()).piece
    table = F.transform(F.split(F.lit(" ".join(piece.get(i, b"").hex() for i in range(max(piece) + 1))), " "), lambda h: F.unhex(h))
    return F.decode(F.aggregate(ids, F.lit(b""), lambda acc, i: F.concat(acc, F.coalesce(F.get(table, i), F.lit(b"")))), "UTF-8")
