"""Mixing sources to target weights.

Documents are put by hash into blocks, whose token counts, of bounded number,
are all that the driver sees.  Each source's quota of the largest possible total
becomes whole draws of its blocks and one that is cut.  A splitting tree shares
the draws out: at each node the draws of all sources are halved by one
multivariate hypergeometric variate, down to one leaf per output shard, so every
shard is an exact random sample of the mixture.  A source's blocks, in random
order, then go to the shards in turn, and rows are shuffled inside their shard
by a hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.tokens import Vocabulary, encoded
from graphloom.session import written

MOST_UNITS = 1 << 18  # draws of blocks that the driver plans and sends to all executors: some 12 MB
MOST_SOURCES = 1 << 12


@dataclass(frozen=True)
class Target:
    """What a source shall contribute: its share of all tokens, and how often a document may stand in the result."""

    source: str
    share: float
    max_repeats: int


def read_targets(targets: DataFrame) -> list[Target]:
    """Targets of a table (source, target_share, max_repeats).

    Rows with a null, a share of 0 or less or no repeats take no part; of
    several rows of a source the shares add and the least repeats hold.
    """
    rows = (
        targets.where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats"))
        .limit(MOST_SOURCES + 1)
        .collect()
    )
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return sorted((Target(r.source, float(r.share), int(r.repeats)) for r in rows), key=lambda t: t.source)


def sized(documents: DataFrame, text: str = "text", vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of every document, as a written table."""
    ids = encoded(documents.select("doc_id", "source", F.col(text).alias("text")), "text", "ids", vocabulary)
    return written(ids.select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens")), "sizes")


def quotas(available: dict[str, int], targets: list[Target]) -> dict[str, int]:
    """Tokens each source gives of the largest total that no source's repeats limit.

    Sources without tokens give nothing; the shares of the others are scaled to
    sum 1.
    """
    held = [t for t in targets if available.get(t.source, 0) > 0]
    whole = sum(t.share for t in held)
    if not held:
        return {}
    total = min(available[t.source] * t.max_repeats * whole / t.share for t in held)
    return {t.source: min(int(total * t.share / whole + 1e-6), available[t.source] * t.max_repeats) for t in held}


def split(counts: list[int], shards: int, rng: np.random.Generator) -> list[list[int]]:
    """Counts per shard and source: the draws halved again and again, each time by a multivariate hypergeometric variate."""
    if shards == 1:
        return [counts]
    left = shards // 2
    share = sum(counts) * left // shards
    taken = rng.multivariate_hypergeometric(counts, share, method="marginals") if counts else np.zeros(0, int)
    rest = [c - int(t) for c, t in zip(counts, taken, strict=True)]
    return split([int(t) for t in taken], left, rng) + split(rest, shards - left, rng)


def plan(blocks: dict[str, list[tuple[int, int]]], targets: list[Target], shards: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """Draws (source, block, copy, shard, limit) for blocks of (number, tokens); limit is -1 for a whole block, else the tokens to take of it."""
    rng = np.random.default_rng(seed)
    quota = quotas({s: sum(n for _, n in b) for s, b in blocks.items()}, targets)
    units: dict[str, list[tuple[int, int, int]]] = {}
    for source, wanted in sorted(quota.items()):
        order = [blocks[source][i] for i in rng.permutation(len(blocks[source]))]
        total = sum(n for _, n in order)
        copies, rest = divmod(wanted, total)
        mine = [(b, c, -1) for c in range(copies) for b, _ in order]
        for b, n in order:
            if rest <= 0:
                break
            mine.append((b, copies, -1 if n <= rest else rest))
            rest -= n
        units[source] = [mine[i] for i in rng.permutation(len(mine))]
    sources = sorted(units)
    out, next_ = [], dict.fromkeys(sources, 0)
    for shard, counts in enumerate(split([len(units[s]) for s in sources], shards, rng)):
        for source, n in zip(sources, counts, strict=True):
            out += [(source, b, c, shard, limit) for b, c, limit in units[source][next_[source] : next_[source] + n]]
            next_[source] += n
    return out


def mixture(sizes: DataFrame, targets: DataFrame, shards: int = 16, seed: int = 7, block_docs: int = 16) -> DataFrame:
    """(shard, source, doc_id, copy, n_tokens, place): the documents drawn, each copy once; rows of a shard are in random order by place.

    ``sizes`` is (doc_id, source, n_tokens), as ``sized`` gives; it is read
    twice.  Documents with a null id or source, of a source without a target,
    or of no tokens take no part.  No source stands in the result more than its
    max_repeats times, and each falls short of its quota by less than one
    document.  A repeated doc_id counts as one document of the larger size.
    """
    wanted = read_targets(targets)
    spark = sizes.sparkSession
    docs = sizes.where("doc_id is not null and n_tokens > 0").join(F.broadcast(spark.createDataFrame([(t.source,) for t in wanted], "source string")), "source")
    docs = docs.groupBy("source", "doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    counted = {r.source: r.n for r in docs.groupBy("source").agg(F.count("*").alias("n")).collect()}  # a row per target at most
    most = max(1, MOST_UNITS // max(1, len(wanted)))
    number = {t.source: max(1, min(-(-counted[t.source] // block_docs), most // (t.max_repeats + 1))) for t in wanted if t.source in counted}
    numbers = spark.createDataFrame(sorted(number.items()), "source string, blocks bigint")
    placed = docs.join(F.broadcast(numbers), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), "blocks").cast("int"))
    blocks: dict[str, list[tuple[int, int]]] = {}
    for r in placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")).orderBy("source", "block").collect():  # MOST_UNITS at most
        blocks.setdefault(r.source, []).append((r.block, r.n))
    draws = spark.createDataFrame(plan(blocks, wanted, shards, seed), "source string, block int, copy int, shard int, limit bigint")
    drawn = placed.join(F.broadcast(draws), ["source", "block"])
    order = F.xxhash64("doc_id", F.lit(seed), F.lit("order"))
    sofar = F.sum("n_tokens").over(W.partitionBy("source", "block", "copy").orderBy(order, "doc_id"))
    cut = drawn.where("limit >= 0").withColumn("sofar", sofar).where("sofar <= limit").drop("sofar")
    place = F.xxhash64("doc_id", "copy", F.lit(seed), F.lit("place"))
    return drawn.where("limit < 0").unionByName(cut).select("shard", "source", "doc_id", "copy", "n_tokens", place.alias("place"))


def shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, documents, rows, tokens, share) of every target, reached shares beside the wanted ones."""
    wanted = sizes.sparkSession.createDataFrame([(t.source, t.share, t.max_repeats) for t in read_targets(targets)], "source string, target_share double, max_repeats int")
    held = sizes.where("doc_id is not null").groupBy("source", "doc_id").agg(F.max("n_tokens").alias("n")).groupBy("source").agg(F.sum("n").alias("available_tokens"))
    got = mixed.groupBy("source").agg(F.count_if(F.col("copy") == 0).alias("documents"), F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens"))
    rows = wanted.join(held, "source", "left").join(got, "source", "left").fillna(0, ["available_tokens", "documents", "rows", "tokens"])
    total = got.agg(F.sum("tokens").alias("total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("total") > 0, F.col("tokens") / F.col("total")).otherwise(0.0)).drop("total")


def kept_promises(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, within_a_document, within_repeats, whole_copies, known_sizes) of every target that has documents with tokens: what ``mixture`` promises, counted on its rows.

    within_a_document: the source falls short of its quota by less than its
    largest document, and does not exceed it; within_repeats: no document
    stands there more than max_repeats times; whole_copies: every row is
    another copy of its document; known_sizes: every row has its document's
    size.  The quotas are worked out anew from the sizes.
    """
    spark = sizes.sparkSession
    wanted = read_targets(targets)
    held = sizes.where("doc_id is not null and n_tokens > 0").groupBy("source", "doc_id").agg(F.max("n_tokens").alias("n"))
    by_source = held.groupBy("source").agg(F.sum("n").alias("available"), F.max("n").alias("largest"))
    named = spark.createDataFrame([(t.source, t.max_repeats) for t in wanted], "source string, max_repeats int")
    have = {r.source: (r.available, r.largest) for r in by_source.join(F.broadcast(named), "source").collect()}  # a row per target
    quota = quotas({s: n for s, (n, _) in have.items()}, wanted)
    rows = [(t.source, t.max_repeats, quota[t.source], have[t.source][1]) for t in wanted if t.source in quota]
    limits = spark.createDataFrame(rows, "source string, max_repeats int, quota bigint, largest bigint")
    per_doc = mixed.join(held, ["source", "doc_id"], "left").groupBy("source", "doc_id").agg(F.count("*").alias("times"), F.countDistinct("copy").alias("copies"), F.sum("n_tokens").alias("tokens"), F.min(F.coalesce(F.col("n_tokens") == F.col("n"), F.lit(False)).cast("int")).alias("fits"))
    got = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("times").alias("times"), F.min((F.col("times") == F.col("copies")).cast("int")).alias("whole"), F.min("fits").alias("fits"))
    all_ = limits.join(got, "source", "left").fillna(0, ["tokens", "times"]).fillna(1, ["whole", "fits"])
    short = F.col("quota") - F.col("tokens")
    return all_.select("source", ((short >= 0) & (short < F.greatest("largest", F.lit(1)))).alias("within_a_document"), (F.col("times") <= F.col("max_repeats")).alias("within_repeats"), (F.col("whole") == 1).alias("whole_copies"), (F.col("fits") == 1).alias("known_sizes"))
