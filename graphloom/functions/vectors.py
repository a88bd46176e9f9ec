"""Vectors: similarity, exhaustive nearest neighbours in blocks, and embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.model import Ontology
from graphloom.functions.iri import local_name
from graphloom.session import written

BLOCK = 1024
MOST_BROADCAST = 64 << 20  # bytes of queries that go to all executors at once
FEW_PAIRS = 1 << 28  # up to so many pairs are compared without looking for equal directions first
CROWD = 1024  # rows in a cell of directions beyond which its queries are compared with all rows


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, as float; 0 where lengths differ or one has length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm), F.lit(0.0)).cast("float")


def check_dimensions(index: DataFrame, vector: str = "vector") -> DataFrame:
    """The index, or an error while it is read where a vector has another length than the first."""
    first = index.select(F.size(vector).alias("n")).first()
    size = first[0] if first else 0
    return index.withColumn(vector, F.when(F.size(vector) == size, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector does not have {size} dimensions"))))


def _blocks(df: DataFrame, id: str, vector: str, rows: int) -> DataFrame:
    """Vectors packed into blocks of about BLOCK rows: one row (ids, vectors) each."""
    number = F.pmod(F.xxhash64(id), F.lit(max(1, -(-rows // BLOCK))))
    return df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v"), number.alias("block")).groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("r")).select(F.col("r.id").alias("ids"), F.col("r.v").alias("vectors"))


def _units(rows: list) -> np.ndarray:
    """Vectors of one length, made to length 1; those of length 0 stay."""
    m = np.array([np.asarray(r, np.float64) for r in rows])
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _cells(df: DataFrame, id: str, vector: str, near: float) -> DataFrame:
    """(cell, id, v): each row with the cell of its direction, and those within ``near`` of it; no row for a vector without direction."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["v"].map(len).to_numpy()
            for n in set(lengths.tolist()) - {0}:
                part = batch[lengths == n]
                unit = _units(part["v"].tolist())
                held = np.flatnonzero(np.isfinite(unit).all(1) & unit.any(1))
                axes = unit[held, :4] * 256
                low, high = np.floor(axes - near * 256).astype(np.int64), np.floor(axes + near * 256).astype(np.int64)
                done = []
                for corner in np.ndindex(*(2,) * axes.shape[1]):
                    up = np.array(corner, bool)
                    new = (low < high)[:, up].all(1)  # each cell once
                    cell = np.full(new.sum(), n, np.int64)
                    for axis in np.where(up, high, low)[new].T:
                        cell = cell * 1024 + axis + 512
                    done.append(part.iloc[held[new]].assign(cell=cell))
                yield pd.concat(done)[["cell", "id", "v"]]

    return df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).alias("v")).mapInPandas(find, f"cell bigint, id bigint, v {df.schema[vector].dataType.simpleString()}")


def _same_direction(q: DataFrame, x: DataFrame, k: int, id: str, vector: str) -> DataFrame:
    """(query, id, score, rank) of those queries that have k rows of score 1, the greatest there is.

    Rounded to 12 digits the cosine is 1 only where unit vectors are less than
    1.1e-6 apart, so these lie in one cell of directions or next to its border.
    """
    cells = _cells(x, id, vector, 1.1e-6).repartition("cell")
    one = F.row_number().over(W.partitionBy("cell", "v").orderBy("id"))
    cells = cells.withColumn("n", one).where(F.col("n") <= k).withColumn("n", F.count("*").over(W.partitionBy("cell"))).where(F.col("n") <= CROWD).drop("n")
    pairs = _cells(q, id, vector, 0.0).select("cell", F.col("id").alias("query"), F.col("v").alias("w")).join(cells, "cell").where(F.size("v") == F.size("w")).select("query", "w", "id", "v")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["v"].map(len).to_numpy()
            for n in set(lengths.tolist()):
                part = batch[lengths == n]
                yield part[["query", "id"]].assign(score=np.round((_units(part["w"].tolist()) * _units(part["v"].tolist())).sum(1), 12))

    best = pairs.mapInPandas(score, "query bigint, id bigint, score double").where("score >= 1")
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("id"))).where(F.col("rank") <= k)
    return best.withColumn("n", F.count("*").over(W.partitionBy("query"))).where(F.col("n") == k).drop("n")


def nearest(queries: DataFrame, index: DataFrame, k: int, id: str = "id", vector: str = "vector") -> DataFrame:
    """(query, id, score, rank): the k rows of ``index`` most similar to each query, ties by id.

    Where there are many pairs, queries that have k rows in their own direction
    are answered with these, since nothing scores more; the others and all of
    few are exhaustive: blocks of queries, broadcast in rounds of bounded size, meet
    blocks of rows, each pair is one matrix product that keeps k rows a query,
    and the best of those are kept.  Ids are
    integers; rows with a null vector or of another length than the query are
    left out, vectors of length 0 score 0; for k of 0 or less nothing comes out.
    """
    q = queries.where(F.col(vector).isNotNull() & F.col(id).isNotNull())
    x = index.where(F.col(vector).isNotNull() & F.col(id).isNotNull())
    schema = "query bigint, id bigint, score double"
    if k <= 0:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    n_q, n_x = q.count(), x.count()
    if n_q * n_x > FEW_PAIRS:
        settled = written(_same_direction(q, x, k, id, vector), "settled")
        q = q.join(settled.select(F.col("query").alias(id)).distinct(), id, "left_anti")
        n_q = q.count()
        return settled if not n_q else settled.unionByName(_compared(q, x, n_q, n_x, k, id, vector))
    return _compared(q, x, n_q, n_x, k, id, vector)


def _compared(q: DataFrame, x: DataFrame, n_q: int, n_x: int, k: int, id: str, vector: str) -> DataFrame:
    """Every query with every row."""
    schema = "query bigint, id bigint, score double"
    asked, held = _blocks(q, id, vector, n_q).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q")), written(_blocks(x, id, vector, n_x), "vectors")
    widest = q.agg(F.max(F.size(vector))).first()[0] or 0
    if n_q * (widest + 1) * 8 <= MOST_BROADCAST:  # the queries go to the blocks, which stay where they are
        pairs = held.crossJoin(F.broadcast(asked))
    else:  # a round of queries after the other meets the blocks: each round's are broadcast, the blocks are read again
        asked = written(asked.withColumn("round", F.pmod(F.monotonically_increasing_id(), F.lit(-(-n_q * (widest + 1) * 8 // MOST_BROADCAST)))), "queries")
        rounds = -(-n_q * (widest + 1) * 8 // MOST_BROADCAST)
        pairs = reduce(DataFrame.unionByName, (held.crossJoin(F.broadcast(asked.where(F.col("round") == r).drop("round"))) for r in range(rounds)))
    pairs = pairs.select("q_ids", "q", "ids", "vectors")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def by_length(ids: np.ndarray, rows: np.ndarray) -> dict[int, tuple]:
            lengths = np.array([len(r) for r in rows])
            return {n: (ids[lengths == n], _units([r for r, m in zip(rows, lengths, strict=True) if m == n])) for n in set(lengths.tolist())}

        for batch in batches:
            for r in batch.itertuples(index=False):
                mine, theirs = by_length(np.asarray(r.q_ids), r.q), by_length(np.asarray(r.ids), r.vectors)
                for n in mine.keys() & theirs.keys():
                    (q_ids, a), (ids, b) = mine[n], theirs[n]
                    s = np.round(a @ b.T, 12)
                    order = np.argsort(ids, kind="stable")
                    best = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, :k]]
                    yield pd.DataFrame({"query": np.repeat(q_ids, best.shape[1]), "id": ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})

    found = pairs.mapInPandas(score, schema)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class EmbeddingBackend(Protocol):
    """What turns texts into vectors."""

    dimensions: int
    label: str

    def embed_batch(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedding:
    """Vectors in [-1, 1] from an extendable hash of the text: equal texts get equal vectors, and nothing else is meant."""

    label = "hash"

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        raw = [np.frombuffer(hashlib.shake_256(t.encode("utf-8", "surrogatepass")).digest(4 * self.dimensions), "<u4") for t in texts]
        return (np.array(raw, np.float64) / (2**31) - 1).astype(np.float32).reshape(len(texts), self.dimensions)


def embedded(df: DataFrame, text: str, backend: EmbeddingBackend, to: str = "vector") -> DataFrame:
    """``df`` with the vector of a text; a null text has none."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        out = np.full(len(texts), None, object)
        held = texts.notna().to_numpy()
        if held.any():
            for i, v in zip(np.flatnonzero(held), backend.embed_batch(texts[held].tolist()), strict=True):
                out[i] = v
        return pd.Series(out, dtype=object)

    return df.withColumn(to, embed(text))


def node_text() -> Column:
    """What a node is embedded by: its name if that is text, else the end of its iri, else its id."""
    name = F.element_at("properties", F.lit("name"))
    return F.coalesce(F.when(name["t"] == "string", name["s"]), F.when(F.col("iri").isNotNull(), local_name(F.col("iri"))), F.col("id"))


def ingest(graph: Ontology, backend: EmbeddingBackend) -> DataFrame:
    """(key, text, vector) of every node; the key is its iri, else its id."""
    return embedded(graph.nodes.select(F.coalesce("iri", "id").alias("key"), node_text().alias("text")), "text", backend)


def propose(surfaces: DataFrame, index: DataFrame, backend: EmbeddingBackend, k: int) -> DataFrame:
    """(surface, key, score, rank): the k nodes most similar to each distinct surface; ``index`` as ``ingest`` gives, keys may repeat."""
    given = embedded(surfaces.select("surface").where("surface is not null").distinct(), "surface", backend).withColumn("id", F.xxhash64("surface"))
    rows = index.withColumn("id", F.xxhash64("key", "text"))
    best = nearest(given, rows, k)
    names = rows.select("id", "key").distinct()
    return best.join(names, "id").join(given.select(F.col("id").alias("query"), "surface"), "query").select("surface", "key", "score", "rank")
