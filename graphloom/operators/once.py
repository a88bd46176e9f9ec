"""Messages delivered more than once: an index of identifiers in sorted runs.

An identifier belongs to a hash prefix: the first bits of its hash.  A run holds,
per prefix, the sorted array of the identifiers' hashes with the identifiers
beside them, and never changes once written; the more identifiers a run has, the
more bits its prefixes have.  Of a batch each task keeps one delivery per
identifier, the deliveries are routed by prefix, and each prefix is looked up by
binary search in all runs.  What is new becomes the next run; runs of one level
are merged when there are many.

A batch is taken in with one manifest, which names the new run and the answer
given to the batch.  A batch that comes again gets the same answer again, and of
two writers the slower one asks anew, so no message is lost and none taken twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import scratch
from graphloom.sources.manifest import ManifestLog, due

RUN = "prefix bigint, hashes array<bigint>, ids array<string>"
LEAST_BITS = 6
MOST_BITS = 40


def identifier(*parts: str | Column) -> Column:
    """One string for several columns, different for different values; null if any of them is."""
    texts = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(*(F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts))


def _found(hashes: np.ndarray, ids: np.ndarray, want_hash: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Which of ``want`` stand in the sorted run; equal hashes are told apart by the identifier itself."""
    at = np.searchsorted(hashes, want_hash, side="left")
    hit = np.zeros(len(want), bool)
    open_ = np.flatnonzero(at < len(hashes))
    while len(open_):
        open_ = open_[hashes[at[open_]] == want_hash[open_]]
        same = ids[at[open_]] == want[open_]
        hit[open_[same]] = True
        open_ = open_[~same]
        at[open_] += 1
        open_ = open_[at[open_] < len(hashes)]
    return hit


def _firsts(rows: pa.Table, order: list[str]) -> pa.Table:
    """Of each id the row that is first by ``order`` (nulls before all else), with the copies of all its rows."""
    if not len(rows):
        return rows
    keys = [(c, "ascending") for c in ("id", *order)]
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
    ids = rows["id"].combine_chunks()
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.chunk(0) if ids.num_chunks == 1 else pa.concat_arrays(ids.chunks)
    starts = np.flatnonzero(np.append(True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)))
    copies = np.add.reduceat(rows["copies"].to_numpy(), starts)
    return rows.take(starts).set_column(rows.column_names.index("copies"), "copies", pa.array(copies, pa.int64()))


def _split(to: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Arrays of a run cut to prefixes of ``to`` bits."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for hashes, ids in zip(batch["hashes"], batch["ids"], strict=True):
                hashes = np.asarray(hashes, "int64")
                prefix = (hashes.view("uint64") >> np.uint64(64 - to)).astype("int64")
                cuts = [0, *(np.flatnonzero(np.diff(prefix)) + 1).tolist(), len(hashes)]
                out += [(int(prefix[a]), hashes[a:b], ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
            yield pd.DataFrame(out, columns=["prefix", "hashes", "ids"])

    return rows


class OnceIndex:
    """Which identifiers have been delivered, under ``root``.

    ``per_array`` is how many identifiers stand under one prefix of a run, on
    average; a run of more identifiers has more prefixes, and a lookup splits
    arrays of older runs, so no task grows with the index.  ``merge_at`` runs of
    one level become one of the next.  Null identifiers name nothing and are
    left out everywhere.
    """

    def __init__(self, spark: SparkSession, root: str, merge_at: int = 8, per_array: int = 20_000):
        self.spark, self.log, self.merge_at, self.per_array = spark, ManifestLog(spark, root), merge_at, per_array

    def bits(self, rows: int) -> int:
        """Bits of the prefixes of a run or batch of so many identifiers."""
        return min(MOST_BITS, max(LEAST_BITS, (max(1, rows) // self.per_array).bit_length()))

    def _hashed(self, ids: DataFrame, bits: int) -> DataFrame:
        return ids.withColumn("hash", F.xxhash64("id")).withColumn("prefix", F.shiftrightunsigned("hash", 64 - bits))

    def _run(self, parts: list, bits: int) -> DataFrame:
        """The arrays of several runs under prefixes of one length, which no run exceeds."""
        read = lambda some: self.spark.read.schema(RUN).parquet(*(f"{self.log.root}/{p[0]}" for p in some))
        as_is, coarse = [p for p in parts if p[1] == bits], [p for p in parts if p[1] < bits]
        out = read(as_is) if as_is else self.spark.createDataFrame([], RUN)
        return out.unionByName(read(coarse).mapInPandas(_split(bits), RUN)) if coarse else out

    def _write_run(self, ids: DataFrame, rows: int, level: int) -> list:
        """[part, bits, level, rows] of a new run of the distinct ``ids``."""
        part, bits = scratch(self.spark, "run").rpartition("/")[2], self.bits(rows)
        arrays = self._hashed(ids, bits).groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("hash", "id"))).alias("s"))
        arrays.select("prefix", F.col("s.hash").alias("hashes"), F.col("s.id").alias("ids")).write.parquet(f"{self.log.root}/{part}")
        return [part, bits, level, rows]

    def extended(self, parts: list, ids: DataFrame, rows: int) -> list:
        """The runs with one more, of ``rows`` distinct identifiers none of which they hold; merged where that is due.  Nothing is published."""
        parts = [*parts, self._write_run(ids, rows, 0)]
        n, level = due([p[2] for p in parts], self.merge_at)
        if n > 1:
            old = self.spark.read.schema(RUN).parquet(*(f"{self.log.root}/{p[0]}" for p in parts[-n:]))
            parts = [*parts[:-n], self._write_run(old.select(F.explode("ids").alias("id")), sum(p[3] for p in parts[-n:]), level)]
        return parts

    def looked_up(self, parts: list, batch: DataFrame, order: list[str], rows: int) -> DataFrame:
        """One row per distinct non-null ``id`` of ``batch``, with ``copies`` and ``known``: whether the runs hold it.

        Of the deliveries of an id the first by ``order`` is kept, its other
        columns as they are.  Each task keeps one delivery of what it has read
        before anything is shuffled; the shuffle goes by prefix.  ``rows`` says
        about how large the batch is.
        """
        bits = max([self.bits(rows), *(p[1] for p in parts)])
        given = batch.where("id is not null").withColumn("copies", F.lit(1).cast("bigint"))
        given = given.mapInArrow(lambda batches: (b for x in batches for b in _firsts(pa.Table.from_batches([x]), order).to_batches()), given.schema)
        given = self._hashed(given, bits)
        kept = [f for f in given.schema.fields if f.name not in ("hash", "prefix")]
        schema = T.StructType([*kept, T.StructField("known", T.BooleanType())])
        names = [f.name for f in kept]

        def probe(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            left = _firsts(left, order)
            want, want_hash = left["id"].to_numpy(), left["hash"].to_numpy()
            known = np.zeros(len(left), bool)
            for hashes, ids in zip(right["hashes"], right["ids"], strict=True):
                known |= _found(hashes.values.to_numpy(), ids.values.to_numpy(zero_copy_only=False), want_hash, want)
            return left.select(names).append_column("known", pa.array(known))

        if not parts:
            return given.groupBy("prefix").applyInArrow(lambda rows: probe((), rows, pa.table({"hashes": [], "ids": []})), schema)
        return given.groupBy("prefix").cogroup(self._run(parts, bits).groupBy("prefix")).applyInArrow(probe, schema)

    def probe(self, batch: DataFrame, order: list[str] | None = None, rows: int | None = None) -> DataFrame:
        """``looked_up`` in the newest version; of several deliveries without an ``order`` any is kept."""
        rows = batch.count() if rows is None else rows
        return self.looked_up(self.log.latest()[1].get("parts", []), batch, order or [], rows)

    def ingest(self, batch: DataFrame, batch_id: str, order: list[str] | None = None, rows: int | None = None) -> DataFrame:
        """Take in a batch: one row per distinct ``id`` as ``looked_up`` gives, the new ones in the index when this returns.

        ``batch_id`` names the batch; under one id it counts once, and whoever
        repeats it after a failure gets the first answer again.  A batch id
        must not be given to other deliveries.
        """
        rows = batch.count() if rows is None else rows
        answer: list[str] = []

        def change(version: int, manifest: dict) -> dict | None:
            known = manifest.get("answers", {})
            if batch_id in known:
                return None
            parts = manifest.get("parts", [])
            part = scratch(self.spark, "answer").rpartition("/")[2]
            found = self.looked_up(parts, batch, order or [], rows)
            found.write.parquet(f"{self.log.root}/{part}")
            answer[:] = [found.schema]
            new = self.spark.read.schema(found.schema).parquet(f"{self.log.root}/{part}").where("not known").select("id")
            n = new.count()
            return {"parts": self.extended(parts, new, n) if n else parts, "answers": known | {batch_id: part}}

        manifest = self.log.update(change)[1]
        path = f"{self.log.root}/{manifest['answers'][batch_id]}"
        return self.spark.read.schema(answer[0]).parquet(path) if answer else self.spark.read.parquet(path)

    def add(self, ids: DataFrame, batch_id: str) -> DataFrame:
        """Take in identifiers alone."""
        return self.ingest(ids.select("id"), batch_id)
