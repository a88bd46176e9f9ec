"""Processing only new or changed records: the target is the state.

Every output row carries the key and version of the source row it was made
from.  What is still to do is the source anti-joined with the newest published
target; what a run has made becomes visible with one manifest.  A run that
fails before that leaves nothing behind that counts, and a run repeated after it
finds nothing to do: no record is skipped and none taken twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import stripped
from graphloom.operators.journal import END, token_number
from graphloom.session import scratch
from graphloom.sources.manifest import CommitConflict, ManifestLog, due


class TargetState:
    """A target table that knows by its own rows what it has been made from.

    ``keys`` are the columns of source key and version.  Rows with a null in any
    of them cannot be told from others and are no records: ``pending`` leaves
    them out.  Repeated source rows come out as often as they stand there;
    other columns pass through whatever their names.

    What is published must say which version it was computed on; if another
    writer has published since, it is refused, so no record is taken twice.
    ``run`` does the whole round and computes anew in that case.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...], merge_at: int = 16):
        self.spark, self.keys, self.log, self.merge_at = spark, keys, ManifestLog(spark, root), merge_at

    def version(self) -> int:
        """The newest published version; 0 before the first."""
        return self.log.latest()[0]

    def _read(self, parts: list) -> DataFrame | None:
        return self.spark.read.parquet(*(f"{self.log.root}/{p}" for p, _ in parts)) if parts else None

    def current(self, version: int | None = None) -> DataFrame | None:
        """A published target, by default the newest; None before the first."""
        manifest = self.log.latest()[1] if version is None else self.log.read(version) if version else {}
        return self._read(manifest.get("parts", []))

    def pending(self, source: DataFrame, version: int | None = None) -> DataFrame:
        """Rows of ``source`` whose key and version no row of that target has."""
        source = source.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in self.keys)))
        target = self.current(version)
        return source if target is None else source.join(target.select(*self.keys), list(self.keys), "left_anti")

    def publish(self, rows: DataFrame, after: int) -> int:
        """Write ``rows`` and make them part of the target, all or none of them; returns the new version.

        ``after`` is the version the rows were computed on; CommitConflict if it
        is not the newest any more.
        """
        version, manifest = self.log.latest()
        if version != after:
            raise CommitConflict(f"{self.log.root} has version {version}, not {after}")
        parts = [*manifest.get("parts", []), [self._write(rows), 0]]
        n, level = due([p[1] for p in parts], self.merge_at)
        if n > 1:
            parts = [*parts[:-n], [self._write(self._read(parts[-n:])), level]]
        return self.log.publish(after + 1, {"parts": parts})

    def _write(self, rows: DataFrame) -> str:
        part = scratch(self.spark, "part").rpartition("/")[2]
        rows.write.parquet(f"{self.log.root}/{part}")
        return part

    def run(self, source: DataFrame, make: Callable[[DataFrame], DataFrame], attempts: int = 20) -> int:
        """Publish what ``make`` makes of the pending rows of ``source``; returns the version that holds them.

        ``make`` must keep the columns of key and version.  Nothing is published
        where nothing is pending.
        """
        for _ in range(attempts):
            at = self.version()
            rows = make(self.pending(source, at))
            if rows.isEmpty():
                return at
            try:
                return self.publish(rows, at)
            except CommitConflict:
                continue
        raise CommitConflict(f"{self.log.root}: {attempts} attempts")


def successful_ranges(batches: DataFrame) -> DataFrame:
    """(source, since_version, since_number, cursor_version, cursor_number, read_at) of every successful batch.

    A batch is successful if its record with the greatest recorded_at says
    committed; of several at one time the one with the greatest fields counts.
    Batches without id, source, cursor or read_at take nothing; a null
    since_version means from the beginning.
    """
    last = F.max(F.struct("recorded_at", F.lower(stripped(F.col("status"))).alias("status"), "source", "since_version", "since_token", "cursor_version", "cursor_token", "read_at"))
    position = lambda c: F.coalesce(token_number(F.col(f"{c}_token")), F.lit(END)).alias(f"{c}_number")
    return (
        batches.where("batch_id is not null")
        .groupBy("batch_id")
        .agg(last.alias("last"))
        .select("last.*")
        .where("status = 'committed' and source is not null and cursor_version is not null and read_at is not null")
        .select("source", F.coalesce("since_version", F.lit(-END)).alias("since_version"), position("since"), "cursor_version", position("cursor"), "read_at")
        .distinct()
    )


def taken(events: DataFrame, ranges: DataFrame, block_bits: int = 8) -> DataFrame:
    """The events that lie in a range of their source and had arrived when it was read.

    Versions are cut into blocks of 2**block_bits.  A range meets its first and
    last block as a pair of positions to compare; the blocks between them it
    covers whole, as at most two dyadic nodes a level.  So the join runs on
    (source, block), a source with a third of all rows is spread over its
    blocks, and ranges over millions of versions cost a few rows each.
    """
    block = lambda c: F.shiftright(F.col(c), block_bits)
    events = events.withColumn("block", block("version"))
    ends = events.groupBy("source").agg(F.min("block").alias("least"), F.max("block").alias("most"))
    cut = (
        ranges.join(ends, "source")
        .withColumn("first", F.greatest(block("since_version"), F.col("least") - 1))
        .withColumn("last", F.least(block("cursor_version"), F.col("most") + 1))
        .where("first <= last and (since_version < cursor_version or since_version = cursor_version and since_number < cursor_number)")
    )
    bounds = ["since_version", "since_number", "cursor_version", "cursor_number", "read_at"]
    edges = cut.select("source", F.explode(F.array_distinct(F.array("first", "last"))).alias("block"), *bounds)
    whole = cut.where("last - first > 1").select("source", "read_at", (F.col("first") + 1).alias("a"), F.col("last").alias("b"))
    widest = whole.agg(F.max(F.col("b") - F.col("a"))).first()[0] or 0
    levels = F.sequence(F.lit(0), F.lit(int(widest).bit_length()))
    nodes = whole.select("source", "read_at", "a", "b", F.explode(levels).alias("level")).select(
        "source", "read_at", "level", F.expr("-shiftright(-a, level)").alias("lo"), F.expr("shiftright(b, level)").alias("hi")
    )
    odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    nodes = nodes.where("lo < hi").select("source", "level", "read_at", F.explode(F.array_compact(F.array(F.when(odd("lo"), F.col("lo")), F.when(odd("hi"), F.col("hi") - 1)))).alias("node"))
    nodes = nodes.groupBy("source", "level", "node").agg(F.max("read_at").alias("read_at"))
    held = events.select("source", "block").distinct().withColumn("level", F.explode(levels)).withColumn("node", F.expr("shiftright(block, level)"))
    covered = (
        held.join(nodes, ["source", "level", "node"])
        .groupBy("source", "block")
        .agg(F.max("read_at").alias("read_at"))
        .select("source", "block", F.lit(-END).alias("since_version"), F.lit(0).cast("bigint").alias("since_number"), F.lit(END).alias("cursor_version"), F.lit(END).alias("cursor_number"), "read_at")
    )
    reach = edges.groupBy("source", "block", *bounds[:4]).agg(F.max("read_at").alias("read_at")).unionByName(covered)
    e, r = events.alias("e"), reach.alias("r")
    after = "(e.version > r.since_version or e.version = r.since_version and e.number > r.since_number)"
    upto = "(e.version < r.cursor_version or e.version = r.cursor_version and e.number <= r.cursor_number)"
    return e.join(r, F.expr(f"e.source = r.source and e.block = r.block and {after} and {upto} and e.arrived_at <= r.read_at"), "left_semi").drop("block")
