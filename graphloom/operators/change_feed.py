"""Applying a stream of inserts, updates and deletes: bucketed copy-on-write.

The table lies in buckets of its key's hash.  A set of changes is reduced per
key where it is read, routed to the buckets of its keys, and sort-merged only
with those buckets; they are written anew beside the old ones, and one manifest
then says which files make up the table.  Readers of the old version are not
disturbed, a writer that fails leaves the old version as it was, and of two
writers the slower one merges anew.  A bucket is the first bits of the hash; it
is split by further bits when it is touched after the table has grown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.journal import deliveries, plain_kind
from graphloom.session import scratch, written
from graphloom.sources.manifest import ManifestLog

MARKS = ("created", "changed", "ended")
RECORD = "struct<version: bigint, at: timestamp, payload: string>"
LEAST_BITS = 4


def marks(journal: DataFrame) -> DataFrame:
    """(actor, created, changed, ended): for each kind of change the record of the greatest version at which it hit the actor.

    A record is (version, at, payload); of several deliveries of one event the
    greatest time and payload count.  These three say all that the order of
    changes can: the greatest is the same however often and in whatever order
    the changes came, and it combines before the shuffle, so an actor with a
    third of all rows is one row per task.  Kinds that change nothing, null
    kinds and rows without actor or version leave no mark.
    """
    has = set(journal.columns)
    held = F.struct("version", *((F.col(c) if c in has else F.lit(None)).cast(t).alias(n) for c, t, n in (("event_at", "timestamp", "at"), ("payload", "string", "payload"))))
    at = lambda k: F.max(F.when(F.col("what") == k, F.col("record")))
    return (
        deliveries(journal)
        .select("actor", held.alias("record"), plain_kind(F.col("kind")).alias("what"))
        .where(F.col("what").isin("created", "statechanged", "terminated"))
        .groupBy("actor")
        .agg(at("created").alias("created"), at("statechanged").alias("changed"), at("terminated").alias("ended"))
    )


class ChangeFeedTable:
    """The state per actor under ``root``, in buckets of some ``per_bucket`` rows.

    Ended actors stay as rows, so that a late change older than their end is
    known to be old.  Applying the same changes twice, or older ones later,
    gives the same table.
    """

    def __init__(self, spark: SparkSession, root: str, per_bucket: int = 1 << 18):
        self.spark, self.log, self.per_bucket = spark, ManifestLog(spark, root), per_bucket

    def _rows(self, parts: list[str]) -> DataFrame:
        schema = "actor string, " + ", ".join(f"{m} {RECORD}" for m in MARKS)
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.log.root}/{p}" for p in parts))

    def apply(self, changes: DataFrame) -> int:
        """Merge ``changes`` (the columns of ``marks``) into the buckets they touch; returns the new version."""
        changes = written(changes.select("actor", *MARKS).withColumn("hash", F.xxhash64("actor")), "changes")
        n = changes.count()  # of the files' footers
        touched: dict[int, set[int]] = {}

        def change(version: int, manifest: dict) -> dict:
            files: dict[str, list] = manifest.get("files", {})  # "bits:prefix" to [part, rows]
            rows = n + sum(r for _, r in files.values())
            bits = max([LEAST_BITS, (rows // self.per_bucket).bit_length(), *(int(b.partition(":")[0]) for b in files)])
            bucket = F.shiftrightunsigned("hash", 64 - bits)
            if bits not in touched:
                touched[bits] = {r[0] for r in changes.select(bucket).distinct().collect()}  # at most a number per bucket
            hit = []
            for name in files:
                b, p = map(int, name.split(":"))
                if any(t >> (bits - b) == p for t in touched[bits]) if b < bits else p in touched[bits]:
                    hit.append(name)
            routed = changes.withColumn("bucket", bucket)
            if hit:
                old = self._rows([files[name][0] for name in hit]).withColumn("hash", F.xxhash64("actor")).withColumn("bucket", bucket)
                routed = routed.unionByName(old)
            merged = routed.repartition(F.col("bucket")).groupBy("bucket", "actor").agg(*(F.max(m).alias(m) for m in MARKS))
            part = scratch(self.spark, "v").rpartition("/")[2]
            merged.select("actor", *MARKS, "bucket").sortWithinPartitions("bucket", "actor").write.partitionBy("bucket").parquet(f"{self.log.root}/{part}")
            counted = self.spark.read.parquet(f"{self.log.root}/{part}").groupBy("bucket").count().collect() if n else []  # a row per bucket written
            now = {k: v for k, v in files.items() if k not in hit} | {f"{bits}:{r['bucket']}": [f"{part}/bucket={r['bucket']}", r["count"]] for r in counted}
            return {"files": now}

        return self.log.update(change)[0]

    def state(self) -> DataFrame:
        """All rows (actor, created, changed, ended) of the newest version, ended actors among them."""
        return self._rows(sorted(p for p, _ in self.log.latest()[1].get("files", {}).values()))

    def alive(self) -> DataFrame:
        """(actor, version, at, payload): actors created after their last end, with the record of the last change applied."""
        kept = self.state().where("created is not null and created.version > coalesce(ended.version, created.version - 1)")
        return kept.select("actor", F.greatest("created", "changed").alias("last")).select("actor", "last.*")
