"""A graph as a log of deltas: a commit writes what changed and publishes one manifest.

Every row carries the version of its commit; reading takes of each id the row
of the latest one.  Parts of one level are merged when there are many, so a
graph is read from few files whatever the number of its commits.  The activity
that made a commit lies in the same manifest, so graph and ledger never differ.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.model import SCHEMAS, Ontology, empty
from graphloom.operators.provenance import SCHEMAS as LEDGER
from graphloom.operators.provenance import Activity
from graphloom.operators.store import Delta, last_wins
from graphloom.session import scratch
from graphloom.sources.manifest import CommitConflict, ManifestLog, due

PARTS = ("nodes", "edges", "axioms")


class DeltaStore:
    """The graph under ``root``; an activity that has been committed is not committed again, whenever it is repeated.

    The ids of the last ``REMEMBERED`` activities stand in the manifest, those
    of older ones in files that it names.
    """

    REMEMBERED = 1000

    def __init__(self, spark: SparkSession, root: str, schema: Ontology | None = None, merge_at: int = 8):
        self.spark, self.log, self.merge_at = spark, ManifestLog(spark, root), merge_at
        self.schema = schema or empty(spark)

    def state(self) -> tuple[int, dict]:
        """The newest version and its manifest."""
        return self.log.latest()

    def is_done(self, manifest: dict, activity_id: str) -> bool:
        """Whether a manifest holds the activity."""
        if activity_id in manifest.get("done", []):
            return True
        old = manifest.get("done_parts", [])
        return bool(old) and not self._ids(old).where(F.col("id") == activity_id).isEmpty()

    def _ids(self, parts: list) -> DataFrame:
        return self.spark.read.schema("id string").parquet(*(f"{self.log.root}/{p}" for p, _ in parts))

    def _with_done(self, manifest: dict, activity_id: str) -> dict:
        done, parts = [*manifest.get("done", []), activity_id], manifest.get("done_parts", [])
        if len(done) > self.REMEMBERED:
            part = self._written("done", self.spark.createDataFrame([(x,) for x in done], "id string").coalesce(1))
            done, parts = [], [*parts, [part, 0]]
            n, level = due([p[1] for p in parts], self.merge_at)
            if n > 1:
                parts = [*parts[:-n], [self._written("done", self._ids(parts[-n:]).coalesce(1)), level]]
        return {"done": done, "done_parts": parts}

    def _written(self, name: str, rows: DataFrame) -> str:
        part = scratch(self.spark, name).rpartition("/")[2]
        rows.write.parquet(f"{self.log.root}/{part}")
        return part

    def commit(self, delta: Delta, activity: str | Activity, after: int | None = None, also: Callable[[dict], dict[str, Any]] | None = None) -> int:
        """Write a delta as one version; nothing happens if the activity has been committed.

        With ``after`` the delta holds only for that version of the graph, and
        CommitConflict is raised if another is the newest.  What ``also`` makes
        of the manifest is published with the commit.
        """
        id = activity if isinstance(activity, str) else activity.id
        made: dict[str, str] = {}

        def change(version: int, manifest: dict) -> dict | None:
            if self.is_done(manifest, id):
                return None
            if after is not None and version != after:
                raise CommitConflict(f"{self.log.root} has version {version}, not {after}")
            parts = {name: list(p) for name, p in manifest.get("parts", {}).items()}
            for name in PARTS:
                rows = getattr(delta, name)
                if rows is not None:
                    if name == "axioms":
                        rows = rows.withColumn("provenance", F.coalesce("provenance", F.lit(id)))
                    rows = last_wins(rows, "id", None).select(*SCHEMAS[name].names)
                    # written anew where another writer was faster: the rows carry their version
                    parts.setdefault(name, []).append([self._written(name, rows.withColumn("_version", F.lit(version + 1).cast("bigint"))), 0])
            if not isinstance(activity, str):
                if "activities" not in made:
                    made["activities"] = self._written("activities", self.spark.createDataFrame([activity.row()], LEDGER["activities"]).coalesce(1))
                parts.setdefault("activities", []).append([made["activities"], 0])
            return manifest | {"parts": {name: self._merged(name, p) for name, p in parts.items()}} | self._with_done(manifest, id) | (also(manifest) if also else {})

        return self.log.update(change)[0]

    def _merged(self, name: str, parts: list) -> list:
        n, level = due([p[1] for p in parts], self.merge_at)
        return [*parts[:-n], [self._written(name, self._rows(name, parts[-n:])), level]] if n > 1 else parts

    def _rows(self, name: str, parts: list) -> DataFrame:
        """The rows of some parts, of each id the latest; with their version, if the table has one."""
        ledger = name in LEDGER
        schema = LEDGER[name] if ledger else T.StructType([*SCHEMAS[name].fields, T.StructField("_version", T.LongType())])
        read = self.spark.read.schema(schema).parquet(*(f"{self.log.root}/{p[0]}" for p in parts))
        if ledger or len(parts) == 1:
            return read
        kept = F.max_by(F.struct(*(c for c in read.columns if c != "id")), "_version").alias("x")
        return read.groupBy("id").agg(kept).select("id", "x.*").select(*read.columns)

    def _table(self, name: str, parts: list) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self._rows(name, parts).drop("_version")

    def graph(self, version: int | None = None) -> Ontology:
        """A version of the graph, by default the newest."""
        manifest = self.log.latest()[1] if version is None else self.log.read(version) if version else {}
        parts = manifest.get("parts", {})
        return self.schema.with_(**{name: self._table(name, parts.get(name, [])) for name in PARTS})

    def activities(self) -> DataFrame:
        """The activities that commits were made under, where the commit was given one."""
        parts = self.log.latest()[1].get("parts", {}).get("activities", [])
        return self._rows("activities", parts) if parts else self.spark.createDataFrame([], LEDGER["activities"])

    def compact(self) -> int:
        """Write each table of the newest version as one part; older files stay for those who read them."""

        def change(version: int, manifest: dict) -> dict | None:
            parts = manifest.get("parts", {})
            if all(len(p) < 2 for p in parts.values()):
                return None
            return manifest | {"parts": {name: p if len(p) < 2 else [[self._written(name, self._rows(name, p)), max(x[1] for x in p) + 1]] for name, p in parts.items()}}

        return self.log.update(change)[0]
