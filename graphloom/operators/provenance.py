"""Who made what from what: activities, entities and four relations between them, as append-only tables."""

from __future__ import annotations

import datetime
import json
import uuid
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Ontology
from graphloom.operators.store import Delta, apply_delta
from graphloom.session import scratch
from graphloom.sources.manifest import ManifestLog, due

SCHEMAS = {
    "activities": "id string, label string, agent string, started_at timestamp, ended_at timestamp, attributes map<string,string>",
    "entities": "id string, label string, attributes map<string,string>",
    "generated": "entity string, activity string",
    "derived": "derived string, source string",
    "attributed": "entity string, agent string",
    "used": "activity string, entity string",
}


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC)


@dataclass(frozen=True)
class Activity:
    """Something that was done; attributes are JSON values."""

    label: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex * 2)
    agent: str | None = None
    started_at: datetime.datetime = field(default_factory=_now)
    ended_at: datetime.datetime | None = None
    attributes: tuple[tuple[str, str], ...] = ()

    def by(self, agent: str) -> Activity:
        return replace(self, agent=agent)

    def with_attribute(self, key: str, value: Any) -> Activity:
        return replace(self, attributes=(*((k, v) for k, v in self.attributes if k != key), (key, json.dumps(value))))

    def finish(self) -> Activity:
        return replace(self, ended_at=_now())

    def row(self) -> tuple:
        return (self.id, self.label, self.agent, self.started_at, self.ended_at, dict(self.attributes))


class ProvenanceLog:
    """The ledger under ``root``.

    Records of one ``append`` become visible together.  Of several activities or
    entities with one id the latest counts; the relations keep every record.
    """

    def __init__(self, spark: SparkSession, root: str, merge_at: int = 16):
        self.spark, self.log, self.merge_at = spark, ManifestLog(spark, root), merge_at

    def append(self, **rows: list[tuple] | DataFrame) -> int:
        """Append rows to the named tables; returns the new version."""
        made = {}
        for name, given in rows.items():
            df = given if isinstance(given, DataFrame) else self.spark.createDataFrame(given, SCHEMAS[name])
            made[name] = self._written(name, df)

        def change(version: int, manifest: dict) -> dict:
            parts = {k: list(v) for k, v in manifest.get("parts", {}).items()}
            for name, part in made.items():
                parts.setdefault(name, []).append([part, 0])
                n, level = due([p[1] for p in parts[name]], self.merge_at)
                if n > 1:
                    some = parts[name][-n:]
                    parts[name] = [*parts[name][:-n], [self._written(name, self._rows(name, some).drop("_at")), level]]
            return {"parts": parts}

        return self.log.update(change)[0]

    def _written(self, name: str, df: DataFrame) -> str:
        part = scratch(self.spark, name).rpartition("/")[2]
        df.write.parquet(f"{self.log.root}/{part}")
        return part

    def record(self, activity: Activity) -> str:
        """Append one activity; returns its id."""
        self.append(activities=[activity.row()])
        return activity.id

    def _rows(self, name: str, parts: list) -> DataFrame:
        """The rows of some parts; of activities and entities the latest of each id, with the place of their part as _at."""
        read = self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.log.root}/{p[0]}" for p in parts))
        place = F.create_map(*(F.lit(x) for i, p in enumerate(parts) for x in (p[0], i)))
        read = read.withColumn("_at", F.element_at(place, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)))
        if name not in ("activities", "entities"):
            return read
        return read.groupBy("id").agg(F.max_by(F.struct(*(c for c in read.columns if c != "id")), "_at").alias("x")).select("id", "x.*").select(*read.columns)

    def table(self, name: str) -> DataFrame:
        """A table of the ledger."""
        parts = self.log.latest()[1].get("parts", {}).get(name, [])
        return self._rows(name, parts).drop("_at") if parts else self.spark.createDataFrame([], SCHEMAS[name])


def commit_with_provenance(graph: Ontology, delta: Delta, activity: Activity, log: ProvenanceLog) -> tuple[Ontology, str]:
    """The graph with the delta, and the id of the activity, now in the ledger."""
    changed = apply_delta(graph, delta, activity.id)
    return changed, log.record(activity)
