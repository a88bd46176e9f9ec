"""Keeping graphs: checkpointers, a store that commits to one, and the snapshot wire form."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import base64_text
from graphloom.model import SCHEMAS, Ontology, empty
from graphloom.operators.provenance import SCHEMAS as LEDGER
from graphloom.operators.provenance import Activity
from graphloom.operators.store import Delta, apply_delta, upsert
from graphloom.session import cut, scratch
from graphloom.sources.manifest import ManifestLog


class Checkpointer(Protocol):
    """Where snapshots go, each with the activities that led to it; load gives None before the first save."""

    version: int

    def save(self, graph: Ontology, activities: DataFrame | None = None) -> int: ...

    def load(self) -> Ontology | None: ...

    def activities(self) -> DataFrame | None: ...


class MemoryCheckpointer:
    """One slot, the last save wins; the rows are fixed when they are saved, whatever becomes of what they were made from."""

    def __init__(self) -> None:
        self._graph: Ontology | None = None
        self._ledger: DataFrame | None = None
        self.version = 0

    def save(self, graph: Ontology, activities: DataFrame | None = None) -> int:
        self._graph = graph.with_(**{name: cut(getattr(graph, name)) for name in Ontology.PARTS})
        self._ledger = cut(activities) if activities is not None else self._ledger
        self.version += 1
        return self.version

    def load(self) -> Ontology | None:
        return self._graph

    def activities(self) -> DataFrame | None:
        return self._ledger


class FolderCheckpointer:
    """Versions of a graph as parquet under ``root``; a version exists when its manifest does.

    ``load`` gives the newest version, or the one asked for.  ``keep`` versions
    stay, 0 for all.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 0):
        self.spark, self.log, self.keep = spark, ManifestLog(spark, root), keep

    @property
    def version(self) -> int:
        """The newest version; 0 before the first."""
        return self.log.latest()[0]

    def save(self, graph: Ontology, activities: DataFrame | None = None) -> int:
        part = scratch(self.spark, "snapshot").rpartition("/")[2]
        if activities is not None:
            activities.write.parquet(f"{self.log.root}/{part}/activities")
        for name in Ontology.PARTS:
            rows = getattr(graph, name)
            if name == "nodes":
                rows = rows.sortWithinPartitions("id")
            writer = rows.write.partitionBy("label") if name == "edges" else rows.write
            writer.parquet(f"{self.log.root}/{part}/{name}")
        manifest = {"part": part, "vocabulary": graph.vocabulary, "iri": graph.iri, "activities": activities is not None}
        out = self.log.update(lambda version, _: manifest)[0]
        if self.keep:
            fs = self.log._fs()
            for old in self.log.versions()[: -self.keep]:
                fs.delete(self.log._path(self.log.read(old)["part"]), True)
                fs.delete(self.log._path("_manifests", f"{old:012d}.json"), False)
        return out

    def load(self, version: int | None = None) -> Ontology | None:
        found = self.log.versions()
        if not found:
            return None
        manifest = self.log.read(found[-1] if version is None else version)
        parts = {}
        for name, schema in SCHEMAS.items():
            rows = self.spark.read.schema(schema).parquet(f"{self.log.root}/{manifest['part']}/{name}")
            parts[name] = rows.select(*schema.names)
        return Ontology(**parts, vocabulary=manifest["vocabulary"], iri=manifest["iri"])

    def activities(self) -> DataFrame | None:
        """The activities saved with the newest version."""
        manifest = self.log.latest()[1]
        return self.spark.read.schema(LEDGER["activities"]).parquet(f"{self.log.root}/{manifest['part']}/activities") if manifest.get("activities") else None


class PersistentStore:
    """A graph that saves itself after every commit, with the activities of all commits; bare upserts wait for ``snapshot_now``.

    Opened over what a checkpointer has, it goes on at its version with its
    graph and activities.
    """

    def __init__(self, spark: SparkSession, checkpointer: Checkpointer):
        self.checkpointer = checkpointer
        self.graph = checkpointer.load() or empty(spark)
        self.version = checkpointer.version
        self.ledger = checkpointer.activities()
        if self.ledger is None:
            self.ledger = spark.createDataFrame([], LEDGER["activities"])

    def upsert(self, delta: Delta) -> None:
        self.graph = apply_delta(self.graph, delta)

    def snapshot_now(self) -> int:
        self.version = self.checkpointer.save(self.graph, self.ledger)
        self.graph, self.ledger = self.checkpointer.load(), self.checkpointer.activities()
        return self.version

    def commit_with_provenance(self, delta: Delta, activity: Activity) -> str:
        spark = self.graph.spark
        self.graph = apply_delta(self.graph, delta, activity.id)
        self.ledger = upsert(self.ledger, spark.createDataFrame([activity.row()], LEDGER["activities"]))
        self.snapshot_now()
        return activity.id


def wire(df: DataFrame) -> DataFrame:
    """(json): nodes or edges as JSON objects, properties tagged with type and value."""
    none = f"map<string,{df.schema['properties'].dataType.valueType.simpleString()}>"

    def value(v):
        plain = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
        text = F.when(v["t"] == "json", v["s"]).when(v["t"].isin("string", "iri"), plain(v["s"])).when(v["t"] == "integer", v["i"].cast("string")).when(v["t"] == "float", plain(v["f"])).when(v["t"] == "bool", v["b"].cast("string"))
        text = text.when(v["t"] == "date_time", plain(F.date_format(v["ts"], "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))).when(v["t"] == "bytes", plain(base64_text(v["bin"])))
        return F.concat(F.lit('{"type":"'), v["t"], F.lit('"'), F.coalesce(F.concat(F.lit(',"value":'), text), F.lit("")), F.lit("}"))

    properties = F.coalesce("properties", F.create_map().cast(none))
    key = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    keys = F.array_sort(F.map_keys(properties))
    entries = F.transform(keys, lambda k: F.concat(key(k), F.lit(":"), value(F.element_at(properties, k))))
    rest = [c for c in df.columns if c != "properties"]
    head = F.regexp_replace(F.to_json(F.struct(*rest)), r"\}$", "")
    return df.select(F.concat(head, F.lit(',"properties":{'), F.concat_ws(",", entries), F.lit("}}")).alias("json"))


def unwire(spark: SparkSession, lines: DataFrame, schema: object) -> DataFrame:
    """Nodes or edges of their JSON objects; times are RFC 3339, bytes base64."""
    names = [f.name for f in schema if f.name != "properties"]
    plain = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema if f.name != "properties")
    read = lines.select(F.from_json("json", f"struct<{plain}, properties: map<string, string>>").alias("x")).select(*(f"x.{n}" for n in names), F.col("x.properties").alias("p"))
    tagged = F.transform_values("p", lambda k, t: F.from_json(t, "struct<type: string, value: string>"))
    t, x = (lambda e: e["type"]), (lambda e: e["value"])
    kinds = {f.name: f.dataType.simpleString() for f in schema["properties"].dataType.valueType}
    slots = lambda e: {
        "t": t(e),
        "s": F.when(t(e).isin("string", "iri", "json"), x(e)),
        "i": F.when(t(e) == "integer", x(e).try_cast("bigint")),
        "f": F.when(t(e) == "float", x(e).try_cast("double")),
        "b": F.when(t(e) == "bool", x(e) == "true"),
        "ts": F.when(t(e) == "date_time", F.try_to_timestamp(x(e))),
        "bin": F.when(t(e) == "bytes", F.unbase64(x(e))),
    }
    made = F.transform_values(tagged, lambda k, e: F.struct(*(c.cast(kinds[n]).alias(n) for n, c in slots(e).items())))
    return read.select(*names, made.alias("properties")).select(*schema.names)

