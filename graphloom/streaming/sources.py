"""Where actor records come from: anything with paths, a journal after a cursor, states of actors and a cursor."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.session import written
from graphloom.sources.persist import Checkpointer

BEGINNING = -1


class ActorSource(Protocol):
    """A store of actor records.

    ``paths``: (path, attributes, and actor where it is known); ``journal``: the
    events of greater versions than ``since``, as the projections take them;
    ``states``: (actor, payload, digest) of the actors in a frame (actor);
    ``cursor``: the greatest version there is, BEGINNING before the first.
    """

    label: str

    def paths(self) -> DataFrame: ...

    def journal(self, since: int) -> DataFrame: ...

    def states(self, actors: DataFrame) -> DataFrame: ...

    def cursor(self) -> int: ...


class TableSource:
    """Frames, or functions that read them anew each time they are asked, as a table that grows needs it."""

    def __init__(self, paths: DataFrame | Callable[[], DataFrame], events: DataFrame | Callable[[], DataFrame], states: DataFrame | Callable[[], DataFrame], label: str = "tables"):
        self._paths, self._events, self._states, self.label = paths, events, states, label

    @staticmethod
    def _now(given: DataFrame | Callable[[], DataFrame]) -> DataFrame:
        return given() if callable(given) and not isinstance(given, DataFrame) else given

    def paths(self) -> DataFrame:
        return self._now(self._paths)

    def journal(self, since: int) -> DataFrame:
        return self._now(self._events).where(F.col("version") > since)

    def states(self, actors: DataFrame) -> DataFrame:
        return self._now(self._states).join(actors.select("actor").distinct(), "actor", "left_semi")

    def cursor(self) -> int:
        last = self._now(self._events).agg(F.max("version")).first()[0]
        return BEGINNING if last is None else last


def numbered(df: DataFrame, order: str, start: int) -> DataFrame:
    """``df`` with ``number``: start + 1, start + 2, ... in order of a column, counted per range of it so that no task sees all rows."""
    placed = written(df.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy("_range").count()
    before = sizes.withColumn("_before", F.coalesce(F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    own = F.row_number().over(W.partitionBy("_range").orderBy(order))
    return placed.join(before.drop("count"), "_range").withColumn("number", F.lit(start) + F.col("_before") + own).drop("_range", "_before")


class SnapshotSource:
    """The nodes of a checkpointer's newest snapshot read as actor records.

    Nodes with a text ``path`` are paths, those with a text ``event_kind``
    events, those with a ``state`` states; the actor is the text ``actor_id``,
    else the node's id.  The cursor is the snapshot's version: if it is not
    after ``since`` nothing is new, else all events are, numbered on from
    ``since`` by their ids.
    """

    counts_snapshots = True  # the cursor is no bound for the versions of events

    def __init__(self, checkpointer: Checkpointer, label: str = "snapshots"):
        self.checkpointer, self.label = checkpointer, label

    def _nodes(self) -> DataFrame | None:
        graph = self.checkpointer.load()
        if graph is None:
            return None
        p = lambda k, t: F.when(F.element_at("properties", F.lit(k))["t"] == t, F.element_at("properties", F.lit(k))["s"])
        text = p("event_payload", "string")
        quoted = F.when(text.isNotNull(), F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", ""))
        actor = F.coalesce(p("actor_id", "string"), F.col("id")).alias("actor")
        return graph.nodes.select("id", actor, p("path", "string").alias("path"), p("event_kind", "string").alias("kind"), F.coalesce(p("event_payload", "json"), quoted).alias("payload"), p("state", "json").alias("state"))

    def _empty(self, schema: str) -> DataFrame:
        from pyspark.sql import SparkSession

        return SparkSession.getActiveSession().createDataFrame([], schema)

    def paths(self) -> DataFrame:
        nodes = self._nodes()
        if nodes is None:
            return self._empty("path string, actor string, attributes map<string,string>")
        return nodes.where("path is not null").select("path", "actor", F.create_map().cast("map<string,string>").alias("attributes"))

    def journal(self, since: int) -> DataFrame:
        schema = "version bigint, token string, actor string, path string, kind string, at timestamp, payload string, batch string, pos bigint"
        nodes = self._nodes()
        if nodes is None or self.cursor() <= since:
            return self._empty(schema)
        rows = numbered(nodes.where("kind is not null"), "id", max(0, since))
        none = F.lit(None)
        return rows.select(F.col("number").alias("version"), none.cast("string").alias("token"), "actor", "path", "kind", none.cast("timestamp").alias("at"), "payload", F.lit("0").alias("batch"), F.col("number").alias("pos"))

    def states(self, actors: DataFrame) -> DataFrame:
        nodes = self._nodes()
        if nodes is None:
            return self._empty("actor string, payload string, digest string")
        first = nodes.where("state is not null").groupBy("actor").agg(F.min_by("state", "id").alias("payload"))
        return first.join(actors.select("actor").distinct(), "actor", "left_semi").select("actor", "payload", F.lit(None).cast("string").alias("digest"))

    def cursor(self) -> int:
        return self.checkpointer.version
