"""Projecting actor records into a graph: four shapes, the same for a batch and inside a stream.

``Records`` hold paths (path, attributes), events (version, actor, path, kind,
at, payload, batch, pos) and states (actor, payload, digest).  ``pos`` orders
the events of a batch.  JSON is text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.paths import prefixes, render, segment_type, segments, workflow_run
from graphloom.model import Ontology, build, content_id, edge_id, properties_of, pv_of, random_id
from graphloom.operators.store import Delta

@dataclass(frozen=True)
class Records:
    """What a source has read."""

    paths: DataFrame
    events: DataFrame
    states: DataFrame


@dataclass(frozen=True)
class Minting:
    """How ids are made: from the path under ``base``, from the content, or at random.

    A random id is drawn once per path and event of a batch, so edges never point
    to an id that no node has.
    """

    kind: str = "content"  # content, path, uuid
    base: str = "urn:graphloom:actor"

    def actor(self, path: Column) -> tuple[Column, Column]:
        """(id, iri) of a rendered path."""
        return self._of(path, path)

    def event(self, version: Column, actor: Column, kind: Column) -> tuple[Column, Column]:
        """(id, iri) of an event."""
        v = version.cast("string")
        return self._of(F.concat(F.lit("/event/"), v, F.lit("/"), actor), F.concat_ws(":", F.lit("event"), v, actor, kind))

    def bucket(self, workflow: Column, run: Column) -> tuple[Column, Column]:
        """(id, iri) of a run; stable even where other ids are random."""
        stable = Minting("content", self.base) if self.kind == "uuid" else self
        return stable._of(F.concat(F.lit("/"), workflow, F.lit("/"), run), F.concat_ws(":", F.lit("flat"), workflow, run))

    def _of(self, tail: Column, key: Column) -> tuple[Column, Column]:
        if self.kind == "path":
            iri = F.concat(F.lit(self.base.removesuffix("/")), tail)
            return content_id("NodeId", iri), iri
        if self.kind == "uuid":
            return random_id(), F.lit(None).cast("string")
        return content_id("NodeId", key), F.lit(None).cast("string")


def _node(id: Column, iri: Column, types: list[Column], properties: Column) -> list[Column]:
    return [id.alias("id"), iri.alias("iri"), F.array(*types).alias("types"), properties.alias("properties")]


_NO_PROPERTIES = "map<string,struct<t:string,s:string,i:bigint,f:double,b:boolean,ts:timestamp,bin:binary>>"


def _edges(df: DataFrame, source: Column, label: str, target: Column) -> DataFrame:
    pairs = df.select(source.alias("source"), target.alias("target")).distinct()
    return pairs.select(edge_id(F.col("source"), F.lit(label), F.col("target")).alias("id"), F.lit(label).alias("label"), "source", "target", F.lit(None).cast(_NO_PROPERTIES).alias("properties"))


def _minted(df: DataFrame, pair: tuple[Column, Column], minting: Minting) -> DataFrame:
    """The frame with id and iri; random ids are fixed before anything is derived from them."""
    from graphloom.session import cut

    out = df.withColumn("id", pair[0]).withColumn("iri", pair[1])
    return cut(out) if minting.kind == "uuid" else out


def event_properties(source: str, with_path: bool = False) -> Column:
    """The properties of an event's node."""
    more = {"path": pv_of(render(segments(F.col("path"))), "string")} if with_path else {}
    payload = F.when(F.col("payload") != "null", F.to_json(F.try_parse_json("payload")))
    return properties_of(
        event_kind=pv_of(F.col("kind"), "string"),
        actor_id=pv_of(F.col("actor"), "string"),
        cursor_version=pv_of(F.col("version"), "integer"),
        event_at=pv_of(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"), "string"),
        source_label=pv_of(F.lit(source), "string"),
        event_payload=pv_of(payload, "json"),
        **more,
    )


def _event_nodes(records: Records, minting: Minting) -> DataFrame:
    return _minted(records.events, minting.event(F.col("version"), F.col("actor"), F.col("kind")), minting)


def _state_nodes(states: DataFrame, source: str, key: Column) -> DataFrame:
    props = properties_of(actor_id=pv_of(F.col("actor"), "string"), state=pv_of(F.to_json(F.try_parse_json("payload")), "json"), source_label=pv_of(F.lit(source), "string"))
    return states.select(*_node(content_id("NodeId", key), F.lit(None).cast("string"), [F.lit("ActorState")], props))


BLOCK_BITS = 12  # positions whose order one task sees at a time


def _successors(events: DataFrame) -> DataFrame:
    """successor edges from each event to the next one of its batch, over all actors.

    Events are ordered within blocks of positions, then the last of each block
    is followed by the first of the next, so a batch of any size, a replay of
    the whole journal say, is spread over tasks.
    """
    e = events.select("batch", "pos", "id", F.shiftright("pos", BLOCK_BITS).alias("block"))
    in_block = W.partitionBy("batch", "block").orderBy("pos", "id")
    inner = e.withColumn("before", F.lag("id").over(in_block))
    ends = e.groupBy("batch", "block").agg(F.min(F.struct("pos", "id"))["id"].alias("first"), F.max(F.struct("pos", "id"))["id"].alias("last"))
    between = ends.withColumn("before", F.lag("last").over(W.partitionBy("batch").orderBy("block")))  # a row per block
    pairs = inner.select("before", "id").unionByName(between.select("before", F.col("first").alias("id")))
    return _edges(pairs.where("before is not null"), F.col("before"), "successor", F.col("id"))


def path_nodes(records: Records, source: str, minting: Minting) -> tuple[DataFrame, DataFrame]:
    """(nodes, supervises edges) of all paths and their prefixes; attributes only where a path ends and was seen first."""
    given = records.paths.select(segments(F.col("path")).alias("s"), "attributes").unionByName(records.events.where("path is not null").select(segments(F.col("path")).alias("s"), F.lit(None).cast("map<string,string>").alias("attributes")))
    each = given.select(F.explode(prefixes(F.col("s"))).alias("p"), F.size("s").alias("n"), "attributes").select("p.*", F.when((F.col("p.depth") + 1 == F.col("n")), F.col("attributes")).alias("attributes"))
    held = each.groupBy("path").agg(F.any_value("parent").alias("parent"), F.any_value("segment").alias("segment"), F.any_value("depth").alias("depth"), F.max(F.to_json("attributes")).alias("attributes"))
    held = _minted(held, minting.actor(F.col("path")), minting)
    own = properties_of(path=pv_of(F.col("path"), "string"), segment=pv_of(F.col("segment"), "string"), depth=pv_of(F.col("depth"), "integer"), source_label=pv_of(F.lit(source), "string"))
    attributes = F.coalesce(F.from_json("attributes", "map<string,string>"), F.create_map().cast("map<string,string>"))
    extra = F.map_filter(F.transform_values(attributes, lambda k, v: pv_of(v, "json")), lambda k, v: v.isNotNull() & ~k.isin("path", "segment", "depth", "source_label"))
    nodes = held.select("path", "parent", *_node(F.col("id"), F.col("iri"), [F.lit("Actor"), segment_type(F.col("segment"))], F.map_concat(own, extra)))
    up = held.select(F.col("path").alias("parent"), F.col("id").alias("above"))
    edges = _edges(held.join(up, "parent"), F.col("above"), "supervises", F.col("id"))
    return nodes, edges


def hierarchical(records: Records, source: str = "", minting: Minting = Minting()) -> Delta:
    """Nodes for all path prefixes, events and states; supervises, emitted and holdsState edges.

    A state belongs to the first path, in order, that ends in its actor.
    """
    nodes, edges = path_nodes(records, source, minting)
    events = _event_nodes(records, minting)
    event_nodes = events.select(*_node(F.col("id"), F.col("iri"), [F.lit("ActorEvent")], event_properties(source)))
    at = nodes.select(F.col("path").alias("at"), F.col("id").alias("actor_node"))
    emitted = _edges(events.where("path is not null").withColumn("at", render(segments(F.col("path")))).join(at, "at"), F.col("actor_node"), "emitted", F.col("id"))
    key = F.concat(F.lit("state:"), "actor")
    states = _state_nodes(records.states, source, key)
    leaf = nodes.groupBy(F.regexp_extract("path", "[^/]*$", 0).alias("actor")).agg(F.min_by("id", "path").alias("actor_node"))
    holds = _edges(records.states.join(leaf, "actor"), F.col("actor_node"), "holdsState", content_id("NodeId", key))
    return Delta(nodes.select("id", "iri", "types", "properties").unionByName(event_nodes).unionByName(states), edges.unionByName(emitted).unionByName(holds))


def event_stream(records: Records, source: str = "", minting: Minting = Minting()) -> Delta:
    """Event nodes, each linked to the next of its batch."""
    events = _event_nodes(records, minting)
    return Delta(events.select(*_node(F.col("id"), F.col("iri"), [F.lit("ActorEvent")], event_properties(source, with_path=True))), _successors(events))


def flat(records: Records, source: str = "", minting: Minting = Minting()) -> Delta:
    """One node per workflow and run, with its events and states as JSON arrays; states stand under <unrouted>."""
    key = lambda c: workflow_run(segments(F.col(c)))
    nothing = F.lit(None)
    paths = records.paths.select(key("path").alias("k"), F.lit(1).alias("n"), nothing.cast("string").alias("event"), nothing.cast("bigint").alias("pos"), nothing.cast("string").alias("state"))
    as_event = F.to_json(F.struct("actor", "kind", F.col("version").alias("cursor"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("at"), F.try_parse_json("payload").alias("payload")), {"ignoreNullFields": "false"})
    events = records.events.where("path is not null").select(key("path").alias("k"), F.lit(0).alias("n"), as_event.alias("event"), F.col("pos").cast("bigint").alias("pos"), nothing.cast("string").alias("state"))
    as_state = F.to_json(F.struct("actor", F.try_parse_json("payload").alias("payload"), "digest"), {"ignoreNullFields": "false"})
    states = records.states.select(F.struct(F.lit("<unrouted>").alias("workflow"), F.col("actor").alias("run")).alias("k"), F.lit(0).alias("n"), nothing.cast("string").alias("event"), nothing.cast("bigint").alias("pos"), as_state.alias("state"))
    rows = paths.unionByName(events).unionByName(states).where("k is not null").select("k.*", "n", "event", "pos", "state")
    listed = lambda c: F.concat(F.lit("["), F.concat_ws(",", c), F.lit("]"))
    in_order = F.transform(F.array_sort(F.collect_list(F.when(F.col("event").isNotNull(), F.struct("pos", "event")))), lambda x: x["event"])
    buckets = rows.groupBy("workflow", "run").agg(F.sum("n").alias("path_count"), listed(in_order).alias("steps"), listed(F.array_sort(F.collect_list("state"))).alias("states"))
    path = F.concat(F.lit("/"), "workflow", F.lit("/"), "run")
    props = properties_of(
        path=pv_of(path, "string"), workflow=pv_of(F.col("workflow"), "string"), run=pv_of(F.col("run"), "string"), source_label=pv_of(F.lit(source), "string"),
        steps=pv_of(F.col("steps"), "json"), states=pv_of(F.col("states"), "json"), path_count=pv_of(F.col("path_count"), "integer"),
    )
    id, iri = minting.bucket(F.col("workflow"), F.col("run"))
    return Delta(buckets.select(*_node(id, iri, [F.lit("Actor"), F.lit("Run")], props)))


def snapshot_diff(records: Records, source: str = "", minting: Minting = Minting()) -> Delta:
    """Nodes for paths, events and states as given, successor edges among the events; what was seen before has to be left out first.

    Of repeated paths, events and states one is kept, the event's first.
    """
    paths = records.paths.select(render(segments(F.col("path"))).alias("path")).distinct()
    paths = _minted(paths, minting.actor(F.col("path")), minting)
    nodes = paths.select(*_node(F.col("id"), F.col("iri"), [F.lit("Actor")], properties_of(path=pv_of(F.col("path"), "string"), source_label=pv_of(F.lit(source), "string"))))
    columns = [c for c in records.events.columns if c not in ("actor", "version")]
    first = records.events.groupBy("actor", "version").agg(F.min_by(F.struct(*columns), F.struct("batch", "pos")).alias("e")).select("actor", "version", "e.*")
    events = _event_nodes(Records(records.paths, first, records.states), minting)
    event_nodes = events.select(*_node(F.col("id"), F.col("iri"), [F.lit("ActorEvent")], event_properties(source)))
    states = records.states.groupBy("actor", "digest").agg(F.any_value("payload").alias("payload"))
    state_nodes = _state_nodes(states, source, F.concat_ws(":", F.lit("state"), "actor", F.coalesce("digest", F.lit("<none>"))))
    return Delta(nodes.unionByName(event_nodes).unionByName(state_nodes), _successors(events))


PROJECTIONS = {"hierarchical": hierarchical, "event_stream": event_stream, "flat": flat, "snapshot_diff": snapshot_diff}


def actor_schema(spark: SparkSession) -> Ontology:
    """The node and edge types of projected graphs."""
    text = lambda name: {"name": name, "datatype": "string", "cardinality": (1, 1)}
    actor = ["Actor"]
    return build(
        spark,
        node_types=[
            {"name": "Actor"},
            {"name": "Workflow", "supertypes": actor, "properties": [text("path")]},
            {"name": "Run", "supertypes": actor},
            {"name": "Step", "supertypes": actor},
            {"name": "ActorPathSegment", "supertypes": actor},
            {"name": "ActorEvent", "properties": [text("event_kind")]},
            {"name": "ActorState"},
            {"name": "ActorProjectionCursor"},
        ],
        edge_types=[
            {"name": "supervises", "domain": actor, "range": actor},
            {"name": "emitted", "domain": actor, "range": ["ActorEvent"]},
            {"name": "holdsState", "domain": actor, "range": ["ActorState"], "functional": True},
            {"name": "successor", "domain": ["ActorEvent"], "range": ["ActorEvent"]},
        ],
    )
