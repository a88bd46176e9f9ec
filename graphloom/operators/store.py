"""Reading and changing a graph: lookups, upserts, deltas, differences and merges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Ontology

KEYS = {"nodes": "id", "edges": "id", "axioms": "id", "node_types": "name", "edge_types": "name"}


def node(graph: Ontology, id: str) -> DataFrame:
    """The node with this id, or no row."""
    return graph.nodes.where(F.col("id") == id).limit(1)


def edge(graph: Ontology, id: str) -> DataFrame:
    """The edge with this id, or no row."""
    return graph.edges.where(F.col("id") == id).limit(1)


def outbound(graph: Ontology, id: str) -> DataFrame:
    """Edges that start at a node, by id."""
    return graph.edges.where(F.col("source") == id).orderBy("id")


def inbound(graph: Ontology, id: str) -> DataFrame:
    """Edges that end at a node, by id."""
    return graph.edges.where(F.col("target") == id).orderBy("id")


def counts(graph: Ontology) -> DataFrame:
    """One row (node_count, edge_count)."""
    return graph.nodes.agg(F.count("*").alias("node_count")).crossJoin(graph.edges.agg(F.count("*").alias("edge_count")))


def last_wins(incoming: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row per key: the one greatest by ``order``, or, without it, any of the equal keys."""
    if order is None:
        return incoming.dropDuplicates([key])
    rest = [c for c in incoming.columns if c not in (key, order)]
    return incoming.groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in rest))


def upsert(current: DataFrame, incoming: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """``current`` with the rows of ``incoming`` in place of those with their key; whole rows are replaced, not merged."""
    incoming = last_wins(incoming, key, order).select(current.columns)
    return current.join(incoming.select(key), key, "left_anti").select(current.columns).unionByName(incoming)


@dataclass(frozen=True)
class Delta:
    """Nodes, edges and axioms to upsert, each may be missing."""

    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    axioms: DataFrame | None = None


def apply_delta(graph: Ontology, delta: Delta, activity_id: str | None = None) -> Ontology:
    """The graph with a delta upserted; axioms without provenance get that of the activity."""
    parts = {}
    if delta.nodes is not None:
        parts["nodes"] = upsert(graph.nodes, delta.nodes)
    if delta.edges is not None:
        parts["edges"] = upsert(graph.edges, delta.edges)
    if delta.axioms is not None:
        axioms = delta.axioms.withColumn("provenance", F.coalesce("provenance", F.lit(activity_id).cast("string")))
        parts["axioms"] = upsert(graph.axioms, axioms)
    return graph.with_(**parts)


def diff(mine: Ontology, other: Ontology) -> DataFrame:
    """(part, change, id): ids only in ``mine`` are added, only in ``other`` removed; changes of a kept id don't show."""
    out = None
    for part in ("nodes", "edges"):
        a, b = getattr(mine, part).select("id"), getattr(other, part).select("id")
        for change, x, y in (("added", a, b), ("removed", b, a)):
            rows = x.join(y, "id", "left_anti").select(F.lit(part).alias("part"), F.lit(change).alias("change"), "id")
            out = rows if out is None else out.unionByName(rows)
    return out


def merge(ours: Ontology, theirs: Ontology, strategy: str = "union") -> Ontology:
    """``ours``, ``theirs``, or the union of both by key, where ours counts; vocabulary and iri stay ours."""
    if strategy == "theirs":
        return theirs
    if strategy == "ours":
        return ours
    if strategy != "union":
        raise ValueError(f"no such strategy: {strategy}")
    join = lambda a, b, k: a.unionByName(b.join(a.select(k), k, "left_anti").select(a.columns))
    return ours.with_(**{p: join(getattr(ours, p), getattr(theirs, p), k) for p, k in KEYS.items()})


def merged_properties(old: Column, new: Column) -> Column:
    """Two property maps in one, the new values counting."""
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def reconcile_nodes(current: DataFrame, incoming: DataFrame, policy: str = "last_write_wins") -> DataFrame:
    """Incoming nodes as they should be upserted.

    last_write_wins leaves them as they are, skip_existing drops those that
    exist, merge adds to what exists: types in order, properties by key with the
    incoming counting, the incoming iri if there is one.
    """
    if policy == "last_write_wins":
        return incoming
    if policy == "skip_existing":
        return incoming.join(current.select("id"), "id", "left_anti").select(incoming.columns)
    if policy != "merge":
        raise ValueError(f"no such policy: {policy}")
    old = current.select("id", F.col("iri").alias("_iri"), F.col("types").alias("_types"), F.col("properties").alias("_properties"))
    both = incoming.join(old, "id", "left")
    return both.select(
        "id",
        F.coalesce("iri", "_iri").alias("iri"),
        F.when(F.col("_types").isNull(), F.col("types")).otherwise(F.concat("_types", F.filter("types", lambda t: ~F.array_contains("_types", t)))).alias("types"),
        merged_properties(F.col("_properties"), F.col("properties")).alias("properties"),
    )


# questions about schema and instances, as small frames


def class_exists(graph: Ontology, name: str) -> DataFrame:
    """One row (exists)."""
    return graph.node_types.where(F.col("name") == name).agg((F.count("*") > 0).alias("exists"))


def list_classes(graph: Ontology) -> DataFrame:
    """(name) of every node type, sorted."""
    return graph.node_types.select("name").orderBy("name")


def list_edge_types(graph: Ontology) -> DataFrame:
    """(name) of every edge type, sorted."""
    return graph.edge_types.select("name").orderBy("name")


def count_instances(graph: Ontology, name: str) -> DataFrame:
    """One row (instances): nodes of exactly this type."""
    return graph.nodes.where(F.array_contains("types", name)).agg(F.count("*").alias("instances"))


def subclasses_of(graph: Ontology, name: str) -> DataFrame:
    """(name) of the types that name this one as supertype."""
    return graph.node_types.where(F.array_contains("supertypes", name)).select("name").orderBy("name")


def supertypes_of(graph: Ontology, name: str) -> DataFrame:
    """(name, depth) of the type itself and all above it, at the least depth."""
    return type_closure(graph).where(F.col("type") == name).select(F.col("above").alias("name"), "depth").orderBy("depth", "name")


def properties_of_type(graph: Ontology, name: str) -> DataFrame:
    """(name, datatype) of the properties a type declares itself."""
    return graph.node_types.where(F.col("name") == name).select(F.explode("properties").alias("p")).select("p.name", "p.datatype").orderBy("name")


def type_closure(graph: Ontology) -> DataFrame:
    """(type, above, depth): every declared type with itself and all its supertypes, declared or not; loops end."""
    from graphloom.plans.compile import reach

    ups = graph.node_types.select(F.col("name").alias("near"), F.explode("supertypes").alias("far")).distinct()
    ups = ups.where("near <> far").withColumn("edge", F.concat_ws("|", "near", "far"))
    found = reach(graph.node_types.select(F.col("name").alias("start")), ups, 0, None)
    return found.select(F.col("start").alias("type"), F.col("node").alias("above"), "depth")


def checked_against_schema(graph: Ontology, delta: Delta) -> Delta:
    """The delta, or ValueError if it has a node type or edge label that the schema does not declare."""
    missing: list[str] = []
    if delta.nodes is not None:
        used = delta.nodes.select(F.explode("types").alias("name")).distinct()
        missing += [f"node type {r[0]}" for r in used.join(graph.node_types, "name", "left_anti").limit(5).collect()]
    if delta.edges is not None:
        used = delta.edges.select(F.col("label").alias("name")).distinct()
        missing += [f"edge label {r[0]}" for r in used.join(graph.edge_types, "name", "left_anti").limit(5).collect()]
    if missing:
        raise ValueError("not declared: " + ", ".join(sorted(missing)))
    return delta


def pipeline(*stages: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Stages one after the other as one function for ``DataFrame.transform``."""

    def run(df: DataFrame) -> DataFrame:
        for stage in stages:
            df = df.transform(stage)
        return df

    return run
