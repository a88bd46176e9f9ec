"""Patterns to columns, plans to DataFrames.

A step gives one row per distinct node it reaches from each row, at the least
number of edges; of several ways of that length the one found first, in order
of edge ids.  Rows carry the ids of the edges gone along, depth first, and this
is also their order where the plan names none.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import SLOT, Ontology, tagged
from graphloom.plans.pattern import EdgePattern, NodePattern, Step, TraversalPlan
from graphloom.session import written

MOST_BROADCAST = 1 << 18  # rows of ids that go to all executors at once
MOST_HASHES = 1 << 20  # hashes of ids that do


def has_property(key: str, value: Any, properties: Column | None = None) -> Column:
    """Whether a property has this value: tag and value equal, a missing one is not null; never null itself."""
    tag, v = tagged(value)
    p = F.element_at(F.col("properties") if properties is None else properties, F.lit(key))
    if tag == "null":
        same = p["t"] == tag
    elif tag == "float" and v != v:
        same = F.lit(False)  # not a number equals nothing
    else:
        same = (p["t"] == tag) & (p[SLOT[tag]] == F.lit(v))
    return F.coalesce(same, F.lit(False))


def node_condition(pattern: NodePattern) -> Column:
    """Two-valued condition on the columns of a node."""
    parts = [F.coalesce(F.col("id") == F.lit(pattern.id), F.lit(False))] if pattern.id is not None else []
    parts += [F.coalesce(F.array_contains("types", t), F.lit(False)) for t in pattern.types]
    parts += [has_property(k, v) for k, v in pattern.properties]
    if pattern.alternatives:
        parts.append(reduce(lambda a, b: a | b, map(node_condition, pattern.alternatives)))
    parts += [~node_condition(p) for p in pattern.excluded]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def edge_condition(pattern: EdgePattern) -> Column:
    """Two-valued condition on the columns of an edge."""
    parts = [F.coalesce(F.col("label") == F.lit(pattern.label), F.lit(False))] if pattern.label is not None else []
    parts += [has_property(k, v) for k, v in pattern.properties]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def match(graph: Ontology, pattern: NodePattern, unordered: bool = False) -> DataFrame:
    """One row per node that the pattern fits; its id under the pattern's name, in the order of ids unless ``unordered``."""
    rows = graph.nodes.where(node_condition(pattern))
    rows = rows if unordered else rows.orderBy("id")
    return rows.select(*([F.col("id").alias(pattern.name)] if pattern.name else []))


def links(graph: Ontology, step: Step) -> DataFrame:
    """(near, far, edge) of the edges a step may take, near being where it comes from."""
    near, far = ("source", "target") if step.outbound else ("target", "source")
    return graph.edges.where(edge_condition(step.edge)).select(F.col(near).alias("near"), F.col(far).alias("far"), F.col("id").alias("edge"))


def _among(df: DataFrame, column: str, hashes: DataFrame) -> DataFrame:
    """The rows whose column has one of these hashes (``_hash``), which go to all executors; Spark asks this first, below any distinct."""
    return df.join(F.broadcast(hashes), F.xxhash64(column) == F.col("_hash"), "left_semi")


def _hashes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.xxhash64("node").alias("_hash")).distinct()


def _levels(starts: DataFrame, edges: DataFrame, most: int | None, trails: bool) -> tuple[list[DataFrame], int | None]:
    """The levels of ``reach`` from 0 on, and no less than the number of their nodes if it is known."""
    trail = ["trail"] if trails else []
    level = starts.select(F.col("start"), F.col("start").alias("node"), *([F.array().cast("array<string>").alias("trail")] if trails else [])).distinct()
    edges = edges.select("near", "far", *(["edge"] if trails else []))

    def ways(level: DataFrame, edges: DataFrame) -> DataFrame:
        on = level.join(edges, level["node"] == edges["near"])
        found = on.select("start", F.col("far").alias("node"), *([F.concat("trail", F.array("edge")).alias("trail")] if trails else []))
        return found.groupBy("start", "node").agg(F.min("trail").alias("trail")) if trails else found.distinct()

    if most is not None and most <= 2:
        out = [level]
        for _ in range(most):
            visited = reduce(DataFrame.unionByName, (x.select("start", "node") for x in out))
            out.append(ways(out[-1], edges).join(visited, ["start", "node"], "left_anti"))
        return out, None
    level = written(level, "level")
    out, held, nodes = [level], level.count(), 0
    visited, n = level.select("start", "node"), held
    while n and (most is None or len(out) <= most):
        hashes = _hashes(level)
        met = hashes.count()
        nodes += met
        close = _among(edges, "near", hashes) if met <= MOST_HASHES else edges
        if n <= MOST_BROADCAST:
            found = ways(F.broadcast(level), close)
        else:
            close = written(close, "edges") if met <= MOST_HASHES else close
            found = ways(level, F.broadcast(close) if met <= MOST_HASHES and close.count() <= MOST_BROADCAST else close)
        level = written(found.join(F.broadcast(visited) if held <= MOST_BROADCAST else visited, ["start", "node"], "left_anti").select("start", "node", *trail), "level")
        n = level.count()
        held += n
        visited = visited.unionByName(level.select("start", "node"))
        out += [level] if n else []
    return out, nodes + n


def reach(starts: DataFrame, edges: DataFrame, least: int, most: int | None, trails: bool = True) -> DataFrame:
    """(start, node, depth, trail): nodes at their least distance from each distinct start, between least and most edges; no trail without ``trails``.

    Breadth first, a level a join; what was visited is kept per start and node,
    so loops lead nowhere new.  Levels are written, and the search ends where a
    level is empty.  Edges are read at the nodes of the level only: where these
    are not too many, their hashes pick the edges before anything is shuffled.
    """
    return _joined(_levels(starts, edges, most, trails)[0], least)


def _joined(levels: list[DataFrame], least: int) -> DataFrame:
    out = [x.withColumn("depth", F.lit(d)) for d, x in enumerate(levels)]
    return reduce(DataFrame.unionByName, out[least:]) if out[least:] else out[0].where("false")


def _named(rows: DataFrame, name: str | None, value: Column) -> DataFrame:
    """The rows with a variable bound; binding a name again replaces what it was."""
    return rows.withColumn(name, value) if name else rows


def walk(graph: Ontology, rows: DataFrame, step: Step, ranked: bool = True) -> DataFrame:
    """One step from ``_at`` of every row, to nodes that its target pattern fits; unless ``ranked``, ``_rank`` only tells rows apart."""
    edges = links(graph, step)
    ends = graph.nodes.where(node_condition(step.target)).select(F.col("id").alias("_end"))
    if (step.edge.least, step.edge.most) == (1, 1):
        kept = rows.columns
        found = rows.join(edges.where("near <> far"), F.col("_at") == F.col("near")).groupBy(*kept, "far").agg(F.min("edge").alias("edge"))
        trail = F.array(F.lit("0000000001"), F.col("edge"))
    else:
        trails = ranked or bool(step.edge.name)
        kept = rows.columns
        far = step.edge.most is None or step.edge.most > 2
        rows = written(rows, "rows") if far else rows
        levels, nodes = _levels(rows.select(F.col("_at").alias("start")), edges, step.edge.most, trails)
        way = _joined(levels, step.edge.least)
        if nodes is not None and nodes <= MOST_HASHES:
            ends = _among(ends, "_end", _hashes(way))
            ends = F.broadcast(ends) if nodes <= MOST_BROADCAST else ends
        rows = F.broadcast(rows) if far and rows.count() <= MOST_BROADCAST // len(kept) else rows
        last = [F.col("trail"), F.get("trail", F.size("trail") - 1).alias("edge")] if trails else []
        found = rows.join(way, F.col("_at") == F.col("start")).select(*(F.col(f"`{c}`") for c in kept), F.col("node").alias("far"), "depth", *last)
        trail = F.concat(F.array(F.lpad(F.col("depth").cast("string"), 10, "0")), "trail") if trails else F.array("far")
    found = found.join(ends, F.col("far") == F.col("_end")).withColumn("_rank", F.concat("_rank", trail)).withColumn("_at", F.col("far"))
    if step.edge.name:
        found = found.withColumn(f"e:{step.edge.name}", F.coalesce(F.col("edge"), F.col(f"`e:{step.edge.name}`")) if f"e:{step.edge.name}" in kept else F.col("edge"))
    found = _named(found, f"n:{step.target.name}" if step.target.name else None, F.col("far"))
    bound = list(dict.fromkeys([*kept, *([f"e:{step.edge.name}"] if step.edge.name else []), *([f"n:{step.target.name}"] if step.target.name else [])]))
    return found.select(*(F.col(f"`{c}`") for c in bound))


def traverse(graph: Ontology, plan: TraversalPlan, unordered: bool = False) -> DataFrame:
    """The rows of a plan: one column per variable.

    ``unordered`` leaves out the sort that only gives a plan without ORDER BY,
    SKIP and LIMIT a fixed order.
    """
    rows = graph.nodes.where(node_condition(plan.seed)).select("id")
    rows = _named(rows, f"n:{plan.seed.name}" if plan.seed.name else None, F.col("id")).withColumn("_at", F.col("id")).withColumn("_rank", F.array("id")).drop("id")
    ranked = bool(plan.order or plan.skipped) or plan.limited is not None or not unordered
    for step in plan.steps:
        rows = walk(graph, rows, step, ranked)
    keys = [F.col(f"`n:{v}`").desc_nulls_last() if down else F.col(f"`n:{v}`").asc_nulls_first() for v, down in plan.order if f"n:{v}" in rows.columns]
    if keys or plan.skipped or plan.limited is not None or not unordered:
        rows = rows.orderBy(*keys, F.col("_rank").asc())
    if plan.skipped:
        rows = rows.offset(plan.skipped)
    if plan.limited is not None:
        rows = rows.limit(plan.limited)
    names = {c: c[2:] for c in rows.columns if c[:2] in ("n:", "e:")}
    if plan.columns:
        names = {c: v for c, v in names.items() if v in plan.columns}
    taken = [c[2:] for c in names if c[0] == "n"]
    return rows.select(*(F.col(f"`{c}`").alias(f"{v}__edge" if c[0] == "e" and v in taken else v) for c, v in names.items()))
