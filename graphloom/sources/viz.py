"""Graphs and provenance as DOT and Mermaid: one line per row, made in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Ontology


def _dot_id(id: Column) -> Column:
    return F.substring(F.concat(F.lit("n_"), F.regexp_replace(id, r"[^\p{L}\p{N}]", "_")), 1, 60)


def _mermaid_id(id: Column) -> Column:
    return F.concat(F.lit("n"), F.regexp_replace(F.substring(id, 1, 20), r"[^\p{L}\p{N}]", "_"))


def _dot_text(c: Column) -> Column:
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", " ")):
        c = F.replace(c, F.lit(raw), F.lit(out))
    return c


def _mermaid_text(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def _name() -> Column:
    v = F.element_at("properties", F.lit("name"))
    return F.coalesce(v["s"], v["i"].cast("string"), v["f"].cast("string"), v["b"].cast("string"), v["ts"].cast("string"))


def dot_lines(graph: Ontology) -> DataFrame:
    """(part, id, value): a line per node and edge; part 0 are nodes, part 1 edges."""
    types, name = F.concat_ws(",", "types"), _name()
    label = F.when(name.isNull(), _dot_text(types)).otherwise(F.concat(_dot_text(name), F.lit(" | "), _dot_text(types)))
    nodes = graph.nodes.select(F.lit(0).alias("part"), "id", F.concat(F.lit("  "), _dot_id(F.col("id")), F.lit(' [label="'), label, F.lit('"];')).alias("value"))
    edge = F.concat(F.lit("  "), _dot_id(F.col("source")), F.lit(" -> "), _dot_id(F.col("target")), F.lit(' [label="'), _dot_text(F.col("label")), F.lit('"];'))
    return nodes.unionByName(graph.edges.select(F.lit(1).alias("part"), "id", edge.alias("value")))


def mermaid_lines(graph: Ontology) -> DataFrame:
    """(part, id, value): a line per node and edge."""
    label = F.coalesce(_name(), F.get("types", F.lit(0)), F.lit(""))
    nodes = graph.nodes.select(F.lit(0).alias("part"), "id", F.concat(F.lit("  "), _mermaid_id(F.col("id")), F.lit('["'), _mermaid_text(label), F.lit('"]')).alias("value"))
    edge = F.concat(F.lit("  "), _mermaid_id(F.col("source")), F.lit(' -- "'), _mermaid_text(F.col("label")), F.lit('" --> '), _mermaid_id(F.col("target")))
    return nodes.unionByName(graph.edges.select(F.lit(1).alias("part"), "id", edge.alias("value")))


def _document(head: list[str], lines: DataFrame, tail: list[str]) -> str:
    """A picture is small by nature; its lines are fetched in order, a partition at a time."""
    return "\n".join([*head, *(r.value for r in lines.orderBy("part", "id").toLocalIterator()), *tail]) + "\n"


def dot_text(graph: Ontology) -> str:
    """The graph as a DOT document."""
    return _document(["digraph ontology {", "  rankdir=LR;", "  node [shape=box, style=rounded];"], dot_lines(graph), ["}"])


def mermaid_text(graph: Ontology) -> str:
    """The graph as a Mermaid document."""
    return _document(["graph LR"], mermaid_lines(graph), [])


def provenance_dot_lines(activities: DataFrame, derived: DataFrame) -> DataFrame:
    """(part, id, value): a line per activity and per derivation."""
    nodes = activities.select(F.lit(0).alias("part"), "id", F.concat(F.lit("  "), _dot_id(F.col("id")), F.lit(' [label="'), _dot_text(F.col("label")), F.lit('"];')).alias("value"))
    edge = F.concat(F.lit("  "), _dot_id(F.col("derived")), F.lit(" -> "), _dot_id(F.col("source")), F.lit(' [label="wasDerivedFrom"];'))
    return nodes.unionByName(derived.select(F.lit(1).alias("part"), F.col("derived").alias("id"), edge.alias("value")))


def provenance_dot(activities: DataFrame, derived: DataFrame) -> str:
    """Activities and derivations as a DOT document."""
    return _document(["digraph provenance {", "  rankdir=TB;", "  node [shape=ellipse, style=filled, fillcolor=lightgray];"], provenance_dot_lines(activities, derived), ["}"])


def provenance_mermaid_lines(activities: DataFrame, derived: DataFrame) -> DataFrame:
    """(part, id, value): a line per activity and per derivation."""
    nodes = activities.select(F.lit(0).alias("part"), "id", F.concat(F.lit("  "), _mermaid_id(F.col("id")), F.lit('(["'), _mermaid_text(F.col("label")), F.lit('"])')).alias("value"))
    edge = F.concat(F.lit("  "), _mermaid_id(F.col("derived")), F.lit(" -- wasDerivedFrom --> "), _mermaid_id(F.col("source")))
    return nodes.unionByName(derived.select(F.lit(1).alias("part"), F.col("derived").alias("id"), edge.alias("value")))


def provenance_mermaid(activities: DataFrame, derived: DataFrame) -> str:
    """Activities and derivations as a Mermaid document."""
    return _document(["graph TD"], provenance_mermaid_lines(activities, derived), [])
