"""Findings: where a graph contradicts its schema and its axioms.

A finding is (severity, code, focus, message).  Cardinality and datatype look at
the properties a node's own types declare; domain and range go up the declared
supertypes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.model import Ontology
from graphloom.operators.store import type_closure
from graphloom.plans.compile import reach
from graphloom.session import cut


def _finding(rows: DataFrame, severity: str, code: str, focus: F.Column, message: F.Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), focus.cast("string").alias("focus"), message.alias("message"))


def _declared(graph: Ontology) -> DataFrame:
    """(id, name, datatype, least, most, value): each property that a node's types declare, with the node's value."""
    declared = graph.node_types.select(F.col("name").alias("type"), F.explode("properties").alias("p"))
    nodes = graph.nodes.select("id", F.explode("types").alias("type"), "properties")
    return nodes.join(declared, "type").select("id", F.col("p.name").alias("name"), F.col("p.datatype").alias("datatype"), F.col("p.cardinality.min").alias("least"), F.col("p.cardinality.max").alias("most"), F.expr("element_at(properties, p.name)").alias("value"))


def cardinality(graph: Ontology) -> DataFrame:
    """A declared property that stands there too rarely or too often; a node has a value once or not at all."""
    found = _declared(graph).withColumn("n", F.when(F.col("value").isNull(), 0).otherwise(1)).where("n < coalesce(least, 0) or n > most")
    text = F.concat(F.lit("property "), "name", F.lit(" has "), F.col("n").cast("string"), F.lit(" values"))
    return _finding(found, "error", "cardinality.violation", F.col("id"), text)


def datatype(graph: Ontology) -> DataFrame:
    """A value of another datatype than declared; a null fits any."""
    found = _declared(graph).where("value is not null and value.t <> 'null' and value.t <> datatype")
    return _finding(found, "warning", "datatype.mismatch", F.col("id"), F.concat(F.lit("property "), "name", F.lit(" is no "), "datatype"))


def _ends(graph: Ontology, end: str, side: str, code: str, above: DataFrame | None = None) -> DataFrame:
    """Edges with an existing end that has no type which fits.

    The fitting pairs of label and type, as few as the schema has, are made
    first; edges are then only joined with the types of their end.
    """
    allowed = graph.edge_types.select(F.col("name").alias("label"), F.explode(side).alias("above"))
    above = (type_closure(graph) if above is None else above).select("type", "above")
    fits = allowed.select("label", F.col("above").alias("type")).unionByName(allowed.join(above, "above").select("label", "type")).distinct()
    ruled = graph.edge_types.where(F.size(side) > 0).select(F.col("name").alias("label"))
    edges = graph.edges.select("id", "label", F.col(end).alias("node")).join(ruled, "label", "left_semi")
    # per node the labels that its types fit, so that an edge is looked up once
    nodes = graph.nodes.select(F.col("id").alias("node"), F.explode_outer("types").alias("type"))
    fitting = nodes.join(fits, "type", "left").groupBy("node").agg(F.collect_set("label").alias("labels"))
    wrong = edges.join(fitting, "node").where(~F.array_contains("labels", F.col("label")))
    return _finding(wrong, "error", code, F.col("id"), F.lit(f"the {end} is not in the {side}"))


def domain(graph: Ontology, above: DataFrame | None = None) -> DataFrame:
    """Edges whose source exists and has no type of the domain, nor one below it."""
    return _ends(graph, "source", "domain", "edge.domain", above)


def range_(graph: Ontology, above: DataFrame | None = None) -> DataFrame:
    """Edges whose target exists and has no type of the range, nor one below it."""
    return _ends(graph, "target", "range", "edge.range", above)


def disjoint(graph: Ontology) -> DataFrame:
    """Nodes that hold both types of a disjoint pair, per pair."""
    pairs = graph.axioms.where("kind = 'DisjointWith'").select("a", "b")
    held = graph.nodes.select("id", F.explode(F.array_distinct("types")).alias("type"))
    both = held.withColumnRenamed("type", "a").join(pairs, "a").join(held.withColumnRenamed("type", "b"), ["id", "b"])
    return _finding(both, "error", "axiom.disjoint", F.col("id"), F.concat(F.lit("holds "), "a", F.lit(" and "), "b"))


def functional(graph: Ontology) -> DataFrame:
    """Edges of a functional property after the first of their source, by edge id."""
    names = graph.axioms.where("kind = 'Functional'").select(F.col("a").alias("label")).distinct()
    ranked = graph.edges.join(names, "label").select("id", "label", "source", F.row_number().over(W.partitionBy("label", "source").orderBy("id")).alias("n"))
    return _finding(ranked.where("n > 1"), "error", "axiom.functional", F.col("id"), F.concat(F.lit("another edge "), "label", F.lit(" of the source")))


def subclass_cycle(graph: Ontology) -> DataFrame:
    """Classes that reach themselves over SubClassOf axioms; the focus is null."""
    ups = graph.axioms.where("kind = 'SubClassOf'").select(F.col("a").alias("near"), F.col("b").alias("far")).distinct()
    steps = ups.where("near <> far").withColumn("edge", F.concat_ws("|", "near", "far"))
    above = reach(ups.select(F.col("near").alias("start")), steps, 1, None).select(F.col("start"), F.col("node"))
    back = above.join(ups.select(F.col("near").alias("node"), F.col("far").alias("start")), ["start", "node"]).select("start")
    loops = back.unionByName(ups.where("near = far").select(F.col("near").alias("start"))).distinct()
    return _finding(loops, "error", "axiom.subclass.cycle", F.lit(None), F.concat(F.lit("the subclass relation leads back to "), "start"))


CHECKS = (cardinality, datatype, domain, range_, disjoint, functional, subclass_cycle)


def validate(graph: Ontology) -> DataFrame:
    """All findings."""
    above = cut(type_closure(graph).select("type", "above"))  # for domain and range
    return reduce(DataFrame.unionByName, (check(graph, above) if check in (domain, range_) else check(graph) for check in CHECKS))


def errors(findings: DataFrame) -> DataFrame:
    """Findings that are errors."""
    return findings.where("severity = 'error'")


def is_clean(findings: DataFrame) -> bool:
    """Whether there is no error among the findings."""
    return errors(findings).isEmpty()
