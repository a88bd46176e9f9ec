"""Vocabularies mapped to graphs: SKOS, FOAF, schema.org, or a mapping of one's own."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.iri import is_iri
from graphloom.model import Ontology, build, edge_id, node_id, pv_of
from graphloom.operators.provenance import Activity
from graphloom.sources.rdf import TYPE


@dataclass(frozen=True)
class Mapping:
    """Which classes and predicates are taken, and what they are called.

    ``data`` is predicate -> (name, datatype, classes), ``links`` predicate ->
    (name, domain, range).  A link to something without a known type gives it
    the default class.
    """

    classes: dict[str, str]
    data: dict[str, tuple[str, str, tuple[str, ...]]]
    links: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]]
    default: str | None


# fixed values: what is taken of each vocabulary
_SKOS, _FOAF, _SCHEMA = "http://www.w3.org/2004/02/skos/core#", "http://xmlns.com/foaf/0.1/", "https://schema.org/"
_CONCEPT = ("Concept",)
SKOS = Mapping(
    {_SKOS + "Concept": "Concept"},
    {_SKOS + n: (n, "string", _CONCEPT) for n in ("prefLabel", "altLabel", "definition")},
    {_SKOS + n: (n, _CONCEPT, _CONCEPT) for n in ("broader", "narrower", "related")},
    "Concept",
)
_AGENTS = ("Person", "Organization")
FOAF = Mapping(
    {_FOAF + n: n for n in _AGENTS},
    {_FOAF + n: (n, d, _AGENTS) for n, d in (("name", "string"), ("mbox", "iri"), ("homepage", "iri"))},
    {_FOAF + "knows": ("knows", ("Person",), ("Person",)), _FOAF + "member": ("member", ("Organization",), ("Person",))},
    "Person",
)
_THINGS = ("Organization", "Person", "WebSite", "Place")
SCHEMA_ORG = Mapping(
    {_SCHEMA + n: n for n in _THINGS},
    {_SCHEMA + "name": ("name", "string", _THINGS), _SCHEMA + "url": ("url", "iri", _THINGS), _SCHEMA + "address": ("address", "string", ("Organization", "Person", "Place"))},
    {_SCHEMA + "memberOf": ("memberOf", ("Person", "Organization"), ("Organization",)), _SCHEMA + "worksFor": ("worksFor", ("Person",), ("Organization",))},
    "Organization",
)


def coerced(lexical: Column, datatype: Column) -> Column:
    """The value struct of a literal; what cannot be read as its datatype stays text, as do times, bytes and JSON."""
    text = pv_of(lexical, "string")
    truth = F.when(lexical.isin("true", "1"), True).when(lexical.isin("false", "0"), False)
    number = lambda c, tag: F.coalesce(pv_of(c, tag), text)
    return (
        F.when(datatype == "integer", number(lexical.try_cast("bigint"), "integer"))
        .when(datatype == "float", number(lexical.try_cast("double"), "float"))
        .when(datatype == "bool", number(truth, "bool"))
        .when((datatype == "iri") & is_iri(lexical), pv_of(lexical, "iri"))
        .otherwise(text)
    )


def project(triples: DataFrame, mapping: Mapping) -> Ontology:
    """The graph of a mapping over triples with a column ``pos`` for their order (the last value of a property counts).

    Without ``pos`` the greatest value counts.  Subjects without a known type are
    dropped, as are values that fit neither.
    """
    spark = triples.sparkSession
    if "pos" not in triples.columns:
        triples = triples.withColumn("pos", F.lit(0))
    t = triples.where("s_kind = 'iri'")
    classes = spark.createDataFrame(sorted(mapping.classes.items()), "o string, type string")
    data = spark.createDataFrame([(p, n, d) for p, (n, d, _) in sorted(mapping.data.items())], "p string, name string, declared string")
    links = spark.createDataFrame([(p, n) for p, (n, _, _) in sorted(mapping.links.items())], "p string, label string")
    # a type is said by rdf:type or by any predicate whose object is a class
    typed = t.where("o_kind = 'iri'").join(F.broadcast(classes), "o").groupBy("s", "type").agg(F.min("pos").alias("pos"))
    types = typed.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("pos", "type")))["type"].alias("types"))
    values = t.where(F.col("p") != TYPE).join(F.broadcast(data), "p").where("o_kind = 'literal' or (o_kind = 'iri' and declared = 'iri')")
    value = F.when(F.col("o_kind") == "iri", pv_of(F.col("o"), "iri")).otherwise(coerced(F.col("o"), F.col("declared")))
    last = values.select("s", "name", "pos", "o", value.alias("value")).groupBy("s", "name").agg(F.max_by("value", F.struct("pos", "o")).alias("value"))
    properties = last.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("properties"))
    edges = t.where(F.col("p") != TYPE).where("o_kind = 'iri'").join(F.broadcast(links), "p").join(types.select("s"), "s", "left_semi").select("s", "label", "o").distinct()
    untyped = edges.select(F.col("o").alias("s")).distinct().join(types, "s", "left_anti")
    if mapping.default is None:
        edges = edges.join(types.select(F.col("s").alias("o")), "o", "left_semi")
        everyone = types
    else:
        everyone = types.unionByName(untyped.withColumn("types", F.array(F.lit(mapping.default))))
    nodes = everyone.join(properties, "s", "left").select(node_id(F.col("s")).alias("id"), F.col("s").alias("iri"), "types", "properties")
    source, target = node_id(F.col("s")), node_id(F.col("o"))
    none = F.lit(None).cast(properties.schema["properties"].dataType)
    rows = edges.select(edge_id(source, F.col("label"), target).alias("id"), "label", source.alias("source"), target.alias("target"), none.alias("properties"))
    declared: dict[str, list[dict]] = {c: [] for c in mapping.classes.values()}
    for p, (name, kind, owners) in mapping.data.items():
        for o in owners:
            declared.setdefault(o, []).append({"name": name, "datatype": kind, "iri": p})
    iris = {c: i for i, c in mapping.classes.items()}
    schema = build(
        spark,
        node_types=[{"name": c, "iri": iris.get(c), "properties": ps} for c, ps in declared.items()],
        edge_types=[{"name": n, "iri": p, "domain": d, "range": r} for p, (n, d, r) in mapping.links.items()],
    )
    return schema.with_(nodes=nodes, edges=rows)


def import_skos(triples: DataFrame) -> tuple[Ontology, Activity]:
    """Concepts with their relations; prefLabel also stands as name where there is none."""
    graph = project(triples, SKOS)
    label = F.element_at("properties", F.lit("prefLabel"))
    named = F.when(label.isNotNull() & ~F.coalesce(F.map_contains_key("properties", F.lit("name")), F.lit(False)), F.map_concat("properties", F.create_map(F.lit("name"), label))).otherwise(F.col("properties"))
    return graph.with_(nodes=graph.nodes.withColumn("properties", named)), Activity("skos-import").with_attribute("vocabulary", _SKOS).finish()


def import_foaf(triples: DataFrame) -> tuple[Ontology, Activity]:
    """People and organisations, whom they know and their members."""
    return project(triples, FOAF), Activity("foaf-import").with_attribute("vocabulary", _FOAF).finish()


def import_schema_org(triples: DataFrame) -> tuple[Ontology, Activity]:
    """Organisations, people, sites and places, memberships and work."""
    return project(triples, SCHEMA_ORG), Activity("schema-org-import").with_attribute("vocabulary", _SCHEMA).finish()
