"""Queries on the schema that node_types declares, on importers and on values, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import iri as iris
from graphloom.functions.text import squeezed
from graphloom.functions.vectors import HashEmbedding, ingest, node_text, propose
from graphloom.model import EDGES, NODES, Iri, Ontology, axiom_id, build, edge_id, empty, is_id, node_id, properties_of, pv_of, random_id
from graphloom.operators import reason, store, validate
from graphloom.operators.extract import json_value, relation_edges
from graphloom.operators.references import type_parents
from graphloom.plans import cypher, sparql
from graphloom.plans.compile import match, traverse
from graphloom.plans.lexer import QueryError, Unsupported
from graphloom.plans.pattern import EdgePattern, NodePattern, TraversalPlan
from graphloom.queries.processing import SQL as PROCESSING
from graphloom.queries.tables import table
from graphloom.queries.whole import GRAPH
from graphloom.sources import importers, rdf, shacl, tables_graph
from graphloom.sources.reference import reference_ontology

N, E = NodePattern(), EdgePattern()
LOCAL = iris.LOCAL_BASE


def schema_graph(spark: SparkSession, sf: str) -> Ontology:
    """The types of node_types with their resolved supertypes, as schema, as nodes with edges, and as SubClassOf axioms."""
    rows = table(spark, sf, "node_types").withColumn("name", squeezed(F.col("name"))).where("name <> ''")
    parents = type_parents(table(spark, sf, "node_types"))
    ups = parents.groupBy("name").agg(F.array_sort(F.collect_set("parent")).alias("supertypes"))
    declared = rows.select("name", F.explode("properties").alias("p")).where("p.name is not null")
    one = F.min(F.struct(F.col("p.datatype"), F.col("p.card_min"), F.col("p.card_max"))).alias("m")
    declared = declared.groupBy("name", F.col("p.name").alias("key")).agg(one)
    none = F.lit(None).cast("string")
    entry = F.struct(F.col("key").alias("name"), F.col("m.datatype").alias("datatype"), F.struct(F.col("m.card_min").alias("min"), F.col("m.card_max").alias("max")).alias("cardinality"), none.alias("iri"), none.alias("description"))
    properties = declared.groupBy("name").agg(F.array_sort(F.collect_list(entry)).alias("properties"))
    types = rows.groupBy("name").agg(F.min(squeezed(F.col("iri"))).alias("iri"), F.max("description").alias("description")).join(ups, "name", "left").join(properties, "name", "left")
    types = types.select("name", "iri", F.coalesce("supertypes", F.array().cast("array<string>")).alias("supertypes"), F.coalesce("properties", F.array().cast(properties.schema["properties"].dataType)).alias("properties"), "description")
    id_ = lambda c: node_id(F.concat(F.lit("urn:type/"), c))
    nodes = types.select(id_(F.col("name")).alias("id"), F.concat(F.lit("urn:type/"), "name").alias("iri"), F.array(F.lit("Type")).alias("types"), properties_of(name=pv_of(F.col("name"), "string"), means=pv_of(F.col("iri"), "iri")).alias("properties"))
    links = parents.where("parent is not null").select("name", "parent").distinct()
    s, t = id_(F.col("name")), id_(F.col("parent"))
    edges = links.select(edge_id(s, F.lit("below"), t).alias("id"), F.lit("below").alias("label"), s.alias("source"), t.alias("target"), F.lit(None).cast(EDGES["properties"].dataType).alias("properties"))
    axioms = links.select(axiom_id(F.lit("SubClassOf"), F.col("name"), F.col("parent")).alias("id"), F.lit("SubClassOf").alias("kind"), F.col("name").alias("a"), F.col("parent").alias("b"), none.alias("provenance"))
    more = build(spark, edge_types=[{"name": "below", "domain": ["Type"], "range": ["Type"], "inverse_of": "above"}, {"name": "sees", "iri": "urn:x/sees", "functional": True}], axioms=[("Transitive", "below"), ("Functional", "sees"), ("InverseOf", "below", "above")])
    return empty(spark).with_(nodes=nodes, edges=edges, node_types=types, edge_types=more.edge_types, axioms=axioms.unionByName(more.axioms))


_TYPE_UP = "WITH RECURSIVE " + PROCESSING["p3_found"][PROCESSING["p3_found"].index("names AS") : PROCESSING["p3_found"].index("c AS (SELECT DISTINCT lower")].rstrip().rstrip(",")
_TYPES = r"""types AS (SELECT name, min(regexp_replace(iri, '\s', '', 'g')) AS iri, max(description) AS description FROM node_types WHERE name IS NOT NULL GROUP BY name),
props AS (SELECT name, p.name AS key, min({'a': p.datatype, 'b': p.card_min, 'c': p.card_max}) AS m FROM (SELECT name, unnest(properties) AS p FROM node_types WHERE name IS NOT NULL) WHERE p.name IS NOT NULL GROUP BY name, p.name)"""
_CLOSURE = """walk(node, anc, depth) USING KEY (node, anc) AS (
  SELECT name, name, 0::BIGINT FROM names
  UNION
  SELECT w.node, u.parent, min(w.depth + 1) FROM walk w JOIN type_up u ON u.node = w.anc LEFT JOIN recurring.walk r ON r.node = w.node AND r.anc = u.parent
  WHERE r.depth IS NULL OR r.depth > w.depth + 1 GROUP BY w.node, u.parent)"""
_TID = lambda c: f"sha256('NodeId|urn:type/' || {c})"
_XSD = f"CASE x WHEN 'json' THEN '{iris.RDF_BASE}JSON' " + " ".join(f"WHEN '{n}' THEN '{iris.XSD_BASE}{v}'" for n, v in iris.XSD.items()) + " END"


def _prefixes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "node_types").where("name is not null and iri is not null")
    return rows.groupBy(F.regexp_extract("name", "^([^:]*):", 1).alias("prefix")).agg(F.min(F.regexp_extract("iri", "^.*[#/:]", 0)).alias("base"))


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "node_types").select(F.explode("supertypes").alias("ref")).where("ref is not null").distinct()


def _document_nodes(spark: SparkSession, sf: str) -> Ontology:
    d = table(spark, sf, "documents")
    iri = F.concat(F.lit("urn:doc/"), F.col("doc_id").cast("string"))
    nodes = d.select(node_id(iri).alias("id"), iri.alias("iri"), F.array(F.lit("Document")).alias("types"), properties_of(name=pv_of(F.col("text"), "string"), subject=pv_of(F.col("subject"), "iri"), lang=pv_of(F.col("lang"), "string"), raw=pv_of(F.encode("text", "UTF-8"), "bytes"), at=pv_of(F.col("written_at"), "date_time")).alias("properties"))
    return empty(spark).with_(nodes=nodes.select(*NODES.names))


def _iri_value(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes whose subject is the most frequent IRI, and not a text of the same letters."""
    top = table(spark, sf, "documents").where("subject is not null").groupBy("subject").count().orderBy(F.desc("count"), "subject").first()
    value = top["subject"] if top else ""
    graph = _document_nodes(spark, sf)
    as_text = match(graph, N.bind("n").with_property("subject", value))
    return match(graph, N.bind("n").with_property("subject", Iri(value))).unionByName(as_text)


def _documents_written(spark: SparkSession, sf: str) -> DataFrame:
    """Every literal of the documents, written as N-Triples and read again."""
    lines = rdf.ntriples_lines(rdf.node_triples(_document_nodes(spark, sf)))
    return rdf.parse_ntriples(lines).where("o_kind = 'literal'").select("s", F.regexp_extract("p", "[^#]*$", 0).alias("p"), "o", F.regexp_extract("datatype", "[^#]*$", 0).alias("datatype"))


def _types_of(graph: Ontology) -> DataFrame:
    return graph.node_types.select("name", "iri", F.concat_ws(",", F.array_sort("supertypes")).alias("supertypes"))


def _skos(spark: SparkSession, sf: str) -> Ontology:
    g = schema_graph(spark, sf)
    skos = importers._SKOS
    t = g.node_types.where("iri is not null").select("iri", "name", "supertypes", "description")
    up = t.select("iri", F.explode("supertypes").alias("up")).join(t.select(F.col("name").alias("up"), F.col("iri").alias("to")), "up")
    one = lambda df, p, o, kind: rdf._triples(df, F.col("iri"), F.lit(p), o, o_kind=F.lit(kind), datatype=F.when(F.lit(kind) == "literal", F.lit(rdf.STRING)))
    triples = one(t, rdf.TYPE, F.lit(skos + "Concept"), "iri").unionByName(one(t, skos + "prefLabel", F.col("name"), "literal")).unionByName(one(t.where("description is not null"), skos + "definition", F.col("description"), "literal")).unionByName(one(up, skos + "broader", F.col("to"), "iri"))
    return importers.import_skos(triples)[0]


def _people(spark: SparkSession, sf: str, base: str, person: str, name: str, link: str, target: str, more: str | None = None) -> DataFrame:
    """Triples of customers as people that are linked to their nation, which is only typed where ``target`` says so."""
    c = table(spark, sf, "customer").withColumn("s", F.concat(F.lit("urn:customer/"), "c_custkey")).withColumn("n", F.concat(F.lit("urn:nation/"), "c_nationkey"))
    t = rdf._triples(c, F.col("s"), F.lit(rdf.TYPE), F.lit(base + person))
    t = t.unionByName(rdf._triples(c, F.col("s"), F.lit(base + name), F.col("c_name"), o_kind=F.lit("literal"), datatype=F.lit(rdf.STRING)))
    t = t.unionByName(rdf._triples(c, F.col("s"), F.lit(base + link), F.col("n")))
    return t.unionByName(rdf._triples(c, F.col("s"), F.lit(base + (more or "unknown")), F.col("n")))


def _imported(graph: Ontology) -> DataFrame:
    nodes = graph.nodes.select(F.lit("node").alias("part"), "iri", F.concat_ws(",", "types").alias("what"), F.element_at("properties", F.lit("name"))["s"].alias("name"), F.lit(None).cast("string").alias("target"))
    return nodes.unionByName(graph.edges.select(F.lit("edge").alias("part"), F.col("source").alias("iri"), F.col("label").alias("what"), F.lit(None).cast("string").alias("name"), "target"))


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by a mapping of one's own: whole numbers, numbers, truth values and IRIs out of text."""
    b = "urn:m#"
    mapping = importers.Mapping({b + "P": "Piece"}, {b + "size": ("size", "integer", ("Piece",)), b + "price": ("price", "float", ("Piece",)), b + "large": ("large", "bool", ("Piece",)), b + "brand": ("brand", "iri", ("Piece",)), b + "kind": ("kind", "integer", ("Piece",))}, {}, None)
    p = table(spark, sf, "part").withColumn("s", F.concat(F.lit("urn:part/"), "p_partkey"))
    said = lambda k, v: rdf._triples(p.where(v.isNotNull()), F.col("s"), F.lit(b + k), v.cast("string"), o_kind=F.lit("literal"), datatype=F.lit(rdf.STRING))
    t = rdf._triples(p, F.col("s"), F.lit(rdf.TYPE), F.lit(b + "P"))
    for k, v in (("size", F.col("p_size")), ("price", F.col("p_retailprice")), ("large", F.col("p_size") > 25), ("brand", F.col("p_brand")), ("kind", F.col("p_type"))):
        t = t.unionByName(said(k, v))
    x = lambda k: F.element_at("properties", F.lit(k))
    n = importers.project(t, mapping).nodes
    return n.select("iri", x("size")["i"].alias("size"), x("price")["f"].alias("price"), x("large")["b"].alias("large"), x("brand")["t"].alias("brand_tag"), x("brand")["s"].alias("brand"), x("kind")["t"].alias("kind_tag"), x("kind")["s"].alias("kind"))


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Properties that the SHACL shapes of the schema have, written and read again; only types with an IRI."""
    g = schema_graph(spark, sf)
    back = shacl.from_shacl(spark, shacl.to_shacl(g.with_(node_types=g.node_types.where("iri is not null"))))
    return back.node_types.select("iri", F.explode("properties").alias("p")).select("iri", "p.name", "p.datatype", F.col("p.cardinality.min").alias("least"), F.col("p.cardinality.max").alias("most"))


def _values(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes of paths as property values."""
    a = table(spark, sf, "paths").select("path_id", F.explode("attributes").alias("k", "v")).where("v is not null")
    v = json_value(F.col("v"))
    return a.select("path_id", "k", v.alias("x")).where("x is not null").select("path_id", "k", F.col("x.t").alias("t"), F.when(F.col("x.t") != "json", F.col("x.s")).alias("s"), F.col("x.i").alias("i"), F.col("x.b").alias("b"))


def _relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations between names whose ends are both known."""
    surfaces = table(spark, sf, "nation").select(F.col("n_name").alias("surface"), node_id(F.concat(F.lit("urn:nation/"), "n_nationkey")).alias("id"))
    surfaces = surfaces.unionByName(table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_name").alias("surface"), node_id(F.concat(F.lit("urn:customer/"), "c_custkey")).alias("id")))
    rel = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).select(F.col("c_name").alias("source"), F.lit("livesIn").alias("label"), F.col("n_name").alias("target"))
    return relation_edges(rel, surfaces).select("id", "label", "source", "target")


TEXTS = (
    "MATCH (a:A) RETURN a", "MATCH (a:A) RETURN a extra", "MATCH (a)-[:r]-(b) RETURN b", "MATCH (a)<-[:r]->(b) RETURN b", "MATCH (a)-[*3..1]->(b) RETURN b", "MATCH (a", "SELECT * WHERE { ?x a :T }",
    "SELECT * WHERE { ?x a :T } trailing", "SELECT * WHERE { ?x ?p ?y }", "SELECT * WHERE { ?x a ?t }", "SELECT * WHERE { :s a :T }", "SELECT * WHERE { ?x a :T . ?y a :U }", "SELECT * WHERE { }", "# a comment\nSELECT ?x WHERE { ?x a <urn:t#T> }",
)


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of query texts: read, outside the subset, or broken."""
    rows = []
    for text in TEXTS:
        try:
            (cypher if text.startswith("MATCH") else sparql).parse(text)
            rows.append((text, "read"))
        except Unsupported:
            rows.append((text, "unsupported"))
        except QueryError:
            rows.append((text, "broken"))
    return spark.createDataFrame(rows, "text string, outcome string")


def _derived_axioms(spark: SparkSession, sf: str) -> DataFrame:
    """Axioms of the schema with all that follows, the derived ones under their activity."""
    return reason.materialize(schema_graph(spark, sf), reason.RuleSet(reason.STANDARD_AXIOM_RULES), "act")[0].axioms.select("kind", "a", "b", "provenance")


def _proposals(spark: SparkSession, sf: str) -> DataFrame:
    """For each name of a customer the node with that name: equal texts have equal vectors."""
    graph = tables_graph.read(spark, sf)
    people = graph.with_(nodes=graph.nodes.where("array_contains(types, 'Customer')"))
    index = ingest(people, HashEmbedding(16))
    names = table(spark, sf, "customer").select(F.col("c_name").alias("surface"))
    return propose(names, index, HashEmbedding(16), 1).select("surface", "key", F.round("score", 4).alias("score"))


_g = schema_graph
QUERIES = {
    "schema_triples": lambda spark, sf: rdf.schema_triples(_g(spark, sf)).select("s", "p", "o").distinct(),
    "axiom_triples": lambda spark, sf: rdf.axiom_triples(_g(spark, sf)).select("s", "p", "o"),
    "from_rdf_types": lambda spark, sf: _types_of(rdf.from_rdf(rdf.schema_triples(_g(spark, sf)))),
    "type_list": lambda spark, sf: store.list_classes(_g(spark, sf)),
    "edge_type_list": lambda spark, sf: store.list_edge_types(_g(spark, sf)),
    "type_closure": lambda spark, sf: store.type_closure(_g(spark, sf)).select("type", "above", F.col("depth").cast("bigint").alias("depth")),
    "type_properties": lambda spark, sf: _g(spark, sf).node_types.select("name", F.explode("properties").alias("p")).select("name", F.col("p.name").alias("key"), F.col("p.datatype").alias("datatype")),
    "type_cycles": lambda spark, sf: validate.subclass_cycle(_g(spark, sf)).select("severity", "code", "message"),
    "type_walk_loops": lambda spark, sf: traverse(_g(spark, sf), TraversalPlan(N.bind("a")).out(E.repeat(1, None), N.bind("b")), unordered=True),
    "type_walk_first_edge": lambda spark, sf: traverse(_g(spark, sf), TraversalPlan(N.bind("a")).in_(E.bind("e").labeled("below"), N.bind("b")), unordered=True),
    "type_materialize": _derived_axioms,
    "type_derived_sorted": lambda spark, sf: reason.run(_g(spark, sf), reason.RuleSet((reason.inverse_of_symmetry, reason.subclass_transitivity))).axioms.select("kind", "a", "b"),
    "curie_expand": lambda spark, sf: iris.expand_curies(table(spark, sf, "node_types").where("name is not null").select("name").distinct(), "name", _prefixes(spark, sf)),
    "ensure_iri": lambda spark, sf: _refs(spark, sf).select("ref", iris.ensure_iri(F.col("ref"), {"ex": "urn:ex#"}).alias("iri")),
    "is_iri": lambda spark, sf: _refs(spark, sf).select("ref", iris.is_iri(F.col("ref")).alias("fits")),
    "namespace_expand": lambda spark, sf: _refs(spark, sf).select(iris.expand("urn:n#", F.col("ref")).alias("iri")),
    "datatype_iri": lambda spark, sf: table(spark, sf, "node_types").select(F.explode("properties").alias("p")).select(F.col("p.datatype").alias("x")).distinct().select("x", iris.datatype_iri(F.col("x")).alias("iri"), iris.datatype_name(iris.datatype_iri(F.col("x"))).alias("back")),
    "hex_ids": lambda spark, sf: table(spark, sf, "commits").select("commit_id", is_id(F.col("commit_id")).alias("fits")).distinct(),
    "random_ids": lambda spark, sf: table(spark, sf, "customer").select(random_id().alias("id")).agg(F.countDistinct("id").alias("n"), F.min(is_id(F.col("id")).cast("int")).alias("fits")),
    "node_match_iri_tag": _iri_value,
    "node_match_id": lambda spark, sf: match(tables_graph.read(spark, sf), N.bind("n").with_id(_customer_seven())),
    "outbound": lambda spark, sf: store.outbound(tables_graph.read(spark, sf), _customer_seven()).select("id", "label", "target"),
    "inbound": lambda spark, sf: store.inbound(tables_graph.read(spark, sf), _customer_seven()).select("id", "label", "source"),
    "cypher_undirected": lambda spark, sf: traverse(tables_graph.read(spark, sf), cypher.parse("MATCH (c:Customer)-[:inNation]-(n:Nation) RETURN c, n"), unordered=True),
    "cypher_any_length": lambda spark, sf: traverse(tables_graph.read(spark, sf), cypher.parse("MATCH (c:Customer)-[*..2]->(x) RETURN c, x"), unordered=True),
    "cypher_from_two": lambda spark, sf: traverse(tables_graph.read(spark, sf), cypher.parse("MATCH (c:Customer)-[*2..]->(x) RETURN c, x"), unordered=True),
    "query_texts": _outcomes,
    "documents_written": _documents_written,
    "node_text_key": lambda spark, sf: tables_graph.read(spark, sf).nodes.select(F.coalesce("iri", "id").alias("key"), node_text().alias("text")),
    "import_skos": lambda spark, sf: _skos(spark, sf).nodes.select("iri", F.concat_ws(",", "types").alias("types"), *(F.element_at("properties", F.lit(k))["s"].alias(k) for k in ("prefLabel", "name", "definition"))),
    "import_skos_broader": lambda spark, sf: _skos(spark, sf).edges.select("label", "source", "target"),
    "import_foaf": lambda spark, sf: _imported(importers.import_foaf(_people(spark, sf, importers._FOAF, "Person", "name", "knows", "Person"))[0]),
    "import_schema_org": lambda spark, sf: _imported(importers.import_schema_org(_people(spark, sf, importers._SCHEMA, "Person", "name", "worksFor", "Organization", "memberOf"))[0]),
    "import_mapping": _mapped,
    "shacl_round_trip": _shapes,
    "reference_types": lambda spark, sf: reference_ontology(spark).node_types.select("name", F.concat_ws(",", "supertypes").alias("supertypes")),
    "json_values": _values,
    "relation_edges": _relations,
    "vector_propose": _proposals,
}


def _customer_seven() -> str:
    import hashlib

    return hashlib.sha256(b"NodeId|urn:customer/7").hexdigest()


_RDFS, _OWL = rdf.RDFS, rdf.OWL
_PAIR = "SELECT DISTINCT ref FROM (SELECT unnest(supertypes) AS ref FROM node_types) WHERE ref IS NOT NULL"
_LOCAL_NAME = lambda c: f"regexp_extract({c}, '[^#/:]*$')"
_C, _N, _R = ("sha256('NodeId|urn:customer/' || c_custkey)", "sha256('NodeId|urn:nation/' || c_nationkey)", "sha256('NodeId|urn:region/' || n_regionkey)")
_SKOS_TYPES = f"{_TYPE_UP}, {_TYPES}"
SQL = {
    "schema_triples": f"""{_TYPE_UP}, {_TYPES}, cls AS (SELECT name, coalesce(iri, CASE WHEN contains(name, ':') THEN name ELSE '{LOCAL}' || name END) AS c FROM types)
SELECT c AS s, '{rdf.TYPE}' AS p, '{_OWL}Class' AS o FROM cls UNION SELECT c, '{_RDFS}subClassOf', CASE WHEN contains(parent, ':') THEN parent ELSE '{LOCAL}' || parent END FROM cls JOIN type_up ON node = name
UNION SELECT '{LOCAL}' || key, '{rdf.TYPE}', '{_OWL}DatatypeProperty' FROM props UNION SELECT '{LOCAL}' || key, '{_RDFS}domain', c FROM props JOIN cls USING (name) UNION SELECT '{LOCAL}' || key, '{_RDFS}range', {_XSD} FROM (SELECT key, m.a AS x FROM props)
UNION SELECT * FROM (VALUES ('{LOCAL}below', '{rdf.TYPE}', '{_OWL}ObjectProperty'), ('{LOCAL}below', '{_OWL}inverseOf', '{LOCAL}above'), ('{LOCAL}below', '{_RDFS}domain', '{LOCAL}Type'), ('{LOCAL}below', '{_RDFS}range', '{LOCAL}Type'), ('urn:x/sees', '{rdf.TYPE}', '{_OWL}ObjectProperty'), ('urn:x/sees', '{rdf.TYPE}', '{_OWL}FunctionalProperty')) x(s, p, o)""",
    "axiom_triples": f"""{_TYPE_UP} SELECT node AS s, '{_RDFS}subClassOf' AS p, parent AS o FROM type_up
UNION ALL SELECT * FROM (VALUES ('{LOCAL}below', '{rdf.TYPE}', '{_OWL}TransitiveProperty'), ('{LOCAL}sees', '{rdf.TYPE}', '{_OWL}FunctionalProperty'), ('{LOCAL}below', '{_OWL}inverseOf', '{LOCAL}above')) x(s, p, o)""",
    "from_rdf_types": f"""{_TYPE_UP}, {_TYPES}, cls AS (SELECT name, coalesce(iri, name) AS c FROM types), l AS (
SELECT {_LOCAL_NAME('c')} AS name, c AS iri, CAST(NULL AS VARCHAR) AS up FROM cls UNION SELECT {_LOCAL_NAME('c')}, c, {_LOCAL_NAME('parent')} FROM cls JOIN type_up ON node = name)
SELECT name, min(iri) AS iri, coalesce(string_agg(DISTINCT up, ',' ORDER BY up), '') AS supertypes FROM l GROUP BY name""",
    "type_list": "SELECT DISTINCT name FROM node_types WHERE name IS NOT NULL",
    "edge_type_list": "SELECT unnest(['below', 'sees']) AS name",
    "type_closure": f"{_TYPE_UP}, {_CLOSURE} SELECT node AS type, anc AS above, depth FROM walk",
    "type_properties": f"{_TYPE_UP}, {_TYPES} SELECT name, key, m.a AS datatype FROM props",
    "type_cycles": f"{_TYPE_UP}, {_CLOSURE} SELECT DISTINCT 'error' AS severity, 'axiom.subclass.cycle' AS code, 'the subclass relation leads back to ' || w.node AS message FROM walk w JOIN type_up u ON u.node = w.anc AND u.parent = w.node",
    "type_walk_loops": f"{_TYPE_UP}, {_CLOSURE} SELECT {_TID('node')} AS a, {_TID('anc')} AS b FROM walk WHERE node <> anc",
    "type_walk_first_edge": f"{_TYPE_UP} SELECT {_TID('parent')} AS a, {_TID('node')} AS b, sha256('EdgeId|' || {_TID('node')} || '|below|' || {_TID('parent')}) AS e FROM type_up WHERE node <> parent",
    "type_materialize": f"""{_TYPE_UP}, {_CLOSURE}, given AS (SELECT 'SubClassOf' AS kind, node AS a, parent AS b FROM type_up UNION ALL SELECT 'Transitive', 'below', NULL UNION ALL SELECT 'Functional', 'sees', NULL UNION ALL SELECT 'InverseOf', 'below', 'above')
SELECT kind, a, b, CAST(NULL AS VARCHAR) AS provenance FROM given UNION ALL SELECT 'InverseOf', 'above', 'below', 'act' UNION ALL SELECT 'SubClassOf', node, anc, 'act' FROM walk WHERE node <> anc AND (node, anc) NOT IN (SELECT a, b FROM given WHERE kind = 'SubClassOf')""",
    "type_derived_sorted": f"{_TYPE_UP}, {_CLOSURE} SELECT 'InverseOf' AS kind, 'above' AS a, 'below' AS b UNION ALL SELECT 'SubClassOf', node, anc FROM walk WHERE node <> anc AND (node, anc) NOT IN (SELECT node, parent FROM type_up)",
    "curie_expand": "WITH b AS (SELECT regexp_extract(name, '^([^:]*):', 1) AS prefix, min(regexp_extract(iri, '^.*[#/:]')) AS base FROM node_types WHERE name IS NOT NULL AND iri IS NOT NULL GROUP BY 1) SELECT name, base || regexp_replace(name, '^[^:]*:', '') AS iri FROM (SELECT DISTINCT name FROM node_types WHERE name IS NOT NULL) LEFT JOIN b ON contains(name, ':') AND regexp_extract(name, '^([^:]*):', 1) = prefix",
    "ensure_iri": f"SELECT ref, CASE WHEN starts_with(ref, 'ex:') THEN 'urn:ex#' || substr(ref, 4) WHEN contains(ref, ':') THEN ref ELSE '{LOCAL}' || ref END AS iri FROM ({_PAIR})",
    "is_iri": rf"SELECT ref, length(ref) > 0 AND NOT regexp_matches(ref, '[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]') AS fits FROM ({_PAIR})",
    "namespace_expand": f"SELECT 'urn:n#' || ref AS iri FROM ({_PAIR})",
    "datatype_iri": f"SELECT DISTINCT x, {_XSD} AS iri, CASE WHEN {_XSD} IS NULL THEN 'string' ELSE x END AS back FROM (SELECT p.datatype AS x FROM (SELECT unnest(properties) AS p FROM node_types))",
    "hex_ids": "SELECT DISTINCT commit_id, coalesce(regexp_full_match(commit_id, '[0-9a-fA-F]{64}'), false) AS fits FROM commits",
    "random_ids": "SELECT count(*) AS n, 1 AS fits FROM customer",
    "node_match_iri_tag": "SELECT sha256('NodeId|urn:doc/' || doc_id) AS n FROM documents WHERE subject = (SELECT subject FROM documents WHERE subject IS NOT NULL GROUP BY subject ORDER BY count(*) DESC, subject LIMIT 1)",
    "node_match_id": f"SELECT {_C} AS n FROM customer WHERE c_custkey = 7",
    "outbound": f"WITH {GRAPH} SELECT sha256('EdgeId|' || s || '|' || label || '|' || t) AS id, label, t AS target FROM g WHERE si = 'urn:customer/7'",
    "inbound": f"WITH {GRAPH} SELECT sha256('EdgeId|' || s || '|' || label || '|' || t) AS id, label, s AS source FROM g WHERE ti = 'urn:customer/7'",
    "cypher_undirected": f"SELECT {_C} AS c, {_N} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "cypher_any_length": f"SELECT {_C} AS c, {_N} AS x FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT {_C}, {_R} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "cypher_from_two": f"SELECT {_C} AS c, {_R} AS x FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "query_texts": "SELECT * FROM (VALUES " + ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', '{o}')" for t, o in zip(TEXTS, ("read", "broken", "read", "unsupported", "broken", "broken", "read", "broken", "unsupported", "unsupported", "unsupported", "unsupported", "broken", "read"), strict=True)) + ") x(text, outcome)",
    "documents_written": """SELECT 'urn:doc/' || doc_id AS s, 'name' AS p, text AS o, 'string' AS datatype FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'urn:doc/' || doc_id, 'lang', lang, 'string' FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT 'urn:doc/' || doc_id, 'raw', base64(encode(text)), 'base64Binary' FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'urn:doc/' || doc_id, 'at', strftime(written_at, '%Y-%m-%dT%H:%M:%SZ'), 'dateTime' FROM documents WHERE written_at IS NOT NULL""",
    "node_text_key": f"WITH {GRAPH} SELECT iri AS key, coalesce(list_filter(p, lambda x: x.k = 'name')[1].v, {_LOCAL_NAME('iri')}) AS text FROM n",
    "import_skos": f"{_SKOS_TYPES} SELECT iri, 'Concept' AS types, max(name) AS prefLabel, max(name) AS name, max(description) AS definition FROM types WHERE iri IS NOT NULL GROUP BY iri",
    "import_skos_broader": f"{_SKOS_TYPES} SELECT DISTINCT 'broader' AS label, sha256('NodeId|' || a.iri) AS source, sha256('NodeId|' || b.iri) AS target FROM type_up JOIN types a ON a.name = node JOIN types b ON b.name = parent WHERE a.iri IS NOT NULL AND b.iri IS NOT NULL",
    "import_foaf": f"""SELECT 'node' AS part, 'urn:customer/' || c_custkey AS iri, 'Person' AS what, c_name AS name, CAST(NULL AS VARCHAR) AS target FROM customer UNION ALL SELECT DISTINCT 'node', 'urn:nation/' || c_nationkey, 'Person', NULL, NULL FROM customer
UNION ALL SELECT 'edge', {_C}, 'knows', NULL, {_N} FROM customer""",
    "import_schema_org": f"""SELECT 'node' AS part, 'urn:customer/' || c_custkey AS iri, 'Person' AS what, c_name AS name, CAST(NULL AS VARCHAR) AS target FROM customer UNION ALL SELECT DISTINCT 'node', 'urn:nation/' || c_nationkey, 'Organization', NULL, NULL FROM customer
UNION ALL SELECT 'edge', {_C}, unnest(['worksFor', 'memberOf']), NULL, {_N} FROM customer""",
    "import_mapping": "SELECT 'urn:part/' || p_partkey AS iri, CAST(p_size AS BIGINT) AS size, CAST(p_retailprice AS DOUBLE) AS price, p_size > 25 AS large, CASE WHEN p_brand IS NULL THEN NULL WHEN contains(p_brand, ' ') THEN 'string' ELSE 'iri' END AS brand_tag, p_brand AS brand, CASE WHEN p_type IS NOT NULL THEN 'string' END AS kind_tag, p_type AS kind FROM part",
    "shacl_round_trip": f"{_TYPE_UP}, {_TYPES} SELECT iri, key AS name, CASE WHEN m.a = 'json' OR m.a IS NULL THEN 'string' ELSE m.a END AS datatype, coalesce(m.b, 0) AS least, m.c AS most FROM props JOIN types USING (name) WHERE iri IS NOT NULL",
    "reference_types": "SELECT * FROM (VALUES ('Organization', ''), ('FormalOrganization', 'Organization'), ('OrganizationalUnit', 'Organization'), ('Person', ''), ('Role', ''), ('Post', ''), ('Site', ''), ('Membership', '')) x(name, supertypes)",
    "json_values": """SELECT path_id, k, CASE j WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'json' END AS t, CASE WHEN j = 'VARCHAR' THEN json_extract_string(v, '$') END AS s,
  CASE WHEN j IN ('UBIGINT', 'BIGINT') THEN CAST(v AS BIGINT) END AS i, CASE WHEN j = 'BOOLEAN' THEN v = 'true' END AS b
FROM (SELECT path_id, e.key AS k, e.value AS v, json_type(e.value) AS j FROM (SELECT path_id, unnest(map_entries(attributes)) AS e FROM paths) WHERE e.value IS NOT NULL AND json_valid(e.value))""",
    "relation_edges": f"SELECT sha256('EdgeId|' || {_C} || '|livesIn|' || {_N}) AS id, 'livesIn' AS label, {_C} AS source, {_N} AS target FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0",
    "vector_propose": "SELECT c_name AS surface, 'urn:customer/' || c_custkey AS key, 1.0::DOUBLE AS score FROM customer",
}
