"""Queries on the graph of the relational tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.iri import local_name
from graphloom.functions.vectors import cosine_similarity, nearest
from graphloom.model import Ontology, axiom_id, build, edge_id, node_id, properties_of, pv_of
from graphloom.operators import reason, store, validate
from graphloom.plans import cypher, sparql
from graphloom.plans.compile import match, traverse
from graphloom.plans.pattern import EdgePattern, NodePattern, TraversalPlan
from graphloom.queries.tables import table
from graphloom.sources import rdf, tables_graph

N, E = NodePattern(), EdgePattern()


def _graph(spark: SparkSession, sf: str) -> Ontology:
    return tables_graph.read(spark, sf)


def _walk(plan: TraversalPlan):
    return lambda spark, sf: traverse(_graph(spark, sf), plan, unordered=plan.limited is None)


def _id(kind: str, key: str) -> str:
    return f"sha256('NodeId|urn:{kind}/' || {key})"


def _edge(source: str, label: str, target: str) -> str:
    return f"sha256('EdgeId|' || {source} || '|{label}|' || {target})"


# matching and walking

customer = N.bind("c").typed("Customer")
region = N.bind("r").typed("Region").with_property("name", "ASIA")
hub = TraversalPlan(N.bind("r").typed("Region"))
QUERIES = {
    "node_match_type": lambda spark, sf: match(_graph(spark, sf), N.bind("n").typed("Supplier"), unordered=True),
    "node_match_property": lambda spark, sf: match(_graph(spark, sf), customer.with_property("mktsegment", "BUILDING"), unordered=True),
    "node_match_integer": lambda spark, sf: match(_graph(spark, sf), N.bind("p").typed("Part").with_property("size", 15), unordered=True),
    "node_match_or": lambda spark, sf: match(_graph(spark, sf), N.bind("n").or_(N.typed("Nation")).or_(N.typed("Customer").with_property("mktsegment", "MACHINERY")), unordered=True),
    "node_match_not": lambda spark, sf: match(_graph(spark, sf), customer.not_(N.with_property("mktsegment", "BUILDING")).not_(N.with_property("mktsegment", "MACHINERY")), unordered=True),
    "hop_outbound": _walk(TraversalPlan(customer).out(E.labeled("inNation"), N.bind("n").typed("Nation"))),
    "hop_inbound": _walk(TraversalPlan(N.bind("n").typed("Nation")).in_(E.labeled("inNation"), N.bind("s").typed("Supplier"))),
    "two_hop_chain": _walk(TraversalPlan(N.bind("o").typed("Order")).out(E.labeled("placedBy"), customer).out(E.labeled("inNation"), N.bind("n"))),
    "edge_binding": _walk(TraversalPlan(N.bind("n").typed("Nation")).out(E.bind("e").labeled("inRegion"), N.bind("r"))),
    "edge_binding_any_label": _walk(TraversalPlan(N.bind("o").typed("Order")).out(E.bind("e"), N.bind("x").typed("Supplier"))),
    "var_path_1_3": _walk(TraversalPlan(region).in_(E.repeat(1, 3), N.bind("x"))),
    "var_path_min0": _walk(TraversalPlan(N.bind("n").typed("Nation")).out(E.labeled("inRegion").repeat(0, 1), N.bind("x"))),
    "var_path_unbounded": _walk(TraversalPlan(N.bind("s").typed("Supplier")).out(E.repeat(1, None), N.bind("x"))),
    "cypher_asia_customers": _walk(cypher.parse('MATCH (c:Customer)-[:inNation]->(n:Nation)-[:inRegion]->(r:Region {name:"ASIA"}) RETURN c, n')),
    "cypher_where_not": _walk(cypher.parse('MATCH (c:Customer)-[:inNation]->(n:Nation) WHERE NOT (c:Customer {mktsegment: "BUILDING"}) RETURN c')),
    "cypher_path_length": _walk(cypher.parse("MATCH (r:Region)<-[*2..2]-(c:Customer) RETURN r, c")),
    "sparql_chain": _walk(sparql.parse("PREFIX t: <urn:t#> SELECT ?o ?n WHERE { ?o a t:Order ; t:placedBy ?c . ?c t:inNation ?n . ?n a t:Nation }")),
    "sparql_type_triple": _walk(sparql.parse("SELECT * WHERE { ?x a :Part }")),
    "order_skip_limit": _walk(TraversalPlan(customer).out(E.labeled("inNation"), N.bind("n")).order_by_desc("n").order_by("c").skip(20).limit(30).return_("c", "n")),
    "projection_bag": _walk(TraversalPlan(customer).out(E.labeled("inNation"), N.bind("n")).return_("n")),
    "point_lookup": lambda spark, sf: store.node(_graph(spark, sf), _sha("NodeId|urn:customer/7")).select("id", "iri"),
    "graph_counts": lambda spark, sf: store.counts(_graph(spark, sf)),
    "count_instances": lambda spark, sf: store.count_instances(_graph(spark, sf), "Customer"),
}


def _sha(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


_ALL_EDGES = f"""g AS (
  SELECT {_id('nation', 'n_nationkey')} AS s, {_id('region', 'n_regionkey')} AS t, 'inRegion' AS label FROM nation
  UNION SELECT {_id('customer', 'c_custkey')}, {_id('nation', 'c_nationkey')}, 'inNation' FROM customer
  UNION SELECT {_id('supplier', 's_suppkey')}, {_id('nation', 's_nationkey')}, 'inNation' FROM supplier
  UNION SELECT {_id('order', 'o_orderkey')}, {_id('customer', 'o_custkey')}, 'placedBy' FROM orders
  UNION SELECT {_id('order', 'l_orderkey')}, {_id('part', 'l_partkey')}, 'contains' FROM lineitem
  UNION SELECT {_id('order', 'l_orderkey')}, {_id('supplier', 'l_suppkey')}, 'suppliedBy' FROM lineitem)"""
_CUSTOMER, _NATION, _REGION = _id("customer", "c_custkey"), _id("nation", "n_nationkey"), _id("region", "r_regionkey")
SQL = {
    "node_match_type": f"SELECT {_id('supplier', 's_suppkey')} AS n FROM supplier",
    "node_match_property": f"SELECT {_CUSTOMER} AS c FROM customer WHERE c_mktsegment = 'BUILDING'",
    "node_match_integer": f"SELECT {_id('part', 'p_partkey')} AS p FROM part WHERE p_size = 15",
    "node_match_or": f"SELECT {_NATION} AS n FROM nation UNION ALL SELECT {_CUSTOMER} FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "node_match_not": f"SELECT {_CUSTOMER} AS c FROM customer WHERE coalesce(c_mktsegment, '') NOT IN ('BUILDING', 'MACHINERY')",
    "hop_outbound": f"SELECT {_CUSTOMER} AS c, {_NATION} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "hop_inbound": f"SELECT {_NATION} AS n, {_id('supplier', 's_suppkey')} AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "two_hop_chain": f"SELECT {_id('order', 'o_orderkey')} AS o, {_CUSTOMER} AS c, {_NATION} AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "edge_binding": f"SELECT {_NATION} AS n, {_REGION} AS r, {_edge(_NATION, 'inRegion', _REGION)} AS e FROM nation JOIN region ON n_regionkey = r_regionkey",
    "edge_binding_any_label": f"SELECT DISTINCT {_id('order', 'l_orderkey')} AS o, {_id('supplier', 'l_suppkey')} AS x, {_edge(_id('order', 'l_orderkey'), 'suppliedBy', _id('supplier', 'l_suppkey'))} AS e FROM lineitem",
    "var_path_1_3": f"""WITH {_ALL_EDGES}, l0 AS (SELECT {_REGION} AS r FROM region WHERE r_name = 'ASIA'), l1 AS (SELECT DISTINCT r, s AS x FROM l0 JOIN g ON t = r),
l2 AS (SELECT DISTINCT r, s AS x FROM l1 JOIN g ON t = x), l3 AS (SELECT DISTINCT r, s AS x FROM l2 JOIN g ON t = x)
SELECT r, x FROM l1 UNION SELECT r, x FROM l2 UNION SELECT r, x FROM l3""",
    "var_path_min0": f"SELECT {_NATION} AS n, {_NATION} AS x FROM nation UNION ALL SELECT {_NATION}, {_REGION} FROM nation JOIN region ON n_regionkey = r_regionkey",
    "var_path_unbounded": f"SELECT {_id('supplier', 's_suppkey')} AS s, {_NATION} AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT {_id('supplier', 's_suppkey')}, {_REGION} FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "cypher_asia_customers": f"SELECT {_CUSTOMER} AS c, {_NATION} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "cypher_where_not": f"SELECT {_CUSTOMER} AS c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'BUILDING'",
    "cypher_path_length": f"SELECT {_REGION} AS r, {_CUSTOMER} AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "sparql_chain": f"SELECT {_id('order', 'o_orderkey')} AS o, {_NATION} AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "sparql_type_triple": f"SELECT {_id('part', 'p_partkey')} AS x FROM part",
    "order_skip_limit": f"SELECT {_CUSTOMER} AS c, {_NATION} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY n DESC, c LIMIT 30 OFFSET 20",
    "projection_bag": f"SELECT {_NATION} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "point_lookup": f"SELECT {_CUSTOMER} AS id, 'urn:customer/' || c_custkey AS iri FROM customer WHERE c_custkey = 7",
    "graph_counts": f"""WITH {_ALL_EDGES} SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS node_count, (SELECT count(*) FROM g) AS edge_count""",
    "count_instances": "SELECT count(*) AS instances FROM customer",
}

# changing: two states of the customers, the second without the first segment and with balances raised


def _states(spark: SparkSession, sf: str) -> tuple[Ontology, Ontology]:
    graph = _graph(spark, sf)
    one = graph.nodes.where(F.array_contains("types", "Customer"))
    segment, balance = F.element_at("properties", F.lit("mktsegment"))["s"], F.element_at("properties", F.lit("acctbal"))["f"]
    raised = F.map_concat(F.map_filter("properties", lambda k, v: k != "acctbal"), properties_of(acctbal=pv_of(balance + 1, "float"), checked=pv_of(F.lit(True), "bool")))
    two = one.where(segment != "BUILDING").withColumn("properties", F.when(segment == "MACHINERY", raised).otherwise(F.col("properties"))).withColumn("types", F.when(segment == "MACHINERY", F.array(F.lit("Checked"), F.lit("Customer"))).otherwise(F.col("types")))
    return graph.with_(nodes=one.where(segment != "HOUSEHOLD"), edges=graph.edges.where("label = 'inNation'")), graph.with_(nodes=two, edges=graph.edges.where("label = 'inRegion'"))


def _flat(nodes: DataFrame) -> DataFrame:
    p = lambda k: F.element_at("properties", F.lit(k))
    return nodes.select("id", "iri", F.concat_ws(",", "types").alias("types"), p("name")["s"].alias("name"), F.round(p("acctbal")["f"], 2).alias("acctbal"), p("checked")["b"].alias("checked"))


QUERIES |= {
    "store_diff": lambda spark, sf: store.diff(*_states(spark, sf)),
    "upsert_replace": lambda spark, sf: _flat(store.upsert(*(g.nodes for g in _states(spark, sf)))),
    "merge_union": lambda spark, sf: _flat(store.merge(*_states(spark, sf)).nodes),
    "node_merge_policy": lambda spark, sf: _flat(store.reconcile_nodes(*(g.nodes for g in _states(spark, sf)), "merge")),
    "skip_existing": lambda spark, sf: _flat(store.reconcile_nodes(*(g.nodes for g in _states(spark, sf)), "skip_existing")),
}
_OLD = f"SELECT {_CUSTOMER} AS id, 'urn:customer/' || c_custkey AS iri, 'Customer' AS types, c_name AS name, round(c_acctbal, 2) AS acctbal, CAST(NULL AS BOOLEAN) AS checked FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'"
_NEW = f"SELECT {_CUSTOMER} AS id, 'urn:customer/' || c_custkey AS iri, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Checked,Customer' ELSE 'Customer' END AS types, c_name AS name, round(c_acctbal + CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END, 2) AS acctbal, CASE WHEN c_mktsegment = 'MACHINERY' THEN true END AS checked FROM customer WHERE c_mktsegment <> 'BUILDING'"
SQL |= {
    "store_diff": f"""WITH {_ALL_EDGES}, a AS ({_OLD}), b AS ({_NEW})
SELECT 'nodes' AS part, 'added' AS change, id FROM a ANTI JOIN b USING (id) UNION ALL SELECT 'nodes', 'removed', id FROM b ANTI JOIN a USING (id)
UNION ALL SELECT 'edges', CASE label WHEN 'inNation' THEN 'added' ELSE 'removed' END, sha256('EdgeId|' || s || '|' || label || '|' || t) FROM g WHERE label IN ('inNation', 'inRegion')""",
    "upsert_replace": f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT * FROM b UNION ALL SELECT * FROM a ANTI JOIN b USING (id)",
    "merge_union": f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT * FROM a UNION ALL SELECT * FROM b ANTI JOIN a USING (id)",
    "node_merge_policy": f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT b.id, b.iri, CASE WHEN a.id IS NOT NULL AND b.checked THEN 'Customer,Checked' ELSE b.types END AS types, b.name, b.acctbal, b.checked FROM b LEFT JOIN a USING (id)",
    "skip_existing": f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT * FROM b ANTI JOIN a USING (id)",
}

# validation: a schema that the tables break in known ways

_TEXT = {"name": "name", "datatype": "string", "cardinality": (1, 1)}


def _strict(spark: SparkSession, sf: str) -> Ontology:
    rules = build(
        spark,
        node_types=[
            {"name": "Agent", "properties": [_TEXT]},
            {"name": "Customer", "supertypes": ["Agent"], "properties": [_TEXT, {"name": "acctbal", "datatype": "float", "cardinality": (0, 1)}]},
            {"name": "Supplier", "supertypes": ["Company"], "properties": [{"name": "mktsegment", "datatype": "string", "cardinality": (1, 1)}]},
            {"name": "Part", "properties": [{"name": "size", "datatype": "string", "cardinality": (0, 1)}]},
            {"name": "Nation", "properties": [{"name": "name", "datatype": "string", "cardinality": (0, 0)}]},
        ],
        edge_types=[{"name": "inNation", "domain": ["Agent"], "range": ["Nation"]}, {"name": "placedBy", "domain": ["Order"], "range": ["Supplier", "Company"]}],
        axioms=[("Functional", "contains"), ("DisjointWith", "Nation", "Vip"), ("SubClassOf", "A", "B"), ("SubClassOf", "B", "C"), ("SubClassOf", "C", "A"), ("SubClassOf", "D", "A"), ("SubClassOf", "S", "S")],
    )
    graph = _graph(spark, sf)
    rich = F.coalesce(F.element_at("properties", F.lit("acctbal"))["f"] > 9000, F.lit(False))
    vip = graph.nodes.withColumn("types", F.when(F.array_contains("types", "Nation") | rich, F.concat("types", F.array(F.lit("Vip")))).otherwise(F.col("types")))
    return graph.with_(nodes=vip, node_types=rules.node_types, edge_types=rules.edge_types, axioms=rules.axioms)


def _check(check):
    return lambda spark, sf: check(_strict(spark, sf)).select("severity", "code", "focus")


QUERIES |= {
    "validate_cardinality": _check(validate.cardinality),
    "validate_datatype": _check(validate.datatype),
    "validate_domain": _check(validate.domain),
    "validate_range": _check(validate.range_),
    "validate_disjoint": _check(validate.disjoint),
    "validate_functional": _check(validate.functional),
    "validate_cycle": lambda spark, sf: validate.subclass_cycle(_strict(spark, sf)).select("severity", "code", "message"),
    "validate_all": lambda spark, sf: validate.validate(_strict(spark, sf)).groupBy("severity", "code").agg(F.count("*").alias("n")),
    "supertypes_of": lambda spark, sf: store.supertypes_of(_strict(spark, sf), "Customer").select("name", F.col("depth").cast("bigint").alias("depth")),
    "list_classes": lambda spark, sf: store.list_classes(_strict(spark, sf)),
}
_CARD = f"SELECT {_id('supplier', 's_suppkey')} AS focus FROM supplier UNION ALL SELECT {_NATION} FROM nation"
_SIZE = f"SELECT {_id('part', 'p_partkey')} AS focus FROM part WHERE p_size IS NOT NULL"
_DOMAIN = f"SELECT {_edge(_id('supplier', 's_suppkey'), 'inNation', _id('nation', 's_nationkey'))} AS focus FROM supplier"
_RANGE = f"SELECT {_edge(_id('order', 'o_orderkey'), 'placedBy', _id('customer', 'o_custkey'))} AS focus FROM orders JOIN customer ON o_custkey = c_custkey"
_FUNCTIONAL = f"WITH e AS (SELECT DISTINCT {_id('order', 'l_orderkey')} AS s, {_edge(_id('order', 'l_orderkey'), 'contains', _id('part', 'l_partkey'))} AS id FROM lineitem) SELECT id AS focus FROM e QUALIFY row_number() OVER (PARTITION BY s ORDER BY id) > 1"
_finding = lambda severity, code, sql: f"SELECT '{severity}' AS severity, '{code}' AS code, focus FROM ({sql})"
SQL |= {
    "validate_cardinality": _finding("error", "cardinality.violation", _CARD),
    "validate_datatype": _finding("warning", "datatype.mismatch", _SIZE),
    "validate_domain": _finding("error", "edge.domain", _DOMAIN),
    "validate_range": _finding("error", "edge.range", _RANGE),
    "validate_disjoint": _finding("error", "axiom.disjoint", f"SELECT {_NATION} AS focus FROM nation"),
    "validate_functional": _finding("error", "axiom.functional", _FUNCTIONAL),
    "validate_cycle": "SELECT 'error' AS severity, 'axiom.subclass.cycle' AS code, 'the subclass relation leads back to ' || x AS message FROM (VALUES ('A'), ('B'), ('C'), ('S')) t(x)",
    "validate_all": f"""SELECT severity, code, count(*) AS n FROM (
{_finding('error', 'cardinality.violation', _CARD)} UNION ALL {_finding('warning', 'datatype.mismatch', _SIZE)} UNION ALL {_finding('error', 'edge.domain', _DOMAIN)} UNION ALL {_finding('error', 'edge.range', _RANGE)}
UNION ALL {_finding('error', 'axiom.disjoint', f'SELECT {_NATION} AS focus FROM nation')} UNION ALL {_finding('error', 'axiom.functional', _FUNCTIONAL)} UNION ALL SELECT 'error', 'axiom.subclass.cycle', NULL FROM range(4)) GROUP BY severity, code""",
    "supertypes_of": "SELECT * FROM (VALUES ('Customer', 0::BIGINT), ('Agent', 1::BIGINT)) t(name, depth)",
    "list_classes": "SELECT unnest(['Agent', 'Customer', 'Nation', 'Part', 'Supplier']) AS name",
}

# reasoning


def _axioms(df: DataFrame, kind: str) -> DataFrame:
    return df.select(axiom_id(F.lit(kind), F.col("a"), F.col("b")).alias("id"), F.lit(kind).alias("kind"), "a", "b", F.lit(None).cast("string").alias("provenance"))


def _with_axioms(spark: SparkSession, sf: str, *axioms: tuple) -> Ontology:
    return _graph(spark, sf).with_(axioms=build(spark, axioms=list(axioms)).axioms)


def subclass_closure(spark: SparkSession, sf: str) -> DataFrame:
    """SubClassOf axioms that follow from those between nations, regions and the world."""
    nation = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    world = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("a"), F.lit("world").alias("b"))
    customers = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
    graph = _graph(spark, sf)
    rules = reason.RuleSet(reason.STANDARD_AXIOM_RULES)
    return reason.run(graph.with_(axioms=_axioms(nation.unionByName(world).unionByName(customers), "SubClassOf")), rules).axioms.select("kind", "a", "b")


def equivalence_closure(spark: SparkSession, sf: str) -> DataFrame:
    """What follows from nations being equivalent to the next one of their region."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    pairs = n.alias("x").join(n.alias("y"), F.expr("x.n_regionkey = y.n_regionkey and x.n_nationkey < y.n_nationkey")).groupBy("x.n_nationkey").agg(F.min("y.n_nationkey").alias("next"))
    rows = pairs.select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("n"), "next").alias("b"))
    return reason.run(_graph(spark, sf).with_(axioms=_axioms(rows, "EquivalentClass")), reason.RuleSet(reason.STANDARD_AXIOM_RULES)).axioms.select("kind", "a", "b")


def _derived(spark: SparkSession, sf: str, *axioms: tuple) -> DataFrame:
    graph = _with_axioms(spark, sf, *axioms)
    graph = graph.with_(edges=graph.edges.where("label in ('inNation', 'inRegion')"))
    return reason.run(graph).edges.select("label", "source", "target")


def property_transitivity(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that follow if all places count as one transitive relation."""
    graph = _with_axioms(spark, sf, ("Transitive", "within"))
    edges = graph.edges.where("label in ('inNation', 'inRegion')").withColumn("label", F.lit("within"))
    edges = edges.withColumn("id", edge_id(F.col("source"), F.col("label"), F.col("target")))
    return reason.run(graph.with_(edges=edges)).edges.select("id", "label", "source", "target")


QUERIES |= {
    "subclass_closure": subclass_closure,
    "equivalence_closure": equivalence_closure,
    "property_symmetry": lambda spark, sf: _derived(spark, sf, ("Symmetric", "inRegion")),
    "inverse_materialize": lambda spark, sf: _derived(spark, sf, ("InverseOf", "inNation", "hasResident")),
    "property_transitivity": property_transitivity,
}
_C_N = "SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer"
_EQUIVALENT = "SELECT 'n' || x.n_nationkey AS a, 'n' || min(y.n_nationkey) AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey GROUP BY x.n_nationkey"
SQL |= {
    "subclass_closure": "SELECT 'SubClassOf' AS kind, 'n' || n_nationkey AS a, 'world' AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'SubClassOf', 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'SubClassOf', 'c' || c_custkey, 'world' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "equivalence_closure": f"""WITH e AS ({_EQUIVALENT}) SELECT 'EquivalentClass' AS kind, b AS a, a AS b FROM e
UNION ALL SELECT 'SubClassOf', 'n' || x.n_nationkey, 'n' || y.n_nationkey FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey""",
    "property_symmetry": f"SELECT 'inRegion' AS label, {_REGION} AS source, {_NATION} AS target FROM nation JOIN region ON n_regionkey = r_regionkey",
    "inverse_materialize": f"SELECT 'hasResident' AS label, t AS source, s AS target FROM (SELECT {_CUSTOMER} AS s, {_id('nation', 'c_nationkey')} AS t FROM customer UNION ALL SELECT {_id('supplier', 's_suppkey')}, {_id('nation', 's_nationkey')} FROM supplier)",
    "property_transitivity": f"""SELECT {_edge('s', 'within', 't')} AS id, 'within' AS label, s AS source, t AS target FROM (
SELECT {_CUSTOMER} AS s, {_id('region', 'n_regionkey')} AS t FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT {_id('supplier', 's_suppkey')}, {_id('region', 'n_regionkey')} FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
}

# RDF, names and vectors

QUERIES |= {
    "to_rdf_edges": lambda spark, sf: rdf.edge_triples(_graph(spark, sf)).select("s", "p", "o"),
    "local_name": lambda spark, sf: _types(spark, sf).select("name", local_name(F.col("iri")).alias("local")),
    "vector_topk": lambda spark, sf: _vectors(spark, sf, 5),
    "vector_cosine": lambda spark, sf: _cosine(spark, sf),
}


def _types(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "node_types").where("name is not null and iri is not null").select("name", "iri").distinct()


def _vectors(spark: SparkSession, sf: str, k: int) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(e.where("id % 20 = 0"), e, k).select("query", "id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _cosine(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return e.select("vec_id", F.round(cosine_similarity(F.col("embedding"), F.reverse("embedding")).cast("double"), 5).alias("score"))


_LOCAL = "urn:graphloom:local#"
SQL |= {
    "to_rdf_edges": f"""SELECT 'urn:nation/' || n_nationkey AS s, '{_LOCAL}inRegion' AS p, 'urn:region/' || n_regionkey AS o FROM nation
UNION ALL SELECT 'urn:customer/' || c_custkey, '{_LOCAL}inNation', 'urn:nation/' || c_nationkey FROM customer UNION ALL SELECT 'urn:supplier/' || s_suppkey, '{_LOCAL}inNation', 'urn:nation/' || s_nationkey FROM supplier
UNION ALL SELECT 'urn:order/' || o_orderkey, '{_LOCAL}placedBy', 'urn:customer/' || o_custkey FROM orders
UNION ALL SELECT DISTINCT 'urn:order/' || l_orderkey, '{_LOCAL}contains', 'urn:part/' || l_partkey FROM lineitem UNION ALL SELECT DISTINCT 'urn:order/' || l_orderkey, '{_LOCAL}suppliedBy', 'urn:supplier/' || l_suppkey FROM lineitem""",
    "local_name": "SELECT name, regexp_extract(iri, '[^#/:]*$') AS local FROM (SELECT DISTINCT name, iri FROM node_types WHERE name IS NOT NULL AND iri IS NOT NULL)",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 12) AS raw FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)
SELECT query, id, round(raw, 5) AS score, row_number() OVER (PARTITION BY query ORDER BY raw DESC, id) AS rank FROM s QUALIFY rank <= 5""",
    "vector_cosine": "SELECT vec_id, round(CAST(CAST(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])) AS FLOAT) AS DOUBLE), 5) AS score FROM embeddings",
}
