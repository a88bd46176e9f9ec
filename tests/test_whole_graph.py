"""Queries that write the graph out: all nodes and edges of the tables, rebuilt here row by row."""

import hashlib
import json
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LOCAL, XSD, TYPE = "urn:graphloom:local#", "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
NODES = {
    "region": ("region", "r_regionkey", "Region", {"name": "r_name"}),
    "nation": ("nation", "n_nationkey", "Nation", {"name": "n_name"}),
    "customer": ("customer", "c_custkey", "Customer", {"name": "c_name", "acctbal": "c_acctbal", "mktsegment": "c_mktsegment"}),
    "supplier": ("supplier", "s_suppkey", "Supplier", {"name": "s_name", "acctbal": "s_acctbal"}),
    "part": ("part", "p_partkey", "Part", {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size"}),
    "order": ("orders", "o_orderkey", "Order", {"status": "o_orderstatus", "priority": "o_orderpriority", "totalprice": "o_totalprice", "orderdate": "o_orderdate"}),
}
EDGES = [
    ("nation", "nation", "n_nationkey", "inRegion", "region", "n_regionkey"),
    ("customer", "customer", "c_custkey", "inNation", "nation", "c_nationkey"),
    ("supplier", "supplier", "s_suppkey", "inNation", "nation", "s_nationkey"),
    ("orders", "order", "o_orderkey", "placedBy", "customer", "o_custkey"),
    ("lineitem", "order", "l_orderkey", "contains", "part", "l_partkey"),
    ("lineitem", "order", "l_orderkey", "suppliedBy", "supplier", "l_suppkey"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(table, *columns):
    return duckdb.sql(f"SELECT {', '.join(columns)} FROM '{SF}/{table}.parquet'").fetchall()


def typed(value):
    if isinstance(value, str):
        return value, XSD + "string"
    if isinstance(value, int):
        return str(value), XSD + "integer"
    if isinstance(value, float):
        return repr(value), XSD + "double"
    return value.strftime("%Y-%m-%dT%H:%M:%SZ"), XSD + "dateTime"


@pytest.fixture(scope="module")
def whole():
    """(nodes: iri -> (type, properties), edges: set of (source, label, target))."""
    nodes = {f"urn:{kind}/{key}": (type_, dict(zip(props, values, strict=True))) for kind, (table, column, type_, props) in NODES.items() for key, *values in rows(table, column, *props.values())}
    edges = {(f"urn:{k}/{a}", label, f"urn:{to}/{b}") for table, k, s, label, to, t in EDGES for a, b in rows(table, s, t)}
    assert {s for s, _, _ in edges} | {t for _, _, t in edges} <= set(nodes) and len(edges) > len(nodes) > 1000
    return nodes, edges


@pytest.fixture(scope="module")
def triples(whole):
    nodes, edges = whole
    own = [(s, TYPE, "iri", LOCAL + type_, None) for s, (type_, _) in nodes.items()]
    own += [(s, LOCAL + k, "literal", *typed(v)) for s, (_, props) in nodes.items() for k, v in props.items() if v is not None]
    return own, [(s, LOCAL + label, "iri", t, None) for s, label, t in edges]


def result(spark, name):
    return Counter(tuple(r) for r in entry.queries()[name](spark, SF).collect())


def test_triples(spark, triples):
    own, between = triples
    assert result(spark, "to_rdf_nodes") == Counter(own)
    assert result(spark, "ntriples_round_trip") == Counter(own + between)


def test_lines_of_triples(spark, triples):
    bases = {"region:": "urn:region/", "nation:": "urn:nation/", "local:": LOCAL}

    def short(iri):
        return next((p + iri[len(b) :] for p, b in bases.items() if iri.startswith(b)), f"<{iri}>")

    each = triples[0] + triples[1]
    full = [f"<{s}> <{p}> " + (f"<{o}>" if kind == "iri" else f'"{o}"^^<{d}>') + " ." for s, p, kind, o, d in each]
    assert result(spark, "ntriples_lines") == Counter((x,) for x in full)
    turtle = [f"{short(s)} {short(p)} " + (short(o) if kind == "iri" else f'"{o}"' + ("" if d == XSD + "string" else f"^^<{d}>")) + " ." for s, p, kind, o, d in each]
    assert result(spark, "turtle_lines") == Counter((x,) for x in turtle)


def test_subjects(spark, triples):
    want = {}
    for s, p, kind, o, d in triples[0] + triples[1]:
        want.setdefault(s, {"@id": s}).setdefault(p, []).append({"@id": o} if kind == "iri" else {"@type": d, "@value": o})
    got = entry.queries()["jsonld_subjects"](spark, SF).collect()
    order = lambda x: {k: sorted(v, key=json.dumps) if isinstance(v, list) else v for k, v in x.items()}
    assert len(got) == len(want) and {r.subject: order(json.loads(r.json)) for r in got} == {s: order(x) for s, x in want.items()}


def test_drawings(spark, whole):
    nodes, edges = whole
    n = lambda iri: sha("NodeId|" + iri)
    e = lambda s, label, t: sha(f"EdgeId|{n(s)}|{label}|{n(t)}")
    named = [(n(s), type_, props.get("name")) for s, (type_, props) in nodes.items()]
    assert not any(re.search(r'["\\\n]', name or "") for _, _, name in named)
    dot = [(0, i, f'  {("n_" + i)[:60]} [label="{t if name is None else name + " | " + t}"];') for i, t, name in named]
    dot += [(1, e(s, label, t), f'  {("n_" + n(s))[:60]} -> {("n_" + n(t))[:60]} [label="{label}"];') for s, label, t in edges]
    assert result(spark, "dot_lines") == Counter(dot)
    mermaid = [(0, i, f'  n{i[:20]}["{t if name is None else name}"]') for i, t, name in named]
    mermaid += [(1, e(s, label, t), f'  n{n(s)[:20]} -- "{label}" --> n{n(t)[:20]}') for s, label, t in edges]
    assert result(spark, "mermaid_lines") == Counter(mermaid)


def test_subjects_are_grouped_once(spark):
    from graphloom.sources import rdf

    rows = [("urn:a", "q", "literal", 'x"', "d"), ("urn:a", "p", "iri", "urn:b", None), ("urn:a", "p", "iri", "urn:a", None)]
    t = spark.createDataFrame([("iri", *r, None) for r in rows], "s_kind string, s string, p string, o_kind string, o string, datatype string, lang string")
    got = rdf.jsonld_subjects(t)
    assert [tuple(r) for r in got.collect()] == [("urn:a", '{"@id":"urn:a","p":[{"@id":"urn:a"},{"@id":"urn:b"}],"q":[{"@type":"d","@value":"x\\""}]}')]
    assert got._jdf.queryExecution().sparkPlan().toString().count("ObjectHashAggregate") == 2
