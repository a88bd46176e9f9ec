"""The whole graph of the relational tables written out, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.iri import LOCAL_BASE, XSD_BASE
from graphloom.model import EDGES, NODES

from graphloom.sources import persist, rdf, tables_graph, viz

PREFIXES = {"region": "urn:region/", "nation": "urn:nation/", "local": LOCAL_BASE}


def _iri(kind: str, key: str) -> str:
    return f"'urn:{kind}/' || {key}"


def _node_sql(kind: str) -> str:
    """(id, iri, type, p): the nodes of a kind, p their properties as (k, t, v)."""
    key, type_, props = tables_graph.KINDS[kind]
    text = lambda c, t: f"strftime(CAST({c} AS TIMESTAMP), '%Y-%m-%dT%H:%M:%SZ')" if t == "date_time" else f"CAST({c} AS VARCHAR)"
    entries = ", ".join(f"{{'k': '{p}', 't': '{t}', 'v': {text(c, t)}}}" for p, (c, t) in props.items())
    return f"SELECT sha256('NodeId|' || {_iri(kind, key)}) AS id, {_iri(kind, key)} AS iri, '{type_}' AS type, [{entries}] AS p FROM {'orders' if kind == 'order' else kind}"


NODE_ROWS = " UNION ALL ".join(map(_node_sql, tables_graph.KINDS))
_ENDS = ", ".join(["'{label}' AS label", "{s} AS si", "{t} AS ti", "sha256('NodeId|' || {s}) AS s", "sha256('NodeId|' || {t}) AS t"])
EDGE_ROWS = " UNION ALL ".join(
    f"SELECT {'DISTINCT ' if table == 'lineitem' else ''}{_ENDS.format(label=label, s=_iri(*source), t=_iri(*target))} FROM {table}" for label, table, source, target in tables_graph.LINKS
)
GRAPH = f"n AS ({NODE_ROWS}), g AS ({EDGE_ROWS}), v AS (SELECT id, iri, type, unnest(p) AS e FROM n)"
DATATYPES = "CASE e.t WHEN 'integer' THEN 'integer' WHEN 'float' THEN 'double' WHEN 'date_time' THEN 'dateTime' ELSE 'string' END"
NODE_TRIPLES = f"""SELECT iri AS s, '{rdf.TYPE}' AS p, 'iri' AS o_kind, '{LOCAL_BASE}' || type AS o, CAST(NULL AS VARCHAR) AS datatype FROM n
UNION ALL SELECT iri, '{LOCAL_BASE}' || e.k, 'literal', e.v, '{XSD_BASE}' || {DATATYPES} FROM v WHERE e.v IS NOT NULL"""
TRIPLES = f"{NODE_TRIPLES} UNION ALL SELECT si, '{LOCAL_BASE}' || label, 'iri', ti, NULL FROM g WHERE si IN (SELECT iri FROM n) AND ti IN (SELECT iri FROM n)"
_NAME = "list_filter(p, lambda x: x.k = 'name')[1].v"
_SHORT = lambda c: f"CASE WHEN starts_with({c}, 'urn:region/') THEN 'region:' || substr({c}, 12) WHEN starts_with({c}, 'urn:nation/') THEN 'nation:' || substr({c}, 12) WHEN starts_with({c}, '{LOCAL_BASE}') THEN 'local:' || substr({c}, {len(LOCAL_BASE) + 1}) ELSE '<' || {c} || '>' END"


def _graph(spark, sf):
    return tables_graph.read(spark, sf)


def _wire(spark, sf):
    g = _graph(spark, sf)
    return persist.wire(g.nodes.select(*NODES.names)).unionByName(persist.wire(g.edges.select(*EDGES.names)))


def _unwired(spark, sf):
    """Properties of all nodes that have gone through the wire form and back."""
    back = persist.unwire(spark, persist.wire(_graph(spark, sf).nodes.select(*NODES.names)), NODES)
    p = back.select("id", "iri", F.concat_ws(",", "types").alias("type"), F.explode("properties").alias("k", "x"))
    kind, text, _ = rdf.literal(F.col("x"))
    return p.select("id", "iri", "type", "k", F.col("x.t").alias("t"), text.alias("v"))


QUERIES = {
    "to_rdf_nodes": lambda spark, sf: rdf.node_triples(_graph(spark, sf)).select("s", "p", "o_kind", "o", "datatype"),
    "to_rdf": lambda spark, sf: rdf.to_rdf(_graph(spark, sf)).select("s", "p", "o_kind", "o", "datatype"),
    "ntriples_lines": lambda spark, sf: rdf.ntriples_lines(rdf.to_rdf(_graph(spark, sf))),
    "ntriples_round_trip": lambda spark, sf: rdf.parse_ntriples(rdf.ntriples_lines(rdf.to_rdf(_graph(spark, sf)))).select("s", "p", "o_kind", "o", "datatype"),
    "turtle_lines": lambda spark, sf: rdf.turtle_lines(rdf.to_rdf(_graph(spark, sf)), PREFIXES),
    "jsonld_subjects": lambda spark, sf: rdf.jsonld_subjects(rdf.to_rdf(_graph(spark, sf))),
    "dot_lines": lambda spark, sf: viz.dot_lines(_graph(spark, sf)),
    "mermaid_lines": lambda spark, sf: viz.mermaid_lines(_graph(spark, sf)),
    "wire_lines": _wire,
    "wire_round_trip": _unwired,
}

_VALUE = "CASE WHEN e.t IN ('integer', 'float') THEN e.v WHEN e.t = 'date_time' THEN '\"' || replace(e.v, 'Z', '.000000Z') || '\"' ELSE CAST(to_json(e.v) AS VARCHAR) END"
SQL = {
    "to_rdf_nodes": f"WITH {GRAPH} {NODE_TRIPLES}",
    "to_rdf": f"WITH {GRAPH} {TRIPLES}",
    "ntriples_lines": f"WITH {GRAPH} SELECT '<' || s || '> <' || p || '> ' || CASE o_kind WHEN 'iri' THEN '<' || o || '>' ELSE '\"' || o || '\"^^<' || datatype || '>' END || ' .' AS value FROM ({TRIPLES})",
    "ntriples_round_trip": f"WITH {GRAPH} {TRIPLES}",
    "turtle_lines": f"WITH {GRAPH} SELECT {_SHORT('s')} || ' ' || {_SHORT('p')} || ' ' || CASE WHEN o_kind = 'iri' THEN {_SHORT('o')} WHEN ends_with(datatype, '#string') THEN '\"' || o || '\"' ELSE '\"' || o || '\"^^<' || datatype || '>' END || ' .' AS value FROM ({TRIPLES})",
    "jsonld_subjects": f"""WITH {GRAPH}, t AS ({TRIPLES}), m AS (
SELECT s, '"' || p || '":[' || string_agg(CASE o_kind WHEN 'iri' THEN '{{"@id":"' || o || '"}}' ELSE '{{"@type":"' || datatype || '","@value":' || CAST(to_json(o) AS VARCHAR) || '}}' END, ',' ORDER BY CASE o_kind WHEN 'iri' THEN '{{"@id":"' || o || '"}}' ELSE '{{"@type":"' || datatype || '","@value":' || CAST(to_json(o) AS VARCHAR) || '}}' END) || ']' AS m FROM t GROUP BY s, p)
SELECT s AS subject, '{{"@id":"' || s || '",' || string_agg(m, ',' ORDER BY m) || '}}' AS json FROM m GROUP BY s""",
    "dot_lines": f"""WITH {GRAPH} SELECT 0 AS part, id, '  ' || left('n_' || id, 60) || ' [label="' || coalesce({_NAME} || ' | ', '') || type || '"];' AS value FROM n
UNION ALL SELECT 1, sha256('EdgeId|' || s || '|' || label || '|' || t), '  ' || left('n_' || s, 60) || ' -> ' || left('n_' || t, 60) || ' [label="' || label || '"];' FROM g""",
    "mermaid_lines": f"""WITH {GRAPH} SELECT 0 AS part, id, '  n' || left(id, 20) || '["' || coalesce({_NAME}, type) || '"]' AS value FROM n
UNION ALL SELECT 1, sha256('EdgeId|' || s || '|' || label || '|' || t), '  n' || left(s, 20) || ' -- "' || label || '" --> n' || left(t, 20) FROM g""",
    "wire_lines": f"""WITH {GRAPH}, w AS (
SELECT id, iri, type, string_agg('"' || e.k || '":{{"type":"' || e.t || '","value":' || {_VALUE} || '}}', ',' ORDER BY e.k) AS m FROM v WHERE e.v IS NOT NULL GROUP BY id, iri, type)
SELECT '{{"id":"' || id || '","iri":"' || iri || '","types":["' || type || '"],"properties":{{' || coalesce(m, '') || '}}}}' AS json FROM n LEFT JOIN w USING (id, iri, type)
UNION ALL SELECT '{{"id":"' || sha256('EdgeId|' || s || '|' || label || '|' || t) || '","label":"' || label || '","source":"' || s || '","target":"' || t || '","properties":{{}}}}' FROM g""",
    "wire_round_trip": f"WITH {GRAPH} SELECT id, iri, type, e.k AS k, e.t AS t, e.v AS v FROM v WHERE e.v IS NOT NULL",
}
