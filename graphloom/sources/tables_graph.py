"""The relational tables as a graph.

Nodes: Region, Nation, Customer, Supplier, Part, Order, each with an IRI
urn:<kind>/<key>.  Edges: inRegion, inNation, placedBy, contains, suppliedBy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Ontology, edge_id, empty, node_id, properties_of, pv_of

# fixed values: table, key column, type, property -> (column, tag)
KINDS = {
    "region": ("r_regionkey", "Region", {"name": ("r_name", "string")}),
    "nation": ("n_nationkey", "Nation", {"name": ("n_name", "string")}),
    "customer": ("c_custkey", "Customer", {"name": ("c_name", "string"), "acctbal": ("c_acctbal", "float"), "mktsegment": ("c_mktsegment", "string")}),
    "supplier": ("s_suppkey", "Supplier", {"name": ("s_name", "string"), "acctbal": ("s_acctbal", "float")}),
    "part": ("p_partkey", "Part", {"name": ("p_name", "string"), "brand": ("p_brand", "string"), "type": ("p_type", "string"), "size": ("p_size", "integer")}),
    "order": ("o_orderkey", "Order", {"status": ("o_orderstatus", "string"), "priority": ("o_orderpriority", "string"), "totalprice": ("o_totalprice", "float"), "orderdate": ("o_orderdate", "date_time")}),
}
# fixed values: label, table, (kind, column) of source and target
LINKS = (
    ("inRegion", "nation", ("nation", "n_nationkey"), ("region", "n_regionkey")),
    ("inNation", "customer", ("customer", "c_custkey"), ("nation", "c_nationkey")),
    ("inNation", "supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey")),
    ("placedBy", "orders", ("order", "o_orderkey"), ("customer", "o_custkey")),
    ("contains", "lineitem", ("order", "l_orderkey"), ("part", "l_partkey")),
    ("suppliedBy", "lineitem", ("order", "l_orderkey"), ("supplier", "l_suppkey")),
)


def _iri(kind: str, key: str) -> F.Column:
    return F.concat(F.lit(f"urn:{kind}/"), F.col(key).cast("string"))


def read(spark: SparkSession, folder: str) -> Ontology:
    """The graph of the tables in ``folder``; scans of tables a query does not need are never planned."""

    def nodes(kind: str) -> DataFrame:
        key, type_, props = KINDS[kind]
        rows = spark.read.parquet(f"{folder}/{'orders' if kind == 'order' else kind}.parquet")
        iri = _iri(kind, key)
        return rows.select(node_id(iri).alias("id"), iri.alias("iri"), F.array(F.lit(type_)).alias("types"), properties_of(**{p: pv_of(F.col(c), tag) for p, (c, tag) in props.items()}).alias("properties"))

    def edges(label: str, table: str, source: tuple, target: tuple) -> DataFrame:
        rows = spark.read.parquet(f"{folder}/{table}.parquet").select(source[1], target[1])
        rows = rows.distinct() if table == "lineitem" else rows  # an edge is one per source, label and target
        s, t = node_id(_iri(*source)), node_id(_iri(*target))
        none = F.map_from_entries(F.array().cast(f"array<struct<k: string, v: {_PV}>>"))
        return rows.select(s.alias("source"), t.alias("target")).select(edge_id(F.col("source"), F.lit(label), F.col("target")).alias("id"), F.lit(label).alias("label"), "source", "target", none.alias("properties"))

    all_nodes = reduce(DataFrame.unionByName, map(nodes, KINDS))
    all_edges = reduce(DataFrame.unionByName, (edges(*x) for x in LINKS))
    return empty(spark).with_(nodes=all_nodes, edges=all_edges)


_PV = "struct<t: string, s: string, i: bigint, f: double, b: boolean, ts: timestamp, bin: binary>"
