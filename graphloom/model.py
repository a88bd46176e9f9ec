"""The data model: a labelled property graph with schema and axioms, as DataFrames."""

from __future__ import annotations

import dataclasses
import datetime
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PV = T.StructType(
    [
        T.StructField("t", T.StringType()),
        T.StructField("s", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("b", T.BooleanType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("bin", T.BinaryType()),
    ]
)
PROPERTIES = T.MapType(T.StringType(), PV)
_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()
_LIST = T.ArrayType(_S)
CARDINALITY = T.StructType([T.StructField("min", _L), T.StructField("max", _L)])
PROPERTY_TYPE = T.StructType([T.StructField("name", _S), T.StructField("datatype", _S), T.StructField("cardinality", CARDINALITY), T.StructField("iri", _S), T.StructField("description", _S)])
NODES = T.StructType([T.StructField("id", _S), T.StructField("iri", _S), T.StructField("types", _LIST), T.StructField("properties", PROPERTIES)])
EDGES = T.StructType([T.StructField("id", _S), T.StructField("label", _S), T.StructField("source", _S), T.StructField("target", _S), T.StructField("properties", PROPERTIES)])
AXIOMS = T.StructType([T.StructField("id", _S), T.StructField("kind", _S), T.StructField("a", _S), T.StructField("b", _S), T.StructField("provenance", _S)])
NODE_TYPES = T.StructType([T.StructField("name", _S), T.StructField("iri", _S), T.StructField("supertypes", _LIST), T.StructField("properties", T.ArrayType(PROPERTY_TYPE)), T.StructField("description", _S)])
EDGE_TYPES = T.StructType(
    [
        T.StructField("name", _S), T.StructField("iri", _S), T.StructField("domain", _LIST), T.StructField("range", _LIST), T.StructField("properties", T.ArrayType(PROPERTY_TYPE)),
        T.StructField("cardinality", CARDINALITY), T.StructField("functional", _B), T.StructField("inverse_of", _S), T.StructField("description", _S),
    ]
)

# fixed values: kinds of axioms, and datatypes of properties
AXIOM_KINDS = ("SubClassOf", "EquivalentClass", "DisjointWith", "Domain", "Range", "Functional", "InverseFunctional", "InverseOf", "Symmetric", "Transitive")
DATATYPES = ("string", "integer", "float", "bool", "date_time", "iri", "bytes", "json")
#: Slot of the value struct by its tag; a null has none.
SLOT = {"string": "s", "integer": "i", "float": "f", "bool": "b", "date_time": "ts", "iri": "s", "bytes": "bin", "json": "s"}

# fixed values: prefixes bound in every vocabulary
STANDARD_PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "prov": "http://www.w3.org/ns/prov#",
    "sh": "http://www.w3.org/ns/shacl#",
}


class Iri(str):
    """A property value that is an IRI, not text."""


class Json(str):
    """A property value that is JSON, given as text."""


def tagged(value: Any) -> tuple[str, Any]:
    """(tag, value) of a Python value: str, bool, int, float, datetime, Iri, Json, bytes or None; dicts and lists count as JSON."""
    if value is None:
        return "null", None
    if isinstance(value, Iri):
        return "iri", str(value)
    if isinstance(value, (Json, dict, list)):
        return "json", canonical_json(value if isinstance(value, str) else json.dumps(value))
    for kind, tag in ((bool, "bool"), (int, "integer"), (float, "float"), (str, "string"), (datetime.datetime, "date_time"), (bytes, "bytes")):
        if isinstance(value, kind):
            return tag, value
    raise TypeError(f"no property value: {value!r}")


def canonical_json(text: str) -> str:
    """JSON with sorted keys and no spaces, so that equal values are equal texts."""
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def pv(value: Any) -> dict:
    """The value struct of a Python value."""
    tag, v = tagged(value)
    return {f.name: None for f in PV} | {"t": tag} | ({SLOT[tag]: v} if tag != "null" else {})


def pv_of(column: Column, tag: str) -> Column:
    """The value struct of a column; null where the column is null."""
    cast = {"s": "string", "i": "bigint", "f": "double", "b": "boolean", "ts": "timestamp", "bin": "binary"}
    slots = [F.lit(tag).alias("t"), *((column if SLOT[tag] == s else F.lit(None)).cast(kind).alias(s) for s, kind in cast.items())]
    return F.when(column.isNotNull(), F.struct(*slots))


def properties_of(**columns: Column) -> Column:
    """A property map from value structs; those that are null are left out."""
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in columns.items())), lambda e: e["v"].isNotNull())
    return F.map_from_entries(entries)


def content_id(domain: str, text: Column) -> Column:
    """A 64-digit id made from the content, different for each kind of thing."""
    return F.sha2(F.concat(F.lit(f"{domain}|"), text), 256)


def node_id(iri: Column) -> Column:
    """Id of the node that an IRI names."""
    return content_id("NodeId", iri)


def edge_id(source: Column, label: Column, target: Column) -> Column:
    """Id of an edge: one per source, label and target."""
    return content_id("EdgeId", F.concat_ws("|", source, label, target))


def axiom_id(kind: Column, a: Column, b: Column) -> Column:
    """Id of an axiom."""
    return content_id("AxiomId", F.concat_ws("|", kind, a, b))


def record_id(iri: Column) -> Column:
    """Id of a record."""
    return content_id("RecordId", iri)


def random_id() -> Column:
    """A random id of the same form."""
    return F.sha2(F.uuid(), 256)


def is_id(text: Column) -> Column:
    """Whether a text is the hexadecimal form of 32 bytes."""
    return F.coalesce(text.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


@dataclass(frozen=True)
class Ontology:
    """Nodes, edges, axioms and schema; ``vocabulary`` maps prefixes to bases.  Operators return a changed copy."""

    nodes: DataFrame
    edges: DataFrame
    axioms: DataFrame
    node_types: DataFrame
    edge_types: DataFrame
    vocabulary: dict[str, str] = field(default_factory=lambda: dict(STANDARD_PREFIXES))
    iri: str | None = None

    PARTS = ("nodes", "edges", "axioms", "node_types", "edge_types")

    def with_(self, **parts: Any) -> Ontology:
        """A copy with some parts replaced."""
        return dataclasses.replace(self, **parts)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession


SCHEMAS = {"nodes": NODES, "edges": EDGES, "axioms": AXIOMS, "node_types": NODE_TYPES, "edge_types": EDGE_TYPES}


def empty(spark: SparkSession, iri: str | None = None) -> Ontology:
    """An ontology without anything in it."""
    return Ontology(*(spark.createDataFrame([], SCHEMAS[p]) for p in Ontology.PARTS), iri=iri)


def build(spark: SparkSession, nodes: list[dict] = (), edges: list[dict] = (), axioms: list[tuple] = (), node_types: list[dict] = (), edge_types: list[dict] = (), **more: Any) -> Ontology:
    """A small ontology from Python rows.

    Nodes: iri or id, types, properties of Python values.  Edges: source, label,
    target (ids or IRIs of given nodes), properties.  Axioms: (kind, a[, b]).
    """
    import hashlib

    sha = lambda domain, text: hashlib.sha256(f"{domain}|{text}".encode()).hexdigest()
    ids = {n["iri"]: n.get("id") or sha("NodeId", n["iri"]) for n in nodes if n.get("iri")}
    props = lambda d: {k: pv(v) for k, v in (d or {}).items()}
    node_rows = [(n.get("id") or ids[n["iri"]], n.get("iri"), list(n.get("types", [])), props(n.get("properties"))) for n in nodes]
    edge_rows = []
    for e in edges:
        s, t = ids.get(e["source"], e["source"]), ids.get(e["target"], e["target"])
        edge_rows.append((e.get("id") or sha("EdgeId", f"{s}|{e['label']}|{t}"), e["label"], s, t, props(e.get("properties"))))
    axiom_rows = [(sha("AxiomId", "|".join(a)), a[0], a[1], a[2] if len(a) > 2 else None, None) for a in axioms]
    prop_types = lambda ps: [(p["name"], p["datatype"], tuple(p.get("cardinality", (0, None))), p.get("iri"), p.get("description")) for p in ps]
    type_rows = [(t["name"], t.get("iri"), list(t.get("supertypes", [])), prop_types(t.get("properties", [])), t.get("description")) for t in node_types]
    edge_type_rows = [
        (t["name"], t.get("iri"), list(t.get("domain", [])), list(t.get("range", [])), prop_types(t.get("properties", [])), tuple(t.get("cardinality", (0, None))), bool(t.get("functional")), t.get("inverse_of"), t.get("description"))
        for t in edge_types
    ]
    rows = {"nodes": node_rows, "edges": edge_rows, "axioms": axiom_rows, "node_types": type_rows, "edge_types": edge_type_rows}
    return Ontology(**{p: spark.createDataFrame(rows[p], SCHEMAS[p]) for p in Ontology.PARTS}, **more)
