"""RDF: graphs to triples and back, N-Triples, Turtle and JSON-LD.

Triples are rows (s_kind, s, p, o_kind, o, datatype, lang); kinds are iri, blank
and literal.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.iri import LOCAL_BASE, RDF_BASE, XSD_BASE, datatype_iri, ensure_iri, local_name
from graphloom.functions.text import base64_text
from graphloom.model import STANDARD_PREFIXES, Ontology, empty

TRIPLES = "s_kind string, s string, p string, o_kind string, o string, datatype string, lang string"
RDFS, OWL = STANDARD_PREFIXES["rdfs"], STANDARD_PREFIXES["owl"]
TYPE = RDF_BASE + "type"
STRING, LANG_STRING = XSD_BASE + "string", RDF_BASE + "langString"


class ParseError(ValueError):
    """A text that is not in the format."""


# graphs to triples


def _triples(df: DataFrame, s: Column, p: Column, o: Column, s_kind: Column | None = None, o_kind: Column | None = None, datatype: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select((F.lit("iri") if s_kind is None else s_kind).alias("s_kind"), s.alias("s"), p.alias("p"), (F.lit("iri") if o_kind is None else o_kind).alias("o_kind"), o.alias("o"), (none if datatype is None else datatype).alias("datatype"), none.alias("lang"))


def schema_triples(graph: Ontology, base: str = LOCAL_BASE) -> DataFrame:
    """Classes, subclasses, datatype and object properties with domain, range, functional and inverse."""
    iri = lambda c: ensure_iri(c, graph.vocabulary, base)
    types = graph.node_types.withColumn("c", F.coalesce("iri", iri(F.col("name"))))
    props = types.select("c", F.explode("properties").alias("p")).withColumn("pi", F.coalesce("p.iri", iri(F.col("p.name"))))
    edges = graph.edge_types.withColumn("e", F.coalesce("iri", iri(F.col("name"))))
    c, pi, e = F.col("c"), F.col("pi"), F.col("e")
    each = lambda df, key, column: df.select(key, F.explode(column).alias("x"))
    parts = [
        _triples(types, c, F.lit(TYPE), F.lit(OWL + "Class")),
        _triples(each(types, "c", "supertypes"), c, F.lit(RDFS + "subClassOf"), iri(F.col("x"))),
        _triples(props, pi, F.lit(TYPE), F.lit(OWL + "DatatypeProperty")),
        _triples(props, pi, F.lit(RDFS + "domain"), c),
        _triples(props, pi, F.lit(RDFS + "range"), datatype_iri(F.col("p.datatype"))),
        _triples(edges, e, F.lit(TYPE), F.lit(OWL + "ObjectProperty")),
        _triples(edges.where("functional"), e, F.lit(TYPE), F.lit(OWL + "FunctionalProperty")),
        _triples(edges.where("inverse_of is not null"), e, F.lit(OWL + "inverseOf"), iri(F.col("inverse_of"))),
        _triples(each(edges, "e", "domain"), e, F.lit(RDFS + "domain"), iri(F.col("x"))),
        _triples(each(edges, "e", "range"), e, F.lit(RDFS + "range"), iri(F.col("x"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def literal(value: Column) -> tuple[Column, Column, Column]:
    """(kind, text, datatype) of a value struct; the text is null for a null."""
    t = value["t"]
    text = (
        F.when(t.isin("string", "iri", "json"), value["s"])
        .when(t == "integer", value["i"].cast("string"))
        .when(t == "float", value["f"].cast("string"))
        .when(t == "bool", value["b"].cast("string"))
        .when(t == "date_time", F.date_format(value["ts"], "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(t == "bytes", base64_text(value["bin"]))
    )
    return F.when(t == "iri", "iri").otherwise("literal"), text, F.when(t != "iri", datatype_iri(t))


def node_triples(graph: Ontology, base: str = LOCAL_BASE) -> DataFrame:
    """Types and properties of nodes; a null property gives nothing.

    A property's IRI is the one declared by the node's first type that the
    schema has.
    """
    iri = lambda c: ensure_iri(c, graph.vocabulary, base)
    nodes = graph.nodes.withColumn("s_kind", F.when(F.col("iri").isNull(), "blank").otherwise("iri")).withColumn("s", F.coalesce("iri", "id"))
    declared = graph.node_types.select(F.col("name").alias("type"), F.col("iri").alias("type_iri"))
    types = nodes.select("s_kind", "s", F.explode("types").alias("type")).join(declared, "type", "left")
    typed = _triples(types, F.col("s"), F.lit(TYPE), F.coalesce("type_iri", iri(F.col("type"))), F.col("s_kind"))
    first = nodes.select("id", F.posexplode("types").alias("n", "type")).join(graph.node_types.select(F.col("name").alias("type"), F.col("properties").alias("declared")), "type")
    first = first.groupBy("id").agg(F.min_by("declared", "n").alias("declared"))
    values = nodes.select("id", "s_kind", "s", F.explode("properties").alias("key", "value")).where("value.t <> 'null'").join(first, "id", "left")
    own = F.get(F.filter("declared", lambda p: p["name"] == F.col("key")), F.lit(0))["iri"]
    kind, text, datatype = literal(F.col("value"))
    return typed.unionByName(_triples(values, F.col("s"), F.coalesce(own, iri(F.col("key"))), text, F.col("s_kind"), kind, datatype))


def edge_triples(graph: Ontology, base: str = LOCAL_BASE, compat: bool = False) -> DataFrame:
    """Edges whose source exists.  A node without iri is blank; ``compat`` writes one that is a target as an IRI _:n<id>."""
    iri = ensure_iri(F.col("label"), graph.vocabulary, base)
    names = graph.edge_types.select(F.col("name").alias("label"), F.col("iri").alias("label_iri"))
    nodes = graph.nodes.select(F.col("id"), F.col("iri"))
    rows = graph.edges.select("label", "source", "target").join(names, "label", "left").join(nodes.select(F.col("id").alias("source"), F.col("iri").alias("si")), "source").join(nodes.select(F.col("id").alias("target"), F.col("iri").alias("ti")), "target", "left")
    end = F.when(F.col("ti").isNotNull(), F.col("ti")).otherwise(F.concat(F.lit("_:n"), "target") if compat else F.col("target"))
    kind = F.when(F.col("ti").isNotNull() | F.lit(compat), "iri").otherwise("blank")
    return _triples(rows, F.coalesce("si", "source"), F.coalesce("label_iri", iri), end, F.when(F.col("si").isNull(), "blank").otherwise("iri"), kind)


# fixed values: axiom kind -> predicate, or the class that the property is of
AXIOM_PREDICATES = {"SubClassOf": RDFS + "subClassOf", "EquivalentClass": OWL + "equivalentClass", "DisjointWith": OWL + "disjointWith", "Domain": RDFS + "domain", "Range": RDFS + "range", "InverseOf": OWL + "inverseOf"}
AXIOM_CLASSES = {"Functional": "FunctionalProperty", "InverseFunctional": "InverseFunctionalProperty", "Symmetric": "SymmetricProperty", "Transitive": "TransitiveProperty"}


def axiom_triples(graph: Ontology, base: str = LOCAL_BASE) -> DataFrame:
    """Axioms as RDF and OWL statements."""
    iri = lambda c: ensure_iri(F.col(c), graph.vocabulary, base)
    predicate, object_ = F.lit(None).cast("string"), iri("b")
    for kind, p in AXIOM_PREDICATES.items():
        predicate = F.when(F.col("kind") == kind, F.lit(p)).otherwise(predicate)
    for kind, c in AXIOM_CLASSES.items():
        predicate = F.when(F.col("kind") == kind, F.lit(TYPE)).otherwise(predicate)
        object_ = F.when(F.col("kind") == kind, F.lit(OWL + c)).otherwise(object_)
    return _triples(graph.axioms, iri("a"), predicate, object_)


def to_rdf(graph: Ontology, base: str = LOCAL_BASE, compat: bool = False) -> DataFrame:
    """All triples of a graph."""
    return reduce(DataFrame.unionByName, [schema_triples(graph, base), node_triples(graph, base), edge_triples(graph, base, compat), axiom_triples(graph, base)])


def from_rdf(triples: DataFrame) -> Ontology:
    """Classes, object properties and subclasses; other triples are skipped."""
    spark = triples.sparkSession
    t = triples.where("s_kind = 'iri' and o_kind = 'iri'")
    subs = t.where(F.col("p") == RDFS + "subClassOf").select(F.col("s").alias("iri"), local_name(F.col("o")).alias("up"))
    classes = t.where((F.col("p") == TYPE) & (F.col("o") == OWL + "Class")).select(F.col("s").alias("iri"), F.lit(None).cast("string").alias("up"))
    node_types = classes.unionByName(subs).groupBy(local_name(F.col("iri")).alias("name")).agg(F.min("iri").alias("iri"), F.array_sort(F.collect_set("up")).alias("supertypes"))
    edge_types = t.where((F.col("p") == TYPE) & (F.col("o") == OWL + "ObjectProperty")).groupBy(local_name(F.col("s")).alias("name")).agg(F.min("s").alias("iri"))
    blank = empty(spark)
    return blank.with_(
        node_types=blank.node_types.unionByName(node_types, allowMissingColumns=True),
        edge_types=blank.edge_types.unionByName(edge_types.withColumn("functional", F.lit(False)), allowMissingColumns=True),
    )


# N-Triples


def _escaped(text: Column) -> Column:
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(out))
    return text


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """(value): one line per triple, full IRIs, every literal with its datatype or language."""
    term = lambda kind, v: F.when(F.col(kind) == "iri", F.concat(F.lit("<"), v, F.lit(">"))).otherwise(F.concat(F.lit("_:"), v))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(F.concat(F.lit("^^<"), F.coalesce("datatype", F.lit(STRING)), F.lit(">")))
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail)).otherwise(term("o_kind", F.col("o")))
    return triples.select(F.concat(term("s_kind", F.col("s")), F.lit(" <"), F.col("p"), F.lit("> "), o, F.lit(" .")).alias("value"))


# possessive, so that a literal of any length is matched without recursion
_NT = r'^\s*(?:<([^>]*)>|_:(\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|_:([^\s.]+)|"((?:[^"\\]++|\\.)*+)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?)\s*\.\s*(?:#.*)?$'
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.DOTALL)
_PLAIN = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def unescape(text: str) -> str:
    """A literal without its escapes."""
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


def parse_ntriples(lines: DataFrame, text: str = "value") -> DataFrame:
    """Triples of lines; blank lines and comments are skipped, any other line that is no triple is an error while reading."""
    line = F.col(text)
    kept = lines.where(line.isNotNull() & ~line.rlike(r"^\s*(#.*)?$"))
    part = lambda i: F.nullif(F.regexp_extract(line, _NT, i), F.lit(""))
    checked = kept.select(F.when(line.rlike(_NT), line).otherwise(F.raise_error(F.concat(F.lit("no triple: "), line))).alias(text))

    @F.pandas_udf("string")
    def plain(s: pd.Series) -> pd.Series:
        return s.map(unescape, na_action="ignore")

    raw = F.regexp_extract(line, _NT, 6)
    literal_ = part(4).isNull() & part(5).isNull()
    lexical = F.when(raw.contains("\\"), plain(raw)).otherwise(raw)
    return checked.select(
        F.when(part(1).isNotNull(), "iri").otherwise("blank").alias("s_kind"), F.coalesce(part(1), part(2)).alias("s"), part(3).alias("p"),
        F.when(literal_, "literal").when(part(4).isNotNull(), "iri").otherwise("blank").alias("o_kind"), F.coalesce(part(4), part(5), lexical).alias("o"),
        F.when(literal_, F.coalesce(part(8), F.when(part(7).isNotNull(), F.lit(LANG_STRING)), F.lit(STRING))).alias("datatype"), part(7).alias("lang"),
    )


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files; lines are split over tasks."""
    return parse_ntriples(spark.read.text(path))


def write_ntriples(graph: Ontology, path: str) -> None:
    """The graph as N-Triples files, one per task."""
    ntriples_lines(to_rdf(graph)).write.text(path)


# Turtle

_TTL = re.compile(
    r'(?P<skip>\s+|#[^\n]*)|(?P<prefix>@prefix\b|PREFIX\b)|(?P<iri><[^>\s]*>)|(?P<text>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<lang>@[A-Za-z0-9-]+)|(?P<hat>\^\^)|(?P<blank>_:[\w.-]*\w)'
    r"|(?P<curie>[A-Za-z_][\w-]*:(?:[\w%.-]*[\w%-])?|:(?:[\w%.-]*[\w%-])?)|(?P<number>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z]+)|(?P<sign>[.;,])"
)


def parse_turtle(text: str) -> list[tuple]:
    """Triples of a Turtle document: prefixes, ; and , lists, a, typed and language-tagged literals, bare numbers and truth values."""
    items, at = [], 0
    while at < len(text):
        m = _TTL.match(text, at)
        if not m or m.end() == at:
            raise ParseError(f"unexpected {text[at : at + 20]!r} at position {at}")
        if m.lastgroup != "skip":
            items.append((m.lastgroup, m[0]))
        at = m.end()
    prefixes: dict[str, str] = {}
    out: list[tuple] = []
    pos = 0

    def take(*kinds: str) -> tuple[str, str]:
        nonlocal pos
        if pos >= len(items) or items[pos][0] not in kinds:
            raise ParseError(f"expected {' or '.join(kinds)}, found {items[pos][1]!r}" if pos < len(items) else f"expected {' or '.join(kinds)} at the end")
        pos += 1
        return items[pos - 1]

    def sign(s: str) -> bool:
        nonlocal pos
        if pos < len(items) and items[pos] == ("sign", s):
            pos += 1
            return True
        return False

    def iri(kind: str, t: str) -> str:
        if kind == "iri":
            return t[1:-1]
        prefix, _, local = t.partition(":")
        if prefix not in prefixes:
            raise ParseError(f"unknown prefix {prefix!r}")
        return prefixes[prefix] + local

    def term() -> tuple[str, str, str | None, str | None]:
        nonlocal pos
        kind, t = take("iri", "curie", "blank", "text", "number", "word")
        if kind == "blank":
            return "blank", t[2:], None, None
        if kind == "text":
            if pos < len(items) and items[pos][0] == "lang":
                pos += 1
                return "literal", unescape(t[1:-1]), LANG_STRING, items[pos - 1][1][1:]
            if pos < len(items) and items[pos][0] == "hat":
                pos += 1
                return "literal", unescape(t[1:-1]), iri(*take("iri", "curie")), None
            return "literal", unescape(t[1:-1]), STRING, None
        if kind == "number":
            return "literal", t, XSD_BASE + ("double" if "e" in t.lower() else "decimal" if "." in t else "integer"), None
        if kind == "word":
            if t not in ("true", "false"):
                raise ParseError(f"unexpected {t!r}")
            return "literal", t, XSD_BASE + "boolean", None
        return "iri", iri(kind, t), None, None

    while pos < len(items):
        if items[pos][0] == "prefix":
            pos += 1
            name = take("curie")[1]
            prefixes[name[:-1]] = take("iri")[1][1:-1]
            sign(".")
            continue
        s_kind, s, *_ = term()
        if s_kind == "literal":
            raise ParseError("a literal is no subject")
        while True:
            if items[pos : pos + 1] == [("word", "a")]:
                pos += 1
                p = TYPE
            else:
                p = iri(*take("iri", "curie"))
            while True:
                out.append((s_kind, s, p, *term()))
                if not sign(","):
                    break
            if not sign(";"):
                break
            if items[pos : pos + 1] == [("sign", ".")]:
                break
        if not sign("."):
            raise ParseError("expected . after a statement")
    return out


def _documents(spark: SparkSession, path: str, parse: object) -> DataFrame:
    """Triples of whole files, each parsed in one task."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["value"]:
                yield pd.DataFrame(parse(text), columns=[c.split()[0] for c in TRIPLES.split(", ")], dtype=object)

    return spark.read.text(path, wholetext=True).mapInPandas(rows, TRIPLES)


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files."""
    return _documents(spark, path, parse_turtle)


def turtle_lines(triples: DataFrame, vocabulary: dict[str, str]) -> DataFrame:
    """(value): one statement per triple; IRIs are shortened by the first prefix, in order, whose base they start with and whose rest has no space or slash."""

    def short(iri: Column) -> Column:
        out = F.concat(F.lit("<"), iri, F.lit(">"))
        for prefix, base in sorted(vocabulary.items(), reverse=True):
            rest = F.substr(iri, F.lit(len(base) + 1))
            out = F.when(iri.startswith(base) & ~rest.rlike("[ /]"), F.concat(F.lit(prefix + ":"), rest)).otherwise(out)
        return out

    term = lambda kind, v: F.when(F.col(kind) == "iri", short(v)).otherwise(F.concat(F.lit("_:"), v))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("datatype") != STRING, F.concat(F.lit("^^"), short(F.col("datatype")))).otherwise("")
    o = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail)).otherwise(term("o_kind", F.col("o")))
    return triples.select(F.concat_ws(" ", term("s_kind", F.col("s")), short(F.col("p")), o, F.lit(".")).alias("value"))


def turtle_header(vocabulary: dict[str, str]) -> str:
    """The prefix lines of a Turtle document."""
    return "".join(f"@prefix {p}: <{b}> .\n" for p, b in sorted(vocabulary.items()))


def turtle_text(graph: Ontology) -> str:
    """A small graph as one Turtle document."""
    lines = [r[0] for r in turtle_lines(to_rdf(graph), graph.vocabulary).toLocalIterator()]
    return turtle_header(graph.vocabulary) + "\n" + "".join(x + "\n" for x in lines)


def write_turtle(graph: Ontology, path: str) -> None:
    """The graph as Turtle files; every file starts with the prefixes, so each is a document."""
    header = turtle_header(graph.vocabulary)

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [header]})
        yield from batches

    turtle_lines(to_rdf(graph), graph.vocabulary).mapInPandas(files, "value string").write.text(path)


# JSON-LD


def jsonld_subjects(triples: DataFrame) -> DataFrame:
    """(subject, json): one JSON-LD object per subject, values per predicate in arrays."""
    key = F.when(F.col("s_kind") == "blank", F.concat(F.lit("_:"), "s")).otherwise(F.col("s"))
    id_ = F.to_json(F.struct(F.when(F.col("o_kind") == "blank", F.concat(F.lit("_:"), "o")).otherwise(F.col("o")).alias("@id")))
    value = F.to_json(F.struct(F.col("lang").alias("@language"), F.when(F.col("lang").isNull(), F.col("datatype")).alias("@type"), F.col("o").alias("@value")))
    rows = triples.select(key.alias("subject"), "p", F.when(F.col("o_kind") == "literal", value).otherwise(id_).alias("o"))
    said = rows.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("p", "o"))).alias("said"))
    name = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    members = "transform(array_distinct(said.p), p -> concat(substring(to_json(array(p)), 2, length(to_json(array(p))) - 2), ':[', concat_ws(',', transform(filter(said, x -> x.p = p), x -> x.o)), ']'))"
    return said.select("subject", F.concat(F.lit('{"@id":'), name("subject"), F.lit(","), F.concat_ws(",", F.array_sort(F.expr(members))), F.lit("}")).alias("json"))


def jsonld_text(graph: Ontology) -> str:
    """A small graph as one JSON-LD document."""
    subjects = [json.loads(r.json) for r in jsonld_subjects(to_rdf(graph)).orderBy("subject").toLocalIterator()]
    return json.dumps({"@context": dict(sorted(graph.vocabulary.items())), "@graph": subjects}, indent=2, ensure_ascii=False)


def parse_jsonld(text: str, compat: bool = False) -> list[tuple]:
    """Triples of a JSON-LD document with @graph; context texts are prefixes.

    Values must be objects with @id or @value, bare ones are skipped.  @type
    gives rdf:type; with ``compat`` a triple whose predicate is the class.
    """
    doc = json.loads(text)
    if not isinstance(doc, dict) or not isinstance(doc.get("@graph"), list):
        raise ParseError("no @graph")
    context = {k: v for k, v in (doc.get("@context") or {}).items() if isinstance(v, str)}

    def expand(name: str) -> str:
        prefix, colon, local = name.partition(":")
        return context[prefix] + local if colon and prefix in context and not local.startswith("//") else name

    def ref(name: str) -> tuple[str, str]:
        return ("blank", name[2:]) if name.startswith("_:") else ("iri", expand(name))

    out = []
    for item in doc["@graph"]:
        if not isinstance(item, dict) or not isinstance(item.get("@id"), str):
            raise ParseError("an object of @graph needs an @id")
        s = ref(item["@id"])
        for key, values in item.items():
            values = values if isinstance(values, list) else [values]
            if key == "@type":
                out += [(*s, expand(v) if compat else TYPE, "iri", expand(v), None, None) for v in values if isinstance(v, str)]
            if key.startswith("@"):
                continue
            for v in values:
                if not isinstance(v, dict):
                    continue
                if isinstance(v.get("@id"), str):
                    out.append((*s, expand(key), *ref(v["@id"]), None, None))
                elif "@value" in v:
                    raw = v["@value"]
                    lexical = raw if isinstance(raw, str) else json.dumps(raw)
                    lang = v.get("@language")
                    datatype = LANG_STRING if lang else expand(v["@type"]) if isinstance(v.get("@type"), str) else STRING
                    out.append((*s, expand(key), "literal", lexical, datatype, lang))
    return out


def read_jsonld(spark: SparkSession, path: str) -> DataFrame:
    """Triples of JSON-LD files."""
    return _documents(spark, path, parse_jsonld)


def triples_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A frame of parsed triples."""
    return spark.createDataFrame(rows, TRIPLES)

