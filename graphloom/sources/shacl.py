"""Schemas as SHACL shapes in Turtle, and back."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from graphloom.functions.iri import XSD, XSD_BASE
from graphloom.model import STANDARD_PREFIXES, Ontology, build
from graphloom.sources.rdf import ParseError, parse_turtle

SH = STANDARD_PREFIXES["sh"]
BASE = "urn:graphloom:shacl:"


def to_shacl(graph: Ontology, base: str = BASE) -> str:
    """A NodeShape per node type with a block per property and per edge type of its domain; supertypes are left out.

    The schema is read whole: it is the declared types, not the data.
    """
    types = sorted((r.asDict(recursive=True) for r in graph.node_types.toLocalIterator()), key=lambda r: r["name"])
    edges = sorted((r.asDict(recursive=True) for r in graph.edge_types.toLocalIterator()), key=lambda r: r["name"])
    iris = {t["name"]: t["iri"] or base + t["name"] for t in types}
    lines, number = [f"@prefix sh: <{SH}> .", f"@prefix xsd: <{XSD_BASE}> .", ""], 0

    def counts(c: dict | None) -> list[str]:
        c = c or {}
        said = [(f"{SH}minCount", c.get("min")) if c.get("min") else None, (f"{SH}maxCount", c.get("max")) if c.get("max") is not None else None]
        return [f'<{k}> "{v}"^^<{XSD_BASE}integer>' for k, v in filter(None, said)]

    for t in types:
        blocks = []
        for p in t["properties"] or ():
            kind = XSD_BASE + XSD.get(p["datatype"], "string")
            blocks.append([f"<{SH}path> <{p['iri'] or base + p['name']}>", *counts(p["cardinality"]), f"<{SH}datatype> <{kind}>"])
        for e in edges:
            if t["name"] in (e["domain"] or ()):
                blocks.append([f"<{SH}path> <{e['iri'] or base + e['name']}>", *counts(e["cardinality"]), f"<{SH}nodeKind> <{SH}IRI>", *(f"<{SH}class> <{iris.get(r, base + r)}>" for r in e["range"] or ())])
        iri = iris[t["name"]]
        names = [f"_:b{number + i}" for i in range(len(blocks))]
        number += len(blocks)
        lines.append(" ;\n  ".join([f"<{iri}Shape> a <{SH}NodeShape>", f"<{SH}targetClass> <{iri}>", *(f"<{SH}property> {n}" for n in names)]) + " .")
        lines += [f"{n} " + " ;\n  ".join(b) + " ." for n, b in zip(names, blocks, strict=True)]
        lines.append("")
    return "\n".join(lines)


def from_shacl(spark: SparkSession, text: str) -> Ontology:
    """Node types with the properties that have a path and a datatype; a shape without target class is an error, an unknown datatype is text."""
    by: dict[str, dict[str, list[str]]] = {}
    for _, s, p, _, o, *_ in parse_turtle(text):
        by.setdefault(s, {}).setdefault(p, []).append(o)
    local = lambda iri: re.split("[#/:]", iri)[-1]
    names = {XSD_BASE + x: n for n, x in XSD.items()}
    types = []
    for s, about in by.items():
        if SH + "NodeShape" not in about.get("http://www.w3.org/1999/02/22-rdf-syntax-ns#type", []):
            continue
        if not about.get(SH + "targetClass"):
            raise ParseError(f"shape {s} has no target class")
        target = about[SH + "targetClass"][0]
        properties = []
        for b in about.get(SH + "property", []):
            block = by.get(b, {})
            if not block.get(SH + "path") or not block.get(SH + "datatype"):
                continue
            least, most = block.get(SH + "minCount", ["0"])[0], block.get(SH + "maxCount", [None])[0]
            path = block[SH + "path"][0]
            properties.append({"name": local(path), "datatype": names.get(block[SH + "datatype"][0], "string"), "cardinality": (int(least), None if most is None else int(most)), "iri": path})
        types.append({"name": local(target), "iri": target, "properties": properties})
    return build(spark, node_types=types)
