"""Names, CURIEs and IRIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL_BASE = "urn:graphloom:local#"


def local_name(iri: Column) -> Column:
    """What follows the last #, / or colon."""
    return F.regexp_extract(iri, "[^#/:]*$", 0)


def expand_curie(curie: Column, vocabulary: dict[str, str]) -> Column:
    """Base and local name of prefix:name; null if there is no colon or the prefix isn't known."""
    prefix = F.regexp_extract(curie, "^([^:]*):", 1)
    base = F.lit(None).cast("string")
    for p, b in sorted(vocabulary.items()):
        base = F.when(prefix == p, F.lit(b)).otherwise(base)
    return F.when(curie.contains(":"), F.concat(base, F.regexp_replace(curie, "^[^:]*:", "")))


def expand(base: str, name: Column) -> Column:
    """Base and local name together."""
    return F.concat(F.lit(base), name)


def ensure_iri(name: Column, vocabulary: dict[str, str], base: str = LOCAL_BASE) -> Column:
    """A CURIE of a known prefix expanded, any other text with a colon as it is, else ``base`` and the name."""
    return F.coalesce(expand_curie(name, vocabulary), F.when(name.contains(":"), name).otherwise(F.concat(F.lit(base), name)))


def is_iri(text: Column) -> Column:
    """Whether a text is neither empty nor has white space in it."""
    return F.coalesce((F.length(text) > 0) & ~text.rlike(r"(?U)\s"), F.lit(False))


# fixed values: datatype -> the name in the XML Schema namespace
XSD = {"string": "string", "integer": "integer", "float": "double", "bool": "boolean", "date_time": "dateTime", "iri": "anyURI", "bytes": "base64Binary"}
XSD_BASE = "http://www.w3.org/2001/XMLSchema#"
RDF_BASE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def datatype_iri(datatype: Column) -> Column:
    """The datatype IRI of a declared datatype; JSON is rdf:JSON."""
    out = F.when(datatype == "json", F.lit(RDF_BASE + "JSON"))
    for name, xsd in XSD.items():
        out = out.when(datatype == name, F.lit(XSD_BASE + xsd))
    return out


def datatype_name(iri: Column) -> Column:
    """The declared datatype of a datatype IRI; string if it isn't known."""
    out = F.when(iri == RDF_BASE + "JSON", "json")
    for name, xsd in XSD.items():
        out = out.when(iri == XSD_BASE + xsd, F.lit(name))
    return out.otherwise("string")


def expand_curies(df: DataFrame, curie: str, prefixes: DataFrame, to: str = "iri") -> DataFrame:
    """``df`` with ``curie`` expanded by a table (prefix, base) of any size, one row per prefix; null as ``expand_curie`` gives it."""
    named = df.withColumn("_prefix", F.when(F.col(curie).contains(":"), F.regexp_extract(curie, "^([^:]*):", 1)))
    found = named.join(prefixes.select(F.col("prefix").alias("_prefix"), F.col("base").alias("_base")), "_prefix", "left")
    return found.withColumn(to, F.concat("_base", F.regexp_replace(curie, "^[^:]*:", ""))).drop("_prefix", "_base")
