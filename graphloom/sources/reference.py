"""A vocabulary of organisations after the W3C organization ontology."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphloom.model import Ontology, build

# fixed values: the public organization vocabulary
_ORG, _FOAF = "http://www.w3.org/ns/org#", "http://xmlns.com/foaf/0.1/"
_NAME = {"name": "name", "datatype": "string", "cardinality": (1, 1), "iri": "http://www.w3.org/2000/01/rdf-schema#label"}


def reference_ontology(spark: SparkSession, iri: str = "urn:graphloom:org") -> Ontology:
    """Eight node types, eight edge types, six axioms, no instances."""
    # fixed values: its types, properties and axioms
    org = lambda name, *sup, **more: {"name": name, "iri": _ORG + name, "supertypes": sup} | more
    link = lambda name, domain, range_, inverse=None: {"name": name, "iri": _ORG + name, "domain": domain, "range": range_, "inverse_of": inverse}
    o = ["Organization"]
    return build(
        spark,
        iri=iri,
        node_types=[
            org("Organization", properties=[_NAME]), org("FormalOrganization", *o), org("OrganizationalUnit", *o),
            {"name": "Person", "iri": _FOAF + "Person", "properties": [_NAME]}, org("Role"), org("Post"), org("Site"), org("Membership"),
        ],
        edge_types=[
            link("memberOf", ["Person", *o], o, "hasMember"), link("hasMember", o, ["Person", *o], "memberOf"),
            link("subOrganizationOf", o, o, "hasSubOrganization"), link("hasSubOrganization", o, o, "subOrganizationOf"),
            link("hasMembership", ["Person"], ["Membership"]), link("organization", ["Membership"], o), link("role", ["Membership"], ["Role"]), link("hasSite", o, ["Site"]),
        ],
        axioms=[
            ("EquivalentClass", "Organization", "schema:Organization"), ("SubClassOf", "FormalOrganization", "Organization"), ("SubClassOf", "OrganizationalUnit", "Organization"),
            ("InverseOf", "memberOf", "hasMember"), ("InverseOf", "subOrganizationOf", "hasSubOrganization"), ("Transitive", "subOrganizationOf"),
        ],
    )
