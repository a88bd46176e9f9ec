"""RDF texts, importers, SHACL, persistence, versions, remote access and extraction."""

import json

import pytest

from graphloom.model import EDGES, NODES, Iri, Json, build, empty
from graphloom.operators.extract import CachedBackend, MockBackend, Session, entity_nodes, extract, extracted, induce, json_value, proposed_axioms, record_delta, relation_edges, store_tools, stream_complete
from graphloom.operators.provenance import Activity, ProvenanceLog, commit_with_provenance
from graphloom.operators.store import Delta
from graphloom.session import scratch, ship
from graphloom.sources import importers, persist, rdf, remote, shacl, viz
from graphloom.sources.delta_store import DeltaStore
from graphloom.sources.reference import reference_ontology
from graphloom.sources.versioned import VersionedStore, VersionError

TTL = """@prefix ex: <urn:ex#> . # prefixes
@prefix skos: <http://www.w3.org/2004/02/skos/core#> .
ex:Cat a skos:Concept ; skos:prefLabel "Cat", "Katze"@de ; skos:broader ex:Animal ; skos:related ex:Dog .
ex:Animal a skos:Concept ; skos:prefLabel "Animal" .
ex:Dog a skos:Concept ; skos:definition "a \\"dog\\"\\u00e9\\n" ; skos:broader ex:Animal ; ex:n 5 ; ex:t true ; ex:f 1.5e3 .
_:b1 ex:p "x"^^<urn:dt> .
"""


def sample(spark):
    return build(
        spark,
        nodes=[{"iri": "urn:a", "types": ["T"], "properties": {"s": 'q"\\\n', "i": 5, "f": 0.5, "b": True, "n": None, "u": Iri("urn:z"), "j": Json('{"b": 1, "a": [2]}'), "y": b"\x00\xff"}}, {"id": "0" * 64, "types": ["Blank"]}],
        edges=[{"source": "urn:a", "label": "to", "target": "0" * 64}, {"source": "missing", "label": "to", "target": "urn:a"}],
        axioms=[("SubClassOf", "T", "owl:Thing"), ("Transitive", "to")],
        node_types=[{"name": "T", "iri": "urn:T", "supertypes": ["Base"], "properties": [{"name": "s", "datatype": "string", "cardinality": (1, 1), "iri": "urn:s"}, {"name": "f", "datatype": "float"}]}],
        edge_types=[{"name": "to", "domain": ["T"], "range": ["T"], "functional": True, "inverse_of": "from"}],
    )


def found(df):
    return {tuple(r) for r in df.collect()}


def test_turtle():
    t = rdf.parse_turtle(TTL)
    assert len(t) == 14 and ("iri", "urn:ex#Cat", "http://www.w3.org/2004/02/skos/core#prefLabel", "literal", "Katze", rdf.LANG_STRING, "de") in t
    assert ("blank", "b1", "urn:ex#p", "literal", "x", "urn:dt", None) in t and any(x[4] == 'a "dog"é\n' for x in t)
    for bad in ("ex:a ex:b ex:c .", "<a> <b> <c>", '<a> <b> "x .', '"x" <b> <c> .'):
        with pytest.raises(rdf.ParseError):
            rdf.parse_turtle(bad)


def test_rdf_round_trips(spark, tmp_path):
    ship(spark)
    g = sample(spark)
    triples = rdf.to_rdf(g)
    want = found(triples)
    assert len(want) == triples.count() and not any(r[4] is None for r in want)
    assert found(rdf.parse_ntriples(rdf.ntriples_lines(triples))) == want
    rdf.write_ntriples(g, f"{tmp_path}/nt")
    assert found(rdf.read_ntriples(spark, f"{tmp_path}/nt")) == want
    assert set(rdf.parse_turtle(rdf.turtle_text(g))) == want
    rdf.write_turtle(g, f"{tmp_path}/ttl")
    assert found(rdf.read_turtle(spark, f"{tmp_path}/ttl")) == want
    assert set(rdf.parse_jsonld(rdf.jsonld_text(g))) == want
    back = rdf.from_rdf(triples)
    assert {(r.name, tuple(r.supertypes)) for r in back.node_types.collect()} == {("T", ("Base", "Thing"))} and back.edge_types.count() == 1


def test_ntriples_lines(spark):
    lines = ['<a> <b> "x\\u00e9\\t\\"" .', "", "# comment", '_:n <b> "y"@en . # tail', "<a> <b> _:c ."]
    got = found(rdf.parse_ntriples(spark.createDataFrame([(x,) for x in lines], "value string")))
    assert got == {("iri", "a", "b", "literal", 'xé\t"', rdf.STRING, None), ("blank", "n", "b", "literal", "y", rdf.LANG_STRING, "en"), ("iri", "a", "b", "blank", "c", None, None)}
    with pytest.raises(Exception, match="no triple"):
        rdf.parse_ntriples(spark.createDataFrame([("nonsense",)], "value string")).collect()


def test_importers(spark):
    g, activity = importers.import_skos(rdf.triples_of(spark, rdf.parse_turtle(TTL)))
    assert g.nodes.count() == 3 and g.edges.count() == 3 and activity.ended_at
    names = {r.iri: {k: v.s for k, v in (r.properties or {}).items()} for r in g.nodes.collect()}
    assert names["urn:ex#Animal"] == {"prefLabel": "Animal", "name": "Animal"} and "name" not in names["urn:ex#Dog"]
    doc = {"@context": {"s": "https://schema.org/"}, "@graph": [
        {"@id": "urn:acme", "@type": "s:Organization", "s:name": {"@value": "Acme"}, "s:url": {"@id": "urn:home"}, "s:extra": 5},
        {"@id": "urn:alice", "@type": ["s:Person"], "s:worksFor": [{"@id": "urn:acme"}], "s:memberOf": {"@id": "urn:club"}}, {"@id": "urn:x", "s:name": {"@value": "untyped"}},
    ]}
    g, _ = importers.import_schema_org(rdf.triples_of(spark, rdf.parse_jsonld(json.dumps(doc))))
    assert {(r.iri, r.types[0]) for r in g.nodes.collect()} == {("urn:acme", "Organization"), ("urn:alice", "Person"), ("urn:club", "Organization")} and g.edges.count() == 2
    foaf = "@prefix f: <http://xmlns.com/foaf/0.1/> .\n<urn:a> a f:Person ; f:name \"A\" ; f:knows <urn:b> ; f:mbox <mailto:a> ."
    g, _ = importers.import_foaf(rdf.triples_of(spark, rdf.parse_turtle(foaf)))
    assert {(r.iri, r.types[0]) for r in g.nodes.collect()} == {("urn:a", "Person"), ("urn:b", "Person")}


def test_shacl_round_trip(spark):
    g = sample(spark)
    back = shacl.from_shacl(spark, shacl.to_shacl(g)).node_types.first()
    assert back.name == "T" and {(p.name, p.datatype, p.cardinality.min, p.cardinality.max) for p in back.properties} == {("s", "string", 1, 1), ("f", "float", 0, None)}
    with pytest.raises(rdf.ParseError):
        shacl.from_shacl(spark, f"<urn:s> a <{shacl.SH}NodeShape> .")


def test_drawings(spark):
    g = sample(spark)
    assert viz.dot_text(g).startswith("digraph") and viz.dot_text(g).count("->") == 2 and viz.mermaid_text(g).count("-->") == 2


def test_checkpoints_and_wire_form(spark):
    g = sample(spark)
    c = persist.FolderCheckpointer(spark, scratch(spark, "c"), keep=1)
    assert c.load() is None
    c.save(empty(spark))
    c.save(g)
    back = c.load()
    assert found(rdf.to_rdf(back)) == found(rdf.to_rdf(g)) and c.log.versions() == [2]
    for part, schema in (("nodes", NODES), ("edges", EDGES)):
        rows = getattr(g, part)
        got = persist.unwire(spark, persist.wire(rows), schema)
        plain = lambda df: sorted((r.asDict(recursive=True) for r in df.collect()), key=lambda r: r["id"])
        assert plain(got) == [r | {"properties": r["properties"] or {}} for r in plain(rows.select(*schema.names))]
    m = persist.PersistentStore(spark, persist.MemoryCheckpointer())
    m.commit_with_provenance(Delta(nodes=g.nodes), Activity("load"))
    assert m.version == 1 and m.graph.nodes.count() == 2


def test_versions(spark):
    g, e = sample(spark), empty(spark)
    s = VersionedStore(spark, scratch(spark, "v"))
    with pytest.raises(VersionError):
        s.branch("early")
    one = s.commit("first", "me", e)
    s.branch("side")
    s.checkout("side")
    two = s.commit("second", "me", g)
    s.checkout("main")
    assert s.merge("side") and s.as_of(s.head().id).nodes.count() == 2 and s.head().parents == (one, two)
    assert [c.id for c in VersionedStore(spark, s.log.root).history()][1:] == [one, two] and s.as_of(one).nodes.count() == 0
    for bad in (lambda: s.merge("main"), lambda: s.merge("none"), lambda: s.checkout("none"), lambda: s.branch("side"), lambda: s.as_of("x")):
        with pytest.raises(VersionError):
            bad()


def test_ledger_and_delta_store(spark):
    log = ProvenanceLog(spark, scratch(spark, "p"))
    act = Activity("load").by("me").with_attribute("n", [1]).finish()
    g, id = commit_with_provenance(empty(spark), Delta(nodes=sample(spark).nodes), act, log)
    log.append(derived=[("x", "y"), ("x", "y")], activities=[act.by("you").row()])
    assert g.nodes.count() == 2 and [(r.id, r.agent) for r in log.table("activities").collect()] == [(id, "you")] and log.table("derived").count() == 2
    store = DeltaStore(spark, scratch(spark, "d"))
    store.commit(Delta(nodes=sample(spark).nodes), "a1")
    changed = build(spark, nodes=[{"iri": "urn:a", "types": ["New"]}])
    assert store.commit(Delta(nodes=changed.nodes), "a2") == 2 == store.commit(Delta(nodes=sample(spark).nodes), "a2")
    for _ in range(2):
        assert {tuple(r.types) for r in store.graph().nodes.collect()} == {("New",), ("Blank",)}
        store.compact()


def test_remote(spark):
    g = sample(spark)
    server = remote.serve(lambda: g)
    client = remote.RemoteClient(f"http://127.0.0.1:{server.server_address[1]}")
    assert client.call("cypher", query="MATCH (a:T)-[:to]->(b) RETURN b") == [{"b": "0" * 64}]
    assert client.call("counts") == [{"node_count": 2, "edge_count": 2}]
    for call in (lambda: client.call("nothing"), lambda: client.call("cypher", query="x")):
        with pytest.raises(remote.RemoteError):
            call()
    server.shutdown()


def test_reference_vocabulary(spark):
    o = reference_ontology(spark)
    assert (o.node_types.count(), o.edge_types.count(), o.axioms.count(), o.nodes.count()) == (8, 8, 6, 0)


def test_extraction(spark):
    ship(spark)
    docs = spark.createDataFrame([(1, "about Acme"), (2, "nothing"), (3, None), (4, "about Acme")], "doc_id int, text string")
    backend = MockBackend({"Acme": '```json\n[{"surface": "Acme", "iri": "urn:acme", "type_name": "Org", "score": 0.5}, {"surface": "Bob", "type_name": "Person"}]\n```', "nothing": "not json"})
    rows = extract(docs, "text", "entities", backend, ["doc_id"])
    assert {(r.doc_id, r.surface) for r in rows.collect()} == {(1, "Acme"), (1, "Bob"), (4, "Acme"), (4, "Bob")}
    nodes = entity_nodes(rows)
    assert nodes.count() == 2 and entity_nodes(rows, iri_required=True).count() == 1
    rel = spark.createDataFrame([("Bob", "worksFor", "Acme", 1.0), ("Bob", "knows", "Eve", 1.0)], "source string, label string, target string, score double")
    assert [r.label for r in relation_edges(rel, nodes).collect()] == ["worksFor"]
    assert proposed_axioms(spark.createDataFrame([("A", "B", 1.0), ("A", "B", 0.5)], "sub string, sup string, score double")).count() == 1
    values = spark.createDataFrame([('"x"',), ("5",), ("0.5",), ("true",), ("null",), ('{"b":1,"a":2}',), ("oops",)], "v string").select(json_value(__import__("pyspark").sql.functions.col("v")).alias("p")).collect()
    assert [(r.p.t if r.p else None) for r in values] == ["string", "integer", "float", "bool", "null", "json", None]
    rec = spark.createDataFrame([("urn:r", "T", {"n": "5"}, [["to", "urn:s"]], None)], "iri string, type_name string, properties map<string,string>, outbound array<array<string>>, source string")
    d = record_delta(rec)
    assert d.nodes.first().properties["n"].i == 5 and d.edges.count() == 1
    cached = CachedBackend(MockBackend(["1", "2", "3"]), "lru", most=1)
    assert [cached.complete(p) for p in ("a", "a", "b", "a")] == ["1", "1", "2", "3"]
    agent = Session(MockBackend(['{"tool": "add", "args": {"a": 1, "b": 2}}', "done"]), {"add": lambda a, b: a + b})
    assert agent.run("go")[0] == "done" and len(agent.run.__self__.backend.prompts) == 2


def test_activities_caches_and_sessions(spark, tmp_path):
    ship(spark)
    docs = spark.createDataFrame([(1, "about Acme", ["Acme", "Bob"]), (2, "about Acme", None)], "doc_id int, text string, who array<string>")
    backend = MockBackend({'["Acme","Bob"]': '[{"source": "Bob", "label": "worksFor", "target": "Acme", "score": 1}]', "[]": "[]"})
    rows, activity = extracted(docs, "text", "relations", backend, ["doc_id"], known="who", agent="me")
    assert [(r.doc_id, r.label) for r in rows.collect()] == [(1, "worksFor")]
    assert activity.ended_at and activity.agent == "me" and dict(activity.attributes) == {"backend": '"mock"', "rows": "1"}

    class Many:
        label = "many"

        def __init__(self):
            self.asked = []

        def complete(self, prompt):
            raise AssertionError

        def complete_batch(self, prompts):
            self.asked.append(list(prompts))
            return [p.upper() for p in prompts]

    inner = Many()
    cached = CachedBackend(inner, "content", folder=f"{tmp_path}/answers")
    assert cached.complete_batch(["a", "b", "a"]) == ["A", "B", "A"] and cached.complete("a") == "A" and inner.asked == [["a", "b"]]
    assert CachedBackend(inner, folder=f"{tmp_path}/answers").complete("b") == "B" and len(inner.asked) == 1
    plain = CachedBackend(inner, "none")
    assert plain.complete("a") == plain.complete("a") == "A" and len(inner.asked) == 3
    assert list(stream_complete(MockBackend(["x"]), "p")) == [("x", True)]
    with pytest.raises(ValueError, match="policy"):
        CachedBackend(inner, "some")
    g = sample(spark)
    tools = store_tools(g)
    assert tools["class_exists"]("T") and tools["list_classes"]() == ["T"] and tools["count_instances"]("T") == 1 and tools["supertypes_of"]("T") == ["T", "Base"] and tools["properties_of_type"]("T") == ["f", "s"] and tools["list_edge_types"]() == ["to"] and tools["subclasses_of"]("Base") == ["T"]
    script = ['{"tool": "class_exists", "args": {"name": "T"}}', '[{"sub": "T", "sup": "Base", "score": 0.9}]', "more"]
    axioms, activity = induce("subclasses", ["T"], Session(MockBackend(script), tools, stop="json:sub"), spark)
    assert [(r.kind, r.a, r.b) for r in axioms.collect()] == [("SubClassOf", "T", "Base")] and dict(activity.attributes)["tool_calls"] == "1"
    axioms, _ = induce("axioms", ["to"], Session(MockBackend(['[{"kind": "Symmetric", "a": "to"}]']), tools), spark)
    assert [(r.kind, r.a) for r in axioms.collect()] == [("Symmetric", "to")]
    session = Session(MockBackend(["a", "b", "c"]), tools, max_turns=2, stop="turns")
    assert session.run("go")[0] == "b" and induce("axioms", [], Session(MockBackend(["no json"]), {}), spark)[0].count() == 0
