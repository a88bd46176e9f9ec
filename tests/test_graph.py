"""Matching, walking, query languages, changes, validation and reasoning on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.model import Iri, Json, build, empty
from graphloom.operators import reason, store, validate
from graphloom.plans import compile, cypher, sparql
from graphloom.plans.compile import match, traverse
from graphloom.plans.lexer import QueryError, Unsupported
from graphloom.plans.pattern import EdgePattern, NodePattern, TraversalPlan

N, E = NodePattern(), EdgePattern()


def graph(spark, edges, nodes="abcd", **more):
    return build(spark, nodes=[{"id": n, "types": ["T"], "properties": {"k": n}} for n in nodes], edges=[{"id": i, "source": s, "label": lab, "target": t} for i, s, lab, t in edges], **more)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_parallel_edges_and_loops(spark):
    g = graph(spark, [("e2", "a", "y", "b"), ("e1", "a", "x", "b"), ("e0", "a", "x", "a")])
    plan = TraversalPlan(N.with_id("a")).out(E.bind("e"), N.bind("n"))
    assert rows(traverse(g, plan)) == [("e1", "b")]
    assert rows(traverse(g, TraversalPlan(N.with_id("a")).out(E.bind("e").repeat(0, 1), N.bind("n")))) == [(None, "a"), ("e1", "b")]


def test_shortest_distance_only(spark):
    g = graph(spark, [("1", "a", "x", "b"), ("2", "b", "x", "c"), ("3", "a", "x", "c")])
    way = lambda lo, hi: [r[0] for r in rows(traverse(g, TraversalPlan(N.with_id("a")).out(E.repeat(lo, hi), N.bind("n"))))]
    assert way(3, 3) == [] and way(2, 2) == [] and way(1, 2) == ["b", "c"]


def test_cycle_and_missing_nodes(spark):
    g = graph(spark, [("1", "a", "x", "b"), ("2", "b", "x", "c"), ("3", "c", "x", "a")])
    assert rows(traverse(g, TraversalPlan(N.with_id("a")).out(E.repeat(1, None), N.bind("n")))) == [("b",), ("c",)]
    g = graph(spark, [("1", "a", "x", "gone"), ("2", "gone", "x", "b")])
    assert rows(traverse(g, TraversalPlan(N.with_id("a")).out(E, N.bind("n")))) == []
    assert rows(traverse(g, TraversalPlan(N.with_id("a")).out(E.repeat(1, 2), N.bind("n")))) == [("b",)]


def test_diamond(spark):
    g = graph(spark, [("1", "a", "x", "b"), ("2", "a", "x", "c"), ("3", "b", "x", "d"), ("4", "c", "x", "d")])
    assert rows(traverse(g, TraversalPlan(N.with_id("a")).out(E.repeat(2, 2).bind("e"), N.bind("n")))) == [("3", "d")]
    assert rows(traverse(g, TraversalPlan(N.with_id("a")).out(E, N.bind("m")).out(E, N.bind("n")))) == [("b", "d"), ("c", "d")]


def brute(edges, nodes, seeds, steps):
    """Rows of a plan by breadth-first search, node by node."""
    out = [((s,), s) for s in sorted(seeds)]
    for label, outbound, least, most in steps:
        next_ = []
        for row, start in out:
            seen, layer, depth = {start}, [start], 0
            while True:
                if depth >= least:
                    next_ += [((*row, n), n) for n in layer if n in nodes]
                if depth == most or not layer:
                    break
                new = []
                for n in layer:
                    for _, s, lab, t in sorted(edges):
                        near, far = (s, t) if outbound else (t, s)
                        if near == n and (label is None or lab == label) and far not in seen:
                            seen.add(far)
                            new.append(far)
                layer, depth = new, depth + 1
        out = next_
    return [row for row, _ in out]


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_in_order(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    edges = [(f"e{i:02}", rng.choice(names), rng.choice("xy"), rng.choice([*names, "gone"])) for i in range(22)]
    g = graph(spark, edges, nodes=names)
    for steps in ([("x", True, 1, 1), (None, False, 1, 1)], [(None, True, 1, 3)], [("y", False, 0, 2), ("x", True, 1, 1)], [("x", True, 2, None)]):
        plan = TraversalPlan(N.bind("v0"))
        for i, (label, outbound, least, most) in enumerate(steps):
            edge = (E.labeled(label) if label else E).repeat(least, most)
            target = N.bind(f"v{i + 1}")
            plan = plan.out(edge, target) if outbound else plan.in_(edge, target)
        assert rows(traverse(g, plan)) == brute(edges, set(names), names, steps)


def test_typed_values(spark):
    values = ["1", 1, 1.0, True, None, Iri("1"), Json("[1, 2]"), float("nan")]
    g = build(spark, nodes=[{"id": str(i), "properties": {"v": v}} for i, v in enumerate(values)] + [{"id": "none"}])
    hit = lambda v: [r[0] for r in rows(match(g, N.bind("n").with_property("v", v)))]
    assert [hit(v) for v in values[:7]] == [["0"], ["1"], ["2"], ["3"], ["4"], ["5"], ["6"]] and hit(float("nan")) == []
    assert len(rows(match(g, N.bind("n").not_(N.with_property("v", 1))))) == 8
    assert rows(match(g, N.bind("n").not_(N))) == [] and match(g, N).count() == 9
    assert rows(match(g, N.bind("n").or_(N.with_property("v", 1)).or_(N.with_id("none")))) == [("1",), ("none",)]


def test_order_skip_limit_and_projection(spark):
    g = graph(spark, [("1", "a", "x", "b"), ("2", "a", "x", "c"), ("3", "b", "x", "d")])
    plan = TraversalPlan(N.bind("s")).out(E.bind("e"), N.bind("t"))
    assert rows(traverse(g, plan.order_by_desc("t").skip(1).limit(1))) == [("a", "2", "c")]
    assert rows(traverse(g, plan.return_("t", "nothing"))) == [("b",), ("c",), ("d",)]
    again = TraversalPlan(N.bind("s").with_id("a")).out(E, N.bind("s"))
    assert rows(traverse(g, again)) == [("b",), ("c",)]


def test_cypher():
    p = cypher.parse('MATCH (a:X:Y {k: "q\\"\\n", n: -3, b: TRUE})<-[e:L*2..]-(b)-->(c) WHERE NOT b:Z RETURN a, c LIMIT 7')
    assert p.seed == N.bind("a").typed("X").typed("Y").with_property("k", 'q"\n').with_property("n", -3).with_property("b", True)
    assert p.steps[0].edge == E.bind("e").labeled("L").repeat(2, None) and not p.steps[0].outbound and p.steps[1].outbound
    assert p.steps[0].target.excluded == (N.typed("Z"),) and p.columns == ("a", "c") and p.limited == 7
    assert [cypher.parse(f"MATCH (a)-[{r}]->(b) RETURN a").steps[0].edge.most for r in ("*", "*3", "*1..4", ":L")] == [None, 3, 4, 1]
    for bad, error in (("MATCH (a", QueryError), ("MATCH (a) RETURN a x", QueryError), ("MATCH (a)<-[]->(b) RETURN a", Unsupported), ("MATCH (a) WHERE a.k = 1 RETURN a", QueryError), ("MATCH (a)-[*3..2]->(b) RETURN a", QueryError), ("MATCH (a {k: 1.5}) RETURN a", QueryError), ("RETURN a", QueryError)):
        with pytest.raises(error):
            cypher.parse(bad)


def test_sparql():
    p = sparql.parse("PREFIX x: <urn:x#> SELECT ?a ?b WHERE { ?a a x:T ; x:l ?b . ?b <urn:y/m> ?c . ?c a :U . ?c :n x:V } OFFSET 2 LIMIT 3 # end")
    assert p.seed == N.bind("a").typed("T") and [s.edge.label for s in p.steps] == ["l", "m", "n"]
    assert p.steps[1].target == N.bind("c").typed("U") and p.steps[2].target == N.typed("V") and (p.skipped, p.limited, p.columns) == (2, 3, ("a", "b"))
    assert sparql.parse("select * where { ?a :l ?b }").columns == ()
    for bad, error in (("SELECT WHERE {}", QueryError), ("SELECT * WHERE { }", QueryError), ("SELECT * WHERE { :a :b ?c }", Unsupported), ("SELECT * WHERE { ?a ?p ?c }", Unsupported), ("SELECT * WHERE { ?a :l ?b . ?z :l ?c }", Unsupported), ("SELECT * WHERE { ?a :l ?b } x", QueryError)):
        with pytest.raises(error):
            sparql.parse(bad)


def toy(spark):
    name = {"name": "name", "datatype": "string", "cardinality": (1, 1)}
    return build(
        spark,
        nodes=[{"iri": f"https://example.org/{i}", "types": t, "properties": {"name": n}} for i, t, n in (("Acme", ["Organization", "FormalOrganization"], "Acme Inc."), ("Globex", ["Organization", "FormalOrganization"], "Globex Inc."), ("Bob", ["Person"], "Bob Smith"))],
        edges=[{"source": "https://example.org/Bob", "label": "memberOf", "target": "https://example.org/Acme"}, {"source": "https://example.org/Globex", "label": "memberOf", "target": "https://example.org/Acme"}],
        axioms=[("SubClassOf", "FormalOrganization", "Organization")],
        node_types=[{"name": "Organization", "properties": [name]}, {"name": "FormalOrganization", "supertypes": ["Organization"]}, {"name": "Person", "properties": [name]}],
        edge_types=[{"name": "memberOf", "domain": ["Person"], "range": ["Organization"]}],
    )


def test_toy_ontology(spark):
    g = toy(spark)
    assert rows(store.counts(g)) == [(3, 2)] and g.axioms.count() == 1
    found = validate.validate(g)
    assert [(r.severity, r.code) for r in found.collect()] == [("error", "edge.domain")] and not validate.is_clean(found)
    assert validate.is_clean(validate.validate(empty(spark)))
    assert rows(store.subclasses_of(g, "Organization")) == [("FormalOrganization",)] and rows(store.count_instances(g, "Organization")) == [(2,)]
    assert rows(store.class_exists(g, "Person")) == [(True,)] and rows(store.properties_of_type(g, "Person")) == [("name", "string")]


def test_reasoner_rules_work_together(spark):
    g = graph(spark, [("1", "a", "p", "b"), ("2", "b", "p", "c"), ("3", "c", "q", "d")], axioms=[("InverseOf", "p", "q"), ("Transitive", "q"), ("Symmetric", "s"), ("EquivalentClass", "A", "B"), ("SubClassOf", "B", "C"), ("SubClassOf", "C", "D")])
    done, report = reason.materialize(g, activity_id="act")
    assert {(r.label, r.source, r.target) for r in report.edges.collect()} == {("q", "b", "a"), ("q", "c", "b"), ("q", "c", "a"), ("p", "d", "c"), ("p", "c", "d")} - {("p", "c", "d")} | {("p", "a", "c")}
    assert {(r.kind, r.a, r.b) for r in report.axioms.collect()} >= {("SubClassOf", "A", "B"), ("SubClassOf", "B", "A"), ("SubClassOf", "A", "D"), ("EquivalentClass", "B", "A"), ("InverseOf", "q", "p")}
    assert report.axioms.where("provenance = 'act'").count() == report.axioms.count()
    again = reason.run(done)
    assert again.axioms.count() == 0 and again.edges.count() == 0 and again.passes == 1
    with pytest.raises(reason.ReasonerError):
        reason.run(g, most=1)


def test_upserts_and_deltas(spark):
    g = graph(spark, [("1", "a", "x", "b")])
    new = build(spark, nodes=[{"id": "a", "types": ["U"], "properties": {"z": 1}}, {"id": "new", "types": ["U"]}], axioms=[("Functional", "x")])
    out = store.apply_delta(g, store.Delta(nodes=new.nodes, axioms=new.axioms), "act")
    assert out.nodes.count() == 5 and out.axioms.first().provenance == "act"
    a = out.nodes.where("id = 'a'").first()
    assert a.types == ["U"] and set(a.properties) == {"z"}
    merged = store.reconcile_nodes(g.nodes, new.nodes, "merge").where("id = 'a'").first()
    assert merged.types == ["T", "U"] and set(merged.properties) == {"k", "z"}
    with pytest.raises(ValueError, match="node type U"):
        store.checked_against_schema(g, store.Delta(nodes=new.nodes))
    assert store.last_wins(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "id string, n int, v string"), "id", "n").first().v == "y"
    assert store.pipeline(lambda d: d.where(F.col("id") == "a"), lambda d: d.select("id"))(g.nodes).count() == 1


def _shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["cypher_from_two", "var_path_1_3", "var_path_unbounded"])
def test_long_walk_does_not_shuffle_all_edges(spark, name):
    sf = "/root/testdata/sf0.01"
    before = _shuffled(spark)
    assert entry.queries()[name](spark, sf).count()
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert 0 < _shuffled(spark) - before < 64 * lines  # an edge has three ids of 64 digits


def test_long_walk_in_all_sizes(spark, monkeypatch):
    rng = random.Random(5)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)}
    graph = build(spark, nodes=[{"iri": f"urn:{i}", "types": ["T"]} for i in range(38)], edges=[{"source": f"urn:{a}", "label": "to", "target": f"urn:{b}"} for a, b in pairs])
    plan = TraversalPlan(N.bind("a")).out(E.repeat(1, None), N.bind("b"))
    walked = lambda: sorted(map(tuple, traverse(graph, plan, unordered=True).collect()))
    ids = {r.id: int(r.iri[4:]) for r in graph.nodes.collect()}
    want = set()
    for start in range(38):
        near, seen = {start}, {start}
        while near:
            near = {b for a, b in pairs if a in near} - seen
            seen |= near
        want |= {(start, x) for x in seen - {start} if x < 38}
    rows = walked()
    assert len(rows) == len(set(rows)) and {(ids[a], ids[b]) for a, b in rows} == want
    for hashes, rows_sent in ((0, 0), (1 << 20, 0)):
        monkeypatch.setattr(compile, "MOST_HASHES", hashes)
        monkeypatch.setattr(compile, "MOST_BROADCAST", rows_sent)
        assert walked() == rows
