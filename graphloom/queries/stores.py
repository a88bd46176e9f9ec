"""Queries on stores, versions, ledgers, projectors and extraction, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import empty
from graphloom.operators import store, validate
from graphloom.operators.extract import CachedBackend, MockBackend, Session, entity_nodes, extract, proposed_axioms, record_delta, store_tools
from graphloom.operators.provenance import Activity, ProvenanceLog, commit_with_provenance
from graphloom.operators.store import Delta
from graphloom.queries.actors import _EVENTS, _ID, _PATHS, _PREFIXES, _p, records
from graphloom.queries.graph import _NEW, _OLD, _flat, _states, _strict
from graphloom.queries.tables import table
from graphloom.session import scratch
from graphloom.sources import persist, remote, tables_graph, viz
from graphloom.sources.delta_store import DeltaStore
from graphloom.sources.versioned import VersionedStore
from graphloom.streaming.ingest import Batch, Polling, PushHook, Replay
from graphloom.streaming.projection import Minting, Records, actor_schema, event_stream, hierarchical
from graphloom.streaming.projector import Projector
from graphloom.streaming.sources import SnapshotSource, TableSource


def _applied(spark: SparkSession, sf: str) -> DataFrame:
    """Customers after a delta over them; nodes alone."""
    one, two = _states(spark, sf)
    return _flat(store.apply_delta(one, Delta(nodes=two.nodes)).nodes)


def _merged(strategy: str):
    return lambda spark, sf: _flat(store.merge(*_states(spark, sf), strategy).nodes)


def _checkpointed(spark: SparkSession, sf: str) -> DataFrame:
    """The newest of two saved versions, loaded again."""
    one, two = _states(spark, sf)
    c = persist.FolderCheckpointer(spark, scratch(spark, "checkpoint"), keep=1)
    c.save(one)
    c.save(two)
    return _flat(c.load().nodes)


def _in_memory(spark: SparkSession, sf: str) -> DataFrame:
    c = persist.MemoryCheckpointer()
    for graph in _states(spark, sf):
        c.save(graph)
    return _flat(c.load().nodes)


def _persistent(spark: SparkSession, sf: str) -> DataFrame:
    """A store committed to twice, closed and opened again: its version, nodes and activities."""
    c = persist.FolderCheckpointer(spark, scratch(spark, "persistent"))
    first = persist.PersistentStore(spark, c)
    one, two = _states(spark, sf)
    first.commit_with_provenance(Delta(nodes=one.nodes), Activity("one", id="a1"))
    first.commit_with_provenance(Delta(nodes=two.nodes), Activity("two", id="a2"))
    again = persist.PersistentStore(spark, c)
    return _flat(again.graph.nodes).withColumn("version", F.lit(again.version)).crossJoin(again.ledger.agg(F.count("*").alias("activities")))


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    """The graph after two committed deltas, one of them repeated."""
    s = DeltaStore(spark, scratch(spark, "deltas"))
    one, two = _states(spark, sf)
    for graph, name in ((one, "a1"), (two, "a2"), (one, "a1")):
        s.commit(Delta(nodes=graph.nodes), Activity("load", id=name))
    return _flat(s.graph().nodes)


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    """Commits of a branch, a merge and what each version holds."""
    one, two = _states(spark, sf)
    s = VersionedStore(spark, scratch(spark, "versions"))
    s.commit("first", "me", one)
    s.branch("side")
    s.checkout("side")
    s.commit("second", "me", two)
    s.checkout("main")
    s.merge("side")
    out = None
    for n, c in enumerate(s.history()):
        g = s.as_of(c.id)
        row = g.nodes.agg(F.count("*").alias("nodes")).select(F.lit(n).alias("place"), F.lit(c.message).alias("message"), F.lit(len(c.parents)).alias("parents"), "nodes")
        out = row if out is None else out.unionByName(row)
    return out


def _branches(spark: SparkSession, sf: str) -> DataFrame:
    """Branches of a store that two users change, and the heads' messages."""
    one, two = _states(spark, sf)
    a = VersionedStore(spark, scratch(spark, "branches"))
    b = VersionedStore(spark, a.log.root)
    first = a.commit("first", "a", one)
    b.commit("second", "b", two)
    b.branch("side")
    a.move("main", first)
    c = VersionedStore(spark, a.log.root)
    return spark.createDataFrame([(n, c.commits[h].message) for n, h in sorted(c.heads.items())], "branch string, message string")


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Records of batches as activities, an append for each half: of one id the later append counts."""
    log = ProvenanceLog(spark, scratch(spark, "ledger"))
    b = table(spark, sf, "actor_batches").where("batch_id is not null").groupBy("batch_id").agg(F.max("source").alias("source"), F.min("recorded_at").alias("first"), F.max("recorded_at").alias("last"))
    row = lambda end: b.select(F.col("batch_id").cast("string").alias("id"), F.lit("batch").alias("label"), F.col("source").alias("agent"), F.col("first").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at") if end is None else F.col(end).alias("ended_at"), F.create_map(F.lit("n"), F.lit("1")).alias("attributes"))
    log.append(activities=row(None))
    log.append(activities=row("last").where("source is not null"))
    return log.table("activities").select("id", "label", "agent", "ended_at")


def _lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """An activity, whom it was done by, and the graph committed with it."""
    log = ProvenanceLog(spark, scratch(spark, "lifecycle"))
    one, _ = _states(spark, sf)
    graph, id = commit_with_provenance(empty(spark), Delta(nodes=one.nodes), Activity("load", id="x").by("me").with_attribute("n", [1]).finish(), log)
    a = log.table("activities").select("id", "label", "agent", F.col("ended_at").isNotNull().alias("finished"), F.col("attributes")["n"].alias("n"))
    return a.crossJoin(graph.nodes.agg(F.count("*").alias("nodes")))


def _derivations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "commits").where("commit_id is not null").select("commit_id", "message", "parent").distinct()
    return c.groupBy(F.col("commit_id").alias("id")).agg(F.max("message").alias("label")).where("label is not null"), c.where("parent is not null").select(F.col("commit_id").alias("derived"), F.col("parent").alias("source")).distinct()


def _remote(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a query asked over HTTP."""
    graph = tables_graph.read(spark, sf)
    server = remote.serve(lambda: graph)
    try:
        client = remote.RemoteClient(f"http://127.0.0.1:{server.server_address[1]}")
        rows = client.call("cypher", query="MATCH (n:Nation)-[:inRegion]->(r:Region) RETURN n, r")
        counts = client.call("counts")[0]
    finally:
        server.shutdown()
    return spark.createDataFrame([(r["n"], r["r"], counts["node_count"]) for r in rows], "n string, r string, node_count bigint")


# projectors


def _source(spark: SparkSession, sf: str) -> TableSource:
    r = records(spark, sf)
    return TableSource(r.paths, r.events, r.states, "journal")


def _reported(spark: SparkSession, *projectors: Projector) -> DataFrame:
    return spark.createDataFrame([(p.report.batches, p.report.nodes, p.report.edges, p.report.activities) for p in projectors], "batches bigint, nodes bigint, edges bigint, activities bigint")


def _projected(spark: SparkSession, sf: str, ingests, shape="hierarchical", **more) -> Projector:
    p = Projector(DeltaStore(spark, scratch(spark, "projected")), shape, source="journal", **more)
    p.run(_source(spark, sf), *ingests)
    return p


def _types_count(graph) -> DataFrame:
    return graph.nodes.groupBy(F.get("types", F.lit(0)).alias("type")).agg(F.count("*").alias("n"))


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    """What a replay reports; the second one finds its batch committed."""
    p = _projected(spark, sf, (Replay(), Replay()), fixed_schema=actor_schema(spark))
    return _reported(spark, p)


def _polled(spark: SparkSession, sf: str) -> DataFrame:
    """Two ticks over the journal: the second finds nothing new."""
    return _types_count(_projected(spark, sf, (Polling(ticks=2, every=0.01, with_paths=False),), "event_stream").store.graph())


def _second_pass(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot-diff shape over two batches that overlap: each record once."""
    r = records(spark, sf)
    p = Projector(DeltaStore(spark, scratch(spark, "diff")), "snapshot_diff", source="journal", seen=scratch(spark, "seen"))
    p.commit(Records(r.paths, r.events.where("version % 3 > 0"), r.states), "one")
    p.commit(r, "two")
    p.commit(r, "three")
    return _types_count(p.store.graph()).crossJoin(spark.createDataFrame([(p.report.batches, p.report.nodes)], "batches bigint, reported bigint"))


def _pushed(spark: SparkSession, sf: str) -> DataFrame:
    """Events read from a snapshot when it is saved."""
    hook = PushHook()
    checkpointer = hook.wrap(persist.FolderCheckpointer(spark, scratch(spark, "pushed")))
    delta = hierarchical(records(spark, sf), "journal")
    checkpointer.save(empty(spark).with_(nodes=store.last_wins(delta.nodes, "id", None)))
    hook.close()
    p = Projector(DeltaStore(spark, scratch(spark, "projected")), "event_stream", source="snapshot")
    p.run(SnapshotSource(checkpointer), hook)
    return p.store.graph().nodes.groupBy(_p("event_kind")["s"].alias("kind")).agg(F.count("*").alias("n"))


class _ByParity:
    """An ingest of one's own: two batches by the parity of the version."""

    label = "parity"

    def batches(self, source):
        for k in (0, 1):
            events = source.journal(-1).where(F.pmod("version", F.lit(2)) == k)
            yield Batch(Records(source.paths().where("false"), events, source.states(events.select("actor"))), k, self.label, str(k))


def _kinds_alone(given: Records, source: str, minting: Minting) -> Delta:
    """A projection of one's own: only events of the kind created, as the event stream has them."""
    return Delta(event_stream(Records(given.paths, given.events.where("lower(trim(kind)) = 'created'"), given.states), source, minting).nodes)


def _minted_paths(spark: SparkSession, sf: str) -> DataFrame:
    nodes = hierarchical(records(spark, sf), "journal", Minting("path", "urn:m/")).nodes
    return nodes.where("array_contains(types, 'Actor')").select("id", "iri")


def _random(spark: SparkSession, sf: str) -> DataFrame:
    """With random ids no edge points to a node that isn't there."""
    d = hierarchical(records(spark, sf), "journal", Minting("uuid"))
    ids = d.nodes.select("id")
    up = d.edges.where("label = 'supervises'")
    lost = up.join(ids.withColumnRenamed("id", "source"), "source", "left_anti").count() + up.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").count()
    return up.agg(F.count("*").alias("edges")).withColumn("lost", F.lit(lost).cast("bigint"))


def _kept(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that exist stay under skip_existing; the second source's label shows on none of them."""
    s = DeltaStore(spark, scratch(spark, "kept"))
    r = records(spark, sf)
    first = Records(r.paths, r.events.where("version % 2 = 0"), r.states)
    Projector(s, "event_stream", source="one").commit(first, "1")
    Projector(s, "event_stream", source="two", policy="skip_existing").commit(r, "2")
    return s.graph().nodes.groupBy(_p("source_label")["s"].alias("source")).agg(F.count("*").alias("n"))


# extraction


def _scripted(stage: str, answer: str, columns: list[str]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        backend = CachedBackend(MockBackend({"reasoner": answer}))
        return extract(table(spark, sf, "documents").select("doc_id", "text"), "text", stage, backend, ["doc_id"]).select("doc_id", *columns)

    return run


def _entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "entity_candidates").select("surface", "iri", "type_name")
    nodes = entity_nodes(rows, iri_required=True)
    return nodes.select("iri", F.concat_ws(",", "types").alias("types"), "surface")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as records of JSON texts, turned into nodes and edges."""
    p = table(spark, sf, "part")
    rows = p.select(F.concat(F.lit("urn:part/"), "p_partkey").alias("iri"), F.lit("Part").alias("type_name"), F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("name"), F.to_json(F.array("p_name"))).alias("properties"), F.array(F.array(F.lit("like"), F.concat(F.lit("urn:brand/"), "p_size"))).alias("outbound"), F.lit(None).cast("string").alias("source"))
    d = record_delta(rows.where("p_size is not null"))
    x = lambda k: F.element_at("properties", F.lit(k))
    return d.nodes.join(d.edges.select(F.col("source").alias("id"), "label", "target"), "id").select("iri", x("size")["i"].alias("size"), x("name")["t"].alias("name_tag"), "label", "target")


def _taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Proposed subclass relations as axioms."""
    c = table(spark, sf, "concept_clusters").where("name is not null").select(F.explode("members").alias("sub"), F.col("name").alias("sup"), F.lit(1.0).alias("score")).where("sub is not null")
    return proposed_axioms(c).select("kind", "a", "b")


def _agent(spark: SparkSession, sf: str) -> DataFrame:
    """An agent that counts instances by a tool and then ends."""
    graph = tables_graph.read(spark, sf)
    session = Session(MockBackend(['{"tool": "count_instances", "args": {"name": "Nation"}}', "done"]), store_tools(graph))
    answer, transcript = session.run("how many nations?")
    return spark.createDataFrame([(answer, len(transcript), transcript[1][0].rpartition("result: ")[2])], "answer string, turns bigint, result string")


def _segments_lengths(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.size(F.split("path", "/")) - 1)


QUERIES = {
    "apply_delta": _applied,
    "merge_ours": _merged("ours"),
    "merge_theirs": _merged("theirs"),
    "checkpoint_folder": _checkpointed,
    "checkpoint_memory": _in_memory,
    "persistent_store": _persistent,
    "delta_store": _deltas,
    "version_history": _versions,
    "version_branches": _branches,
    "ledger_latest": _ledger,
    "activity_lifecycle": _lifecycle,
    "provenance_dot_lines": lambda spark, sf: viz.provenance_dot_lines(*_derivations(spark, sf)),
    "provenance_mermaid_lines": lambda spark, sf: viz.provenance_mermaid_lines(*_derivations(spark, sf)),
    "remote_rows": _remote,
    "class_exists": lambda spark, sf: store.class_exists(_strict(spark, sf), "Agent").unionByName(store.class_exists(_strict(spark, sf), "Nobody")),
    "subclasses_of": lambda spark, sf: store.subclasses_of(_strict(spark, sf), "Agent"),
    "properties_of_type": lambda spark, sf: store.properties_of_type(_strict(spark, sf), "Customer"),
    "validate_errors": lambda spark, sf: validate.errors(validate.cardinality(_strict(spark, sf)).unionByName(validate.datatype(_strict(spark, sf)))).groupBy("code").agg(F.count("*").alias("n")),
    "stage_pipeline": lambda spark, sf: store.pipeline(lambda d: d.select("path").where("path is not null"), _segments_lengths, lambda d: d.groupBy("n").agg(F.count("*").alias("paths")))(table(spark, sf, "paths")),
    "projector_replay": _replayed,
    "projector_polling": _polled,
    "projector_push_hook": _pushed,
    "projector_second_pass": _second_pass,
    "projector_own_ingest": lambda spark, sf: _types_count(_projected(spark, sf, (_ByParity(),), "event_stream").store.graph()),
    "projector_own_projection": lambda spark, sf: _types_count(_projected(spark, sf, (Replay(),), _kinds_alone).store.graph()),
    "projector_skip_existing": _kept,
    "actor_minted_paths": _minted_paths,
    "actor_random_ids": _random,
    "actor_vocabulary": lambda spark, sf: actor_schema(spark).edge_types.select("name", F.concat_ws(",", "domain").alias("domain"), F.concat_ws(",", "range").alias("range")),
    "source_journal_since": lambda spark, sf: _source(spark, sf).journal(_source(spark, sf).cursor() // 2).select("actor", "version", "pos"),
    "extract_entities_mock": _scripted("entities", '[{"surface": "reasoner", "iri": "urn:r", "type_name": "Tool", "score": 0.5, "is_new": true}]', ["surface", "iri", "type_name", "is_new"]),
    "extract_relations_mock": _scripted("relations", '```\n[{"source": "reasoner", "label": "uses", "target": "journal", "score": 1}]\n```', ["source", "label", "target"]),
    "extract_records_mock": _scripted("records", '{"iri": "urn:r", "type_name": "Tool", "properties": {"n": "5"}, "outbound": [["to", "urn:s"]]}', ["iri", "type_name"]),
    "extract_clusters_mock": _scripted("clusters", '[{"name": "tools", "members": ["reasoner", "planner"], "score": 0.25}]', ["name"]),
    "extract_axioms_mock": _scripted("axioms", '[{"kind": "Transitive", "a": "partOf", "b": null, "score": 0.25}]', ["kind", "a"]),
    "entity_nodes": _entities,
    "record_nodes": _records,
    "taxonomy_axioms": _taxonomy,
    "agent_session": _agent,
}

_BOTH = f"WITH a AS ({_OLD}), b AS ({_NEW})"
_MENTIONED = "FROM documents WHERE contains(text, 'reasoner')"
_COMMITS = "(SELECT DISTINCT commit_id, message, parent FROM commits WHERE commit_id IS NOT NULL)"
_DOT_ID = lambda c: f"left('n_' || regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]', '_', 'g'), 60)"
_MER_ID = lambda c: f"'n' || regexp_replace(left({c}, 20), '[^\\p{{L}}\\p{{N}}]', '_', 'g')"
_EVENT_IDS = f"SELECT DISTINCT {_ID} AS id FROM ({_EVENTS})"
SQL = {
    "apply_delta": f"{_BOTH} SELECT * FROM b UNION ALL SELECT * FROM a ANTI JOIN b USING (id)",
    "merge_ours": f"{_BOTH} SELECT * FROM a",
    "merge_theirs": f"{_BOTH} SELECT * FROM b",
    "checkpoint_folder": f"{_BOTH} SELECT * FROM b",
    "checkpoint_memory": f"{_BOTH} SELECT * FROM b",
    "persistent_store": f"{_BOTH} SELECT *, 2 AS version, 2::BIGINT AS activities FROM (SELECT * FROM b UNION ALL SELECT * FROM a ANTI JOIN b USING (id))",
    "delta_store": f"{_BOTH} SELECT * FROM b UNION ALL SELECT * FROM a ANTI JOIN b USING (id)",
    "version_history": f"""{_BOTH} SELECT 0 AS place, 'merge side into main' AS message, 2 AS parents, (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b)) AS nodes
UNION ALL SELECT 1, 'first', 0, (SELECT count(*) FROM a) UNION ALL SELECT 2, 'second', 1, (SELECT count(*) FROM b)""",
    "version_branches": "SELECT * FROM (VALUES ('main', 'first'), ('side', 'second')) x(branch, message)",
    "ledger_latest": "SELECT CAST(batch_id AS VARCHAR) AS id, 'batch' AS label, max(source) AS agent, CASE WHEN max(source) IS NOT NULL THEN max(recorded_at) END AS ended_at FROM actor_batches WHERE batch_id IS NOT NULL GROUP BY batch_id",
    "activity_lifecycle": f"{_BOTH} SELECT 'x' AS id, 'load' AS label, 'me' AS agent, true AS finished, '[1]' AS n, count(*) AS nodes FROM a",
    "provenance_dot_lines": f"""SELECT 0 AS part, commit_id AS id, '  ' || {_DOT_ID('commit_id')} || ' [label="' || replace(replace(replace(m, '\\', '\\\\'), '"', '\\"'), chr(10), ' ') || '"];' AS value FROM (SELECT commit_id, max(message) AS m FROM {_COMMITS} GROUP BY commit_id) WHERE m IS NOT NULL
UNION ALL SELECT DISTINCT 1, commit_id, '  ' || {_DOT_ID('commit_id')} || ' -> ' || {_DOT_ID('parent')} || ' [label="wasDerivedFrom"];' FROM (SELECT DISTINCT commit_id, parent FROM {_COMMITS} WHERE parent IS NOT NULL)""",
    "provenance_mermaid_lines": f"""SELECT 0 AS part, commit_id AS id, '  ' || {_MER_ID('commit_id')} || '(["' || replace(m, '"', '&quot;') || '"])' AS value FROM (SELECT commit_id, max(message) AS m FROM {_COMMITS} GROUP BY commit_id) WHERE m IS NOT NULL
UNION ALL SELECT 1, commit_id, '  ' || {_MER_ID('commit_id')} || ' -- wasDerivedFrom --> ' || {_MER_ID('parent')} FROM (SELECT DISTINCT commit_id, parent FROM {_COMMITS} WHERE parent IS NOT NULL)""",
    "remote_rows": "SELECT sha256('NodeId|urn:nation/' || n_nationkey) AS n, sha256('NodeId|urn:region/' || n_regionkey) AS r, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) AS node_count FROM nation JOIN region ON n_regionkey = r_regionkey",
    "class_exists": "SELECT unnest([true, false]) AS exists",
    "subclasses_of": "SELECT 'Customer' AS name",
    "properties_of_type": "SELECT * FROM (VALUES ('name', 'string'), ('acctbal', 'float')) x(name, datatype)",
    "validate_errors": "SELECT 'cardinality.violation' AS code, (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS n",
    "stage_pipeline": "SELECT CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS n, count(*) AS paths FROM paths WHERE path IS NOT NULL GROUP BY 1",
    "projector_polling": f"SELECT 'ActorEvent' AS type, count(*) AS n FROM ({_EVENT_IDS})",
    "projector_push_hook": f"WITH e AS (SELECT DISTINCT version, actor, kind FROM ({_EVENTS})) SELECT kind, count(*) AS n FROM e GROUP BY kind",
    "projector_second_pass": f"""WITH c AS (SELECT 'Actor' AS type, count(*) AS n FROM ({_PATHS}) UNION ALL SELECT 'ActorEvent', count(DISTINCT (actor, version)) FROM ({_EVENTS}) UNION ALL SELECT 'ActorState', count(*) FROM (SELECT DISTINCT actor, digest FROM states WHERE actor IS NOT NULL))
SELECT type, n, 2::BIGINT AS batches, CAST((SELECT sum(n) FROM c) AS BIGINT) AS reported FROM c""",
    "projector_own_ingest": f"SELECT 'ActorEvent' AS type, count(*) AS n FROM ({_EVENT_IDS})",
    "projector_own_projection": f"SELECT 'ActorEvent' AS type, count(DISTINCT {_ID}) AS n FROM ({_EVENTS}) WHERE lower(kind) = 'created'",
    "projector_skip_existing": f"SELECT CASE WHEN even THEN 'one' ELSE 'two' END AS source, count(*) AS n FROM (SELECT {_ID} AS id, bool_or(version % 2 = 0) AS even FROM ({_EVENTS}) GROUP BY 1) GROUP BY 1",
    "actor_minted_paths": f"SELECT sha256('NodeId|urn:m' || path) AS id, 'urn:m' || path AS iri FROM ({_PREFIXES})",
    "actor_random_ids": f"SELECT count(*) AS edges, 0::BIGINT AS lost FROM ({_PREFIXES}) WHERE parent IS NOT NULL",
    "actor_vocabulary": "SELECT * FROM (VALUES ('supervises', 'Actor', 'Actor'), ('emitted', 'Actor', 'ActorEvent'), ('holdsState', 'Actor', 'ActorState'), ('successor', 'ActorEvent', 'ActorEvent')) x(name, domain, range)",
    "source_journal_since": f"SELECT actor, version, delivery_id AS pos FROM ({_EVENTS}) WHERE version > (SELECT max(version) // 2 FROM ({_EVENTS}))",
    "extract_entities_mock": f"SELECT doc_id, 'reasoner' AS surface, 'urn:r' AS iri, 'Tool' AS type_name, true AS is_new {_MENTIONED}",
    "extract_relations_mock": f"SELECT doc_id, 'reasoner' AS source, 'uses' AS label, 'journal' AS target {_MENTIONED}",
    "extract_records_mock": f"SELECT doc_id, 'urn:r' AS iri, 'Tool' AS type_name {_MENTIONED}",
    "extract_clusters_mock": f"SELECT doc_id, 'tools' AS name {_MENTIONED}",
    "extract_axioms_mock": f"SELECT doc_id, 'Transitive' AS kind, 'partOf' AS a {_MENTIONED}",
    "entity_nodes": "SELECT iri, coalesce(type_name, '') AS types, min(surface) AS surface FROM entity_candidates WHERE iri IS NOT NULL GROUP BY iri, type_name",
    "record_nodes": "SELECT 'urn:part/' || p_partkey AS iri, CAST(p_size AS BIGINT) AS size, 'json' AS name_tag, 'like' AS label, sha256('NodeId|urn:brand/' || p_size) AS target FROM part WHERE p_size IS NOT NULL",
    "taxonomy_axioms": "SELECT DISTINCT 'SubClassOf' AS kind, sub AS a, name AS b FROM (SELECT unnest(members) AS sub, name FROM concept_clusters WHERE name IS NOT NULL) WHERE sub IS NOT NULL",
    "agent_session": "SELECT 'done' AS answer, 2::BIGINT AS turns, CAST(count(*) AS VARCHAR) AS result FROM nation",
}
