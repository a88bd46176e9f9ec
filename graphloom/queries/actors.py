"""Queries that project the journal and the supervision paths, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import render, segments, workflow_run
from graphloom.operators.extract import MockBackend, extract
from graphloom.operators.journal import deliveries
from graphloom.queries.tables import table
from graphloom.streaming.projection import Records, event_stream, flat, hierarchical, snapshot_diff


def records(spark: SparkSession, sf: str) -> Records:
    """The journal, paths and states as the projections take them; one load is one batch."""
    j = deliveries(table(spark, sf, "journal"))
    events = j.select("version", "token", "actor", "path", F.trim("kind").alias("kind"), F.col("event_at").alias("at"), "payload", F.col("load_id").cast("string").alias("batch"), F.col("delivery_id").alias("pos"))
    parts = F.filter(F.coalesce("segments", F.split("path", "/")), lambda x: x.isNotNull() & (x != ""))  # as p3 reads them: the text is irregular or missing in places
    paths = table(spark, sf, "paths").select(parts.alias("parts"), "attributes").where("size(parts) > 0").select(render(F.col("parts")).alias("path"), "attributes")
    states = table(spark, sf, "states").where("actor is not null").select("actor", "payload", "digest")
    return Records(paths, events, states)


def _p(key: str) -> F.Column:
    return F.element_at("properties", F.lit(key))


def hierarchical_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of path prefixes."""
    nodes = hierarchical(records(spark, sf), "journal").nodes.where("array_contains(types, 'Actor')")
    return nodes.select("id", F.get("types", F.lit(1)).alias("type"), _p("path")["s"].alias("path"), _p("depth")["i"].alias("depth"), _p("segment")["s"].alias("segment"))


def edges_of(label: str, project) -> object:
    return lambda spark, sf: project(records(spark, sf), "journal").edges.where(F.col("label") == label).select("id", "source", "target")


def flat_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with the number of their paths, events and states."""
    nodes = flat(records(spark, sf), "journal").nodes
    n = lambda k: F.json_array_length(_p(k)["s"]).cast("bigint")
    return nodes.select("id", _p("workflow")["s"].alias("workflow"), _p("run")["s"].alias("run"), _p("path_count")["i"].alias("path_count"), n("steps").alias("events"), n("states").alias("states"))


def run_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Workflow and run of each path."""
    return records(spark, sf).paths.select("path").distinct().select("path", workflow_run(segments(F.col("path"))).alias("k")).select("path", "k.*")


def snapshot_diff_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the first pass by type."""
    return snapshot_diff(records(spark, sf), "journal").nodes.groupBy(F.get("types", F.lit(0)).alias("type")).agg(F.count("*").alias("n"))


def extract_terms_mock(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of all documents by a scripted model."""
    backend = MockBackend({"reasoner": '[{"surface": "reasoner", "score": 0.9}]', "journal": '```json\n[{"surface": "journal", "score": 0.5, "category": "store"}]\n```'})
    return extract(table(spark, sf, "documents").select("doc_id", "text"), "text", "terms", backend, ["doc_id"]).select("doc_id", "surface", "category")


QUERIES = {
    "actor_hierarchical_nodes": hierarchical_nodes,
    "actor_supervises_edges": edges_of("supervises", hierarchical),
    "actor_emitted_edges": edges_of("emitted", hierarchical),
    "actor_successor": edges_of("successor", event_stream),
    "actor_holds_state": edges_of("holdsState", hierarchical),
    "actor_flat": flat_runs,
    "actor_run_keys": run_keys,
    "actor_snapshot_diff": snapshot_diff_nodes,
    "extract_terms_mock": extract_terms_mock,
}


_WS = "' ' || chr(9) || chr(10) || chr(13)"
_PATHS = "SELECT DISTINCT '/' || array_to_string(s, '/') AS path FROM (SELECT list_filter(coalesce(segments, string_split(path, '/')), lambda x: x IS NOT NULL AND x <> '') AS s FROM paths) WHERE len(s) > 0"
_EVENTS = f"SELECT trim(actor, {_WS}) AS actor, version, path, trim(kind) AS kind, load_id, delivery_id FROM journal WHERE trim(actor, {_WS}) <> '' AND version IS NOT NULL"
_ID = "sha256('NodeId|event:' || version || ':' || actor || ':' || kind)"
# segments as the projections read them: one slash at the start goes
_ALL = f"SELECT DISTINCT '/' || regexp_replace(path, '^/', '') AS path FROM (SELECT path FROM ({_PATHS}) UNION SELECT path FROM ({_EVENTS}) WHERE path IS NOT NULL)"
_PREFIXES = f"SELECT DISTINCT '/' || array_to_string(list_slice(s, 1, n), '/') AS path, CASE WHEN n > 1 THEN '/' || array_to_string(list_slice(s, 1, n - 1), '/') END AS parent, n - 1 AS depth, s[n] AS segment FROM (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM (SELECT string_split(substr(path, 2), '/') AS s FROM ({_ALL}) WHERE path <> '/'))"
_SEGMENT_TYPE = "CASE segment WHEN 'workflow' THEN 'Workflow' WHEN 'run' THEN 'Run' WHEN 'step' THEN 'Step' ELSE 'ActorPathSegment' END"
_edge = lambda s, label, t: f"sha256('EdgeId|' || {s} || '|{label}|' || {t}) AS id, {s} AS source, {t} AS target"
SQL = {
    "actor_hierarchical_nodes": f"SELECT sha256('NodeId|' || path) AS id, {_SEGMENT_TYPE} AS type, path, depth, segment FROM ({_PREFIXES})",
    "actor_supervises_edges": f"SELECT DISTINCT {_edge("sha256('NodeId|' || parent)", 'supervises', "sha256('NodeId|' || path)")} FROM ({_PREFIXES}) WHERE parent IS NOT NULL",
    "actor_emitted_edges": f"SELECT DISTINCT {_edge("sha256('NodeId|/' || regexp_replace(path, '^/', ''))", 'emitted', _ID)} FROM ({_EVENTS}) WHERE path IS NOT NULL AND path <> '/'",
    "actor_successor": f"SELECT DISTINCT {_edge('before', 'successor', 'node')} FROM (SELECT {_ID} AS node, lag({_ID}) OVER (PARTITION BY load_id ORDER BY delivery_id) AS before FROM ({_EVENTS})) WHERE before IS NOT NULL",
    "actor_snapshot_diff": f"SELECT 'Actor' AS type, count(*) AS n FROM ({_PATHS}) UNION ALL SELECT 'ActorEvent', count(DISTINCT (actor, version)) FROM ({_EVENTS}) UNION ALL SELECT 'ActorState', count(*) FROM (SELECT DISTINCT actor, digest FROM states WHERE actor IS NOT NULL)",
}
# workflow and run of a path's segments, one after the other: a segment that is taken as a value is no keyword
_FOLD = """list_reduce(list_transform(s, lambda x: {'w': CAST(NULL AS VARCHAR), 'r': CAST(NULL AS VARCHAR), 'k': '', 'x': x}), lambda a, b: CASE WHEN a.k <> ''
  THEN {'w': CASE WHEN a.k = 'workflow' THEN b.x ELSE a.w END, 'r': CASE WHEN a.k = 'run' THEN b.x ELSE a.r END, 'k': '', 'x': ''}
  ELSE {'w': CASE WHEN b.x = 'workflow' THEN NULL ELSE a.w END, 'r': CASE WHEN b.x = 'run' THEN NULL ELSE a.r END, 'k': CASE WHEN b.x IN ('workflow', 'run') THEN b.x ELSE '' END, 'x': ''} END,
  {'w': CAST(NULL AS VARCHAR), 'r': CAST(NULL AS VARCHAR), 'k': '', 'x': ''})"""
_KEYED = lambda given: f"SELECT *, k.w AS workflow, CASE WHEN k.w IS NOT NULL THEN coalesce(k.r, '<no-run>') END AS run FROM (SELECT *, {_FOLD} AS k FROM (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS s FROM ({given})))"
_EVERY_PATH = "SELECT '/' || array_to_string(s, '/') AS path FROM (SELECT list_filter(coalesce(segments, string_split(path, '/')), lambda x: x IS NOT NULL AND x <> '') AS s FROM paths) WHERE len(s) > 0"
SQL |= {
    "actor_run_keys": f"SELECT path, workflow, run FROM ({_KEYED(_PATHS)})",
    "actor_flat": f"""WITH r AS (
SELECT workflow, run, 1 AS n, 0 AS e, 0 AS st FROM ({_KEYED(_EVERY_PATH)}) WHERE workflow IS NOT NULL UNION ALL SELECT workflow, run, 0, 1, 0 FROM ({_KEYED(f"SELECT path FROM ({_EVENTS}) WHERE path IS NOT NULL")}) WHERE workflow IS NOT NULL
UNION ALL SELECT '<unrouted>', actor, 0, 0, 1 FROM states WHERE actor IS NOT NULL)
SELECT sha256('NodeId|flat:' || workflow || ':' || run) AS id, workflow, run, CAST(sum(n) AS BIGINT) AS path_count, CAST(sum(e) AS BIGINT) AS events, CAST(sum(st) AS BIGINT) AS states FROM r GROUP BY workflow, run""",
    "actor_holds_state": f"SELECT DISTINCT {_edge("sha256('NodeId|' || p)", 'holdsState', "sha256('NodeId|state:' || actor)")} FROM (SELECT segment AS actor, min(path) AS p FROM ({_PREFIXES}) GROUP BY segment) JOIN (SELECT DISTINCT actor FROM states WHERE actor IS NOT NULL) USING (actor)",
    "extract_terms_mock": "SELECT doc_id, CASE WHEN contains(text, 'reasoner') THEN 'reasoner' ELSE 'journal' END AS surface, CASE WHEN contains(text, 'reasoner') THEN NULL ELSE 'store' END AS category FROM documents WHERE contains(text, 'reasoner') OR contains(text, 'journal')",
}
