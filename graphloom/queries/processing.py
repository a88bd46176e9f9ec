"""Queries of the general problems on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import squeezed
from graphloom.operators.change_feed import ChangeFeedTable, marks
from graphloom.operators.hierarchy import descendants, full_paths, hierarchy, lineage, path_links
from graphloom.operators.incremental import TargetState, successful_ranges, taken
from graphloom.operators.journal import deliveries, events
from graphloom.operators.nested import array_objects, flat_fields
from graphloom.operators.once import OnceIndex, identifier
from graphloom.operators.references import commit_parents, type_parents
from graphloom.operators.snapshot_diff import commit_changes, store_changes
from graphloom.queries.tables import table
from graphloom.session import scratch, written


WAVES = 4  # how many batches the journal is delivered in


def loads(spark: SparkSession, sf: str) -> list[tuple[str, DataFrame]]:
    """The journal as it was delivered: (batch id, rows) of some loads after the other, all rows in one of them."""
    journal = table(spark, sf, "journal")
    first, last = journal.agg(F.min("load_id"), F.max("load_id")).first()
    if first is None:
        return [("all", journal)]
    bounds = sorted({first + (last + 1 - first) * k // WAVES for k in range(WAVES + 1)})
    load = F.coalesce("load_id", F.lit(last))
    return [(f"{a}-{b}", journal.where((load >= a) & (load < b))) for a, b in zip(bounds, bounds[1:], strict=False)]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Events that no successful batch has taken."""
    known = written(events(table(spark, sf, "journal")), "events")
    target = TargetState(spark, scratch(spark, "p1"), ("actor", "version"))
    target.publish(taken(known, successful_ranges(table(spark, sf, "actor_batches"))).select("actor", "version"), target.version())
    return target.pending(known).select("actor", "version")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """What changed between each snapshot and the one before it, in stores and in repositories."""
    return store_changes(table(spark, sf, "snapshots")).unionByName(commit_changes(table(spark, sf, "commits")))


def hierarchy_links(spark: SparkSession, sf: str) -> DataFrame:
    """(tree, node, parent, coarse, fine) of node types, commits and paths."""
    types = type_parents(table(spark, sf, "node_types")).select(F.lit("node_types").alias("tree"), F.col("name").alias("node"), "parent", F.regexp_extract("name", "^[^:]*", 0).alias("coarse"), F.lit("").alias("fine"))
    commits = table(spark, sf, "commits")
    place = commits.groupBy(F.lower(squeezed(F.col("commit_id"))).alias("commit_id")).agg(F.min("repo").alias("coarse"), F.min(F.date_format("committed_at", "yyyy-MM-dd")).alias("fine"))
    links = commit_parents(commits).join(place, "commit_id").select(F.lit("commits").alias("tree"), F.col("commit_id").alias("node"), F.col("parent_id").alias("parent"), "coarse", "fine")
    return types.unionByName(links).unionByName(path_links(table(spark, sf, "paths")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of every type, commit and path, and those whose ancestry runs in a loop."""
    return hierarchy(hierarchy_links(spark, sf), F.col("coarse"), F.col("fine"))


def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes lie below each type, commit and path."""
    return descendants(lineage(hierarchy_links(spark, sf), F.col("coarse"), F.col("fine")))


def p3_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The path from a nearest root down to each type, commit and path that reaches one."""
    return full_paths(hierarchy_links(spark, sf), F.col("coarse"), F.col("fine"))


def nested_sources(spark: SparkSession, sf: str) -> list[tuple]:
    """(origin, rows, text column, base path, unwrap) of the JSON columns."""
    journal = table(spark, sf, "journal").select(F.col("delivery_id").alias("record_id"), F.col("payload").alias("text"))
    states = table(spark, sf, "states").select(F.col("state_id").alias("record_id"), F.col("payload").alias("text"))
    attributes = table(spark, sf, "paths").select(F.col("path_id").alias("record_id"), F.explode("attributes").alias("key", "text"))
    return [("journal", journal, None, True), ("states", states, None, True), ("paths", attributes, F.concat(F.lit("$."), F.col("key")), False)]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every object in an array, with its path and that of the object it lies in."""
    parts = [array_objects(rows, ["record_id"], "text", base, unwrap).withColumn("origin", F.lit(origin)) for origin, rows, base, unwrap in nested_sources(spark, sf)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("origin", "record_id", "parent_path", "path")


def p4_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The scalar fields of every object in an array, a row each, under the object's key and that of the object it lies in; the table they belong to is the path without places in arrays."""
    parts = []
    for origin, rows, base, unwrap in nested_sources(spark, sf):
        objects = array_objects(rows, ["record_id"], "text", base, unwrap, with_text=True).withColumn("origin", F.lit(origin))
        parts.append(flat_fields(objects, "object"))
    keys = ["origin", "record_id", "parent_path", "path"]
    return reduce(DataFrame.unionByName, parts).select(*keys, F.regexp_replace("path", r"\[[0-9]+\]", "[]").alias("of"), "key", "kind", "value")


def _current(spark: SparkSession, sf: str) -> DataFrame:
    """The actors' table after the journal's loads have been applied one after the other."""
    state = ChangeFeedTable(spark, scratch(spark, "p5"))
    for _, rows in loads(spark, sf):
        state.apply(marks(rows))
    return state.alive()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Actors alive after all changes."""
    return _current(spark, sf).select("actor", "version")


def p5_state(spark: SparkSession, sf: str) -> DataFrame:
    """The current row of every actor alive: version, time and payload of the last change applied."""
    return _current(spark, sf).select("actor", "version", F.col("at").alias("event_at"), "payload")


def _delivered(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """What the once-index has answered to each batch of the journal's loads, after it had taken in what an earlier pass has emitted."""
    index = OnceIndex(spark, scratch(spark, "p7"))
    seen = table(spark, sf, "diff_projections").select(F.explode("seen_events").alias("e")).select("e.*")
    index.add(deliveries(seen).select(identifier("actor", "version").alias("id")), "seen")
    batches = loads(spark, sf)
    rows = table(spark, sf, "journal").count() // len(batches)  # of the files' footers
    answers = [index.ingest(deliveries(batch).select("actor", "version", *columns, identifier("actor", "version").alias("id")), name, list(columns), rows) for name, batch in batches]
    return reduce(DataFrame.unionByName, answers)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Events delivered more than once, counting what an earlier pass has emitted: known to the index when a batch came, or several times in a batch."""
    return _delivered(spark, sf).where("known or copies > 1").select("actor", "version").distinct()


def p7_kept(spark: SparkSession, sf: str) -> DataFrame:
    """The one delivery kept of each event that no earlier pass has emitted: the first to arrive in its first batch, of several the least delivery_id."""
    return _delivered(spark, sf, "arrived_at", "delivery_id").where("not known").select("actor", "version", "delivery_id")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_descendants": p3_descendants, "p3_paths": p3_paths, "p4_found": p4_found, "p4_fields": p4_fields, "p5_found": p5_found, "p5_state": p5_state, "p7_found": p7_found, "p7_kept": p7_kept}

# the characters of white space in the SQL below are those of functions.text.WHITE_SPACE
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"
_DELIVERIES = f"""d AS (
  SELECT trim(actor, {_WS}) AS actor, version, source, token, kind, arrived_at, delivery_id FROM journal
  WHERE trim(actor, {_WS}) <> '' AND version IS NOT NULL)"""
_SEEN = f"""seen AS (
  SELECT DISTINCT trim(e.actor, {_WS}) AS actor, e.version AS version
  FROM (SELECT unnest(seen_events) AS e FROM diff_projections) WHERE trim(e.actor, {_WS}) <> '' AND e.version IS NOT NULL)"""

# of one snapshot's element: its leaves as sorted text, numbers as numbers
_LEAVES = """list_sort(list(t.fullkey || '|' || CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT') THEN 'n' || CAST(CAST(t.atom AS DOUBLE) AS VARCHAR) WHEN t.type IN ('OBJECT', 'ARRAY') THEN lower(t.type) ELSE t.type || coalesce(CAST(t.atom AS VARCHAR), '') END))"""
SQL = {
    "p2_found": f"""
WITH RECURSIVE saves AS (
  SELECT store AS holder, version, json_extract(json, '$.ontology') AS o FROM snapshots WHERE store IS NOT NULL AND version IS NOT NULL AND json_valid(json)
  QUALIFY row_number() OVER (PARTITION BY store, version ORDER BY id DESC) = 1), c AS (
  SELECT DISTINCT lower(trim(commit_id)) AS id, lower(regexp_replace(parent, '\\s', '', 'g')) AS ref, repo FROM commits), snap AS (
  SELECT lower(trim(commit_id)) AS id, any_value(CAST(snapshot AS JSON)) AS o FROM commits WHERE json_valid(snapshot) GROUP BY 1), hit AS (
  SELECT c.id, c.repo, c.ref, p.id AS parent FROM c JOIN (SELECT DISTINCT id FROM c) p ON c.ref <> '' AND starts_with(p.id, c.ref)), up AS (
  SELECT id, max(repo) AS repo, parent FROM (SELECT *, count(DISTINCT parent) OVER (PARTITION BY id, ref) AS n FROM (SELECT DISTINCT * FROM hit)) WHERE (n = 1 OR parent = ref) AND parent <> id GROUP BY id, parent), pair AS (
  SELECT holder, CAST(version AS VARCHAR) AS version_key, holder || '/' || version AS now, holder || '/' || lag(version) OVER (PARTITION BY holder ORDER BY version) AS before FROM saves
  UNION ALL SELECT repo, id, id, parent FROM up WHERE id IN (SELECT id FROM snap) AND parent IN (SELECT id FROM snap)), doc AS (
  SELECT holder || '/' || version AS key, o FROM saves UNION ALL SELECT id, o FROM snap), part AS (
  SELECT key, 0 AS part, unnest(from_json(json_extract(o, '$.nodes'), '["JSON"]')) AS e, generate_subscripts(from_json(json_extract(o, '$.nodes'), '["JSON"]'), 1) AS n FROM doc
  UNION ALL SELECT key, 1, unnest(from_json(json_extract(o, '$.edges'), '["JSON"]')), generate_subscripts(from_json(json_extract(o, '$.edges'), '["JSON"]'), 1) FROM doc), el AS (
  SELECT key, e, json_extract_string(e, '$.id') AS id FROM part QUALIFY row_number() OVER (PARTITION BY key, json_extract_string(e, '$.id') ORDER BY part DESC, n DESC) = 1), sig AS (
  SELECT el.key, el.id, {_LEAVES} AS sig FROM el, json_tree(el.e) t WHERE regexp_matches(t.fullkey, '^\\$\\.(iri|types|label|source|target|properties)') GROUP BY el.key, el.id), sides AS (
  SELECT holder, version_key, id AS element_id, sig AS now, CAST(NULL AS VARCHAR[]) AS was FROM pair JOIN sig ON key = pair.now WHERE before IS NOT NULL
  UNION ALL SELECT holder, version_key, id, CAST(NULL AS VARCHAR[]), sig FROM pair JOIN sig ON key = pair.before), one AS (
  SELECT holder, version_key, element_id, max(now) AS now, max(was) AS was FROM sides GROUP BY ALL)
SELECT holder, version_key, element_id, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS change FROM one WHERE was IS DISTINCT FROM now""",
    "p3_found": r"""
WITH RECURSIVE names AS (SELECT DISTINCT name FROM node_types WHERE name IS NOT NULL),
keys AS (SELECT name AS key, name AS parent, 0 AS rank FROM names UNION SELECT regexp_replace(iri, '\s', '', 'g'), name, 1 FROM node_types WHERE iri IS NOT NULL AND name IS NOT NULL),
refs AS (SELECT DISTINCT name, regexp_replace(ref, '\s', '', 'g') AS ref FROM (SELECT name, unnest(supertypes) AS ref FROM node_types) WHERE ref IS NOT NULL),
tried AS (SELECT name, ref, ref AS key, 0 AS local FROM refs UNION ALL SELECT name, ref, regexp_extract(name, '^[^:]*:') || ref, 1 FROM refs),
type_up AS (SELECT DISTINCT name AS node, parent FROM (SELECT name, parent FROM tried JOIN keys USING (key) WHERE local = 0 OR rank = 0 QUALIFY rank() OVER (PARTITION BY name, ref ORDER BY local, rank) = 1)),
c AS (SELECT DISTINCT lower(trim(commit_id)) AS id, lower(regexp_replace(parent, '\s', '', 'g')) AS ref FROM commits),
hit AS (SELECT c.id, p.id AS parent, c.ref FROM c JOIN (SELECT DISTINCT id FROM c) p ON c.ref <> '' AND starts_with(p.id, c.ref)),
commit_up AS (SELECT DISTINCT id AS node, parent FROM (SELECT *, count(*) OVER (PARTITION BY id, ref) AS n FROM hit) WHERE n = 1 OR parent = ref),
segs AS (SELECT DISTINCT list_filter(coalesce(segments, string_split(path, '/')), lambda x: x IS NOT NULL AND x <> '') AS s FROM paths),
pre AS (SELECT DISTINCT '/' || array_to_string(list_slice(s, 1, n), '/') AS node, CASE WHEN n > 1 THEN '/' || array_to_string(list_slice(s, 1, n - 1), '/') END AS parent FROM (SELECT s, unnest(range(1, len(s) + 1)) AS n FROM segs)),
up AS (SELECT 'node_types' AS tree, node, parent FROM type_up UNION ALL SELECT 'commits', node, parent FROM commit_up UNION ALL SELECT 'paths', node, parent FROM pre WHERE parent IS NOT NULL),
nodes AS (SELECT 'node_types' AS tree, name AS node FROM names UNION SELECT 'commits', id FROM c UNION SELECT 'paths', node FROM pre),
walk(tree, node, anc, depth) USING KEY (tree, node, anc) AS (
  SELECT tree, node, node, 0::BIGINT FROM nodes
  UNION
  SELECT w.tree, w.node, up.parent, min(w.depth + 1) FROM walk w JOIN up ON up.tree = w.tree AND up.node = w.anc LEFT JOIN recurring.walk r ON r.tree = w.tree AND r.node = w.node AND r.anc = up.parent
  WHERE r.depth IS NULL OR r.depth > w.depth + 1 GROUP BY w.tree, w.node, up.parent),
loops AS (SELECT DISTINCT w.tree, w.node FROM walk w JOIN up ON up.tree = w.tree AND up.node = w.anc AND up.parent = w.node)
SELECT tree, node, anc AS root, depth FROM walk w WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.tree = w.tree AND up.node = w.anc)
UNION ALL SELECT DISTINCT w.tree, w.node, '<cycle>', -1 FROM walk w JOIN loops l ON l.tree = w.tree AND l.node = w.anc""",
    "p4_found": r"""
WITH texts AS (
  SELECT 'journal' AS origin, delivery_id AS record_id, payload AS text, '$' AS base, true AS unwrap FROM journal UNION ALL SELECT 'states', state_id, payload, '$', true FROM states
  UNION ALL SELECT 'paths', path_id, e.value, '$.' || e.key, false FROM (SELECT path_id, unnest(map_entries(attributes)) AS e FROM paths)), valid AS (
  SELECT origin, record_id, base, CASE WHEN unwrap AND json_type(text) = 'VARCHAR' THEN json_extract_string(text, '$') ELSE text END AS text FROM texts WHERE text IS NOT NULL AND json_valid(text)), doc AS (
  SELECT origin, record_id, base, CAST(text AS JSON) AS j FROM valid WHERE json_valid(text) AND json_type(text) IN ('OBJECT', 'ARRAY')), el AS (
  SELECT origin, record_id, base, t.fullkey AS k FROM doc, json_tree(doc.j) t WHERE t.type = 'OBJECT' AND ends_with(t.fullkey, ']')), near AS (
  SELECT e.origin, e.record_id, e.base, e.k, max(length(a.k)) AS n FROM el e LEFT JOIN el a ON a.origin = e.origin AND a.record_id = e.record_id AND a.base = e.base AND starts_with(e.k, a.k || '.') GROUP BY ALL)
SELECT origin, record_id, CASE WHEN n IS NULL THEN '$' ELSE base || regexp_replace(substr(k, 2, n - 1), '\."([^"]*)"', '.', 'g') END AS parent_path, base || regexp_replace(substr(k, 2), '\."([^"]*)"', '.', 'g') AS path FROM near""",
    "p1_found": f"""
WITH {_DELIVERIES}, ev AS (
  SELECT actor, version, max(source) AS source, coalesce(max(TRY_CAST(nullif(regexp_extract(token, '([0-9]+)$', 1), '') AS BIGINT)), -1) AS num, min(arrived_at) AS arrived_at
  FROM d GROUP BY actor, version), last AS (
  SELECT batch_id, arg_max(actor_batches, recorded_at) AS b FROM actor_batches WHERE batch_id IS NOT NULL GROUP BY batch_id), ok AS (
  SELECT b.source AS source, coalesce(b.since_version, -1) AS sv, coalesce(TRY_CAST(nullif(regexp_extract(b.since_token, '([0-9]+)$', 1), '') AS BIGINT), 9223372036854775807) AS sn,
    b.cursor_version AS cv, coalesce(TRY_CAST(nullif(regexp_extract(b.cursor_token, '([0-9]+)$', 1), '') AS BIGINT), 9223372036854775807) AS cn, b.read_at AS read_at
  FROM last WHERE lower(trim(b.status, {_WS})) = 'committed')
SELECT actor, version FROM ev WHERE NOT EXISTS (
  SELECT 1 FROM ok WHERE ok.source = ev.source AND (ev.version > sv OR ev.version = sv AND num > sn) AND (ev.version < cv OR ev.version = cv AND num <= cn) AND ev.arrived_at <= ok.read_at)""",
    "p5_found": f"""
WITH {_DELIVERIES}, e AS (
  SELECT DISTINCT actor, version, regexp_replace(lower(translate(kind, {_WS}, '')), '[-_.:/]', '', 'g') AS what FROM d), k AS (
  SELECT actor, max(CASE WHEN what = 'created' THEN version END) AS born, max(CASE WHEN what = 'terminated' THEN version END) AS dead FROM e GROUP BY actor)
SELECT k.actor AS actor, max(e.version) AS version FROM k JOIN e ON e.actor = k.actor AND e.version >= k.born
WHERE k.born > coalesce(k.dead, k.born - 1) AND e.what IN ('created', 'statechanged') GROUP BY k.actor""",
    "p5_state": f"""
WITH {_DELIVERIES.replace("kind, arrived_at", "kind, event_at, payload, arrived_at")}, e AS (
  SELECT actor, version, event_at, payload, regexp_replace(lower(translate(kind, {_WS}, '')), '[-_.:/]', '', 'g') AS what FROM d), k AS (
  SELECT actor, max(CASE WHEN what = 'created' THEN version END) AS born, max(CASE WHEN what = 'terminated' THEN version END) AS dead FROM e GROUP BY actor)
SELECT k.actor AS actor, e.version AS version, e.event_at AS event_at, e.payload AS payload FROM k JOIN e ON e.actor = k.actor AND e.version >= k.born
WHERE k.born > coalesce(k.dead, k.born - 1) AND e.what IN ('created', 'statechanged')
QUALIFY row_number() OVER (PARTITION BY k.actor ORDER BY e.version DESC, e.event_at DESC NULLS LAST, e.payload DESC NULLS LAST) = 1""",
    "p7_found": f"""
WITH {_DELIVERIES}, {_SEEN}
SELECT d.actor AS actor, d.version AS version FROM d LEFT JOIN seen USING (actor, version) GROUP BY d.actor, d.version HAVING count(*) > 1 OR count(seen.actor) > 0""",
    "p7_kept": f"""
WITH {_DELIVERIES}, {_SEEN}
SELECT actor, version, delivery_id FROM d ANTI JOIN seen USING (actor, version)
QUALIFY row_number() OVER (PARTITION BY actor, version ORDER BY arrived_at NULLS FIRST, delivery_id) = 1""",
}
_WALK = SQL["p3_found"][: SQL["p3_found"].index("loops AS")].rstrip().rstrip(",")
SQL["p3_descendants"] = f"{_WALK} SELECT tree, anc AS node, count(*) FILTER (depth > 0) AS descendants FROM walk GROUP BY tree, anc"
SQL["p3_paths"] = f"""{_WALK}, least AS (SELECT tree, node, min(depth) AS d FROM walk w WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.tree = w.tree AND up.node = w.anc) GROUP BY tree, node),
pick AS (SELECT u.tree, u.node, arg_min(u.parent, {{'d': l.d, 'p': u.parent}}) AS parent FROM (SELECT DISTINCT tree, node, parent FROM up) u JOIN least l ON l.tree = u.tree AND l.node = u.parent GROUP BY u.tree, u.node),
way(tree, node, path) AS (SELECT tree, node, [node] FROM least WHERE d = 0 UNION ALL SELECT k.tree, k.node, list_append(w.path, k.node) FROM way w JOIN pick k ON k.tree = w.tree AND k.parent = w.node)
SELECT tree, node, path FROM way"""
_OBJECTS = SQL["p4_found"]
_FIELDS = _OBJECTS[: _OBJECTS.rindex("SELECT origin, record_id, CASE")].rstrip()
SQL["p4_fields"] = rf"""{_FIELDS}, named AS (SELECT origin, record_id, base, k, CASE WHEN n IS NULL THEN '$' ELSE base || regexp_replace(substr(k, 2, n - 1), '\."([^"]*)"', '.\1', 'g') END AS parent_path, base || regexp_replace(substr(k, 2), '\."([^"]*)"', '.\1', 'g') AS path FROM near)
SELECT n.origin, n.record_id, n.parent_path, n.path, regexp_replace(n.path, '\[[0-9]+\]', '[]', 'g') AS of, t.key, CASE t.type WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'truth' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind,
  CASE t.type WHEN 'VARCHAR' THEN json_extract_string(t.value, '$') WHEN 'NULL' THEN NULL ELSE CAST(t.value AS VARCHAR) END AS value
FROM named n JOIN doc d ON d.origin = n.origin AND d.record_id = n.record_id AND d.base = n.base, json_each(json_extract(d.j, n.k)) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')"""
