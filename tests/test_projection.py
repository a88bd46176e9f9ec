"""Projections of actor records, in a batch and in a stream."""

import datetime

import pytest

from graphloom.operators.provenance import ProvenanceLog
from graphloom.operators.store import Delta
from graphloom.session import scratch, ship
from graphloom.sources.delta_store import DeltaStore
from graphloom.streaming.projection import Minting, Records, actor_schema, event_stream, flat, hierarchical, snapshot_diff
from graphloom.streaming.projector import EVENTS, PATHS, STATES, Projector, ProjectorError, event_files

AT = datetime.datetime(2027, 1, 1)
LEAVES = ("/workflow/foo/run/1/step/a", "/workflow/foo/run/1/step/b", "/workflow/foo/run/2/step/c")


def shape(spark):
    paths = spark.createDataFrame([(p, {"k": '"v"'}) for p in LEAVES], PATHS)
    events = spark.createDataFrame([(i + 1, f"t{i}", p[-1], p, "completed", AT, '{"z":1}', "0", i) for i, p in enumerate(LEAVES)], EVENTS)
    states = spark.createDataFrame([(p[-1], '{"s":1}', "d") for p in LEAVES], STATES)
    return Records(paths, events, states)


def sizes(delta):
    return delta.nodes.select("id").distinct().count(), delta.edges.select("id").distinct().count() if delta.edges is not None else 0


def test_shapes(spark):
    r = shape(spark)
    assert sizes(hierarchical(r)) == (16, 15) and sizes(event_stream(r)) == (3, 2) and sizes(flat(r)) == (5, 0) and sizes(snapshot_diff(r)) == (9, 2)
    labels = {x.label: x.n for x in hierarchical(r).edges.groupBy("label").count().withColumnRenamed("count", "n").collect()}
    assert labels == {"supervises": 9, "emitted": 3, "holdsState": 3}
    leaf = hierarchical(r).nodes.where("properties['path'].s = '/workflow/foo/run/1/step/a'").first()
    assert leaf.types == ["Actor", "ActorPathSegment"] and leaf.properties["k"].s == '"v"' and leaf.properties["depth"].i == 5
    assert hierarchical(r).nodes.where("array_contains(types, 'Workflow')").count() == 1


@pytest.mark.parametrize("kind", ["content", "path", "uuid"])
def test_minted_ids_hold_together(spark, kind):
    d = hierarchical(shape(spark), "s", Minting(kind, "urn:x/"))
    nodes = {r.id for r in d.nodes.collect()}
    assert len(nodes) == 16 and all(e.source in nodes and e.target in nodes for e in d.edges.collect())
    assert (d.nodes.where("iri like 'urn:x/workflow%'").count() > 0) == (kind == "path")


def test_replay_policies_and_second_pass(spark):
    r = shape(spark)
    store, ledger = DeltaStore(spark, scratch(spark, "g")), ProvenanceLog(spark, scratch(spark, "l"))
    p = Projector(store, "snapshot_diff", ledger, "src", seen=scratch(spark, "seen"))
    assert p.replay(r) and p.report.nodes == 9 and store.graph().edges.count() == 2
    assert not p.replay(r, name="second") and p.report.batches == 1 and ledger.table("activities").count() == 1
    strict = Projector(DeltaStore(spark, scratch(spark, "g")), "hierarchical", fixed_schema=actor_schema(spark))
    assert strict.replay(r)

    def other(records, source, minting):
        return Delta(hierarchical(records).nodes.withColumn("types", __import__("pyspark").sql.functions.array(__import__("pyspark").sql.functions.lit("Odd"))))

    with pytest.raises(ValueError, match="Odd"):
        Projector(strict.store, other, fixed_schema=actor_schema(spark)).replay(r)
    with pytest.raises(ProjectorError):
        Projector(store, "nothing")
    with pytest.raises(ProjectorError):
        Projector(store, "snapshot_diff")


def test_stream_equals_batch_and_repeats_count_once(spark, tmp_path):
    ship(spark)
    r = shape(spark)
    source = f"{tmp_path}/in"
    for i in range(3):
        r.events.where(f"pos = {i}").coalesce(1).write.mode("append").parquet(source)
    store = DeltaStore(spark, scratch(spark, "g"))
    p = Projector(store, "event_stream", source="s")
    for _ in range(2):
        p.stream(event_files(spark, source, per_batch=1), f"{tmp_path}/cp").awaitTermination()
    assert p.report.batches == 3 and store.graph().nodes.count() == 3
    again = Projector(store, "event_stream", source="s")
    again.commit(Records(r.paths, r.events.withColumn("batch", r.events["token"]), r.states), f"{tmp_path}/cp:0")
    assert store.log.latest()[0] == 3
