"""Sources and ways of ingesting them."""

import datetime

import pytest
from test_projection import LEAVES, shape

from graphloom.model import build
from graphloom.operators.provenance import Activity
from graphloom.operators.store import Delta
from graphloom.session import scratch
from graphloom.sources.delta_store import DeltaStore
from graphloom.sources.persist import FolderCheckpointer, MemoryCheckpointer, PersistentStore
from graphloom.streaming.ingest import Batch, EventStream, Polling, PushHook, Replay
from graphloom.streaming.projection import hierarchical
from graphloom.streaming.projector import EVENTS, Projector, ProjectorError
from graphloom.streaming.sources import BEGINNING, SnapshotSource, TableSource, numbered


def growing(spark):
    """A source whose events are those of a list that grows."""
    r = shape(spark)
    rows = [tuple(x) for x in r.events.orderBy("pos").collect()]
    held = rows[:2]
    return TableSource(r.paths, lambda: spark.createDataFrame(held, EVENTS), r.states), held, rows


def projector(spark, shape_="event_stream"):
    return Projector(DeltaStore(spark, scratch(spark, "g")), shape_, source="s")


def test_replay_and_missing_parts(spark):
    source, _, _ = growing(spark)
    p = projector(spark, "hierarchical")
    assert p.run(source, Replay()).batches == 1 and p.run(source, Replay()).batches == 1  # the same batch again
    for args in ((None, Replay()), (source,)):
        with pytest.raises(ProjectorError):
            p.run(*args)
    assert source.cursor() == 2 and source.journal(1).count() == 1


def test_polling_goes_on_from_its_cursor(spark):
    source, held, rows = growing(spark)
    polling = Polling(every=0.01, ticks=2, with_paths=False)
    p = projector(spark)
    p.run(source, polling)
    assert p.report.batches == 1 and polling.since == 2  # the second tick finds nothing
    held.append(rows[2])
    p.run(source, polling)
    assert p.report.batches == 2 and polling.since == 3 and p.store.graph().nodes.count() == 3
    polling.stop()
    assert p.run(source, polling).batches == 2


def test_a_poll_that_fails_is_repeated(spark, monkeypatch):
    source, _, _ = growing(spark)
    polling, p = Polling(ticks=1, with_paths=False), projector(spark)
    monkeypatch.setattr(p.store, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        p.run(source, polling)
    monkeypatch.undo()
    assert polling.since == BEGINNING and p.run(source, polling).batches == 1


def test_push_hook_follows_saves(spark):
    source, held, rows = growing(spark)
    hook = PushHook()
    inner = MemoryCheckpointer()
    checkpointer = hook.wrap(inner)
    p = projector(spark)
    checkpointer.save(build(spark, nodes=[{"iri": "urn:a"}]))
    hook.close()
    p.run(source, hook)
    held.append(rows[2])
    checkpointer.save(build(spark))
    hook.close()
    p.run(source, hook)
    assert inner.version == checkpointer.version == 2 and p.report.batches == 2 and checkpointer.load().nodes.count() == 0


def test_event_stream_has_a_batch_per_event(spark):
    source, _, rows = growing(spark)
    stream, p = EventStream(), projector(spark, "hierarchical")
    for r in [rows[0], rows[1], rows[0]]:
        stream.push(r)
    stream.push((9, None, "x", None, "odd", datetime.datetime(2027, 1, 1), None, "0", 9))
    stream.close()
    assert p.run(source, stream).batches == 3  # the repeated one counts once
    assert p.store.graph().nodes.where("array_contains(types, 'ActorEvent')").count() == 3


def test_an_ingest_of_ones_own_and_several_at_once(spark):
    source, _, _ = growing(spark)

    class Halves:
        label = "halves"

        def batches(self, source):
            r = shape(spark)
            for i, part in enumerate(("pos = 0", "pos > 0")):
                yield Batch(type(r)(r.paths.where("false"), r.events.where(part), r.states), i, self.label, f"{i}")

    p = projector(spark)
    assert p.run(source, Halves(), Polling(ticks=1, with_paths=False), Replay()).batches == 4
    assert p.store.graph().nodes.count() == 3


def test_snapshots_as_a_source(spark):
    d = hierarchical(shape(spark), "s")
    c = FolderCheckpointer(spark, scratch(spark, "c"))
    source = SnapshotSource(c)
    assert source.cursor() == 0 and source.paths().count() == 0 and source.journal(BEGINNING).count() == 0 and source.states(spark.createDataFrame([("a",)], "actor string")).count() == 0
    store = PersistentStore(spark, c)
    store.commit_with_provenance(Delta(nodes=d.nodes, edges=d.edges), Activity("load"))
    assert source.cursor() == 1 and source.journal(1).count() == 0
    events = source.journal(0).collect()
    assert sorted(e.version for e in events) == [1, 2, 3] and {(e.actor, e.kind, e.payload) for e in events} == {(p[-1], "completed", '{"z":1}') for p in LEAVES}
    assert {r.path for r in source.paths().collect()} >= set(LEAVES)
    assert source.states(spark.createDataFrame([("a",)], "actor string")).first().payload == '{"s":1}'
    p = projector(spark)
    assert p.run(source, Polling(ticks=2, every=0.01)).batches == 1 and p.store.graph().nodes.count() == 3  # the second tick has paths alone, of which this shape makes nothing
    again = PersistentStore(spark, FolderCheckpointer(spark, c.log.root))
    assert again.version == 1 and again.ledger.count() == 1 and again.graph.nodes.count() == d.nodes.count()
    again.commit_with_provenance(Delta(), Activity("more"))
    assert again.version == 2 and again.ledger.count() == 2


def test_numbers_over_many_ranges(spark):
    rows = numbered(spark.range(1000).selectExpr("cast(id as string) as id").repartition(7), "id", 5)
    got = sorted((r.id, r.number) for r in rows.collect())
    assert [n for _, n in got] == list(range(6, 1006))
