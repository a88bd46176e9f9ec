"""Failures between the steps of a commit, and two writers at once: every record ends up in the target once."""

import pytest
from test_projection import shape

from graphloom.model import build
from graphloom.operators.incremental import TargetState
from graphloom.operators.once import OnceIndex
from graphloom.operators.provenance import Activity
from graphloom.operators.store import Delta
from graphloom.session import scratch
from graphloom.sources.delta_store import DeltaStore
from graphloom.sources.manifest import CommitConflict, ManifestLog, due
from graphloom.sources.versioned import VersionedStore
from graphloom.streaming.projector import Projector


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def new(answer):
    return sorted(r.id for r in answer.where("not known").collect())


@pytest.fixture
def failing(monkeypatch):
    """Lets the next publish under a folder fail."""
    real = ManifestLog.publish

    def arm(root, error=RuntimeError):
        def publish(self, version, manifest):
            if self.root == root:
                monkeypatch.setattr(ManifestLog, "publish", real)
                raise error("lost")
            return real(self, version, manifest)

        monkeypatch.setattr(ManifestLog, "publish", publish)

    return arm


@pytest.fixture
def overtaken(monkeypatch):
    """Runs something just before the next publish under a folder, as another writer would."""
    real = ManifestLog.publish

    def arm(root, other):
        def publish(self, version, manifest):
            if self.root == root:
                monkeypatch.setattr(ManifestLog, "publish", real)
                other()
            return real(self, version, manifest)

        monkeypatch.setattr(ManifestLog, "publish", publish)

    return arm


def test_levels_of_parts():
    assert due([0], 3) == (1, 0) and due([0, 0, 0], 3) == (3, 1) and due([1, 1, 0, 0, 0], 3) == (5, 2) and due([2, 1, 0, 0], 3) == (1, 0)


def test_index_retry_and_two_writers(spark, failing, overtaken):
    index = OnceIndex(spark, scratch(spark, "o"))
    failing(index.log.root)
    with pytest.raises(RuntimeError):
        index.ingest(ids(spark, "a", "b"), "one")
    assert new(index.ingest(ids(spark, "a", "b"), "one")) == ["a", "b"]
    assert new(index.ingest(ids(spark, "a", "b"), "one")) == ["a", "b"]  # whoever failed after this gets the same answer
    other = OnceIndex(spark, index.log.root)
    theirs = []
    overtaken(index.log.root, lambda: theirs.extend(new(other.ingest(ids(spark, "c", "d"), "theirs"))))
    ours = new(index.ingest(ids(spark, "b", "c", "e"), "ours"))
    assert sorted(theirs + ours) == ["c", "d", "e"] and theirs == ["c", "d"]


def test_target_retry_and_two_writers(spark, failing, overtaken):
    target = TargetState(spark, scratch(spark, "t"), ("id",), merge_at=2)
    source = ids(spark, "a", "b")
    failing(target.log.root)
    with pytest.raises(RuntimeError):
        target.run(source, lambda rows: rows)
    target.run(source, lambda rows: rows)
    more = ids(spark, "a", "b", "c", "d")
    overtaken(target.log.root, lambda: TargetState(spark, target.log.root, ("id",)).run(more.where("id <> 'd'"), lambda rows: rows))
    target.run(more, lambda rows: rows)
    target.run(more, lambda rows: rows)
    assert sorted(r.id for r in target.current().collect()) == ["a", "b", "c", "d"] and target.version() == 3
    at = target.version()
    target.publish(ids(spark, "e"), at)
    with pytest.raises(CommitConflict):
        target.publish(ids(spark, "e"), at)


def test_a_batch_that_failed_is_projected_when_repeated(spark, failing):
    r = shape(spark)
    store = DeltaStore(spark, scratch(spark, "g"))
    p = Projector(store, "snapshot_diff", source="s", seen=scratch(spark, "seen"))
    failing(store.log.root)
    with pytest.raises(RuntimeError):
        p.commit(r, "b1")
    assert p.commit(r, "b1") and store.graph().nodes.count() == 9 and store.activities().count() == 1
    assert not p.commit(r, "b1") and not p.commit(r, "b2") and store.log.latest()[0] == 1


def test_two_projectors_of_overlapping_batches(spark, overtaken):
    r = shape(spark)
    part = type(r)(r.paths.limit(1), r.events.where("pos < 2"), r.states.limit(1))
    store, seen = DeltaStore(spark, scratch(spark, "g")), scratch(spark, "seen")
    one, two = (Projector(DeltaStore(spark, store.log.root), "snapshot_diff", source="s", seen=seen) for _ in range(2))
    overtaken(store.log.root, lambda: two.commit(part, "theirs"))
    assert one.commit(r, "ours")
    assert one.report.nodes + two.report.nodes == 9 == store.graph().nodes.count()


def test_merge_policy_loses_no_update(spark, overtaken):
    store = DeltaStore(spark, scratch(spark, "g"))
    node = lambda kind, **p: build(spark, nodes=[{"iri": "urn:a", "types": [kind], "properties": p}])
    projector = lambda graph: Projector(DeltaStore(spark, store.log.root), lambda *_: Delta(nodes=graph.nodes), policy="merge")
    r = shape(spark)
    projector(node("A", x=1)).commit(r, "1")
    overtaken(store.log.root, lambda: projector(node("B", y=2)).commit(r, "2"))
    projector(node("C", z=3)).commit(r, "3")
    row = store.graph().nodes.first()
    assert sorted(row.types) == ["A", "B", "C"] and sorted(row.properties) == ["x", "y", "z"]


def test_two_users_of_a_versioned_store(spark, overtaken, failing):
    graph = lambda n: build(spark, nodes=[{"iri": f"urn:{n}", "types": ["T"]}])
    one = VersionedStore(spark, scratch(spark, "v"))
    two = VersionedStore(spark, one.log.root)
    a = one.commit("a", "me", graph("a"))
    b = two.commit("b", "you", graph("b"))
    theirs = []
    overtaken(one.log.root, lambda: theirs.append(two.commit("c", "you", graph("c"))))
    d = one.commit("d", "me", graph("d"))
    assert [c.id for c in VersionedStore(spark, one.log.root).history()] == [d, *theirs, b, a]
    two.branch("side")
    one.checkout("side")
    assert two.current == "main" and one.current == "side"
    e = one.commit("e", "me", graph("e"))
    overtaken(one.log.root, lambda: one_more.append(VersionedStore(spark, one.log.root).commit("f", "you", graph("f"))))
    one_more = []
    m = two.merge("side")
    assert two.commits[m].parents == (one_more[0], e)
    failing(one.log.root)
    with pytest.raises(RuntimeError):
        one.commit("g", "me", graph("g"))
    assert one.commit("g", "me", graph("g")) == one.head().id


def test_old_activities_are_remembered(spark, monkeypatch):
    monkeypatch.setattr(DeltaStore, "REMEMBERED", 2)
    store = DeltaStore(spark, scratch(spark, "g"), merge_at=2)
    for i in range(7):
        store.commit(Delta(nodes=build(spark, nodes=[{"iri": f"urn:{i % 3}", "types": [f"T{i}"]}]).nodes), Activity("x", id=f"a{i}"))
    assert store.commit(Delta(nodes=build(spark, nodes=[{"iri": "urn:0", "types": ["Old"]}]).nodes), "a0") == 7
    assert {(r.iri, r.types[0]) for r in store.graph().nodes.collect()} == {("urn:0", "T6"), ("urn:1", "T4"), ("urn:2", "T5")}
    assert len(store.log.latest()[1]["parts"]["nodes"]) < 4 and store.activities().count() == 7
    assert {r.types[0] for r in store.graph(3).nodes.collect()} == {"T0", "T1", "T2"}
