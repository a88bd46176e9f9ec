"""Target as state: what is pending, what batches have taken, and commits that fail."""

import datetime
import random

import pytest

from graphloom.operators.incremental import TargetState, successful_ranges, taken
from graphloom.operators.journal import events
from graphloom.session import scratch
from graphloom.sources.manifest import CommitConflict, ManifestLog

T0 = datetime.datetime(2027, 1, 1)
JOURNAL = "delivery_id bigint, source string, version bigint, token string, actor string, kind string, arrived_at timestamp"
BATCHES = "batch_id bigint, source string, since_version bigint, since_token string, cursor_version bigint, cursor_token string, read_at timestamp, recorded_at timestamp, status string"


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def test_pending_skips_published_and_nulls(spark):
    target = TargetState(spark, scratch(spark, "t"), ("k", "v"))
    source = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("b", 1, None), (None, 1, "n"), ("c", None, "n")], "k string, v int, bucket string")
    assert sorted(map(tuple, target.pending(source).collect())) == [("a", 1, "x"), ("a", 1, "x"), ("b", 1, None)]
    target.publish(target.pending(source).where("k = 'a'"), 0)
    assert [tuple(r) for r in target.pending(source).collect()] == [("b", 1, None)]
    target.publish(target.pending(source), 1)
    assert target.pending(source).count() == 0
    changed = spark.createDataFrame([("a", 2, "y")], "k string, v int, bucket string")
    assert target.pending(changed).count() == 1
    assert target.pending(source.where("false")).count() == 0


def test_a_failed_run_leaves_nothing(spark, monkeypatch):
    target = TargetState(spark, scratch(spark, "t"), ("k",))
    rows = spark.createDataFrame([("a",)], "k string")
    monkeypatch.setattr(ManifestLog, "publish", lambda self, v, m: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        target.publish(rows, 0)
    monkeypatch.undo()
    assert target.current() is None and target.pending(rows).count() == 1


def test_two_writers_of_one_version(spark):
    log = ManifestLog(spark, scratch(spark, "log"))
    log.publish(1, {"x": 1})
    with pytest.raises(CommitConflict):
        log.publish(1, {"x": 2})
    assert log.latest() == (1, {"x": 1})


def brute(journal, batches):
    def number(token, missing):
        digits = ""
        for c in reversed(token or ""):
            if not c.isdigit():
                break
            digits = c + digits
        return int(digits) if digits else missing

    ev = {}
    for _, source, version, token, actor, _, arrived in journal:
        if actor is None or not actor.strip() or version is None:
            continue
        key = (actor.strip(), version)
        s, n, a = ev.get(key, (source, -1, arrived))
        ev[key] = (s, max(n, number(token, -1)), min(a, arrived))
    last = {}
    for b in batches:
        if b[0] is not None and (b[0] not in last or b[7] > last[b[0]][7]):
            last[b[0]] = b
    ok = [b for b in last.values() if (b[8] or "").strip().lower() == "committed" and b[4] is not None]
    out = set()
    for (actor, version), (source, n, arrived) in ev.items():
        def takes(b):
            since = (b[2] if b[2] is not None else -(10**9), number(b[3], 10**18))
            return b[1] == source and since < (version, n) <= (b[4], number(b[5], 10**18)) and arrived <= b[6]
        if any(takes(b) for b in ok):
            out.add((actor, version))
    return out


@pytest.mark.parametrize("seed,span,bits", [(1, 60, 2), (2, 5000, 4), (3, 5000, 8), (4, 40, 0)])
def test_taken_against_brute_force(spark, seed, span, bits):
    rng = random.Random(seed)
    token = lambda: rng.choice([None, f"wal:{rng.randrange(40)}", "odd", f"b3/{rng.randrange(9)}"])
    journal = [(i, rng.choice(["hot", "hot", "hot", "s2", None]), rng.randrange(span), token(), rng.choice([" a", "a\t", "b", "", None]), "x", at(rng.randrange(100))) for i in range(250)]
    owner = {}
    journal = [(i, owner.setdefault(v, s), v, *r) for i, s, v, *r in journal]
    batches = []
    for b in range(40):
        lo = rng.randrange(-1, span)
        for k in range(rng.randrange(1, 3)):
            batches.append((b if b else None, rng.choice(["hot", "s2"]), rng.choice([lo, None, 0]), token(), rng.choice([lo + rng.randrange(span), None, span]), token(), at(rng.randrange(100)), at(b * 10 + k), rng.choice(["committed", " COMMITTED ", "failed", None])))
    got = taken(events(spark.createDataFrame(journal, JOURNAL)), successful_ranges(spark.createDataFrame(batches, BATCHES)), bits)
    assert {(r.actor, r.version) for r in got.collect()} == brute(journal, batches)


def test_taken_of_empty_tables(spark):
    journal, batches = spark.createDataFrame([], JOURNAL), spark.createDataFrame([], BATCHES)
    assert taken(events(journal), successful_ranges(batches)).count() == 0
