"""The change feed: any order, repeats, copy-on-write buckets."""

import random

from graphloom.operators.change_feed import ChangeFeedTable, marks
from graphloom.session import scratch

J = "actor string, version bigint, kind string, payload string, bucket int"
KINDS = ["created", "Created ", "STATE-CHANGED", "state changed", "Terminated", "paused", None, "re-created", "Custom:created"]


def brute(rows):
    plain = lambda k: "".join(c for c in (k or "").lower() if c not in " \t_-.:/")
    alive, out = {}, {}
    for actor, version, kind, *_ in sorted((r for r in rows if (r[0] or "").strip() and r[1] is not None), key=lambda r: r[1]):
        actor = actor.strip()
        k = plain(kind)
        if k == "created" or (k == "statechanged" and alive.get(actor)):
            alive[actor], out[actor] = True, version
        elif k == "terminated":
            alive[actor] = False
    return {(a, v) for a, v in out.items() if alive[a]}


def feed(seed, n=300):
    rng = random.Random(seed)
    rows, kind_of = [], {}
    for _ in range(n):
        a, v = rng.choice(["hot", "hot ", "a", "b", "c", " ", None]), rng.choice([*range(60), None])
        k = kind_of.setdefault(((a or "").strip(), v), rng.choice(KINDS))
        rows.append((a, v, k, None, 1))
    return rows


def test_against_brute_force_in_any_order_and_number_of_batches(spark):
    for seed in (1, 2):
        rows = feed(seed)
        random.Random(seed).shuffle(rows)
        table = ChangeFeedTable(spark, scratch(spark, "cf"), per_bucket=1)
        for part in (rows[:100], rows[100:120], rows[100:], rows[:50]):
            table.apply(marks(spark.createDataFrame(part, J)))
        assert {(r.actor, r.version) for r in table.alive().collect()} == brute(rows)


def test_only_touched_buckets_are_written(spark):
    table = ChangeFeedTable(spark, scratch(spark, "cf"), per_bucket=8)
    table.apply(marks(spark.createDataFrame([(f"a{i}", 1, "created", None, 0) for i in range(50)], J)))
    before = table.log.latest()[1]["files"]
    table.apply(marks(spark.createDataFrame([("a7", 2, "terminated", None, 0)], J)))
    after = table.log.latest()[1]["files"]
    assert sum(after.get(b) != f for b, f in before.items()) == 1
    assert table.alive().count() == 49 and table.state().count() == 50


def test_empty(spark):
    table = ChangeFeedTable(spark, scratch(spark, "cf"))
    assert table.alive().count() == 0
    table.apply(marks(spark.createDataFrame([], J)))
    assert table.alive().count() == 0


def test_buckets_split_when_the_table_has_grown(spark):
    table = ChangeFeedTable(spark, scratch(spark, "cf"), per_bucket=4)
    frame = lambda a, b, kind: marks(spark.createDataFrame([(f"a{i}", 1 if kind == "created" else 2, kind, f"{kind}{i}", 0) for i in range(a, b)], J))
    table.apply(frame(0, 3, "created"))
    few = len(table.log.latest()[1]["files"])
    table.apply(frame(3, 300, "created"))
    table.apply(frame(10, 20, "terminated"))
    table.apply(frame(0, 5, "state_changed"))
    files = table.log.latest()[1]["files"]
    assert len(files) > 4 * few and len({f.partition(":")[0] for f in files}) > 0
    got = {(r.actor, r.version, r.payload) for r in table.alive().collect()}
    assert got == {(f"a{i}", 2 if i < 5 else 1, f"{'state_changed' if i < 5 else 'created'}{i}") for i in range(300) if not 10 <= i < 20}
