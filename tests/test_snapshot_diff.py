"""Merkle trees and differences between snapshots."""

import json
import random

import brute
from graphloom.operators.snapshot_diff import commit_changes, differing, elements, merkle, store_changes

S = "id bigint, store string, version bigint, json string, change string"


def node(i, **more):
    return {"id": f"n{i}", "iri": f"urn:{i}", "types": ["T"], "properties": {"a": {"type": "integer", "value": i}}} | more


def test_differing_finds_every_changed_range_at_any_depth():
    rng = random.Random(1)
    for n, m in ((1, 1), (50, 50), (40, 400), (0, 9), (300, 290)):
        a = {"nodes": [node(i) for i in range(n)]}
        b = {"nodes": [node(i, iri="urn:x") if rng.random() < 0.05 else node(i) for i in range(m)]}
        ea, eb = elements(a), elements(b)
        mask = differing(merkle(ea), merkle(eb))
        changed = {p for p, i, d in set(ea) ^ set(eb)}
        if not changed:
            assert mask is None
            continue
        bits = len(mask).bit_length() - 1
        assert {p >> (32 - bits) for p in changed} == {k for k, on in enumerate(mask) if on}


def test_equality_rules(spark):
    e = lambda **more: json.dumps({"ontology": {"nodes": [node(1, **more)], "edges": []}})
    p = lambda v: {"properties": {"a": v}}
    versions = [
        e(**p({"type": "float", "value": 121.0})), e(**p({"value": 1.21e2, "type": "float"})).replace("121.0", "1.21e2"), e(**p({"type": "integer", "value": 121})), e(**p({"type": "bool", "value": True})),
        e(**p({"type": "bool", "value": 1})), e(**p({"type": "null"})), e(**p({"type": "null", "value": None})), e(properties={}), e(properties={}, extra=1), e(properties={}, types=["T", "T"]),
        json.dumps({"ontology": {"nodes": [node(1, iri="old"), node(1, properties={}, types=["T", "T"])]}}),
    ]
    rows = [(i, "s", i * 3, t, None) for i, t in enumerate(versions)]
    got = {(int(r.version_key) // 3, r.change) for r in store_changes(spark.createDataFrame(rows, S)).collect()}
    assert got == {(k, "changed") for k in (2, 3, 4, 5, 6, 7, 9)}


def test_random_snapshots_with_gaps_and_broken_saves(spark):
    rng = random.Random(7)
    rows, number = [], 0
    for store in ("a", "b", None):
        state = {i: node(i) for i in range(30)}
        for version in sorted(rng.sample(range(2000), 25)):
            for i in rng.sample(range(40), 3):
                state.pop(i, None) if rng.random() < 0.4 else state.__setitem__(i, node(i, iri=f"urn:{rng.randrange(9)}"))
            text = json.dumps({"ontology": {"nodes": list(state.values()), "edges": [{"id": "e", "label": "x", "source": "n1", "target": "n2", "properties": {}}]}, "version": version})
            rows.append((number, store, version, text[:-9], None))
            rows.append((number + 1, store, version, text, None))
            number += 2
    rows.append((number, "a", None, "{}", None))
    rows.append((number + 1, "c", 1, None, None))
    plain = [dict(zip(("id", "store", "version", "json"), r, strict=False)) for r in rows if r[1] and r[2] is not None and r[3]]
    got = [tuple(r) for r in store_changes(spark.createDataFrame(rows, S)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute.snapshot_rows(plain, [], {})
    assert store_changes(spark.createDataFrame([], S)).count() == 0


def test_commits(spark):
    snap = lambda *ids: json.dumps({"nodes": [node(i) for i in ids]})
    a, b, c = "a" * 64, "b" * 64, "c" * 64
    rows = [(a, "r", None, snap(1, 2)), (b, "r", a[:20].upper(), snap(2, 3)), (b, "r", a, snap(2, 3)), (c, "r", "b" * 64, None), ("loop", "q", "loop", snap(1)), (None, "r", a, snap(9))]
    got = {tuple(r) for r in commit_changes(spark.createDataFrame(rows, "commit_id string, repo string, parent string, snapshot string")).collect()}
    assert got == {("r", b, "n1", "removed"), ("r", b, "n3", "added")}
