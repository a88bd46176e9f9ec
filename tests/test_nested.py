"""Nested JSON by structural indexing: random documents against walking the parsed value."""

import json
import random

import brute
from graphloom.operators import nested
from graphloom.operators.nested import array_objects, flat_fields, frames, index_objects, readable


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 6 else 5)
    if kind == 0:
        return rng.choice([None, True, False, 1, -2.5e3, 0])
    if kind < 5:
        return rng.choice(["", "a\"b", "\\", "[{\"x\":1}]", "é\n ", "\\\\\"", "{", "a,b:c", "😀"])
    if kind < 7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b.c", "k\"q", "ü", "", "x y", "\\"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def rows(spark, texts, **more):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "record_id bigint, text string, path string")
    return {("o", r.record_id, r.parent_path, r.path) for r in array_objects(df, ["record_id"], "text", **more).collect()}


def test_random_documents(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(400):
        v = value(rng) if rng.random() < 0.2 else [value(rng), {"a": value(rng), "l": [value(rng), {"z": [{}]}]}]
        text = json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        texts.append(rng.choice([text, text, json.dumps(text), text[:-1], text + " \n", " " + text]))
    want = set()
    for i, t in enumerate(texts):
        want |= brute.object_rows("o", i, t)
    assert rows(spark, texts) == want and len(want) > 300


def test_odd_texts(spark):
    deep = "[" * 3000 + "{}" + "]" * 3000
    texts = [None, "", " ", "null", "[{}", "[{}] x", "[{},]", "[{\"a\":NaN}]", "[{\"a\":1,\"a\":[{}]}]", json.dumps(json.dumps(json.dumps([{}]))), "[{\"n\":" + "9" * 5000 + "}]", deep, "[{}]" + " " * 100_000, json.dumps([{"t": "x" * 300_000}]), "﻿[{}]", "[01,{}]"]
    got = rows(spark, texts)
    assert {r[1] for r in got} == {8, 10, 11, 12, 13}
    assert ("o", 11, "$", "$" + "[0]" * 3000) in got and ("o", 8, "$[0]", "$[0].a[0]") in got


def test_validity_of_deep_texts():
    deep = lambda inner: "[" * 200_000 + inner + "]" * 200_000
    assert readable(deep('{"a": [1, "x", {}]}'), True) and readable(deep("{"), True) is None and readable(deep("{} {}"), True) is None


def test_spans_and_empty(spark):
    df = spark.createDataFrame([(1, '[{"a":[{"b": 2}]}, 3, {}]')], "id bigint, text string")
    got = {(r.path, r.object) for r in array_objects(df, ["id"], "text", with_text=True).collect()}
    assert got == {("$[0]", '{"a":[{"b": 2}]}'), ("$[0].a[0]", '{"b": 2}'), ("$[2]", "{}")}
    assert array_objects(df.where("false"), ["id"], "text").count() == 0


def test_flat_fields(spark):
    rows = [(1, '{"a":"x","n":1.5,"t":true,"z":null,"o":{"b":1},"l":[1],"it\'s":"{\\"q\\":1}"}'), (2, "{}"), (3, None)]
    got = {(r.id, r.key, r.kind, r.value) for r in flat_fields(spark.createDataFrame(rows, "id int, object string"), "object").collect()}
    assert got == {(1, "a", "text", "x"), (1, "n", "number", "1.5"), (1, "t", "truth", "true"), (1, "z", "null", None), (1, "it's", "text", '{"q":1}')}


def test_texts_without_objects_in_arrays(spark):
    assert rows(spark, ['{"a":[1,"{"]}'] * 3) == set()
    long = json.dumps({"a": ["{"] * (nested.CHUNK // 4)})  # indexed alone, beside one that holds an object
    assert rows(spark, [long, "[{}]"]) == {("o", 1, "$", "$[0]")}


def test_frames_are_bounded_and_whole(monkeypatch):
    deep = '[{"a":' * 400 + "[]" + "}]" * 400
    texts = [deep, '{"a":[{}],"a":[{}],"b":1}', "[1]", '[{"l":[{},{"x":[{}]},{}]},{}]'] * 2
    whole = list(dict.fromkeys(index_objects(texts, ["$"] * len(texts), True)))
    assert {r[:3] for r in whole} == {r[1:] for i, t in enumerate(texts) for r in brute.object_rows("o", i, t)}
    monkeypatch.setattr(nested, "FRAME", 5000)
    parts = list(frames(index_objects(texts, ["$"] * len(texts), True)))
    assert [r for p in parts for r in p] == whole and len(parts) > 100
    assert all(0 < sum(nested.ROW + len(r[1]) + len(r[2]) + len(r[3]) for r in p[:-1]) < 5000 or len(p) == 1 for p in parts)
    assert list(frames([])) == []
    monkeypatch.setattr(nested, "FRAME", 1)  # each row alone: what came before is known still
    assert [r for p in frames(index_objects(texts, ["$"] * len(texts))) for r in p] == [(*r[:3], None) for r in whole]


def test_flat_fields_of_any_key(spark):
    keys = ["it's \"x\"", "']", "a.b", "", "$[0]", "\\", "é\n"]
    df = spark.createDataFrame([(1, json.dumps({k: i for i, k in enumerate(keys)}))], "id int, object string")
    assert {(r.key, r.kind, r.value) for r in flat_fields(df, "object").collect()} == {(k, "number", str(i)) for i, k in enumerate(keys)}
