"""Deeply nested records to flat, linked rows by structural indexing.

Texts are read many at a time as one array of bytes.  A bitmap of quotes (those
that an odd run of backslashes does not escape) gives by parity what lies inside
strings; outside them brackets and delimiters form the structural index, whose
prefix sums are the nesting depth.  Sorted by depth and place, the tokens of one
container lie together, so each container's parent, its index in an array, its
key in an object and its span come from searches in sorted arrays.  Python runs
once per object that comes out, not per byte or per token.  Rows leave in frames
of bounded size, however many or long they are.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 4 << 20  # bytes indexed at a time; a longer text is indexed alone
FRAME = 16 << 20  # characters given out at a time, with ROW more for each row
ROW = 100


def _refuse(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_refuse)
_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')
_SPACE = " \t\n\r"


def _valid_deep(text: str) -> bool:
    """Whether a text nested too deep for the decoder is valid JSON."""
    at, end, stack, state = 0, len(text.rstrip(_SPACE)), [], "value"
    while at < end:
        m = _TOKEN.match(text, at)
        if not m or state == "done":
            return False
        at, mark = m.end(), m[1]
        if state in ("value", "first") and mark in ("{", "["):
            stack.append(mark)
            state = "key?" if mark == "{" else "first"
        elif mark in ("}", "]"):
            if not stack or stack.pop() != {"}": "{", "]": "["}[mark] or state not in ("after", "key?" if mark == "}" else "first"):
                return False
            state = "after" if stack else "done"
        elif state in ("value", "first") and not mark:
            state = "after" if stack else "done"
        elif state in ("key", "key?") and m[2]:
            state = "colon"
        elif state == "colon" and mark == ":":
            state = "value"
        elif state == "after" and mark == ",":
            state = "key" if stack[-1] == "{" else "value"
        else:
            return False
    return state == "done"


def readable(text: str | None, unwrap: bool) -> str | None:
    """``text`` if it is valid JSON that may hold an object in an array, else None.

    With ``unwrap``, a JSON string at the top is read through once.
    """
    if text is None:
        return None
    wrapped = unwrap and text.lstrip(_SPACE)[:1] == '"'
    if not wrapped and ("[" not in text or "{" not in text):
        return None
    try:
        value, end = _DECODER.raw_decode(text, len(text) - len(text.lstrip(_SPACE)))
        if text[end:].strip(_SPACE):
            return None
    except RecursionError:
        return text if _valid_deep(text) else None
    except ValueError:
        return None
    if wrapped:
        return readable(value, False) if isinstance(value, str) else None
    return text


def _quotes(buf: np.ndarray) -> np.ndarray:
    """Places of the quotes that open or close strings."""
    at = np.flatnonzero(buf == 0x22)
    slash = buf == 0x5C
    if len(at) and slash.any():
        plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(buf))))
        before = np.maximum(at - 1, 0)
        run = np.where(at > 0, before - plain[before], 0)
        at = at[run % 2 == 0]
    return at


def index_objects(texts: list[str], bases: list[str], with_text: bool = False) -> Iterator[tuple[int, str, str, str | None]]:
    """(place of the text, parent_path, path, span) of every object that is an element of an array, as they stand; texts must be valid JSON."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw)
    buf = np.frombuffer(joined, np.uint8)
    starts = np.cumsum([0, *(len(r) + 1 for r in raw)])[:-1]
    quotes = _quotes(buf)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[quotes[0::2]] = 1
    inside[quotes[1::2]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8)
    table = np.zeros(256, bool)
    table[list(b"{}[],:")] = True
    pos = np.flatnonzero(table[buf] & (inside == 0))
    if not len(pos):
        return
    mark = buf[pos]
    opens, closes = (mark == 0x7B) | (mark == 0x5B), (mark == 0x7D) | (mark == 0x5D)
    depth = np.cumsum(opens.astype(np.int64) - closes) + closes
    wide = np.int64(len(buf) + 1)
    keys = depth * wide + pos
    order = np.argsort(keys, kind="stable")
    keys, mark_, open_, pos_ = keys[order], mark[order], opens[order], pos[order]
    head = np.maximum.accumulate(np.where(open_, np.arange(len(order)), 0))  # the token that opens the container, per token
    commas = np.cumsum(mark_ == 0x2C)
    child = np.flatnonzero(open_)
    inner = keys[child] >= 2 * wide
    before = np.searchsorted(keys, keys[child] - wide) - 1  # the token before it, one level up
    before = np.where(inner, before, 0)
    parent = np.where(inner, head[before], -1)
    in_array = inner & (mark_[parent] == 0x5B)
    number = commas[before] - commas[np.maximum(parent, 0)]
    key_end = np.searchsorted(quotes, pos_[before]) - 1
    slot = np.full(len(order), -1, np.int64)
    slot[child] = np.arange(len(child))
    up = np.where(inner, slot[np.maximum(parent, 0)], -1).tolist()
    emit = np.flatnonzero(in_array & (mark_[child] == 0x7B))
    emit = emit[np.argsort(pos_[child[emit]], kind="stable")]
    text_of = np.searchsorted(starts, pos_[child], side="right") - 1
    ends = pos_[np.append(child[1:], len(order)) - 1] + 1 if with_text else None
    in_array_, number_, key_end_, text_of_, pos_child = in_array.tolist(), number.tolist(), key_end.tolist(), text_of.tolist(), pos_[child].tolist()
    lengths: dict[int, int] = {}  # of the paths so far; the last one begins with that of every object still open
    path = ""
    for i in emit.tolist():
        steps, at = [], i
        while at >= 0 and at not in lengths:
            if in_array_[at]:
                steps.append(f"[{number_[at]}]")
            elif up[at] >= 0:
                e = key_end_[at]
                key = joined[quotes[e - 1] + 1 : quotes[e]]
                name = json.loads(b'"' + key + b'"', strict=False) if b"\\" in key else key.decode("utf-8", "surrogatepass")
                steps.append("." + name)
            at = up[at]
        parent = path[: lengths[at]] if at >= 0 else "$"
        path = (parent if at >= 0 else bases[text_of_[i]]) + "".join(reversed(steps))
        lengths[i] = len(path)
        span = joined[pos_child[i] : ends[i]].decode("utf-8", "surrogatepass") if with_text else None
        yield text_of_[i], parent, path, span


def frames(rows: Iterable[tuple[int, str, str, str | None]]) -> Iterator[list[tuple[int, str, str, str | None]]]:
    """``rows`` in lists of bounded size, none empty, equal rows once; those of one text must follow each other."""
    digest = lambda row: hashlib.blake2b(repr(row).encode(), digest_size=16).digest()
    frame: dict[tuple, None] = {}
    gone: set[bytes] = set()  # rows of this text that earlier frames hold
    size, text = 0, -1
    for row in rows:
        if row[0] != text:
            text, gone = row[0], set()
        if row in frame or gone and digest(row) in gone:
            continue
        frame[row] = None
        size += ROW + len(row[1]) + len(row[2]) + len(row[3] or "")
        if size >= FRAME:
            yield list(frame)
            gone.update(digest(r) for r in frame if r[0] == text)
            frame, size = {}, 0
    if frame:
        yield list(frame)


def array_objects(df: DataFrame, ids: list[str], text: str, base: Column | None = None, unwrap: bool = True, with_text: bool = False) -> DataFrame:
    """(ids, parent_path, path[, object]) of every object that is an element of an array in the JSON of ``text``.

    path is ``base`` (``$`` by default) and what leads to the object; (ids, path)
    is the row's key, (ids, parent_path) that of the nearest enclosing such
    object, ``$`` if there is none.  A null, blank or broken text gives nothing.
    Of an object with one key twice both values count; equal rows of one text
    come out once.  Columns other than ``ids`` are dropped.
    """
    columns = [F.col(c).alias(f"id{i}") for i, c in enumerate(ids)]
    given = df.where(F.col(text).isNotNull()).select(*columns, F.col(text).alias("text"), (F.lit("$") if base is None else base).alias("base"))
    kinds = {f.name: f.dataType.simpleString() for f in given.schema}
    schema = ", ".join([*(f"id{i} {kinds[f'id{i}']}" for i in range(len(ids))), "parent_path string, path string, object string"])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def indexed(part: pd.DataFrame, texts: list[str]) -> Iterator[pd.DataFrame]:
            clean = lambda s: s if s is None or s.isascii() else s.encode("utf-8", "replace").decode()
            for found in frames(index_objects(texts, part["base"].tolist(), with_text)):  # a frame without rows would be an error in Spark's conversion of texts
                out = part.iloc[[f[0] for f in found]][[f"id{i}" for i in range(len(ids))]].reset_index(drop=True)
                yield out.assign(parent_path=[clean(f[1]) for f in found], path=[clean(f[2]) for f in found], object=[clean(f[3]) for f in found])

        for batch in batches:
            texts = [readable(t, unwrap) for t in batch["text"]]
            keep = [i for i, t in enumerate(texts) if t is not None]
            start = 0
            while start < len(keep):
                size, stop = 0, start
                while stop < len(keep) and (stop == start or size + len(texts[keep[stop]]) <= CHUNK):
                    size += len(texts[keep[stop]])
                    stop += 1
                part = keep[start:stop]
                yield from indexed(batch.iloc[part], [texts[i] for i in part])
                start = stop

    out = given.mapInPandas(rows, schema)
    named = [F.col(f"id{i}").alias(c) for i, c in enumerate(ids)]
    return out.select(*named, "parent_path", "path", *(["object"] if with_text else []))


def flat_fields(objects: DataFrame, text: str) -> DataFrame:
    """``objects`` with a row per scalar field of the JSON object ``text``: key, kind (text, number, truth or null) and value; the text itself is dropped.

    Objects and arrays in it are rows or tables of their own and left out, so an
    object without scalar fields gives none.  Numbers keep the form the parser
    gives them; of a key that stands there twice the last counts.
    """
    shapes = F.from_json(F.col(text), "map<string,string>")  # nested values as their text
    # what a value was is said by its own text in the object, parsed as a variant; keys are looked up in it as they are, not by a path
    variants = F.try_variant_get(F.try_parse_json(F.col(text)), "$", "map<string,variant>")
    both = F.map_zip_with(shapes, variants, lambda _, value, of: F.struct(value.alias("value"), F.schema_of_variant(of).alias("kind")))
    parsed = objects.withColumn("_v", F.explode(F.map_entries(both))).withColumn("key", F.col("_v.key")).withColumn("value", F.col("_v.value.value"))
    kind = F.col("_v.value.kind")
    named = F.when(kind == "STRING", "text").when(kind == "BOOLEAN", "truth").when(kind == "VOID", "null").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
    return parsed.withColumn("kind", named).where("kind is not null").drop("_v", text)
