"""Per-document text statistics and the structural profile a text is nearest to.

Four distributions describe a text: how its characters spread over kinds of
lines, over kinds of words (function words of the language it uses most among
them), how its words spread over kinds of sentences, and its classes of
characters; a fifth is how its function words spread over those of all
languages.  Each structural profile (prose of several kinds, lists, tables,
code, junk) has the first four.  Each language has a prose profile of its own,
taken from all texts of the corpus that read as prose in it.  A text's language
is the one whose function words are nearest; its Jensen-Shannon divergences from
the structural profiles and from the prose of its language are added up over the
groups, and the least decides.

Statistics are taken for many texts at a time: characters by a table of classes,
tokens by a table that grows with the words met, sums by position.  Python runs
once per line, sentence and distinct token.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import written

MOST_WORDS = 50_000
MOST_LANGUAGES = 63
CHUNK = 4 << 20  # characters measured at a time; a longer text is measured alone
HELD_TOKENS = 1 << 18  # distinct tokens whose classes a worker keeps, of at most HELD_LENGTH characters
HELD_LENGTH = 64
LEAST_TEXTS = 20  # texts that a language must have before its prose has a profile of its own

GROUPS = {
    "lines": ("flowing", "short", "marked", "delimited", "repeated"),
    "words": ("function", "plain", "identifier", "number", "sign"),
    "sentences": ("tiny", "enumerated", "full"),
    "chars": ("vowel", "consonant", "digit", "structural"),
}
WEIGHTS = {"lines": 1.5, "words": 1.0, "sentences": 1.0, "chars": 1.0}
PROSE = ("prose", "technical")

# fixed values: shares of the classes above in texts of each structure, in the order of GROUPS
PROFILES: dict[str, tuple[tuple[float, ...], ...]] = {
    "code/json": ((0.47, 0.45, 0.00, 0.03, 0.04), (0.00, 0.81, 0.00, 0.13, 0.06), (0.00, 1.00, 0.00), (0.30, 0.44, 0.14, 0.12)),
    "code/query": ((1.00, 0.00, 0.00, 0.00, 0.00), (0.03, 0.29, 0.65, 0.03, 0.00), (0.00, 0.00, 1.00), (0.30, 0.49, 0.03, 0.18)),
    "code/triples": ((1.00, 0.00, 0.00, 0.00, 0.00), (0.02, 0.01, 0.93, 0.00, 0.04), (0.00, 0.00, 1.00), (0.35, 0.46, 0.09, 0.10)),
    "junk/blob": ((1.00, 0.00, 0.00, 0.00, 0.00), (0.00, 0.00, 1.00, 0.00, 0.00), (1.00, 0.00, 0.00), (0.19, 0.62, 0.16, 0.03)),
    "junk/bytes": ((1.00, 0.00, 0.00, 0.00, 0.00), (0.00, 0.22, 0.78, 0.00, 0.00), (0.00, 0.00, 1.00), (0.49, 0.14, 0.05, 0.32)),
    "junk/function": ((0.60, 0.40, 0.00, 0.00, 0.00), (1.00, 0.00, 0.00, 0.00, 0.00), (0.07, 0.11, 0.82), (0.41, 0.59, 0.00, 0.00)),
    "junk/letters": ((1.00, 0.00, 0.00, 0.00, 0.00), (0.00, 1.00, 0.00, 0.00, 0.00), (0.00, 0.00, 1.00), (0.13, 0.87, 0.00, 0.00)),
    "junk/salad": ((1.00, 0.00, 0.00, 0.00, 0.00), (0.00, 1.00, 0.00, 0.00, 0.00), (0.84, 0.00, 0.16), (0.38, 0.62, 0.00, 0.00)),
    "junk/signs": ((0.57, 0.33, 0.00, 0.10, 0.00), (0.00, 0.17, 0.53, 0.00, 0.31), (0.04, 0.05, 0.91), (0.11, 0.17, 0.03, 0.69)),
    "list/inline": ((0.93, 0.06, 0.00, 0.00, 0.01), (0.05, 0.78, 0.06, 0.02, 0.09), (0.00, 1.00, 0.00), (0.33, 0.56, 0.02, 0.09)),
    "list/marked": ((0.00, 0.00, 0.92, 0.00, 0.08), (0.15, 0.45, 0.31, 0.05, 0.05), (0.02, 0.04, 0.94), (0.37, 0.57, 0.02, 0.04)),
    "list/menu": ((0.05, 0.43, 0.00, 0.00, 0.52), (0.33, 0.64, 0.03, 0.00, 0.00), (0.00, 0.00, 1.00), (0.39, 0.61, 0.00, 0.00)),
    "list/names": ((0.00, 0.99, 0.00, 0.00, 0.01), (0.01, 0.02, 0.97, 0.00, 0.00), (0.00, 0.00, 1.00), (0.37, 0.56, 0.00, 0.07)),
    "list/plain": ((0.00, 0.89, 0.00, 0.00, 0.11), (0.17, 0.61, 0.22, 0.00, 0.00), (0.00, 0.00, 1.00), (0.39, 0.61, 0.00, 0.00)),
    "list/repeated": ((0.02, 0.06, 0.06, 0.00, 0.86), (0.18, 0.81, 0.00, 0.00, 0.01), (0.00, 0.00, 1.00), (0.39, 0.60, 0.00, 0.01)),
    "prose": ((1.00, 0.00, 0.00, 0.00, 0.00), (0.22, 0.76, 0.02, 0.00, 0.00), (0.00, 0.00, 1.00), (0.40, 0.60, 0.00, 0.00)),
    "prose/sparse": ((1.00, 0.00, 0.00, 0.00, 0.00), (0.06, 0.92, 0.02, 0.00, 0.00), (0.00, 0.00, 1.00), (0.45, 0.55, 0.00, 0.00)),
    "table": ((0.02, 0.01, 0.00, 0.97, 0.00), (0.06, 0.56, 0.12, 0.22, 0.04), (0.00, 0.19, 0.81), (0.23, 0.36, 0.35, 0.06)),
    "technical": ((1.00, 0.00, 0.00, 0.00, 0.00), (0.03, 0.52, 0.44, 0.01, 0.00), (0.00, 0.00, 1.00), (0.37, 0.56, 0.03, 0.04)),
    "technical/dense": ((1.00, 0.00, 0.00, 0.00, 0.00), (0.02, 0.50, 0.45, 0.02, 0.01), (0.00, 0.00, 1.00), (0.34, 0.54, 0.03, 0.09)),
}

# kinds of lines
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{_WS}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python alone
_LINE_END = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_MARK = re.compile(r"\s*(?:[-*•–—·▪◦‣+>]|\(?[0-9]{1,3}[.)\]]|\[[0-9]+\]|\(?[a-z][.)])\s+\S", re.A)
_TIME = re.compile(r"[\W_]?(?:[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2})")
_CLOSED = re.compile(r"\S+\s+\S+\s+\S+\s+\S.*[.!?][\"')»”]*$", re.A)
_DELIMITERS = {"|": re.compile(r"\|(?=\s|$)", re.A), "\t": re.compile("\t"), ";": re.compile(r";(?=\S)", re.A), ",": re.compile(r",(?=\S)", re.A), "  ": re.compile(r"[^\s.,;:!?] {2,}\S", re.A)}
_FINAL = re.compile(r"[.!?;:][\"')»”]*$")
# sentences and their clauses
_SENTENCE_END = re.compile(r"[.!?]+[\"')»”]*(?: |$)")
_CLAUSE_END = re.compile("[,;/>|·•] ")
# tokens
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”„«»‘’‚…–—•·◦▪‣¿¡§°€£©®™✓→←⇒"
_IDENTIFIER = regex.compile(r"\p{L}[0-9_:#/=]|\p{Ll}\p{Lu}|[0-9]\p{L}")
_LETTER, _NUMBER = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
# characters that are neither letters, digits nor white space and yet say nothing of structure
_PLAIN = " \t\n\x0b\x0c\r.,;!?'’\"“”«»¿¡-"
_OTHER, _VOWEL, _CONSONANT, _FOREIGN, _IS_DIGIT, _STRUCTURAL, _COLON, _UNKNOWN = 0, 1, 2, 3, 4, 5, 6, 255
FOREIGN_VOWELS = 0.4  # letters of other scripts than Latin count as so much vowel


def _letter(c: str) -> int:
    base = unicodedata.normalize("NFKD", c)[0].lower()
    return _VOWEL if base in "aeiouyæøœ" else _CONSONANT if "a" <= base <= "z" or base in "ßłđðþ" else _FOREIGN


def line_kind(line: str) -> int:
    """Place in GROUPS['lines'] of a line taken by itself."""
    if ":" in line and _TIME.match(line):
        return 3
    for sign, pattern in _DELIMITERS.items():
        if sign in line and len(pattern.findall(line)) >= 2:
            return 3
    if _MARK.match(line):
        return 2
    return 1 if len(line) < 36 and not _CLOSED.search(line) else 0


def common_words(words: DataFrame) -> dict[str, list[str]]:
    """Language to its function words, of a table (lang, word) of at most MOST_WORDS rows and MOST_LANGUAGES languages; rows with a null are left out."""
    rows = words.where("lang is not null and word is not null").select("lang", F.lower("word").alias("word")).distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} function words")
    out: dict[str, list[str]] = {}
    for lang, word in sorted(map(tuple, rows)):
        out.setdefault(lang, []).append(word)
    if len(out) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return out


class Tokens(dict):
    """Token to the row of its classes, made when it is first met: kind, length, languages in bits, place among the function words."""

    def __init__(self, function_words: dict[str, list[str]]):
        super().__init__()
        self.words = sorted({w for ws in function_words.values() for w in ws})
        self.place = {w: i for i, w in enumerate(self.words)}
        self.bits: dict[str, int] = {}
        for k, lang in enumerate(sorted(function_words)):
            for w in function_words[lang]:
                self.bits[w] = self.bits.get(w, 0) | 1 << k
        self.rows: list[tuple[int, int, int, int]] = []
        self._table = np.zeros((0, 4), np.int64)

    def classes(self, token: str) -> tuple[int, int, int, int]:
        bare = token.strip(_SIGNS)
        word = bare.lower()
        bits = self.bits.get(word, 0) if bare else 0
        if not bare:
            kind = 4
        elif bits:
            kind = 0
        elif _IDENTIFIER.search(token):
            kind = 2
        else:
            kind = 1 if _LETTER.search(bare) else 3 if _NUMBER.search(bare) else 4
        return kind, len(token), bits, self.place[word] if bits else -1

    def __missing__(self, token: str) -> int:
        at = len(self.rows)
        self.rows.append(self.classes(token))
        if len(token) <= HELD_LENGTH:
            self[token] = at
        return at

    def table(self, codes: np.ndarray) -> np.ndarray:
        """The classes of tokens, a row each."""
        if len(self.rows) > len(self._table):
            self._table = np.concatenate([self._table, np.array(self.rows[len(self._table) :], np.int64)])
        return self._table[codes]

    def trimmed(self) -> None:
        """Forget all tokens if there are too many: they are classed anew when met."""
        if len(self.rows) > HELD_TOKENS:
            self.clear()
            self.rows, self._table = [], np.zeros((0, 4), np.int64)


_CLASSES = np.full(0x110000, _UNKNOWN, np.uint8)


def character_classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    found = _CLASSES[points]
    new = np.unique(points[found == _UNKNOWN])
    if len(new):
        for p in new.tolist():
            c = chr(p)
            kind = unicodedata.category(c)[0]
            _CLASSES[p] = _letter(c) if kind == "L" else _IS_DIGIT if kind == "N" else _COLON if c == ":" else _OTHER if c in _PLAIN else _STRUCTURAL
        found = _CLASSES[points]
    return found


def _shares(counts: np.ndarray) -> np.ndarray:
    """Rows of counts as shares of their sums; all 0 if there is nothing."""
    total = counts.sum(1, keepdims=True)
    return np.divide(counts, total, out=np.zeros(counts.shape), where=total > 0)


def measured(texts: list[str], tokens: Tokens, languages: int) -> dict[str, np.ndarray | list]:
    """The statistics of some texts, by name."""
    n = len(texts)
    # lines, and sentences with their words
    kinds, all_, distinct, n_lines, closed = np.zeros((n, 4)), np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
    sentences, echoed = np.zeros((n, 3)), np.zeros(n)
    codes: list[int] = []
    ends = np.zeros(n, np.int64)
    for d, text in enumerate(texts):
        words = text.split() if not _ODD_SPACE.search(text) else [w for w in _SPACE.split(text) if w]
        codes += [tokens[w] for w in words]
        ends[d] = len(codes)
        raw = [x for x in _LINE_END.split(text) if x.strip(_WS)]
        n_lines[d] = len(raw)
        seen: set[str] = set()
        for x in raw:
            line = x.rstrip(" ")
            kinds[d, line_kind(line)] += len(line)
            bare = line.lstrip(" ")
            all_[d] += len(bare)
            if bare not in seen:
                seen.add(bare)
                distinct[d] += len(bare)
            if _FINAL.search(line[-64:]) or (len(line) > 64 and _FINAL.search(line)):
                closed[d] += 1
        echoed[d] = sum(len(a) for a, b in zip(words, words[1:], strict=False) if a == b)
        for s in _SENTENCE_END.split(" ".join(words)):
            if not s:
                continue
            size = s.count(" ") + (s[0] != " ") - (s[-1] == " " and len(s) > 1)
            if size <= 2:
                sentences[d, 0] += size
                continue
            clauses = sum(1 for c in _CLAUSE_END.split(s) if c.strip(" "))
            listed = clauses >= 5 and s.strip(" ").count(" ") + 1 <= 4.5 * clauses
            sentences[d, 1 if listed else 2] += size
    # tokens
    classes = tokens.table(np.array(codes, np.int64))
    kind, length, bits, place = classes.T if len(classes) else np.zeros((4, 0), np.int64)
    doc = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    chars = np.bincount(doc * 5 + kind, weights=length, minlength=5 * n).reshape(n, 5)
    word = kind < 4
    n_words = np.bincount(doc[word], minlength=n)
    word_chars = np.bincount(doc[word], weights=length[word], minlength=n)
    spoken, spoken_chars = np.zeros((n, languages + 1)), np.zeros((n, languages + 1))
    for k in range(languages):
        on = np.flatnonzero(bits >> k & 1)
        spoken[:, k] = np.bincount(doc[on], minlength=n)
        spoken_chars[:, k] = np.bincount(doc[on], weights=length[on], minlength=n)
    best_chars = spoken_chars.max(1)
    used = place >= 0
    pairs, times = np.unique(doc[used] * max(1, len(tokens.words)) + place[used], return_counts=True)
    # characters
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([0, *map(len, texts)])
    found = character_classes(points)
    structural = found == _STRUCTURAL
    colons = np.flatnonzero(found == _COLON)
    last = np.zeros(len(points) + 1, bool)
    last[bounds[1:]] = True  # the place after the end of a text
    follows = np.append(points, 32)[colons + 1]
    structural[colons] = ~last[colons + 1] & ~np.isin(follows, [9, 10, 11, 12, 13, 32])
    per_text = lambda on: np.diff(np.append(0, np.cumsum(on))[bounds])
    vowels, consonants, foreign = per_text(found == _VOWEL), per_text(found == _CONSONANT), per_text(found == _FOREIGN)
    digits, signs = per_text(found == _IS_DIGIT), per_text(structural)
    by_class = np.column_stack([vowels + FOREIGN_VOWELS * foreign, consonants + (1 - FOREIGN_VOWELS) * foreign, digits, signs])
    # shares
    few = n_lines < 3  # a line or two, however short, are no list
    kinds[few, 0] += kinds[few, 1]
    kinds[few, 1] = 0
    repeated = 1 - np.divide(distinct, all_, out=np.ones(n), where=all_ > 0)  # lines that stand there before, or words that repeat the one before
    repeated = np.maximum(repeated, np.divide(echoed, chars.sum(1), out=np.zeros(n), where=chars.sum(1) > 0))
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    n_chars = np.diff(bounds)
    out = {
        "lines": np.column_stack([_shares(kinds) * (1 - repeated[:, None]), repeated]),
        # function words of other languages than the one most used are plain words here
        "words": _shares(np.column_stack([best_chars, chars[:, 1] + chars[:, 0] - best_chars, chars[:, 2:]])),
        "sentences": _shares(sentences),
        "chars": _shares(by_class),
        "n_words": n_words, "n_chars": n_chars, "n_lines": n_lines, "mean_word_length": ratio(word_chars, n_words), "symbol_ratio": ratio(signs, n_chars),
        "punctuated_lines": ratio(closed, n_lines), "common_words": ratio(spoken.max(1), n_words), "best": np.where(spoken.max(1) > 0, spoken.argmax(1), -1),
        "function": (pairs, times),
    }
    at, out["distance"] = _nearest(np.column_stack([out[g] for g in GROUPS]))
    out["nearest"] = np.where(n_lines == 0, "blank", np.array(_NAMES, object)[at])
    return out


_SHARES = T.ArrayType(T.DoubleType())
STATS = T.StructType(
    [
        *(T.StructField(g, _SHARES) for g in GROUPS),
        *(T.StructField(c, T.IntegerType()) for c in ("n_words", "n_chars", "n_lines")),
        *(T.StructField(c, T.DoubleType()) for c in ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")),
        T.StructField("best", T.IntegerType()),
        T.StructField("nearest", T.StringType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("function", T.ArrayType(T.StructType([T.StructField("word", T.IntegerType()), T.StructField("n", T.IntegerType())]))),
    ]
)


def statistics(df: DataFrame, text: str, function_words: dict[str, list[str]]) -> DataFrame:
    """``df`` with one column ``stats``: the distributions named in GROUPS, basic counts, and function words.

    ``best`` is the place of the language whose function words are most, among
    the sorted languages, -1 without any; ``function`` counts the function words
    by their place among those of all languages, sorted; ``nearest`` is the
    nearest structural profile, ``distance`` its divergence.  A null text counts as
    empty: all counts and shares are 0.  Columns of any other name pass through;
    a column ``stats`` is replaced.
    """
    rest = [c for c in df.columns if c != "stats"]
    given = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("measured"))
    schema = T.StructType([*given.schema.fields[:-1], T.StructField("stats", STATS)])
    languages = len(function_words)

    def as_arrow(found: dict, n: int, tokens: Tokens) -> pa.StructArray:
        fields = []
        for f in STATS:
            value = found[f.name]
            if f.name == "function":
                pairs, times = value
                rows, place = np.divmod(pairs, max(1, len(tokens.words)))
                items = pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(times.astype(np.int32))], ["word", "n"])
                fields.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), items))
            elif f.name in GROUPS:
                fields.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * value.shape[1]), pa.array(value.ravel())))
            else:
                fields.append(pa.array(value, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string() if isinstance(f.dataType, T.StringType) else pa.float64()))
        return pa.StructArray.from_arrays(fields, STATS.names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(function_words)
        for batch in batches:
            texts = batch.column(len(rest)).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) <= CHUNK):
                    size += len(texts[stop])
                    stop += 1
                found = measured(texts[start:stop], tokens, languages)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], as_arrow(found, stop - start, tokens)], names=schema.names)
                tokens.trimmed()
                start = stop

    out = given.mapInArrow(rows, schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), "stats")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergences (in bits, term by term) of arrays of shares that broadcast."""
    m = (p + q) / 2
    half = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0)
    return (half(p) + half(q)) / 2


_NAMES = sorted(PROFILES)
_TABLE = np.array([[x for part in PROFILES[name] for x in part] for name in _NAMES])
_WEIGHT = np.array([WEIGHTS[g] for g, names in GROUPS.items() for _ in names])


def _rows(stats: pd.DataFrame) -> np.ndarray:
    return np.column_stack([np.array(stats[g].tolist(), float).reshape(len(stats), len(names)) for g, names in GROUPS.items()])


def _nearest(shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest structural profile and its divergence; of equally near ones the first by name."""
    d = np.stack([(divergence(shares, q) * _WEIGHT).sum(1) for q in _TABLE], 1) if len(shares) else np.zeros((0, len(_TABLE)))
    at = d.argmin(1)
    return at, d[np.arange(len(d)), at]


def profile(stats: Column) -> Column:
    """The name of the nearest structural profile, whatever the language; 'blank' of a null, empty or blank text."""
    return stats["nearest"]


class Languages:
    """Prose profiles of languages: how its function words spread, and the shares of words and characters of its prose."""

    def __init__(self, names: list[str], words: int):
        self.names, self.words = names, words
        self.function = np.zeros((0, words))
        self.shares = np.zeros((0, len(_WEIGHT)))
        self.known: list[str] = []

    def learn(self, stats: DataFrame) -> Languages:
        """Take the profiles from all texts of ``stats`` that read as prose: one pass over the statistics, a row per language and one per function word come back."""
        prose = stats.where(is_prose(profile(F.col("stats"))) & (F.col("stats.best") >= 0))
        groups = [(g, i) for g, names in GROUPS.items() for i in range(len(names))]
        means = prose.groupBy(F.col("stats.best").alias("best")).agg(F.count("*").alias("n"), *(F.avg(F.get(F.col(f"stats.{g}"), F.lit(i))).alias(f"{g}{i}") for g, i in groups)).collect()
        spread = prose.select(F.col("stats.best").alias("best"), F.explode("stats.function").alias("f")).groupBy("best", "f.word").agg(F.sum("f.n").alias("n")).collect()
        kept = sorted((r for r in means if r["n"] >= LEAST_TEXTS), key=lambda r: r["best"])
        self.known = [self.names[r["best"]] for r in kept]
        self.shares = np.array([[r[f"{g}{i}"] for g, i in groups] for r in kept]).reshape(len(kept), len(groups))
        row = {r["best"]: i for i, r in enumerate(kept)}
        self.function = np.zeros((len(kept), self.words))
        for r in spread:
            if r["best"] in row:
                self.function[row[r["best"]], r["word"]] = r["n"]
        self.function = _shares(self.function)
        return self

    def nearest(self, function: list[list]) -> np.ndarray:
        """Of each text the language whose function words spread most alike; -1 of a text without function words."""
        out = np.full(len(function), -1)
        for i, f in enumerate(function):
            if len(f) and len(self.known):
                at = np.array([x["word"] for x in f])
                p = np.array([x["n"] for x in f], float)
                p /= p.sum()
                q = self.function[:, at]
                # what the text has none of adds half of the language's share of it
                out[i] = int((divergence(p[None], q).sum(1) + (1 - q.sum(1)) / 2).argmin())
        return out


def language_profile(languages: Languages) -> Column:
    """A column function of ``stats``: struct (language, profile), the profile the nearest of the structural ones and of the prose of the text's language, there named prose/<language>."""

    @F.pandas_udf("language string, profile string")
    def named(stats: pd.DataFrame) -> pd.DataFrame:
        shares, d, names = _rows(stats), stats["distance"].to_numpy(), stats["nearest"].to_numpy(object).copy()
        spoken = languages.nearest(stats["function"].tolist())
        has = np.flatnonzero((spoken >= 0) & (names != "blank"))
        if len(has):
            own = (divergence(shares[has], languages.shares[spoken[has]]) * _WEIGHT).sum(1)
            near = has[own < d[has]]
            names[near] = [f"prose/{languages.known[k]}" for k in spoken[near]]
        spoken_names = [languages.known[k] if k >= 0 else None for k in spoken]
        return pd.DataFrame({"language": pd.Series(spoken_names, dtype=object), "profile": names})

    return named


def profiled(df: DataFrame, text: str, function_words: dict[str, list[str]]) -> DataFrame:
    """``df`` with ``stats``, ``language`` and ``profile``: statistics are taken once, written, and read to learn the languages and then to name profiles.

    Columns of these names are replaced.
    """
    kept = df.drop("stats", "language", "profile")
    stats = written(statistics(kept, text, function_words), "stats")
    words = len({w for ws in function_words.values() for w in ws})
    named = language_profile(Languages(sorted(function_words), words).learn(stats))
    return stats.withColumn("named", named(F.col("stats"))).select(*stats.columns, "named.language", "named.profile")


def is_prose(name: Column) -> Column:
    """Whether a profile is one of prose."""
    return F.split(name, "/")[0].isin(*PROSE)
