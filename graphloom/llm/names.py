"""Variant spellings of the names of persons and organisations, linked.

A surface is reduced to a form: class, given name or kind of organisation,
family or proper words, number.  Forms are indexed by the suffixes of their
words; a suffix that very many forms share is refined by the other fields
instead of being dropped.  A second index by letters has a common key for every
pair that the comparison accepts.  Pairs that meet are compared word by word by
their longest common subsequence.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import written as written_once

SHORTEST = 5  # letters of a suffix
CROWDED = 24  # forms under one suffix from which it is refined
PACKED = 400  # forms under one refined suffix from which it is refined again
FULL = 200  # forms under one key of letters from which it is refined
# fixed values: letters in groups about equally frequent, and in others that cut across them; any other sign goes by its code
GROUPS = ("ejqvz", "tpgbx", "amfwk", "oldy", "isuc", "nrh")
OTHER_GROUPS = ("alp", "imtw", "enyg", "rckx", "ozdsq", "ubfhvj")

# fixed values: words that say what kind of organisation it is, and short forms of them
KINDS = (
    "academy agency association authority bank bureau center college committee company consortium cooperative corporation council department "
    "federation foundation group holding hospital incorporated institute laboratory library limited ministry museum observatory office partners "
    "press school society studio syndicate trust union university"
).split()
KIND_FORMS = dict(x.split("=") for x in "acad=academy assn=association assoc=association centre=center co=company coop=cooperative corp=corporation dep=department dept=department fdn=foundation found=foundation fnd=foundation inc=incorporated inst=institute lab=laboratory labs=laboratory ltd=limited min=ministry mus=museum soc=society uni=university univ=university".split())
# fixed values: short forms of given names
GIVEN_FORMS = dict(
    x.split("=")
    for x in (
        "abby=abigail al=albert andy=andrew bella=isabella ben=benjamin bert=albert bess=elizabeth betsy=elizabeth betty=elizabeth billy=william bobby=robert cathy=catherine charlie=charles chuck=charles dan=daniel danny=daniel dave=david "
        "dick=richard ed=edward eddie=edward fran=francisco fred=frederick greg=gregory hank=henry harry=henry jack=john jerry=gerald jim=james jimmy=james joe=joseph johnny=john ken=kenneth kit=christopher larry=lawrence lexi=alexandra "
        "lisa=elizabeth lizzie=elizabeth matt=matthew meg=margaret mickey=michael molly=mary nicky=nicholas pancho=francisco pat=patricia pete=peter phil=philip ray=raymond rick=richard robbie=robert ron=ronald sam=samuel sandy=alexander steve=steven "
        "susie=susanna teddy=theodore tom=thomas tommy=thomas vic=victoria willy=william xander=alexander"
    ).split()
)
# fixed values: words in a name that do not tell it apart
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame rev hon herr frau mme monsieur madame señor señora".split())
GLUE = frozenset("the of and".split())
_LETTERS = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().translate(_LETTERS)) if not unicodedata.combining(c))


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of a row's bits at once."""
    if a == b:
        return len(a)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        x = row & places.get(c, 0)
        row = ((row + x) | (row - x)) & full
    return len(a) - row.bit_count()


def apart(a: str, b: str) -> int:
    """Letters of the longer word outside the longest common subsequence: 1 for one letter too many, missing, wrong or two exchanged."""
    return max(len(a), len(b)) - common(a, b)


class Forms:
    """Short forms of given names and organisation words: the fixed ones and those of ``pairs`` (short, full)."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.kind = dict(KIND_FORMS) | {k: k for k in KINDS}
        self.given = dict(GIVEN_FORMS)
        clean = lambda s: re.sub(r"[^a-z]", "", plain(s))
        for short, full in pairs:
            short, full = clean(short), clean(full)
            if short and full:
                (self.kind if full in KINDS else self.given)[short] = full
        self.given |= {full: full for full in list(self.given.values())}

    def _near(self, word: str, known: dict[str, str]) -> str | None:
        """The full form that the word is one slip away from; None if there are several."""
        hits = {full for form, full in known.items() if abs(len(form) - len(word)) <= 1 and len(form) >= 5 and apart(form, word) <= 1} if len(word) >= 5 else set()
        return hits.pop() if len(hits) == 1 else None

    def read(self, surface: str) -> list[str]:
        """The forms a surface can have: 'o|kind|number|words' or 'p|given||words'; several where it isn't clear which word is the given name."""
        text = re.sub(r"\bco-?op\b\.?", "coop", plain(surface)).replace("&", " and ")
        head, comma, tail = text.partition(",")
        words_of = lambda t: [w for w in re.split(r"[\W_]+", re.sub(r"['’`.]", lambda m: "" if m[0] != "." else " ", t)) if w]
        first, last = words_of(head), words_of(tail)
        words = [w for w in first + last if w not in GLUE]
        numbers = [w for w in words if w.isdigit()]
        rest = [w for w in words if not w.isdigit()]
        at = next((i for i, w in enumerate(rest) if w in self.kind and len(rest) > 1), None)
        kind = self.kind[rest[at]] if at is not None else None
        named = [w for w in rest if w not in TITLES]
        if kind is None and not any(w in self.given or len(w) == 1 for w in named):
            near = [(i, k) for i, w in enumerate(rest) if (k := self._near(w, self.kind))]
            if len(near) == 1 and len(rest) > 2:
                at, kind = near[0]
        if kind is not None:
            core = rest[:at] + rest[at + 1 :]
            return [f"o|{kind}|{' '.join(numbers)}|{' '.join(core)}"]
        if not named:
            return [f"x|||{' '.join(words) or plain(surface).strip()}"]
        if len(named) == 1 or numbers:
            return [f"x|||{' '.join(named + numbers)}"]
        tail_words = [w for w in last if w not in TITLES and w not in GLUE]
        if comma and tail_words:
            choices = [len(named) - len(tail_words)]
        elif any(len(w) == 1 for w in named):
            choices = [next(i for i, w in enumerate(named) if len(w) == 1)]
        else:
            ends = [0, len(named) - 1]
            choices = [i for i in ends if named[i] in self.given][:1] or [i for i in ends if self._near(named[i], self.given)][:1] or ends
        out = []
        for i in choices:
            given = named[i]
            given = self.given.get(given) or self._near(given, self.given) or given
            out.append(f"p|{given}||{' '.join(named[:i] + named[i + 1 :])}")
        return list(dict.fromkeys(out))


def _words_apart(a: list[str], b: list[str]) -> int:
    """Letters apart of two lists of words in the best order, or of the words run together; 99 if a word fits none."""
    best = 99
    if len(a) == len(b):
        orders = [b] if len(b) == 1 else [b, b[1:] + b[:1]]
        for order in orders:
            each = [apart(x, y) for x, y in zip(a, order, strict=True)]
            if all(n <= 1 or 3 * n <= max(len(x), len(y)) for n, x, y in zip(each, a, order, strict=True)):
                best = min(best, sum(each))
    else:
        runs = lambda w: {"".join(w), "".join(w[1:] + w[:1])}
        for x in runs(a):
            for y in runs(b):
                n = apart(x, y)
                if 6 * n <= max(len(x), len(y)):
                    best = min(best, n)
    return best


def same_name(a: str, b: str, slips: int = 2) -> bool:
    """Whether two forms name one person or organisation, with so many slips of the pen in both together."""
    ka, fa, na, wa = a.split("|", 3)
    kb, fb, nb, wb = b.split("|", 3)
    if ka != kb or na != nb:
        return False
    wa_, wb_ = wa.split(), wb.split()
    if ka == "o":
        return fa == fb and _words_apart(wa_, wb_) <= slips
    if ka == "x":
        return _words_apart(wa_, wb_) <= min(slips, 1)
    if len(fa) == 1 or len(fb) == 1:
        return fa[0] == fb[0] and _words_apart(wa_, wb_) <= min(slips, 1)
    given = apart(fa, fb)
    if given and (3 * given > max(len(fa), len(fb)) or given > 1):
        return False
    return given + _words_apart(wa_, wb_) <= slips


def suffixes(form: str) -> Iterator[tuple[str, str, str]]:
    """(suffix, refined, refined again) under which a form is indexed.

    Refining adds the class and kind with number, or the initial of the given
    name; refining again the last letters of the other words.  The ends of all
    words together are one more suffix, their starts another.
    """
    kind, first, number, words = form.split("|", 3)
    field = f"{kind}{first}{number}" if kind == "o" else f"{kind}{first[:1]}"
    split = words.split()
    keys: dict[str, str] = {}
    for i, w in enumerate(split):
        other = "".join(split[:i] + split[i + 1 :])[-3:]
        for n in range(min(SHORTEST, len(w)), len(w) + 1):
            keys.setdefault(w[len(w) - n :], other)
        if len(split) == 1:  # words run together: the end of the first is inside
            for cut in range(SHORTEST, len(w) - SHORTEST + 1):
                keys.setdefault(w[max(0, cut - SHORTEST - 1) : cut], w[-3:])
    for key, other in keys.items():
        yield key, f"{key}|{field}", f"{key}|{field}|{other}"
    if len(split) > 1:  # short ends, and starts, refined by those of the other words: for slips in two words
        for key in ("&".join(sorted(w[-3:] for w in split)), "&".join(sorted(w[:3] for w in split)) + "^"):
            yield key, f"{key}|{field}", f"{key}|{field}|{first}"


def _letters(words: str, untouched: int, groups: tuple[str, ...] = GROUPS) -> list[str]:
    """The sorted letters of so many of the groups, one text for each choice of groups."""
    of = [""] * len(groups)
    for c in sorted("".join(words.split())):
        of[next((i for i, g in enumerate(groups) if c in g), ord(c) % len(groups))] += c
    return ["|".join(f"{i}{of[i]}" for i in some) for some in combinations(range(len(groups)), untouched)]


def exact_keys(form: str) -> list[tuple[str, bool]]:
    """Keys, and whether the given name is still free under them, of which every two forms that ``same_name`` accepts with two slips share one.

    A slip takes at most one letter from either side whatever the order of the
    words and the blanks between them, so it touches two groups of letters at
    most: one slip leaves four of the six as they are, two leave two.  Two are
    in the words only if all other fields are equal.
    """
    kind, first, number, words = form.split("|", 3)
    one, two = len(GROUPS) - 2, len(GROUPS) - 4
    if kind == "o":
        return [(f"o|{first}|{number}|{x}", False) for x in _letters(words, two)]
    keys = [(f"{kind}||{x}", kind == "p") for x in _letters(words, one)]
    if kind == "p" and len(first) > 1:
        keys += [(f"p|{first}|{x}", False) for x in _letters(words, two)]
    return keys


def refined(form: str, free: bool) -> list[tuple[str, bool]]:
    """What a full key of the form is refined by, and whether two such rows need not meet; accepted pairs still share one.

    A free given name: itself without any one letter, and its initial, which two
    full names need not meet under.  Else the letters in other groups.
    """
    kind, first, _, words = form.split("|", 3)
    if free:
        less = {first} | {first[:i] + first[i + 1 :] for i in range(len(first))} if len(first) > 1 else set()
        return [(x, False) for x in sorted(less)] + [(f"{first[0]}^", len(first) > 1)]
    return [(x, False) for x in _letters(words, len(GROUPS) - (2 if kind == "x" else 4), OTHER_GROUPS)]


def linked(surfaces: DataFrame, forms: DataFrame, surface: str = "surface", most_forms: int = 100_000) -> DataFrame:
    """(surface_a, surface_b), a < b by code points: every two different strings that name the same person or organisation.

    ``forms`` has columns short_form and full_form, at most ``most_forms`` rows;
    rows with a null in them are left out.  Null and empty surfaces are left
    out, repeated ones count once, other columns are dropped.  A surface of
    blanks or signs alone is linked to none but those of equal plain letters.
    """
    pairs = [tuple(r) for r in forms.where("short_form is not null and full_form is not null").select("short_form", "full_form").distinct().limit(most_forms + 1).collect()]
    if len(pairs) > most_forms:
        raise ValueError(f"more than {most_forms} short forms")
    known = Forms(sorted(pairs))
    given = surfaces.select(F.col(surface).alias("surface")).where("surface <> ''").distinct()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, f) for s in b["surface"] for f in known.read(s)]
            yield pd.DataFrame(rows, columns=["surface", "form"])

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *key) for f in b["form"] for key in suffixes(f)]
            yield pd.DataFrame(rows, columns=["form", "k0", "k1", "k2"])

    def index_exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(f, *key) for f in b["form"] for key in exact_keys(f)], columns=["form", "key", "free"])

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, k, *more) for f, k, free in zip(b["form"], b["key"], b["free"], strict=True) for more in refined(f, free)]
            yield pd.DataFrame(rows, columns=["form", "key", "more", "skip"])

    read_ = written_once(given.mapInPandas(read, "surface string, form string"), "names")
    keyed = read_.select("form").distinct().mapInPandas(index, "form string, k0 string, k1 string, k2 string")
    keyed = written_once(keyed, "suffixes")
    crowded = keyed.groupBy("k0").count().where(F.col("count") > CROWDED).select("k0", F.lit(True).alias("crowded"))
    packed = keyed.join(crowded, "k0", "left_semi").groupBy("k1").count().where(F.col("count") > PACKED).select("k1", F.lit(True).alias("packed"))
    key = F.when(F.col("packed"), F.col("k2")).when(F.col("crowded"), F.col("k1")).otherwise(F.col("k0"))
    blocks = keyed.join(crowded, "k0", "left").join(packed, "k1", "left").select("form", key.alias("key")).distinct()
    met = blocks.alias("a").join(blocks.alias("b"), F.expr("a.key = b.key and a.form < b.form")).select(F.col("a.form").alias("a"), F.col("b.form").alias("b"))
    exact = read_.select("form").distinct().mapInPandas(index_exact, "form string, key string, free boolean").select("form", F.xxhash64("key").alias("key"), "free")
    exact = written_once(exact, "letters")
    full = exact.groupBy("key").count().where(F.col("count") > FULL).select("key", F.lit(True).alias("full"))
    exact = exact.join(full, "key", "left")
    apart_ = exact.where("full").select("form", "key", "free").mapInPandas(refine, "form string, key bigint, more string, skip boolean").select("form", F.xxhash64("key", "more").alias("key"), "skip")
    exact = exact.where("full is null").select("form", "key", F.lit(False).alias("skip")).unionByName(apart_)
    met = met.unionByName(exact.alias("a").join(exact.alias("b"), F.expr("a.key = b.key and a.form < b.form and not (a.skip and b.skip)")).select(F.col("a.form").alias("a"), F.col("b.form").alias("b")))

    def judge(slips: int) -> object:
        @F.pandas_udf("boolean")
        def same(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([same_name(x, y, slips) for x, y in zip(a, b, strict=True)], dtype=bool)

        return same

    near = written_once(met.distinct().where(judge(2)("a", "b")), "near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # two slips that leave no common suffix meet through a spelling both are near to; an initial is no such bridge
    bridge = both.where(~F.col("a").rlike(r"^p\|.\|"))
    over = bridge.alias("l").join(bridge.alias("r"), F.expr("l.a = r.a and l.b < r.b")).select(F.col("l.b").alias("a"), F.col("r.b").alias("b")).distinct()
    over = over.join(near, ["a", "b"], "left_anti").where(judge(3)("a", "b"))
    forms_ = near.unionByName(over)
    own = read_.select(F.col("form").alias("a")).distinct().select("a", F.col("a").alias("b"))
    sides = forms_.unionByName(own).join(read_.select(F.col("form").alias("a"), F.col("surface").alias("x")), "a").join(read_.select(F.col("form").alias("b"), F.col("surface").alias("y")), "b")
    return sides.where("x <> y").select(F.least("x", "y").alias("surface_a"), F.greatest("x", "y").alias("surface_b")).distinct()

