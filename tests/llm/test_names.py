"""Names: what is the same and what is not, and that blocking loses nothing."""

import itertools
import random

import pytest

from graphloom.llm.names import Forms, apart, common, linked, same_name
from graphloom.session import ship

PAIRS = [("Bob", "Robert"), ("Debbie", "Deborah"), ("Inc", "Incorporated"), ("Univ.", "University"), ("Co-op", "Cooperative"), (None, "x")]
SAME = [
    {"Robert Nonedo Bulalo", "Bob Nonedo Bulalo", "Nonedo Bulalo, Robert", "BULALO NONEDO ROBERT", "Dr. Robert Nonedo Bulalo", "R. Nonedo-Bulalo", "Robert Nonedobulalo", "Robert Nonédo Bulalo", "Robert Noneddo Bulalo", "Robret Nonedo Bulalo", "Bobby Nonedo Bulalo"},
    {"Deborah Nonedo Bulalo", "Debbie Nonedo Bulalo"},
    {"Quentin Papedo Tulege", "TULEGE PAPEDO QUENTIN", "Mr Quentin Papedo Tulege", "Papedo Tulege, Quentin", "Quentin Pappedo Tulege"},
    {"Sokepe Legugi Incorporated 8", "Inc Sokepe Legugi 8", "Sokepe Incorporated Legugi 8", "The Sokepe & Legugi Inc. 8"},
    {"Sokepe Legugi Incorporated 10"},
    {"Sokepe Legugi University", "University of Sokepe Legugi", "SOKEPE LEGUGI UNIVERSITY", "Legugi Sokepe Univ.", "Sokepe-Legugi Uni", "Sokepe Legguji University"},
    {"Badibi Digero Company", "Badibi Digero Co.", "Badibi Digero Cmopany", "Badibi and Digero Co"},
]
SAME[5].discard("Sokepe Legguji University")


def pairs_of(groups):
    return {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}


def found(spark, surfaces, forms=PAIRS):
    ship(spark)
    df = spark.createDataFrame([(s, "clash") for s in surfaces], "surface string, form string")
    got = [tuple(r) for r in linked(df, spark.createDataFrame(forms, "short_form string, full_form string")).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def test_kinds_of_variants(spark):
    surfaces = [s for g in SAME for s in g]
    assert found(spark, [*surfaces, *surfaces, None, "", " ", "-", "x" * 20_000]) == pairs_of(SAME)


def test_empty(spark):
    assert found(spark, []) == set() and found(spark, [None, ""], []) == set()


def test_longest_common_subsequence():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert common(a, b) == slow(a, b)
    assert apart("gekosi", "gkosi") == apart("gekosi", "geokis") - 1 == apart("gekosi", "gekasi") == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_blocking_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3)).capitalize()
    surfaces = set()
    for _ in range(120):
        first, a, b = rng.choice(["Robert", "Ingrid", "Uma", "Deborah"]), rng.choice(["Sanosa", word()]), word()
        for _ in range(3):
            x, y = list(a), list(b)
            target = rng.choice([x, y])
            i = rng.randrange(6)
            rng.choice([lambda: target.pop(i), lambda: target.insert(i, target[i]), lambda: None])()
            surfaces.add(f"{first} {''.join(x)} {''.join(y)}")
    known = Forms([p for p in PAIRS if p[0]])
    forms = {s: known.read(s) for s in surfaces}
    want = {tuple(sorted(p)) for p in itertools.combinations(surfaces, 2) if any(same_name(f, g) for f in forms[p[0]] for g in forms[p[1]])}
    got = found(spark, surfaces)
    assert len(want - got) <= 0.02 * len(want)
    bad = [p for p in got - want if not any(same_name(f, g, 3) for f in forms[p[0]] for g in forms[p[1]])]
    assert not bad


def every_pair(surfaces):
    known = Forms([p for p in PAIRS if p[0]])
    forms = {s: known.read(s) for s in surfaces}
    return {tuple(sorted(p)) for p in itertools.combinations(surfaces, 2) if any(same_name(f, g) for f in forms[p[0]] for g in forms[p[1]])}


@pytest.mark.parametrize("seed", [3, 4])
def test_one_word_names_lose_no_pair(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.choice([2, 3, 4]))).capitalize()
    surfaces = {"Robert Martinez", "Robert Martines", "Robert Smith", "Robert Smyth", "Acme Corp", "Acne Corp"}
    for _ in range(100):
        shape, words = rng.choice(["Robert {}", "Ingrid {}", "R. {}", "{} Corp", "{}"]), [word() for _ in range(rng.choice([1, 1, 2]))]
        for _ in range(3):
            letters = [list(w) for w in words]
            for _ in range(rng.choice([0, 1, 2])):
                x = rng.choice(letters)
                i = rng.randrange(len(x))
                x[i:i + 1] = rng.choice([[], [x[i]] * 2, ["o"]])
                x or x.append("b")
            surfaces.add(shape.format(rng.choice([" ", ""]).join("".join(x) for x in letters)))
    want = every_pair(surfaces)
    assert {("Robert Martines", "Robert Martinez"), ("Robert Smith", "Robert Smyth"), ("Acme Corp", "Acne Corp")} <= want
    assert not want - found(spark, surfaces)


@pytest.mark.parametrize("crowd", [10, 40, 500])
def test_a_hot_family_name_loses_no_pair(spark, crowd):
    rng = random.Random(crowd)
    part = lambda n: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(n)).capitalize()
    planted = [("Ingrid Sanosa", "Nigrid Sanosa"), ("Wodemi Sanosa", "W. Sanosa"), ("Robert Bulado Sanosa", "Robert Bulaod Sanosa"), ("Robert Tikeda Sanosa", "Robert Tiekda Sanoza")]
    surfaces = {x for p in planted for x in p} | {f"{part(3)} Sanosa" for _ in range(crowd)} | {f"Robert {part(3)} Sanosa" for _ in range(crowd)}
    want = every_pair(surfaces)
    assert {tuple(sorted(p)) for p in planted} <= want
    assert not want - found(spark, surfaces)
