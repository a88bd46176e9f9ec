"""Text statistics against plain Python, and structural profiles."""

import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm.quality import GROUPS, PROFILES, common_words, is_prose, profile, profiled, statistics

PROSE = [
    "The resolver was written before the last event of its run. It cannot see a copy of the archive.",
    "the reasoner keeps a list of prefixes unless a person has marked it as final and that is usually enough so the pass depends on it",
    "Der Zeiger braucht den letzten Stand, bevor es weiter gehen kann. Die Prüfung ersetzt eine Liste der Namen.",
    "Il grafo descrive una copia dell'indice quando il lotto resta piccolo. Più tardi questa classe aspetta.",
    "Reader planner-4 sees AgentEvent twice (cf. https://vocab.example/locatedIn#34), LedgerUnit never. PumpGroup supersedes MethodType via `ex:partOf` (rank 45).",
    "The schema keeps a token from another system. A supervising\nactor was compared with those axioms which nobody reads as we\nfound out in the spring, so the second curator shares its\nname with a copy of the archive.",
    "# Notes\n\nThe journal depends on the label of its parent when the batch is small.\n\n- one thing\n- another thing\n\nThe property graph explains the domain and the range, and nobody on the team has seen it since.",
    "Looks fine to me.",
]
OTHER = [
    None, "", " \t \n", "- a list of prefixes\n- ArchiveUnit;\n- delta lease.\n* PumpLink\n- the domain", "a,b,c\n1,2,3\n4,5,6\n7,8,9", "| a | b |\n|---|---|\n| the label | 4.5 |\n| x | y |",
    "ParcelUnit\npumice budget\nthe end of the chain\ncedar depth\nHabitatType\nochre epoch\nSignalType\nslate owner", "2027-03-11T00:13:00Z WARN [router-24] index owner=148\n2027-03-25T05:20:00Z INFO [mapper-31] read budget=625",
    '[\n {\n  "depth": 179\n },\n {\n  "owner": "amber",\n  "budget": null\n }\n]', "MATCH (a:Site)-[:partOf]->(b:Device) RETURN a, b LIMIT 16\nMATCH (a:Concept)-[:locatedIn]->(b:Person) RETURN a, b LIMIT 32",
    "slate slate. kelp. phase! epoch! quota. quartz! garnet. ochre! nectar. Policy. Vessel lagoon. owner.", "Back > Login > Home > Next > Login > Help > Search > Home", "vNhP3d3mTSVnLNuPyQUUbtdZdYRae/M3xVoZ4h/Azq6odYKMKdd+pl/DBWaQD31fZ63T1JgzBzXO3HbE7EeZXPGZ==",
    "if\nand which, when have it from. a, if\nare to\nby it\nbe\nand this of\nthe, for or. are", "@prefix ex: <https://v/t/> .\nex:Device11 a ex:Link ; ex:derivedFrom ex:Pump16 .\nex:Channel17 a ex:Set ; ex:partOf ex:Unit2 .", "one\n" * 50,
    "gktffwkdswar qqsaajgzaze zd gwshgzjhkzkre ahfedrgzfqdzg zzettjerfwe ltqqfqt zqahzqqhrztkzl sktkthtjhkg tlzzetrt", "harbor " * 60,
]
WORDS = [(lang, w) for lang, ws in {"en": "a an and are as at be by for from has have if in is it its no not of on or so that the to was when which", "de": "das den der die eine es bevor", "it": None}.items() for w in (ws or "").split()] + [(None, "x"), ("en", None), ("en", "the")]


@pytest.fixture(scope="module")
def words(spark):
    return common_words(spark.createDataFrame(WORDS, "lang string, word string"))


def test_profiles_are_distributions():
    for parts in PROFILES.values():
        assert [len(p) for p in parts] == [len(g) for g in GROUPS.values()]
        assert all(abs(sum(p) - 1) < 0.021 for p in parts)


def test_prose_and_the_rest(spark, words):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(PROSE + OTHER)], "doc_id bigint, text string, stats string")
    got = {r.doc_id: r.p for r in statistics(df, "text", words).select("doc_id", profile(F.col("stats")).alias("p")).collect()}
    wrong = {i: p for i, p in got.items() if (p.split("/")[0] in ("prose", "technical")) != (i < len(PROSE))}
    assert not wrong
    kept = statistics(df, "text", words).where(is_prose(profile(F.col("stats")))).count()
    assert kept == len(PROSE)
    assert [got[len(PROSE) + i] for i in range(3)] == ["blank"] * 3


def test_basic_statistics(spark, words):
    texts = [*(t for t in PROSE + OTHER), "word " * 50_000, "x" * 100_000]
    df = statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), "text", words)
    for r in df.select("doc_id", "stats.*").collect():
        t = texts[r.doc_id] or ""
        tokens = [w for w in t.split() if re.search(r"[^\W_]", w)]
        lines = [x for x in re.split("\r\n|[\n\r\x0b\x0c\x85  ]", t) if x.strip()]
        assert (r.n_words, r.n_chars, r.n_lines) == (len(tokens), len(t), len(lines))
        assert r.mean_word_length == pytest.approx(sum(map(len, tokens)) / len(tokens) if tokens else 0)
        assert r.punctuated_lines == pytest.approx(sum(bool(re.search(r"[.!?;:][\"')»”]*\s*$", x)) for x in lines) / len(lines) if lines else 0)
        bare = [re.sub(r"^[\W_]+|[\W_]+$", "", w).lower() for w in tokens]
        assert r.common_words == pytest.approx(max(sum(b in ws for b in bare) for ws in words.values()) / len(tokens) if tokens else 0)
        assert all(sum(getattr(r, g)) == pytest.approx(1) or sum(getattr(r, g)) == 0 for g in GROUPS)


def test_empty_tables(spark, words):
    assert statistics(spark.createDataFrame([], "doc_id bigint, text string"), "text", words).count() == 0
    none = common_words(spark.createDataFrame([], "lang string, word string"))
    assert statistics(spark.createDataFrame([("the end of it",)], "text string"), "text", none).select("stats.common_words").first()[0] == 0


def test_prose_profiles_of_languages(spark, words):
    german = "Das Haus und die Stadt: es war das Ende, bevor der Regen kam, und die Leute sahen den Fluss und die Wege dort."
    texts = [PROSE[0], german] * 30 + OTHER
    rows = profiled(spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, profile string"), "text", words).select("doc_id", "language", "profile", "stats").collect()
    for r in rows:
        if r.doc_id < 60:
            assert (r.language, r.profile) == (("en", "prose/en"), ("de", "prose/de"))[r.doc_id % 2]
        else:
            assert not r.profile.startswith("prose")
    assert profiled(spark.createDataFrame([], "doc_id bigint, text string"), "text", words).count() == 0


def test_long_texts_and_odd_characters(spark, words):
    texts = ["a" * 5_000_000, "\x1c the \x1d end \ud83d".encode("utf-8", "replace").decode(), "的" * 1000, "the end. " * 200_000, "\u2028", "e\u0301" * 9]
    got = {r.doc_id: r.stats for r in statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "text", words).collect()}
    assert [got[i].n_chars for i in range(6)] == [len(t) for t in texts] and got[3].n_words == 400_000 and got[4].n_lines == 0 and got[1].n_words == 2
