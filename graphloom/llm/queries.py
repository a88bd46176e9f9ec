"""Queries of this package on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.mixing import kept_promises, mixture, shares, sized
from graphloom.llm.names import linked
from graphloom.llm.quality import common_words, is_prose, profiled, statistics
from graphloom.llm.tokens import encoded


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every two spellings of one person or organisation."""
    surfaces = _table(spark, sf, "entity_candidates").select("surface").unionByName(_table(spark, sf, "concept_clusters").select(F.explode("members").alias("surface")))
    return linked(surfaces, _table(spark, sf, "name_forms"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The token ids of every text by byte_bpe_50k."""
    return encoded(_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mixture, with their shard and copy."""
    return mixture(sized(_table(spark, sf, "documents")), _table(spark, sf, "mix_targets")).select("shard", "source", "doc_id", "copy", "n_tokens", "place")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that the mixture reaches."""
    sizes, targets = sized(_table(spark, sf, "documents")), _table(spark, sf, "mix_targets")
    return shares(mixture(sizes, targets), sizes, targets)


def p9_promises(spark: SparkSession, sf: str) -> DataFrame:
    """What the mixture promises for every source, counted on its rows."""
    sizes, targets = sized(_table(spark, sf, "documents")), _table(spark, sf, "mix_targets")
    return kept_promises(mixture(sizes, targets), sizes, targets)


def _profiled(spark: SparkSession, sf: str) -> DataFrame:
    return profiled(_table(spark, sf, "documents").select("doc_id", "text"), "text", common_words(_table(spark, sf, "common_words")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose text is not natural prose."""
    return _profiled(spark, sf).where(~is_prose(F.col("profile"))).select("doc_id")


def p10_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Basic statistics, language and the nearest structural profile of every text."""
    s = F.col("stats")
    rounded = [F.round(s[c], 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")]
    return _profiled(spark, sf).select("doc_id", s["n_words"].alias("n_words"), s["n_chars"].alias("n_chars"), s["n_lines"].alias("n_lines"), *rounded, "language", "profile")


def p10_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts of every text that SQL can take as well."""
    s = F.col("stats")
    measured = statistics(_table(spark, sf, "documents").select("doc_id", "text"), "text", common_words(_table(spark, sf, "common_words")))
    return measured.select("doc_id", *(s[c].alias(c) for c in ("n_chars", "n_words", "n_lines")), *(F.round(s[c], 6).alias(c) for c in ("mean_word_length", "punctuated_lines")))


QUERIES = {"p6_found": p6_found, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_promises": p9_promises, "p10_found": p10_found, "p10_stats": p10_stats, "p10_counts": p10_counts}

_WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SQL: dict[str, str] = {
    "p9_promises": "SELECT source, true AS within_a_document, true AS within_repeats, true AS whole_copies, true AS known_sizes FROM mix_targets WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE text <> '')",
    "p10_counts": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[{_WS}]+'), lambda w: regexp_matches(w, '[\p{{L}}\p{{N}}]')) AS words,
    list_filter(string_split_regex(t, '\r\n|[\n\r\x0b\x0c\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_matches(x, '[^{_WS}]')) AS lines FROM d)
SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, CAST(len(words) AS INTEGER) AS n_words, CAST(len(lines) AS INTEGER) AS n_lines,
  round(CASE WHEN len(words) > 0 THEN list_sum(list_transform(words, lambda w: length(w))) / len(words) ELSE 0.0 END, 6) AS mean_word_length,
  round(CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(rtrim(x, ' '), '[.!?;:]["'')»”]*$'))) / len(lines) ELSE 0.0 END, 6) AS punctuated_lines FROM p""",
}
