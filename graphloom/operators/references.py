"""References written in several ways, resolved to the rows they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import squeezed


def commit_parents(commits: DataFrame) -> DataFrame:
    """(commit_id, parent_id): every commit with its parent in the table, null if it has none there.

    Case and white space are ignored.  A reference may be cut to a leading part
    of the id: for each length of reference that occurs (at most as many as an
    id has characters) the ids are cut to it and joined by equality.  The whole
    id goes before a leading part; a part that fits several ids names none.
    """
    own = F.lower(squeezed(F.col("commit_id")))
    rows = commits.select(own.alias("commit_id"), F.lower(squeezed(F.col("parent"))).alias("ref")).where("commit_id <> ''").distinct()
    ids, refs = rows.select("commit_id").distinct(), rows.where("ref <> ''").select("ref").distinct()
    whole = refs.join(ids.select(F.col("commit_id").alias("ref")), "ref", "left_semi").select("ref", F.col("ref").alias("parent_id"))
    lengths = [r[0] for r in refs.select(F.length("ref")).distinct().collect()]  # at most as many as an id has characters, or the longest reference
    longest = ids.agg(F.max(F.length("commit_id"))).first()[0] or 0
    lengths = sorted(x for x in lengths if x < longest)
    found = whole
    if lengths:
        cut = ids.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).where("length(commit_id) > n").select(F.expr("left(commit_id, n)").alias("ref"), "commit_id")
        part = refs.join(cut, "ref").groupBy("ref").agg(F.min("commit_id").alias("parent_id"), F.max("commit_id").alias("other")).where("parent_id = other").select("ref", "parent_id")
        found = whole.unionByName(part).groupBy("ref").agg(F.max_by("parent_id", F.col("parent_id") == F.col("ref")).alias("parent_id"))
    return rows.join(found, "ref", "left").groupBy("commit_id").agg(F.array_sort(F.collect_set("parent_id")).alias("p")).select("commit_id", F.explode_outer("p").alias("parent_id"))


def type_parents(node_types: DataFrame) -> DataFrame:
    """(name, parent): every declared type with its declared supertypes, null if it has none.

    All rows of one name count together.  A reference, white space ignored, is a
    name, else an iri, else a name without the prefix of the type's own
    vocabulary; others are ignored.
    """
    name = squeezed(F.col("name"))
    rows = node_types.withColumn("name", name).where("name <> ''")
    names = rows.select("name").distinct()
    keys = names.select(F.col("name").alias("key"), "name", F.lit(0).alias("rank")).unionByName(
        rows.select(squeezed(F.col("iri")).alias("key"), "name", F.lit(1).alias("rank")).where("key <> ''").distinct()
    )
    keys = keys.select("key", F.col("name").alias("parent"), "rank")
    refs = rows.select("name", F.explode("supertypes").alias("ref")).select("name", squeezed(F.col("ref")).alias("ref")).where("ref <> ''").distinct()
    prefix = F.regexp_extract("name", "^[^:]*:", 0)
    tried = refs.select("name", "ref", F.explode(F.array(F.struct(F.col("ref").alias("key"), F.lit(0).alias("local")), F.struct(F.concat(prefix, "ref").alias("key"), F.lit(1).alias("local")))).alias("t"))
    hits = tried.select("name", "ref", "t.*").join(keys, "key").where("local = 0 or rank = 0")
    best = hits.groupBy("name", "ref").agg(F.min(F.struct(F.col("local") * 2 + F.col("rank"), "parent")).alias("b")).select("name", F.col("b.parent").alias("parent")).distinct()
    return names.join(best, "name", "left")
