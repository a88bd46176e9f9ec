"""The journal of actor events as the other operators need it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import squeezed, stripped

END = (1 << 63) - 1


def token_number(token: Column) -> Column:
    """The number at the end of a token, null if it has none that fits 64 bits."""
    return F.regexp_extract(token, r"([0-9]+)$", 1).try_cast("bigint")


def deliveries(journal: DataFrame) -> DataFrame:
    """Rows of the journal that name an event: actor stripped, neither actor nor version null, actor not blank."""
    return journal.withColumn("actor", stripped(F.col("actor"))).where("actor is not null and actor <> '' and version is not null")


def events(journal: DataFrame) -> DataFrame:
    """One row (actor, version, source, number, arrived_at) per event, with its earliest arrival.

    The number is the token's, -1 without one: such an event stands before all
    others of its version.  Deliveries are combined before the shuffle, so an
    event delivered very often costs one row per task.
    """
    return (
        deliveries(journal)
        .groupBy("actor", "version")
        .agg(F.max("source").alias("source"), F.coalesce(F.max(token_number(F.col("token"))), F.lit(-1)).cast("bigint").alias("number"), F.min("arrived_at").alias("arrived_at"))
    )


def plain_kind(kind: Column) -> Column:
    """A kind without case, white space and separators."""
    return F.lower(squeezed(kind, "_-.:/"))
