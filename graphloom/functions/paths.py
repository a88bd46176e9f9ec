"""Supervision paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    """Segments between slashes; one empty segment at the start is dropped."""
    return F.when(path == "/", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(path, "^/", ""), "/"))


def render(parts: Column) -> Column:
    """/a/b of segments; / of none."""
    return F.concat(F.lit("/"), F.concat_ws("/", parts))


def parent(parts: Column) -> Column:
    """The segments without the last; null if there is none."""
    return F.when(F.size(parts) > 0, F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))


def prefixes(parts: Column) -> Column:
    """array<struct<path, parent, segment, depth>>: the path and all above it, from the root."""
    up = lambda n: render(F.slice(parts, 1, n))
    one = lambda n: F.struct(up(n).alias("path"), F.when(n > 1, up(n - 1)).alias("parent"), F.get(parts, n - 1).alias("segment"), (n - 1).cast("bigint").alias("depth"))
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), one)).otherwise(F.array().cast("array<struct<path:string,parent:string,segment:string,depth:bigint>>"))


def segment_type(segment: Column) -> Column:
    """The node type that a segment stands for."""
    return F.when(segment == "workflow", "Workflow").when(segment == "run", "Run").when(segment == "step", "Step").otherwise("ActorPathSegment")


def workflow_run(parts: Column) -> Column:
    """struct<workflow, run>: the segments after the last ``workflow`` and ``run``; null without workflow.

    A segment taken as a value is not read as a keyword.  A keyword at the end
    takes its value away.  Without run: <no-run>.
    """
    nothing = F.lit(None).cast("string")
    start = F.struct(nothing.alias("workflow"), nothing.alias("run"), F.lit("").alias("waits"))

    def step(s: Column, x: Column) -> Column:
        on_value = F.struct(F.when(s["waits"] == "workflow", x).otherwise(s["workflow"]).alias("workflow"), F.when(s["waits"] == "run", x).otherwise(s["run"]).alias("run"), F.lit("").alias("waits"))
        on_key = F.struct(F.when(x == "workflow", nothing).otherwise(s["workflow"]).alias("workflow"), F.when(x == "run", nothing).otherwise(s["run"]).alias("run"), F.when(x.isin("workflow", "run"), x).otherwise("").alias("waits"))
        return F.when(s["waits"] != "", on_value).otherwise(on_key)

    found = F.aggregate(parts, start, step)
    return F.transform(F.array(found), lambda f: F.when(f["workflow"].isNotNull(), F.struct(f["workflow"].alias("workflow"), F.coalesce(f["run"], F.lit("<no-run>")).alias("run"))))[0]
