"""Joins Spark has no operator for: points in ranges, nearest neighbours, exact-match excuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallybook.operators.running import carry_last


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, low: str, high: str) -> DataFrame:
    """Points with the range [low, high] of the same keys that they lie in; a NULL high is open.  Ranges of one key do not
    overlap, so a point can only lie in the last range that starts at or before it: points and range starts are put in one
    order and each point takes the start carried down to it.  A range of any length stays one row."""
    kept = [c for c in ranges.columns if c not in keys]
    blank = lambda df, cols: F.lit(None).cast(df.select(F.struct(*cols).alias("s")).schema["s"].dataType)
    rest = [c for c in points.columns if c not in keys]
    starts = ranges.where(F.col(low).isNotNull()).select(*keys, F.col(low).cast("long").alias("_at"), F.lit(0).alias("_point"), F.struct(*kept).alias("_range"), blank(points, rest).alias("_row"))
    placed = points.where(F.col(point).isNotNull()).select(*keys, F.col(point).cast("long").alias("_at"), F.lit(1).alias("_point"), blank(ranges, kept).alias("_range"), F.struct(*rest).alias("_row"))
    both = starts.unionByName(placed).withColumn("_span", F.floor(F.col("_at") / 4096))
    found = carry_last(both, keys, ["_at", "_point"], F.col("_range"), "_in", ["_span"]).where("_point = 1 and _in is not null")
    inside = found.where(F.col(f"_in.{high}").isNull() | (F.col("_at") <= F.col(f"_in.{high}")))
    return inside.select(*keys, "_row.*", "_in.*")


def excused(findings: DataFrame, known_errors: DataFrame, keys: list[str]) -> DataFrame:
    """Findings no known error explains: every key, and both numbers, must be equal."""
    return findings.join(known_errors.select(*keys).distinct(), keys, "left_anti")


def allowlist_report(failing: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Failures not on the list ('new') and list entries that no longer fail ('stale')."""
    a, b = failing.select(*keys).distinct(), allowed.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("status", F.lit("new")).unionByName(
        b.join(a, keys, "left_anti").withColumn("status", F.lit("stale")))
