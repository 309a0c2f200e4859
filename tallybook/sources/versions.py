"""Replacing versions of the tables on plain parquet: staged first, checked, then written over the old partitions.

A table is one folder partitioned by version.  A load writes all its versions in one job into a staging folder, compares the
rows with what was expected, and only then overwrites the partitions it brings, in one dynamic partition overwrite a table;
Spark commits each of them when all its files are there.  A failed load leaves the tables as they were.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = "budget_version"


def replace_versions(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: dict[tuple[str, str], int] | None = None) -> dict[tuple[str, str], int]:
    """Write every version that the tables hold and switch to them.  Returns rows by (table, version); a count that differs
    from the expected one stops the load before any table is switched."""
    stage, counts, staged = f"{root}/staged/{uuid.uuid4().hex}", {}, {}
    for name, df in tables.items():
        rows = df.withColumn(KEY, F.col(KEY).cast("string"))
        rows.write.mode("errorifexists").parquet(f"{stage}/{name}")
        staged[name] = spark.read.schema(rows.schema).parquet(f"{stage}/{name}")
        counts |= {(name, r[KEY]): r["n"] for r in staged[name].groupBy(KEY).agg(F.count("*").alias("n")).collect()}  # one row per version
    for (name, version), want in (expected or {}).items():
        if counts.get((name, version), 0) != want:
            raise ValueError(f"{name}: wrote {counts.get((name, version), 0)} rows of {version}, expected {want}; the version was not switched")
    for name, df in staged.items():
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(KEY).parquet(f"{root}/data/{name}")
    return counts


def replace_version(spark: SparkSession, root: str, version: str, tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> dict[str, int]:
    """One version of tables that may hold more."""
    rows = {name: df.where(F.col(KEY) == version) for name, df in tables.items()}
    counts = replace_versions(spark, root, rows, {(name, version): n for name, n in (expected or {}).items()})
    return {name: counts.get((name, version), 0) for name in tables}


def read_version(spark: SparkSession, root: str, table: str, version: str | None = None) -> DataFrame:
    """A table over all versions, or one: a filter on the version prunes folders."""
    rows = spark.read.parquet(f"{root}/data/{table}")
    rows = rows.withColumn(KEY, F.col(KEY).cast("string"))
    return rows if version is None else rows.where(F.col(KEY) == version)


def replace_snapshot(spark: SparkSession, root: str, snapshot_date: str, parcels: DataFrame, meta_rows: int) -> int:
    """The full property snapshot, switched only when its row count is the one its metadata states."""
    rows = parcels.withColumn(KEY, F.lit(snapshot_date))
    return replace_version(spark, root, snapshot_date, {"parcels": rows}, {"parcels": meta_rows})["parcels"]
