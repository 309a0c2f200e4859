"""Reading and writing the tables: declared schemas in, exact casts out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallybook import fixed_values as V
from tallybook.functions.numbers import blank_to_null
from tallybook.schema import TABLES


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(path)


def read_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """JSON lines: passages and the hand-kept tables.  A line that does not parse stops the job."""
    return spark.read.schema(TABLES[name]).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document per file (an object or an array of rows)."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_property_csv(spark: SparkSession, path: str, snapshot_date: str) -> DataFrame:
    """The property file as text, then only the columns kept.  Owner and mailing columns never leave the scan: column
    pruning keeps them out of every later stage."""
    header = spark.read.option("header", True).csv(path).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", False).option("nullValue", "\u0000").csv(path)
    return property_rows(raw, snapshot_date)


def property_rows(raw: DataFrame, snapshot_date: str) -> DataFrame:
    """Trimmed, blanks to NULL, whole numbers cast strictly: junk stops the job (ANSI casts)."""
    kept = raw.select(*[blank_to_null(F.col(c)).alias(c.lower()) for c in V.PARCEL_KEEP])
    casts = {c.lower(): F.col(c.lower()).cast("long" if "_A_" in c else "int") for c in V.PARCEL_INTS}
    casts["lot_area"] = F.col("lot_area").cast("decimal(14,2)")
    out = kept.withColumns(casts).withColumn("snapshot_date", F.lit(snapshot_date).cast("date"))
    return out.select(*[f.name for f in TABLES["parcels"]])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the declared schema; columns a source does not have are NULL.  Money stays a nullable long."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in TABLES[name]])


def write_table(df: DataFrame, path: str, name: str, partition_by: list[str] | None = None) -> None:
    writer = conform(df, name).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def with_parents(departments: DataFrame) -> DataFrame:
    """Departments with their parent's row beside them.  Keys are slugs, so nothing needs a generated number."""
    parents = departments.select("budget_version", F.col("slug").alias("parent"), F.col("name").alias("parent_name"))
    return departments.join(parents, ["budget_version", "parent"], "left")


def with_line_keys(positions: DataFrame, line_items: DataFrame, keys: list[str]) -> DataFrame:
    """Position lines with the key of the line they were printed on; the last such line when several share a place."""
    lines = line_items.groupBy(*keys).agg(F.max("line_item_id").alias("line_item_id"))
    return positions.join(lines, keys, "left")


def load_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table, in one job."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def snapshot_years(parcels: DataFrame) -> DataFrame:
    return parcels.groupBy("snapshot_date", "yr_assmt").agg(F.count("*").alias("rows"))
