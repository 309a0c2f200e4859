"""Content-addressed results: vectors and judgments keyed by a hash of what they were made from, not by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallybook.functions.text import fingerprint


def keyed_texts(passages: DataFrame, concepts: DataFrame | None, model: str, input_type: str = "document") -> DataFrame:
    """Every text to be embedded with its table, row id and hash."""
    parts = passages.select(F.lit("passages").alias("table"), F.col("id").cast("string").alias("id"),
                            F.concat("context_header", F.lit("\n\n"), "text").alias("text"))
    if concepts is not None:
        label = F.when(F.col("gloss").isNotNull(), F.concat("label", F.lit(" — "), "gloss")).otherwise(F.col("label"))
        parts = parts.unionByName(concepts.select(F.lit("concepts").alias("table"), F.col("id").cast("string").alias("id"),
                                                  label.alias("text")))
    return parts.withColumn("hash", fingerprint(F.lit(model), F.lit(input_type), F.col("text")))


def cache_misses(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct texts whose hash is not cached.  Only hashes shuffle for the comparison; a text travels once."""
    return items.join(cache.select("hash"), "hash", "left_anti").groupBy("hash").agg(F.min("text").alias("text"))


def refill(items: DataFrame, cache: DataFrame, value: str = "embedding") -> DataFrame:
    """Rows with their cached value; NULL where the cache has none."""
    return items.drop("text").join(cache.select("hash", value), "hash", "left")


def cache_report(items: DataFrame, cache: DataFrame) -> DataFrame:
    distinct = items.select("hash").distinct()
    known = distinct.join(cache.select("hash").distinct().withColumn("_hit", F.lit(True)), "hash", "left")
    return known.agg(F.count("*").alias("texts"), F.count("_hit").alias("hits"),
                     (F.count("*") - F.count("_hit")).alias("misses"))
