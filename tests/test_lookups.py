from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallybook.operators import checks as C, lookups as L


def test_articles_keep_the_order_of_the_claim(spark):
    claims = spark.createDataFrame([("c", [("b", "q1"), ("a", "q2"), ("b", "q3")])], "id string, sources array<struct<article: string, quote: string>>")
    articles = spark.createDataFrame([("a", "2026-01-02", "Post"), ("b", "2026-01-01", "News")], "article string, date string, outlet string")
    got = L.claim_articles(claims, articles).first()["articles"]
    assert [(x["article"], x["outlet"], x["quote"]) for x in got] == [("b", "News", "q1"), ("a", "Post", "q2"), ("b", "News", "q3")]


def test_each_version_has_its_own_total(spark):
    rows = spark.createDataFrame([("P", "A", 1), ("P", "B", 2), ("F", "A", 5)], "budget_version string, section string, v long")
    got = sorted(tuple(r) for r in L.with_grand_total(rows, "section", ["v"]).collect())
    assert got == [("F", "A", 5, False), ("F", "Total", 5, True), ("P", "A", 1, False), ("P", "B", 2, False), ("P", "Total", 3, True)]


def test_a_figure_missing_in_one_version_stops_the_job(spark):
    cols = "budget_version string, {} string, adopted_2026 long, proposed_2027 long, cite string"
    depts = spark.createDataFrame([("P", "a", 1, 2, "c"), ("F", "a", 3, 4, "c"), ("F", "b", 5, 6, "c")], cols.format("slug"))
    none = depts.limit(0)
    heads = none.select("budget_version", *[F.lit(0).alias(c) for c in ("levy_cite", "levy_adopted_2026", "levy_proposed_2027", "rate_2026", "rate_2027")])
    heads = heads.withColumn("levy_cite", F.lit("c"))
    fees = none.select("budget_version", F.col("slug").alias("fee"), F.col("adopted_2026").alias("value_2026"), F.col("proposed_2027").alias("value_2027"), "cite")
    projects = none.select("budget_version", F.col("slug").alias("name"), F.col("adopted_2026").alias("amount"), "cite")

    def figures(*topics):
        asked = spark.createDataFrame([(v, "t", 1, k, "department", k) for v, k in topics], "budget_version string, topic string, ordinal int, label string, source string, key string")
        out = L.topic_figures(asked, heads, none.withColumnRenamed("slug", "section"), depts, fees, projects)
        return sorted((r["budget_version"], r["key"], int(r["proposed_2027"])) for r in out.collect())

    assert figures(("P", "a"), ("F", "a"), ("F", "b")) == [("F", "a", 4), ("F", "b", 6), ("P", "a", 2)]
    with pytest.raises(Exception, match="a topic figure"):
        figures(("P", "a"), ("P", "b"), ("F", "b"))


def test_fee_revenue_is_that_of_the_same_version_and_fund(spark):
    fees = spark.createDataFrame([("P", "waste", 10), ("F", "waste", 12), ("F", "snow", 7)], "budget_version string, fee string, revenue_2027 long")
    names = spark.createDataFrame([("waste", "Waste Fee"), ("snow", "Snow Fee")], "fee string, line string")
    printed = [("P", "summary", "general", "Waste Fee", 10, 1), ("F", "summary", "general", "Waste Fee", 13, 1), ("F", "summary", "debt", "Snow Fee", 7, 1),
               ("F", "detailed", "general", "Waste Fee", 12, 2)]
    revenues = spark.createDataFrame(printed, "budget_version string, source string, fund string, line string, proposed_2027 long, at int").withColumn(
        "cite", F.struct(F.lit("summary").alias("doc"), F.col("at").alias("pdf_page"), F.lit("1").alias("printed_page"), F.col("at").alias("line_no")))
    got = sorted(tuple(r) for r in C.fee_revenue_gaps(fees, revenues, names).collect())
    assert got == [("F", "snow", None, 7), ("F", "waste", 13, 12)]
