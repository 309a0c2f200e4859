"""What written steps leave on disk."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tallybook.operators import passages as P
from tallybook.session import materialize


def test_a_written_step_drops_its_shuffle_files(spark, monkeypatch):
    key, held = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []
    keep = type(spark.range(1).write).parquet
    monkeypatch.setattr(type(spark.range(1).write), "parquet", lambda self, *a, **b: held.append(spark.conf.get(key)) or keep(self, *a, **b))
    rows = materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert rows.count() == 7 and held == ["true"] and spark.conf.get(key, "false") == "false"


def test_passages_leave_no_table_that_is_not_read(spark, monkeypatch):
    wrote, keep = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df: wrote.append(keep(df)) or wrote[-1])
    pages = spark.createDataFrame([("b", 11 + i, "FIRE\nOne sentence of eight words stands on this page here.\nAnd another one follows it at once as well.") for i in range(3)],
                                  "doc string, page int, text string")
    depts = spark.createDataFrame([("b", 11 + i, "fire", "Fire") for i in range(3)], "doc string, page int, dept string, dept_name string")
    out = P.narrative_passages(pages, depts, ["doc"])
    path = lambda f: f.removeprefix("file:").replace("///", "/")
    lines = [df for df in wrote if "_row" in df.columns or ("_title" in df.columns and "region" not in df.columns)]
    assert out.count() >= 1 and len(lines) >= 3
    assert not [f for df in lines for f in df.inputFiles() if os.path.exists(path(f))]
