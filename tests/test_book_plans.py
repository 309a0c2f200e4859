"""How often the book's passes scan and write: plans and results, not the clock."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallybook.operators import chains, layout as L, running as R
from tallybook.plans import layout_plans as LP


def _book(spark, pages=2):
    head, x = ["DOLLARS", "UNITS"] * 3 + ["DOLLARS"], [214.0, 269.0, 311.0, 574.0, 616.0, 671.0, 713.0]
    out = []
    for page in range(pages):
        out += [("book", page, t, a, a + 35, 80.0) for t, a in zip(head, x)]
        out += [("book", page, t, 60.0 + 50 * i, 100.0 + 50 * i, 590.0) for i, t in enumerate("Fire Department 300.1 3rd Run 9/14/26".split())]
        out += [("book", page, "1", 20.0, 28.0, 107.0), ("book", page, "Clerk", 380.0, 398.0, 108.0), ("book", page, "1,2", 335.0, 345.0, 107.0),
                ("book", page, "00", 345.5, 355.0, 107.0), ("book", page, "12", 400.0, 410.0, 500.0)]
    return spark.createDataFrame(out, "doc string, page int, text string, x0 double, x1 double, top double")


def test_rows_are_read_from_a_page_without_writing_its_words(spark, monkeypatch):
    wrote, words = [], _book(spark)
    for module in (L, R):
        keep = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, keep=keep: wrote.append(df.columns) or keep(df))
    rows = L.page_rows(words, L.page_geometry(words)).orderBy("page").collect()
    assert [(r["page"], r["line_no"], r["description_raw"], float(r["adopted_2026"])) for r in rows] == [(0, 1, "Clerk", 1200.0), (1, 1, "Clerk", 1200.0)]
    assert not [c for c in wrote if "x0" in c]


def test_numbers_merge_alike_in_an_array_and_in_rows(spark):
    r = random.Random(5)
    words = []
    for page in range(40):
        x = 0.0
        for _ in range(r.randrange(1, 9)):
            text = r.choice(["1", "2,3", "(4", ")", "a", "b1", "-"])
            words.append((page, text, x, x + 5.0, 1.0))
            x += 5.0 + r.choice([0.5, 1.0, 1.5, 9.0])
    df = spark.createDataFrame(words, "page int, text string, x0 double, x1 double, top double")
    want = R.merge_split_numbers(df, ["page"]).select("page", "x0", "x1", "text")
    ws = df.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("x0", "x1", "text", "top"))).alias("w"))
    got = ws.select("page", F.explode(R.merged_numbers(F.col("w"))).alias("w")).select("page", "w.x0", "w.x1", "w.text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() < len(words)


def test_units_need_two_scans(spark, monkeypatch):
    scans, keep = [], R._before
    monkeypatch.setattr(R, "_before", lambda *a: scans.append(a) or keep(*a))
    df = spark.createDataFrame([("k", i, i // 2, i % 3 < 2, i % 3 == 2, 5 if i % 3 < 2 else 10) for i in range(9)], "k string, i long, part long, a boolean, c boolean, v long")
    got = chains.closing_rows(df, ["k"], ["i"], F.col("a"), F.col("c"), F.lit(False), [F.col("v")], "part")
    assert sorted(r["i"] for r in got.collect()) == [2, 5, 8] and len(scans) == 2


@pytest.mark.parametrize("backwards", [False, True])
def test_state_before_a_bucket(spark, backwards):
    values = [None, 3, None, 5, None]
    parts = spark.createDataFrame([("d", p, v) for p, v in enumerate(values)], "doc string, page int, v int")
    got = [r["out"] for r in R.before_buckets(parts, ["doc"], "page", "v", "out", backwards).orderBy("page").collect()]
    assert got == ([3, 5, 5, None, None] if backwards else [None, None, 3, 3, 5])


def test_explode_of_words_reads_a_column(spark):
    plan = LP.book_words(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(words#" in plan
