from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallybook.operators import layout as L, running as R
from tallybook.operators.chains import closing_rows
from tallybook.session import materialize


def test_lines_follow_their_first_word(spark):
    words = spark.createDataFrame([("d", 1, t, float(x), x + 5.0, float(y)) for t, x, y in
                                   (("a", 0, 0), ("b", 10, 2), ("c", 20, 4), ("d", 30, 8))],
                                  "doc string, page int, text string, x0 double, x1 double, top double")
    got = R.line_text(R.visual_lines(words, tol=3.0)).orderBy("line").collect()
    assert [r["text"] for r in got] == ["a b", "c", "d"]


def test_two_levels_equal_one(spark):
    rows = [(k, p, i, (i * 7 + p) % 5 == 0) for k in "ab" for p in range(4) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, p int, i int, f boolean")
    value = F.when(F.col("f"), F.col("p") * 100 + F.col("i"))
    for inclusive in (True, False):
        one = R.carry_last(df, ["k"], ["p", "i"], value, "v", None, inclusive)
        two = R.carry_last(df, ["k"], ["p", "i"], value, "v", ["p"], inclusive)
        assert one.exceptAll(two.select(one.columns)).count() == 0
        one = R.running_count(df, ["k"], ["p", "i"], F.col("f"), "n", None, inclusive)
        two = R.running_count(df, ["k"], ["p", "i"], F.col("f"), "n", ["p"], inclusive)
        assert one.exceptAll(two.select(one.columns)).count() == 0


def _closed(spark, rows, part=4):
    df = spark.createDataFrame([("k", i, i // part, a, c, e, v) for i, a, c, e, v in rows], "k string, i long, part long, a boolean, c boolean, e boolean, v long")
    got = closing_rows(df, ["k"], ["i"], F.col("a"), F.col("c"), F.col("e"), [F.col("v")], "part")
    return sorted(r["i"] for r in got.collect())


def test_units_close_by_sum_or_by_name(spark):
    #            i  anchor candidate explicit values
    rows = [(1, True, False, False, 10), (2, True, False, False, 5), (3, False, True, False, 14),
            (4, False, True, False, 15), (5, True, False, False, 7), (6, False, True, True, 99)]
    assert _closed(spark, rows) == [4, 6]
    assert _closed(spark, [(30_000_000 * 1_000_000 + i, *x) for i, *x in rows]) == [30_000_000 * 1_000_000 + i for i in (4, 6)]


def test_units_close_as_a_loop_says(spark):
    r, rows, want, total = random.Random(3), [], [], 0
    for i in range(1500):
        if r.random() < 0.5:
            v = r.choice([0, 1, 2, 3, -2])
            rows.append((i, True, False, False, v))
            total += v
        else:
            explicit, v = r.random() < 0.01, total if r.random() < 0.3 else r.choice([0, 1, 2, 5, 6, 7])
            rows.append((i, False, True, explicit, v))
            if explicit or (v == total and total != 0):
                want.append(i)
                total = 0
    assert len(want) > 100 and _closed(spark, rows, 50) == want


def _page(page, lines, dept="Fire Department", number="300.1"):
    head = ["DOLLARS", "UNITS", "DOLLARS", "UNITS", "DOLLARS", "UNITS", "DOLLARS"]
    x = [214.0, 269.0, 311.0, 574.0, 616.0, 671.0, 713.0]
    out = [("book", page, t, a, a + 35, 80.0) for t, a in zip(head, x)]
    out += [("book", page, t, a, a + 20, 85.0) for t, a in (("FUND", 50.0), ("ORG", 82.0), ("SBCL", 114.0), ("ACCOUNT", 148.0), ("RANGE", 540.0))]
    out += [("book", page, t, 60.0 + 50 * i, 100.0 + 50 * i, 590.0) for i, t in enumerate(f"{dept} {number} 3rd Run 9/14/26".split())]
    for n, (account, text, pay, values) in enumerate(lines, 1):
        y = 90 + 17.0 * n
        out.append(("book", page, str(n), 20.0, 28.0, y))
        if account:
            out.append(("book", page, account, 148.0, 175.0, y))
        out += [("book", page, t, 380.0 + 20 * i, 398.0 + 20 * i, y + 1) for i, t in enumerate(text.split())]
        if pay:
            out.append(("book", page, pay, 545.0, 560.0, y))
        for column, value in values.items():
            right = x[column] + (30 if column in (1, 3, 5) else 44)
            out.append(("book", page, value, right - 5.0 * len(value), right, y))
    return out


def test_a_department_page(spark):
    lines = [
        (None, "FIRE SUPPRESSION UNIT", None, {}), (None, "SALARIES & WAGES", None, {}),
        (None, "Fire Captain (A)", "1UX", {1: "2", 2: "150,644", 5: "2", 6: "160,000"}),
        (None, "Overtime Compensated*", None, {2: "1,000", 6: "(2,000)"}),
        (None, "(A) Private Auto Allowance may be paid", None, {}),
        ("006000", "NET SALARIES & WAGES TOTAL", None, {2: "151,644", 6: "158,000"}),
        (None, "OPERATING EXPENDITURES", None, {}), ("630500", "General Office Expense", None, {2: "500", 6: "600"}),
        ("006300", "OPERATING EXPENDITURES TOTAL", None, {2: "500", 6: "600"}),
        (None, "TOTAL BUDGET FOR PROVISION FOR", None, {}), (None, "FIRE SUPPRESSION", None, {2: "152,144", 6: "158,600"})]
    words = spark.createDataFrame(_page(7, lines), "doc string, page int, text string, x0 double, x1 double, top double")
    rows = L.detailed_book(words).orderBy("line_no").collect()
    assert [r["row_type"] for r in rows] == ["heading", "heading", "position", "adjustment", "note", "rollup", "heading", "account",
                                             "rollup", "heading", "rollup"]
    captain, overtime, total = rows[2], rows[3], rows[10]
    assert (captain["pay_range"], captain["description"], captain["footnote_codes"]) == ("1UX", "Fire Captain", ["A"])
    assert (captain["adopted_2026"], float(captain["adopted_2026_units"]), captain["actual_2025"]) == (150644, 2.0, None)
    assert (overtime["proposed_2027"], overtime["footnote_flag"], overtime["category"]) == (-2000, True, "salaries")
    assert overtime["note"].startswith("(A) Private")
    assert total["description"] == "TOTAL BUDGET FOR PROVISION FOR FIRE SUPPRESSION" and total["is_unit_total"]
    assert total["flags"] == ["label_joined_from_line_10"] and total["category"] == "equipment"
    assert captain["hierarchy_path"] == ["Fire Department", "FIRE SUPPRESSION UNIT"]
    assert captain["cite"]["printed_page"] == "300.1" and captain["cite"]["line_no"] == 3


def test_category_and_notes_cross_pages(spark):
    one = [(None, "SALARIES & WAGES", None, {}), (None, "Fire Captain", "1UX", {2: "10"})]
    two = [(None, "continued note text about pay", None, {}), (None, "Clerk", "2BN", {2: "5"})]
    words = spark.createDataFrame(_page(7, one) + _page(8, two, number="300.2"),
                                  "doc string, page int, text string, x0 double, x1 double, top double")
    rows = materialize(L.typed_rows(materialize(L.page_rows(words, L.page_geometry(words))))).orderBy("page", "line_no").collect()
    assert rows[1]["note"] == "continued note text about pay"
    assert (rows[3]["row_type"], rows[3]["category"]) == ("position", "salaries")


def test_report_counts_orphans_and_skipped_pages(spark):
    page = _page(7, [(None, "A LINE", None, {2: "5"})]) + [("book", 7, "stray", 400.0, 420.0, 500.0), ("book", 8, "cover", 10.0, 20.0, 300.0)]
    words = spark.createDataFrame(page, "doc string, page int, text string, x0 double, x1 double, top double")
    got = {r["page"]: (r["skipped"], r["orphans"]) for r in L.extraction_report(words, L.page_geometry(words)).collect()}
    assert got == {7: (False, 1), 8: (True, 0)}


def test_note_before_a_row_over_pages(spark):
    from pyspark.sql import functions as F
    from tallybook.operators.running import following

    rows = spark.createDataFrame([("d", 1, 1, None), ("d", 1, 2, "a"), ("d", 1, 3, None), ("d", 4, 1, "b"), ("d", 4, 2, None), ("e", 5, 1, "c")],
                                 "doc string, page long, line_no int, note string")
    got = following(rows, ["doc"], ["page", "line_no"], F.col("note"), "after", ["page"]).orderBy("doc", "page", "line_no").collect()
    assert [r.after for r in got] == ["a", None, "b", None, None, None]


def test_report_reads_words_once(spark):
    page = _page(7, [(None, "A LINE", None, {2: "5"})]) + [("book", 7, "stray", 400.0, 420.0, 500.0), ("book", 7, "12", 400.0, 420.0, 520.0), ("book", 7, "3", 10.0, 15.0, 540.0),
                                                           ("book", 8, "cover", 10.0, 20.0, 300.0)]
    words = spark.createDataFrame(page, "doc string, page int, text string, x0 double, x1 double, top double").repartition(3, "page")
    alone = L.extraction_report(words)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan  # words dealt by page are grouped where they are
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, L.extraction_report(words, L.page_geometry(words)).collect())) == [("book", 7, False, False, 2), ("book", 8, True, False, 0)]


def test_book_words_are_written_in_no_file(spark):
    from tallybook.plans import layout_plans as LP

    files = lambda df: {f for f in df.inputFiles() if "/stage-" in f}
    assert not files(LP.extraction_report(spark, "/root/testdata/sf0.001")) and not files(LP.page_geometry(spark, "/root/testdata/sf0.001"))
