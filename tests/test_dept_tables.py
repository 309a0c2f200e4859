from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.operators import dept_tables as D

SCHEMA = "doc string, page int, text string, x0 double, x1 double, top double, bottom double"


def words(spark, *lines, page=40):
    """lines: (top, [(x0, text), ...]); a word is five points a letter."""
    rows = [("summary", page, t, float(x), x + 5.0 * len(t), float(top), top + 8.0) for top, ws in lines for x, t in ws]
    return spark.createDataFrame(rows, SCHEMA)


def test_budget_summary(spark):
    w = words(
        spark, (100, [(200, "Actual"), (260, "Adopted"), (320, "Requested"), (380, "Proposed"), (440, "Versus")]),
        (110, [(200, "Budget"), (440, "Adopted"), (500, "Requested")]), (125, [(40, "PERSONNEL")]),
        (140, [(40, "Total"), (70, "Positions"), (120, "Authorized"), (205, "10"), (270, "11"), (340, "12"), (395, "12"), (455, "1"), (520, "0")]),
        (160, [(40, "EXPENDITURES")]),
        (180, [(40, "Salaries"), (85, "and"), (105, "Wages"), (200, "$1,000"), (262, "2,000"), (330, "3,000"), (385, "2,500"), (445, "500"), (510, "-500")]),
        (200, [(40, "Charges"), (80, "Deferred")]), (204, [(205, "[50]"), (270, "60"), (340, "70"), (395, "80")]), (208, [(40, "Compensation")]),
        (230, [(40, "Total"), (200, "1,050"), (262, "2,060"), (330, "3,070"), (385, "2,580"), (445, "520"), (510, "-490")]))
    got = {r["metric"]: r for r in D.budget_summary(D.page_lines(w), spark.createDataFrame([(40, "fire")], "page int, dept string")).collect()}
    assert set(got) == {"positions", "salaries", "charges_deferred_compensation", "total_expenditures"}
    assert (got["positions"]["group"], int(got["positions"]["proposed_2027"])) == ("personnel", 12)
    assert [int(got["salaries"][k]) for k in ("actual_2025", "proposed_2027", "change_vs_adopted", "change_vs_requested")] == [1000, 2500, 500, -500]
    wrapped = got["charges_deferred_compensation"]
    assert wrapped["label_wrapped"] and wrapped["flags"] == ["printed_bracketed:actual_2025"] and int(wrapped["actual_2025"]) == 50


def test_section_totals(spark):
    head = [(300, "2026"), (360, "2027"), (420, "CHANGE"), (480, "2026"), (530, "2027"), (580, "CHANGE")]
    w = words(spark, (50, head), (80, [(40, "A."), (60, "General"), (100, "Purposes")]),
              (95, [(50, "1."), (65, "Budget"), (290, "1,000"), (350, "1,100"), (430, "100")]), (110, [(50, "2."), (65, "Other")]),
              (116, [(290, "400"), (350, "300"), (430, "-100")]),
              (130, [(50, "3."), (65, "Levy"), (290, "600"), (350, "800"), (430, "200"), (480, "3.33"), (530, "3.05"), (580, "-0.28")]))
    rows = D.section_totals(D.page_lines(w)).collect()
    got = {r["line"]: r for r in rows}
    assert {r["section"] for r in rows} == {"A"} and got["budget"]["proposed_2027"] == 1100
    assert (got["non_levy"]["adopted_2026"], float(got["levy"]["tax_rate_2027"])) == (400, 3.05)


def test_section_comparisons(spark):
    w = words(spark, (50, [(250, "Budget"), (300, "Budget"), (350, "Budget"), (400, "Adopted"), (445, "v"), (470, "Asked"), (505, "v")]),
              (80, [(40, "A."), (60, "General")]), (95, [(50, "Appropriations")]), (110, [(60, "Salaries"), (255, "10"), (305, "20"), (355, "30"), (410, "20"), (480, "10")]),
              (125, [(50, "Funding")]), (140, [(60, "Levy"), (255, "1"), (305, "2"), (355, "3"), (410, "2"), (480, "1")]))
    rows = D.section_comparisons(D.page_lines(w)).orderBy("proposed_2027").collect()
    assert [(r["section"], r["group_path"], r["line"], r["proposed_2027"]) for r in rows] == [
        ("A", ["Funding"], "Levy", 3), ("A", ["Appropriations"], "Salaries", 30)]


def test_department_list(spark):
    row = lambda label, vals: [(60, label)] + [(300 + 60 * i - 5 * len(v), v) for i, v in enumerate(vals)]
    w = words(spark, (90, [(40, "Public"), (75, "Works")]), (105, row("Infrastructure", ["10", "11", "12", "2", "1"])),
              (120, row("Division", ["(10)", "(11)", "(12)", "(2)", "(1)"])), (135, row("Library*", ["5", "5", "5"])))
    rows = D.department_list(D.page_lines(w)).orderBy("label").collect()
    assert [(r["label"], r["is_division_subtotal"], int(r["proposed_2027"]), r["group"]) for r in rows] == [
        ("Division", True, 12, "Public Works"), ("Infrastructure", False, 12, "Public Works"), ("Library", False, 5, "Public Works")]
    assert [r["footnote_star"] for r in rows] == [False, False, True]


def cells(spark, *tables):
    rows = [("summary", page, n, i, r) for n, (page, t) in enumerate(tables) for i, r in enumerate(t)]
    return spark.createDataFrame(rows, "doc string, page int, table_no int, row_no int, cells array<string>")


def test_bordered_tables(spark):
    c = cells(
        spark, (1, [["Description of Services Provided", "Operating", "FTEs"], ["Provide leadership", "$1,234", "5.50"], ["Total", "1,234", "-"]]),
        (1, [["Key Performance Measures", "2024 Actual", "2025"], ["Calls • Fire • EMS", "1 2", "3 4"], ["Odd • A • B", "1", "2 3"]]),
        (2, [["Positions", "O&M", "Other", "Position Title", "Reason"], ["", "", "", "Transportation", ""], ["1", "1.00", "-", "Clerk", "New position"],
             ["-1", "", "", "", ""]]),
        (3, [["2", "2.00", "", "Engineer", "Moved to Library"], ["2", "3.00", "", "Totals", ""]]), (4, [["What", "is", "this"]]))
    kinds = D.table_kinds(c)
    assert [r["kind"] for r in kinds.orderBy("table_no").collect()] == ["services", "kpis", "position_changes", "position_changes", "unknown"]
    s = D.services(c, kinds).orderBy("row_no").collect()
    assert (s[0]["operating"], s[0]["capital"], float(s[0]["ftes"]), s[1]["is_total"], s[1]["ftes"]) == (1234, None, 5.5, True, None)
    k = D.kpis(c, kinds).collect()
    assert sorted((r["measure"], tuple(r["values"]), tuple(r["flags"])) for r in k) == [
        ("EMS", ("2", "4"), ()), ("Fire", ("1", "3"), ()), ("Odd • A • B", ("1", "2 3"), ("bulleted_values_not_split",))]
    p = D.position_changes(c, kinds).orderBy("page", "row_no").collect()
    assert [(r["title"], r["section"], r["merged_with_previous"], r["reason_category"]) for r in p] == [
        ("Clerk", "Transportation", False, "new_funded"), ("Clerk", "Transportation", True, "new_funded"),
        ("Engineer", "Transportation", False, "transfer"), ("Totals", None, False, None)]


def test_capital_items(spark):
    lines = [(1, "CAPITAL PROJECTS"), (1, "The 2027 Capital Budget includes $4,115,000 for:"), (1, "• Police Vehicles ($2.0 million) – The program"),
             (1, "replaces cars in N."), (2, "35th Street."), (2, "• Terminal ($1,300,000 million): repairs."), (2, "BUDGET SUMMARY"), (2, "• not an item ($1)")]
    df = spark.createDataFrame([("d", p, i, t) for i, (p, t) in enumerate(lines)], "doc string, page int, line int, text string")
    got = {r["name"]: r for r in D.capital_items(df, ["doc"]).collect()}
    assert got["Police Vehicles"]["amount"] == 2_000_000 and got["Police Vehicles"]["pdf_pages"] == [1, 2]
    assert got["Terminal"]["amount"] is None and got["Terminal"]["amount_text"] == "($1,300,000 million)"
    assert sorted(r["kind"] for r in got.values()) == ["list_heading", "project", "project"]


def test_capital_names(each):
    assert each(["$150,000 for general IT upgrades", "Pump Facilities: The fund pays.", "Compliance Loan Program (CLP) - The program", "Costs rise."],
                D.capital_name) == ["General IT upgrades", "Pump Facilities", "Compliance Loan Program (CLP)", None]
    assert F is not None


def test_department_list_collects_nothing_for_a_broadcast(spark):
    from pyspark.sql import functions as F

    words = spark.range(40).select(F.lit("b").alias("doc"), (F.col("id") % 2).cast("int").alias("page"), F.lit("1").alias("text"),
                                   F.lit(60.0).alias("x0"), F.lit(70.0).alias("x1"), (F.col("id") * 10.0).alias("top"))
    plan = D.department_list(D.page_lines(words))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bordered_tables_collect_nothing_for_a_broadcast(spark):
    cells = spark.createDataFrame([("d", 1, 1, 0, ["Description of Services Provided", "Operating"]), ("d", 1, 1, 1, ["Mowing", "5"])],
                                  "doc string, page int, table_no int, row_no int, cells array<string>")
    from tallybook.session import materialize

    cells = materialize(cells)
    kinds = D.table_kinds(cells)
    for read in (D.services, D.kpis, D.position_changes):
        assert "Broadcast" not in read(cells, kinds)._jdf.queryExecution().executedPlan().toString().replace("AdaptiveSpark", "")
    assert [r.description for r in D.services(cells, kinds).collect()] == ["Mowing"]


def test_borderless_rows_meet_their_neighbours_by_windows(spark):
    """Rows, reasons, titles and headings of a page are brought together without joining the page with itself."""
    lines = spark.createDataFrame([("d", 1, 1, 10.0, [(1.0, 2.0, "a")], "a")], "doc string, page long, line int, top double, ws array<struct<x0:double,x1:double,text:string>>, text string")
    plan = D.borderless_position_changes(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 5
