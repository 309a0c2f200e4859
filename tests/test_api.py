from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallybook.api import Budget
from tallybook.plans.charge_plans import FEES, RATES
from tallybook.schema import TABLES
from tallybook.sources.tables import conform

CITE = ("summary", 17, "7", None)


@pytest.fixture(scope="module")
def budget(spark):
    def make(name, rows, ddl):
        df = spark.createDataFrame([(*r, CITE) for r in rows], ddl + ", cite struct<doc:string,pdf_page:int,printed_page:string,line_no:int>")
        return conform(df.withColumn("budget_version", F.lit("v")), name)

    totals = [("A", "General", "budget", 820, 846, None, None), ("TOTAL", "All", "budget", 2200, 2261, None, None)]
    totals += [(s, s, "levy", 100, 110, a, b) for s, (a, b) in RATES.items()]
    dept = [("fire", "total_expenditures", 160.0, 165.0, 175.0, 172.0, 7.0, -3.0), ("fire", "positions", 5.0, 6.0, 7.0, 7.0, 1.0, 0.0),
            ("police", "total_expenditures", 300.0, 320.0, 330.0, 310.0, -10.0, -20.0)]
    tables = {
        "section_totals": make("section_totals", totals, "section string, label string, line string, adopted_2026 long, proposed_2027 long, "
                               "tax_rate_2026 string, tax_rate_2027 string"),
        "departments": conform(spark.createDataFrame([("v", "fire", "Fire Department", "A", ["300"]), ("v", "police", "Police Department", "A", ["310"])],
                                                     "budget_version string, slug string, name string, section string, detailed array<string>"), "departments"),
        "dept_summary": make("dept_summary", dept, "dept string, metric string, actual_2025 double, adopted_2026 double, requested_2027 double, "
                             "proposed_2027 double, change_vs_adopted double, change_vs_requested double"),
        "fees": make("fees", [(k, *v) for k, v in FEES.items()], "fee string, value_2026 string, value_2027 string"),
        "line_items": make("line_items", [("300", "Overtime", 10, 12, False, False), ("310", "Overtime pay", 20, None, False, False),
                                          ("300", "Overtime total", 10, 12, True, False)],
                           "section string, description string, adopted_2026 long, proposed_2027 long, is_subtotal boolean, is_position boolean"),
        "budget_facts": make("budget_facts", [("f1", "act_12", "Act 12 sets police recruit classes.", "a person"), ("f2", "police", "Unreviewed police fact.", None)],
                             "id string, topic string, statement string, reviewed_by string"),
        "glossary": make("glossary", [("Tax levy", "What the property tax raises.", ["levy"])], "term string, plain_definition string, aliases array<string>"),
        "kpis": make("kpis", [("fire", "Response", ["2025", "2026"], ["4", "5"])], "dept string, measure string, col_labels array<string>, values array<string>"),
        "position_changes": make("position_changes", [("fire", 1.0, "Clerk", "New", False), ("fire", 1.0, "Total", None, True)],
                                 "dept string, positions double, title string, reason string, is_total boolean"),
        "capital_projects": make("capital_projects", [("fire", "Engine", 5, "$5", "project"), (None, "Typo", None, "$1,300,000 million", "project"),
                                                      ("fire", "All:", 9, "$9", "list_heading")],
                                 "dept string, name string, amount long, amount_text string, kind string"),
        "events": spark.createDataFrame([("Hearing", "2026-10-05T18:00:00-05:00")], "title string, start string"),
    }
    assert all(set(df.columns) == {f.name for f in TABLES[n]} for n, df in tables.items() if n in TABLES)
    return Budget(tables, "v")


def test_overview_and_departments(budget):
    row = budget.overview().first()
    assert (row["all_funds_proposed_2027"], row["gcp_proposed_2027"], float(row["rate_2027"])) == (2261, 846, 7.29)
    assert [r["slug"] for r in budget.departments().collect()] == ["police", "fire"]
    assert [(r["slug"], r["direction"]) for r in budget.departments(view="changes").collect()] == [("fire", "up"), ("police", "down")]
    assert [r["metric"] for r in budget.department_breakdown("fire").collect()] == ["total_expenditures", "positions"]


def test_search(budget):
    rows = {r["slug"]: r for r in budget.search_lines("overtime").collect()}
    assert (rows["fire"]["line_count"], rows["fire"]["change_from_adopted"], rows["police"]["change_from_adopted"]) == (1, 2, -20)
    assert budget.search_lines("overtime", "police").first()["change_from_adopted"] is None
    assert [r["id"] for r in budget.facts("police recruits").collect()] == ["f1"]
    assert [r["term"] for r in budget.glossary("LEVY").collect()] == ["Tax levy"]
    notes = {r["name"]: r["note"] for r in budget.capital_projects().collect()}
    assert set(notes) == {"Engine", "Typo"} and "$1,300,000 million" in notes["Typo"] and notes["Engine"] is None


def test_people_and_measures(budget):
    change = budget.position_changes("fire").collect()
    assert [(r["title"], float(r["total_positions_2027"])) for r in change] == [("Clerk", 7.0)]
    assert budget.performance_measures("fire").first()["values"] == ["4", "5"]
    assert budget.hearings().first()["starts"].isoformat().startswith("2026-10-05T23")


def test_charges_of_typed_values(budget, spark):
    ddl = "view string, frontage_ft string, extra_carts string, taxkey string, assessed_2026 string, assessed_2025 string, units string, building_units string"
    asked = spark.createDataFrame([("owner", "40", None, None, "200000", "188000", None, None), ("guest", None, None, None, "1", None, None, None)], ddl)
    done, rejected = budget.estimate_charges(asked)
    assert (done.first()["total_c2026"], done.first()["total_c2027"]) == (203676, 208062)
    assert rejected.first()["error"].startswith("view must be")
    assert budget.fees().count() == 5
