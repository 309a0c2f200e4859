"""Questions over the budget tables that go beyond a single lookup: comparisons, asks, unit costs, derived shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook.functions.numbers import percent_change
from tallybook.operators.lookups import VERSION, movers

BASES = {"adopted": "adopted_2026", "requested": "requested_2027", "actual": "actual_2025"}


def compare_departments(dept_summary: DataFrame, slugs: list[str], metric: str, stage: str) -> DataFrame:
    """One column per department for a metric and stage."""
    rows = dept_summary.where((F.col("metric") == metric) & F.col("dept").isin(slugs))
    return rows.groupBy(VERSION).pivot("dept", slugs).agg(F.max(stage))


def ask_vs_got(rows: DataFrame, keys: list[str], direction: str = "cut") -> DataFrame:
    """Rows proposed below ('cut'), above ('above') or at ('met') what was requested."""
    gap = F.col("proposed_2027") - F.col("requested_2027")
    wanted = {"cut": gap < 0, "above": gap > 0, "met": gap == 0}[direction]
    return rows.where(wanted).select(*keys, "requested_2027", "proposed_2027", gap.alias("gap"),
                                     percent_change(gap, F.col("requested_2027")).alias("gap_percent"))


def top_changes(rows: DataFrame, vs: str, n: int, keys: list[str], tie: str) -> DataFrame:
    return movers(rows, F.col("proposed_2027") - F.col(BASES[vs]), n, keys, tie)


def title_costs(position_lines: DataFrame, stage: str = "proposed_2027", category: Column | None = None) -> DataFrame:
    """Budgeted money and units of each position title, and money per unit."""
    rows = position_lines if category is None else position_lines.where(category)
    out = rows.groupBy("title").agg(F.sum(F.coalesce(stage, F.lit(0))).alias("money"), F.sum(F.coalesce(f"{stage}_units", F.lit(0))).alias("units"))
    return out.withColumn("per_unit", F.when(F.col("units") != 0, F.col("money").cast("double") / F.col("units").cast("double")))


def per_resident(amounts: DataFrame, population: DataFrame, amount: str, keys: list[str]) -> DataFrame:
    """Dollars per resident, per year and per day; population(version, residents) has one row per version."""
    yearly = F.col(amount).cast("double") / F.col("residents")
    return amounts.join(population, VERSION).select(*keys, amount, "residents", yearly.alias("per_resident"),
                                                                (yearly / 365).alias("per_resident_day"))


def tax_by_department(receipts: DataFrame, departments: DataFrame, keys: list[str], section: str = "A") -> DataFrame:
    """The general part of each household's tax spread over departments by their share of spending.  Illustrative: the
    budget does not earmark the general levy."""
    share = F.col("proposed_2027").cast("double") / F.sum("proposed_2027").over(Window.partitionBy(VERSION))
    shares = departments.select(VERSION, "slug", share.alias("share"))
    general = receipts.select(*keys, VERSION, F.inline("split")).where(F.col("section") == section)
    cents = F.floor(F.col("c2027") * F.col("share") + 0.5).cast("long")
    return general.join(shares, VERSION).select(*keys, "slug", cents.alias("c2027"), F.lit(True).alias("illustrative"))


def implied_base(section_totals: DataFrame) -> DataFrame:
    """Levy over rate, in dollars of assessed value, and its growth.  Derived, not printed."""
    base = lambda levy, rate: F.col(levy).cast("double") / F.nullif(F.col(rate).cast("double"), F.lit(0.0)) * 1000
    rows = section_totals.where("line = 'levy'").withColumns({"base_2026": base("adopted_2026", "tax_rate_2026"),
                                                              "base_2027": base("proposed_2027", "tax_rate_2027")})
    growth = percent_change(F.col("base_2027") - F.col("base_2026"), F.col("base_2026"))
    return rows.select(VERSION, "section", "base_2026", "base_2027", growth.alias("growth_percent"), F.lit(True).alias("derived"))
