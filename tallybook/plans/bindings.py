"""Budget tables derived from the driver's tables, so that every registered query grows with them.

nation is the department, region the section, the order status the budget version, and cents stand in for whole dollars.
Every year belongs to one of the four stages, which take turns: 1995-1998 are the stages in order, 1994 is as 1998.  Each binding has the same meaning in the oracle SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallybook.functions.text import zero_pad_account
from tallybook.plans.registry import table
from tallybook.schema import STAGES

YEARS = (1995, 1996, 1997, 1998)
STAGE_BY_YEAR = dict(zip(YEARS, STAGES))
PRIORITY_METRIC = {"1-URGENT": "salaries", "2-HIGH": "fringe", "3-MEDIUM": "operating", "4-NOT SPECIFIED": "equipment",
                   "5-LOW": "special_funds"}
REGION_SECTION = ["A", "B", "C", "D", "F"]


def cents(value: str) -> Column:
    return F.floor(F.col(value) * 100 + 0.5).cast("long")


def letter(region: str = "n_regionkey") -> Column:
    return F.get(F.array(*[F.lit(x) for x in REGION_SECTION]), F.col(region))


def cite(doc: str, page: Column, line: Column) -> Column:
    return F.struct(F.lit(doc).alias("doc"), page.cast("int").alias("pdf_page"), page.cast("string").alias("printed_page"),
                    line.cast("int").alias("line_no")).alias("cite")


def stage_year(date: str) -> Column:
    return 1995 + (F.year(date) + 1) % 4


#: The same in the oracles.
STAGE_YEAR = "(1995 + (year({0}) + 1) % 4)"


def stage_sums(year: Column, amount: Column) -> list[Column]:
    return [F.sum(F.when(year == y, amount)).alias(s) for y, s in STAGE_BY_YEAR.items()]


def versions(spark: SparkSession) -> list[str]:
    return ["F", "O", "P"]


def departments(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation in each version; section from the region, one detailed prefix, summary pages five apart."""
    n = table(spark, sf, "nation")
    each = F.explode(F.array(*[F.lit(v) for v in versions(spark)])).alias("budget_version")
    return n.select(each, F.lower("n_name").alias("slug"), F.col("n_name").alias("name"),
                    F.lit(None).cast("string").alias("short_name"), letter().alias("section"),
                    F.array(F.concat(F.lit("d"), F.col("n_nationkey"))).alias("detailed"),
                    (F.col("n_nationkey") * 5 + 1).cast("int").alias("summary_page"),
                    F.lit(None).cast("int").alias("summary_last_page"),
                    F.array(F.col("n_name")).alias("aliases"))


def order_spend(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                                          "o_orderpriority")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderstatus").alias("budget_version"), "c_nationkey", "c_mktsegment", "o_orderpriority", "o_orderkey",
        stage_year("o_orderdate").alias("year"), cents("o_totalprice").alias("amount"))


def dept_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Spending by department and metric over the four stages, with a total row; printed changes from the figures."""
    spend = order_spend(spark, sf).groupBy(
        "budget_version", "c_nationkey", "o_orderpriority").agg(*stage_sums(F.col("year"), F.col("amount")))
    metric = F.create_map(*[F.lit(x) for pair in PRIORITY_METRIC.items() for x in pair])[F.col("o_orderpriority")]
    both = spend.select("budget_version", "c_nationkey", *STAGES,
                        F.explode(F.array(metric, F.lit("total_expenditures"))).alias("metric"))
    rows = both.groupBy("budget_version", "c_nationkey", "metric").agg(*[F.sum(s).alias(s) for s in STAGES])
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return rows.join(n, rows.c_nationkey == n.n_nationkey).select(
        "budget_version", F.lower("n_name").alias("dept"), "metric", F.col("metric").alias("label"),
        F.lit("expenditures").alias("group"), *STAGES,
        (F.col("proposed_2027") - F.col("adopted_2026")).alias("change_vs_adopted"),
        (F.col("proposed_2027") - F.col("requested_2027")).alias("change_vs_requested"),
        cite("summary", F.col("c_nationkey") + 1, F.length("metric")))


def section_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Region by line status: O pays as levy, F as other money, both together the budget; subtotal and TOTAL rows."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_linestatus", "l_returnflag", "l_extendedprice", "l_shipdate")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    year = stage_year("l_shipdate")
    sums = [F.sum(F.when(year == y, cents("l_extendedprice"))).alias(c)
            for y, c in ((1996, "adopted_2026"), (1998, "proposed_2027"))]
    by_nation = li.where(year.isin(1996, 1998)).groupBy("l_suppkey", "l_linestatus", "l_returnflag").agg(*sums)
    rows = by_nation.join(s, by_nation.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    line = F.when(F.col("l_linestatus") == "O", "levy").otherwise("non_levy")
    spread = rows.select(
        F.col("l_returnflag").alias("budget_version"), "adopted_2026", "proposed_2027",
        F.explode(F.array(letter(), F.lit("SUBTOTAL_ABCDF"), F.lit("TOTAL"))).alias("section"), line.alias("part")).select(
        "*", F.explode(F.array(F.col("part"), F.lit("budget"))).alias("line"))
    out = spread.groupBy("budget_version", "section", "line").agg(
        F.sum("adopted_2026").alias("adopted_2026"), F.sum("proposed_2027").alias("proposed_2027"))

    def rate(c: str) -> Column:
        return F.when(F.col("line") == "levy", (F.floor(F.col(c) / 1000000 + 0.5) / 100).cast("decimal(8,2)"))

    return out.select(
        "budget_version", "section", F.col("section").alias("label"), "line", "adopted_2026", "proposed_2027",
        (F.col("proposed_2027") - F.col("adopted_2026")).alias("change"), rate("adopted_2026").alias("tax_rate_2026"),
        rate("proposed_2027").alias("tax_rate_2027"), (rate("proposed_2027") - rate("adopted_2026")).alias("tax_rate_change"),
        cite("summary", F.lit(17), F.ascii("section") * 10 + F.length("line")))


def revenues(spark: SparkSession, sf: str) -> DataFrame:
    """Order value by market segment (the fund) and priority (the printed line); high priorities are totals."""
    spend = order_spend(spark, sf).groupBy("budget_version", "c_mktsegment", "o_orderpriority").agg(
        *stage_sums(F.col("year"), F.col("amount")))
    return spend.select(
        "budget_version", F.lit("summary").alias("source"), F.lower("c_mktsegment").alias("fund"),
        F.lit(None).cast("string").alias("dept"), F.lit("orders").alias("category"), F.col("o_orderpriority").alias("line"),
        (F.col("o_orderpriority") < "3").alias("is_total"), *STAGES, F.lit(None).cast("string").alias("account"),
        cite("summary", F.lit(160), F.ascii("o_orderpriority")))


def line_items(spark: SparkSession, sf: str) -> DataFrame:
    """One printed line per line item: part name as description, part key as account, ship year as stage."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
                                             "l_returnflag", "l_linestatus", "l_shipdate")
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    year = stage_year("l_shipdate")
    stages = [F.when(year == y, cents("l_extendedprice")).alias(c) for y, c in STAGE_BY_YEAR.items()]
    return li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).select(
        F.col("l_linestatus").alias("status"), F.lit("F").alias("budget_version"),
        F.concat(F.lit("d"), F.col("s_nationkey")).alias("section"), F.col("p_name").alias("description"),
        zero_pad_account(F.col("p_partkey").cast("string")).alias("account"), F.col("p_brand").alias("org"),
        F.col("p_type").alias("fund"), *stages, (F.col("l_returnflag") == "R").alias("is_subtotal"),
        F.lit(False).alias("is_position"), F.lit("decision_unit").alias("block"), F.col("l_orderkey"), F.col("l_linenumber"),
        cite("detailed", F.col("l_orderkey"), F.col("l_linenumber")))


def parcels(spark: SparkSession, sf: str) -> DataFrame:
    """A customer as a property: balances as assessments, segment as class, key digits as dwelling units."""
    c = table(spark, sf, "customer")
    classes = F.create_map(*[F.lit(x) for x in (
        "AUTOMOBILE", "1", "HOUSEHOLD", "1", "BUILDING", "2", "FURNITURE", "3", "MACHINERY", "9")])
    value = F.when(F.col("c_acctbal") > 0, cents("c_acctbal"))
    return c.select(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("taxkey"),
        # Taken from the row, as a stored version would be: a literal would turn the tariff join into a nested loop.
        F.when(F.col("c_custkey").isNotNull(), "P").alias("budget_version"), F.lit("2026").alias("yr_assmt"), classes[F.col("c_mktsegment")].alias("c_a_class"), value.alias("c_a_total"),
        F.floor(value * 94 / 100).alias("p_a_total"), (F.col("c_custkey") % 7).cast("int").alias("nr_units"),
        F.when(F.col("c_nationkey") > 11, "O").alias("own_ocpd"))


def street_parcels(spark: SparkSession, sf: str) -> DataFrame:
    """A part as a property: size as house number, name as street, type as street type, brand as direction.  Parts that
    share all four are units at one address."""
    p = table(spark, sf, "part")
    kinds = F.create_map(*[F.lit(x) for x in (
        "STANDARD", "ST", "MEDIUM", "AV", "SMALL", "LA", "LARGE", "BL", "PROMO", "PK", "ECONOMY", "CT")])
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return p.select(
        F.lpad(F.col("p_partkey").cast("string"), 10, "0").alias("taxkey"), (F.col("p_size") * 100).alias("house_nr_lo"),
        (F.col("p_size") * 100 + F.when(brand > 12, 4).otherwise(0)).alias("house_nr_hi"),
        F.lit(None).cast("string").alias("house_nr_sfx"),
        F.when(brand % 4 == 0, "N").when(brand % 4 == 1, "S").when(brand % 4 == 2, "E").otherwise("W").alias("sdir"),
        F.upper("p_name").alias("street"), kinds[F.col("p_type")].alias("sttype"))


def typed_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier types the address of the part with its key, spelled out, with the street's fourth letter lost."""
    s = table(spark, sf, "supplier").select("s_suppkey")
    p = street_parcels(spark, sf)
    named = F.create_map(*[F.lit(x) for x in (
        "ST", "Street", "AV", "Avenue", "LA", "Lane", "BL", "Blvd", "PK", "Parkway", "CT", "Court")])
    lost = F.concat(F.substring("street", 1, 3), F.expr("substring(street, 5)"))
    return s.join(p, F.lpad(s.s_suppkey.cast("string"), 10, "0") == p.taxkey).select(
        F.col("s_suppkey").alias("query_id"),
        F.concat_ws(" ", (F.col("house_nr_lo") + 2).cast("string"), F.lower("sdir"), F.lower(lost),
                    named[F.col("sttype")]).alias("typed"))


def document_departments(spark: SparkSession, sf: str) -> DataFrame:
    """A source as a department whose title page is its first document."""
    return table(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("summary_page")).select(
        F.lit("d").alias("budget_version"), F.col("source").alias("slug"), "summary_page",
        F.lit(None).cast("long").alias("summary_last_page"))
