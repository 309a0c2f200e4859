"""Comparisons, asks, unit costs and derived shares, and printed department tables, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.operators import dept_tables as D, specified as S
from tallybook.plans import bindings as B
from tallybook.plans.charge_plans import INPUT_SQL, KEYS, RATES, receipts, tax
from tallybook.plans.lookup_plans import CENTS, DEPT_SUMMARY, SECTION_TOTALS, pct, rate
from tallybook.plans.registry import query, table


@query("compare_departments", f"""with {DEPT_SUMMARY} select v as budget_version, max(case when dept = 'nation_1' then proposed_2027 end) as nation_1,
  max(case when dept = 'nation_2' then proposed_2027 end) as nation_2 from ds where metric = 'operating' group by v""")
def compare_departments(spark, sf):
    return S.compare_departments(B.dept_summary(spark, sf), ["nation_1", "nation_2"], "operating", "proposed_2027")


@query("ask_vs_got", f"""with {DEPT_SUMMARY} select v as budget_version, dept, metric, requested_2027, proposed_2027, proposed_2027 - requested_2027 as gap,
  {pct('(proposed_2027 - requested_2027)', 'requested_2027')} as gap_percent from ds where proposed_2027 < requested_2027""")
def ask_vs_got(spark, sf):
    return S.ask_vs_got(B.dept_summary(spark, sf), ["budget_version", "dept", "metric"])


@query("top_changes", f"""with {DEPT_SUMMARY}, c as (select v, dept, metric, proposed_2027 - actual_2025 as change, dept || metric as k from ds),
r as (select *, 'up' as direction, row_number() over (partition by v order by change desc, k) as rank from c where change > 0
  union all select *, 'down', row_number() over (partition by v order by change, k) from c where change < 0)
select v as budget_version, dept, metric, change, direction, cast(rank as integer) as rank from r where rank <= 7""")
def top_changes(spark, sf):
    rows = B.dept_summary(spark, sf).withColumn("k", F.concat("dept", "metric"))
    return S.top_changes(rows, "actual", 7, ["budget_version"], "k").select("budget_version", "dept", "metric", "change", "direction", "rank")


@query("title_costs", f"""select p_name as title, cast(sum({CENTS.format('l_extendedprice')}) as bigint) as money, cast(sum(l_quantity) as bigint) as units,
  sum({CENTS.format('l_extendedprice')})::double / sum(cast(l_quantity as bigint))::double as per_unit from lineitem join part on l_partkey = p_partkey group by 1""")
def title_costs(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", B.cents("l_extendedprice").alias("m"), F.col("l_quantity").cast("long").alias("q"))
    per_part = li.groupBy("l_partkey").agg(F.sum("m").alias("proposed_2027"), F.sum("q").alias("proposed_2027_units"))
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("title"))
    return S.title_costs(per_part.join(p, per_part.l_partkey == p.p_partkey))


@query("per_resident", f"""with {DEPT_SUMMARY}, n as (select count(*) as residents from customer)
select v as budget_version, dept, proposed_2027, residents, proposed_2027::double / residents as per_resident, proposed_2027::double / residents / 365 as per_resident_day
from ds, n where metric = 'total_expenditures'""")
def per_resident(spark, sf):
    each = F.explode(F.array(*[F.lit(v) for v in B.versions(spark)])).alias("budget_version")
    people = table(spark, sf, "customer").agg(F.count("*").alias("residents")).select(each, "residents")
    totals = B.dept_summary(spark, sf).where("metric = 'total_expenditures'")
    return S.per_resident(totals, people, "proposed_2027", ["budget_version", "dept"])


@query("tax_by_department", f"""with {DEPT_SUMMARY}, sh as (select dept, proposed_2027::double / sum(proposed_2027) over () as share from ds where v = 'P' and metric = 'total_expenditures'),
{INPUT_SQL}, g as (select taxkey, view, {tax('a26', int(RATES['A'][1].replace('.', '')))} as c from i where kind = 'estimate')
select taxkey, view, dept as slug, cast(floor(c * share + 0.5) as bigint) as c2027, true as illustrative from g, sh""")
def tax_by_department(spark, sf):
    totals = B.dept_summary(spark, sf).where("metric = 'total_expenditures'").withColumnRenamed("dept", "slug")
    return S.tax_by_department(receipts(spark, sf), totals, KEYS)


@query("implied_base", f"""with {SECTION_TOTALS}, r as (select v, section, adopted, proposed, {rate('adopted')} as r0, {rate('proposed')} as r1 from st where line = 'levy'),
b as (select v, section, adopted::double / r0 * 1000 as b0, proposed::double / r1 * 1000 as b1 from r)
select v as budget_version, section, b0 as base_2026, b1 as base_2027, floor((b1 - b0) / b0 * 1000 + 0.5) / 10 as growth_percent, true as derived from b""")
def implied_base(spark, sf):
    return S.implied_base(B.section_totals(spark, sf))


# --- Printed tables, rendered from the driver's tables and read back ------------------------------------------------------------


def word(text, x, top, doc="summary", width=None):
    return F.struct(F.lit(doc).alias("doc"), F.col("page"), text.cast("string").alias("text"), x.alias("x0"),
                    (x + (F.length(text.cast("string")) * 5.0 if width is None else width)).alias("x1"), top.alias("top"), (top + 8).alias("bottom"))


PART_ROWS = """r as (select cast(p_partkey // 20 as integer) as page, p_partkey, p_name, p_partkey % 3 = 0 as division, cast(floor(p_retailprice) as bigint) as a, p_size * 1000::bigint as b from part),
f as (select page, min(p_partkey) as k from r group by page)"""


@query("department_list", f"""with {PART_ROWS} select page, p_partkey || ' ' || p_name as label, division as is_division_subtotal, a::double as adopted_2026, b::double as requested_2027,
  (a + b)::double as proposed_2027, b::double as change_vs_adopted, a::double as change_vs_requested from r""")
def department_list(spark, sf):
    """Twenty parts to a page with five right-aligned figures each; every third is a division in parentheses."""
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 20).cast("int").alias("page"), "p_partkey", "p_name",
                                        (F.col("p_partkey") % 3 == 0).alias("division"), F.floor("p_retailprice").alias("a"),
                                        (F.col("p_size") * 1000).cast("long").alias("b"))
    top = (F.col("p_partkey") % 20) * 15.0 + 100
    a, b = F.col("a"), F.col("b")
    figures = []
    for i, v in enumerate((a, b, a + b, b, a)):
        text = F.when(F.col("division"), F.concat(F.lit("("), F.format_number(v, 0), F.lit(")"))).otherwise(F.format_number(v, 0))
        figures.append(word(text, F.lit(340.0 + 70 * i) - F.length(text) * 5.0, top))
    name = word(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name"), F.lit(60.0), top, width=F.lit(100.0))
    words = p.select(F.inline(F.array(name, *figures)))
    return D.department_list(D.page_lines(words)).select(
        "page", "label", "is_division_subtotal", *[F.col(k).cast("double").alias(k) for k in D.FIVE_KEYS])


@query("bordered_tables", """select p_partkey, (['services', 'kpis', 'position_changes'])[p_partkey % 3 + 1] as kind, p_name as label,
  case when p_partkey % 3 = 1 then null else p_size::double end as value from part""")
def bordered_tables(spark, sf):
    """A part as a table of its own: a service, a measure, or a position, told apart by header words."""
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    shapes = [([F.lit("Description of Services Provided"), F.lit("FTEs"), F.lit("Operating")], [F.col("p_name"), F.lit("-"), size]),
              ([F.lit("Key Performance Measures"), F.lit("2025"), F.lit("2026")], [F.col("p_name"), size, size]),
              ([F.lit("Positions"), F.lit("O&M"), F.lit("Other"), F.lit("Position Title"), F.lit("Reason")],
               [size, F.lit("-"), F.lit(""), F.col("p_name"), F.lit("New")])]
    pick = lambda i: F.get(F.array(*[F.array(*[c.cast("string") for c in s[i]]) for s in shapes]), (F.col("p_partkey") % 3).cast("int"))
    cells = p.select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("doc"), F.lit(1).alias("page"), F.lit(1).alias("table_no"), F.explode(F.array(
        F.struct(F.lit(0).alias("row_no"), pick(0).alias("cells")), F.struct(F.lit(1).alias("row_no"), pick(1).alias("cells")))).alias("r")).select(
        "doc", "page", "table_no", "r.row_no", "r.cells")
    kinds = D.table_kinds(cells)
    out = [D.services(cells, kinds).select("doc", F.lit("services").alias("kind"), F.col("description").alias("label"), F.col("operating").cast("double").alias("value")),
           D.kpis(cells, kinds).select("doc", F.lit("kpis").alias("kind"), F.col("measure").alias("label"), F.lit(None).cast("double").alias("value")),
           D.position_changes(cells, kinds).select("doc", F.lit("position_changes").alias("kind"), F.col("title").alias("label"), F.col("positions").cast("double").alias("value"))]
    return out[0].unionByName(out[1]).unionByName(out[2]).select(F.expr("substring(doc, 2)").cast("long").alias("p_partkey"), "kind", "label", "value")


@query("capital_items", """select p_partkey, upper(p_name[1]) || p_name[2:] as name, case p_type when 'PROMO' then p_size * 1000000::bigint when 'ECONOMY' then null else (p_size * 1000)::bigint end as amount,
  'project' as kind from part""")
def capital_items(spark, sf):
    """A bullet per part over two lines, fifty parts to a page; economy parts carry a misprinted amount."""
    p = table(spark, sf, "part")
    name = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    amount = F.when(F.col("p_type") == "PROMO", F.concat(F.col("p_size").cast("string"), F.lit(".0 million"))).when(
        F.col("p_type") == "ECONOMY", F.lit("1,300,000 million")).otherwise(F.format_number(F.col("p_size") * 1000, 0))
    page, at = F.floor(F.col("p_partkey") / 50).cast("int") + 1, (F.col("p_partkey") % 50).cast("int") * 2 + 2
    first = F.concat(F.lit("• "), name, F.lit(" ($"), amount, F.lit(") – The program in W."))
    body = p.select(page.alias("page"), F.inline(F.array(F.struct(at.alias("line"), first.alias("text")), F.struct((at + 1).alias("line"), F.concat(
        F.lit("part "), F.col("p_partkey").cast("string"), F.lit(".")).alias("text")))))
    heads = body.select("page").distinct().select("page", F.lit(1).alias("line"), F.lit("CAPITAL PROJECTS").alias("text"))
    items = D.capital_items(body.unionByName(heads).withColumn("doc", F.lit("d")), ["doc"])
    return items.select(F.regexp_extract("description", r"part (\d+)\.", 1).cast("long").alias("p_partkey"), "name", "amount", "kind")
