"""Checks over the driver's tables: printed totals against their parts, two books against each other, keys and counts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tallybook.operators import checks as K
from tallybook.operators.joins import allowlist_report
from tallybook.plans import bindings as B
from tallybook.plans.lookup_plans import CENTS, DEPT_SUMMARY, SECTION_TOTALS, SPEND
from tallybook.plans.registry import query, table

NUMBERED = """o as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice, l_suppkey) as rn from lineitem)"""


PART_LINES = 250_000  # line items in one task


def numbered_lines(spark, sf, *columns):
    """Line items dealt by order: the number of parts follows their number, so that what a task sorts is bounded."""
    need = {"l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", *columns}
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey")
    li = table(spark, sf, "lineitem")
    return li.select(*sorted(need)).repartition(1 + li.count() // PART_LINES, "l_orderkey").withColumn("rn", F.row_number().over(order))


@query("total_vs_lines", f"""with l as (select l_orderkey, cast(sum({CENTS.format('l_extendedprice')}) as bigint) as extracted from lineitem group by 1),
f as (select o_orderkey, o_orderstatus, {CENTS.format('o_totalprice')} as printed, coalesce(extracted, 0) as extracted from orders left join l on o_orderkey = l_orderkey)
select o_orderkey::varchar as section, printed::varchar as printed, extracted::varchar as extracted from f
where printed <> extracted and not (o_orderstatus = 'F' and printed % 2 = 0)""")
def total_vs_lines(spark, sf):
    """Order totals that their lines do not reproduce, less the known errors: filled orders with an even total, excused only
    when both numbers are the ones on record (half of the records carry an outdated number and excuse nothing)."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(B.cents("l_extendedprice")).alias("extracted"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", B.cents("o_totalprice").alias("printed"))
    found = K.mismatches(o.join(lines, o.o_orderkey == lines.l_orderkey, "left").withColumn(
        "extracted", F.coalesce("extracted", F.lit(0)))).select(
        F.lit("order_total").alias("check"), F.col("o_orderkey").cast("string").alias("section"), F.lit("total").alias("column"),
        "printed", "extracted", "o_orderstatus")
    known = found.where("o_orderstatus = 'F'").select(
        "check", "section", "column", (F.col("printed") + F.col("printed") % 2).cast("string").alias("printed"),
        F.col("extracted").cast("string").alias("extracted"))
    return K.unexplained(found.drop("o_orderstatus"), known).select("section", "printed", "extracted")


CATEGORY = "(['operating', 'net_salaries', 'equipment', 'special'])[l_linenumber % 4 + 1]"


@query("reconcile_units", f"""with {NUMBERED}, c as (select l_orderkey, {CATEGORY} as chk, case l_returnflag when 'A' then 'adopted_2026' when 'N' then 'requested_2027' else 'proposed_2027' end as stage,
  cast(l_quantity as bigint) as q, l_linestatus from o)
select l_orderkey::varchar as section, chk as "check", stage, cast(sum(q) + max(case when l_linestatus = 'F' then 1 else 0 end) as bigint) as printed, cast(sum(q) as bigint) as extracted from c group by all""")
def reconcile_units(spark, sf):
    """Every order as a unit: category heading, lines, printed category totals and a unit total.  A printed total is one too
    many where a filled line is in it, so both agreements and findings appear."""
    li = numbered_lines(spark, sf, "l_returnflag", "l_linestatus", "l_quantity")
    kinds = [("operating", "operating", "account", "OPERATING EXPENDITURES TOTAL"),
             ("net_salaries", "salaries", "position", "NET SALARIES & WAGES TOTAL"),
             ("equipment", "equipment", "item", "EQUIPMENT PURCHASES TOTAL"), ("special", "special", "item", "SPECIAL FUNDS TOTAL")]
    which = F.col("l_linenumber") % 4
    pick = lambda j: F.get(F.array(*[F.lit(k[j]) for k in kinds]), which)
    q = F.col("l_quantity").cast("long")
    stages = {"actual_2025": None, "adopted_2026": "A", "requested_2027": "N", "proposed_2027": "R"}
    vals = [(F.when(F.col("l_returnflag") == f, q) if f else F.lit(None).cast("long")).alias(s) for s, f in stages.items()]
    items = li.select(F.col("l_orderkey").alias("section"), F.col("rn").alias("line_no"), pick(2).alias("row_type"),
                      pick(1).alias("category"), F.lit("line").alias("description"), *vals, F.lit(False).alias("is_unit_total"),
                      "l_linestatus", pick(3).alias("total"))
    off = lambda s: F.max(F.when(F.col(s).isNotNull() & (F.col("l_linestatus") == "F"), 1).otherwise(0))
    totals = items.groupBy("section", F.col("total").alias("description"), "category").agg(
        *[(F.sum(s) + off(s)).alias(s) for s in stages]).select(
        "section", (F.lit(100_000) + F.length("description")).alias("line_no"), F.lit("rollup").alias("row_type"), "category",
        "description", *stages, F.lit(False).alias("is_unit_total"))
    ends = items.select("section").distinct().select("section", F.explode(F.array(
        F.struct(F.lit(0).alias("line_no"), F.lit("heading").alias("row_type"), F.lit("OPERATING EXPENDITURES").alias("description")),
        F.struct(F.lit(200_000).alias("line_no"), F.lit("rollup").alias("row_type"), F.lit("UNIT TOTAL").alias("description")))).alias("e")).select(
        "section", "e.line_no", "e.row_type", F.lit(None).cast("string").alias("category"), "e.description",
        *[F.lit(None).cast("long").alias(s) for s in stages], (F.col("e.row_type") == "rollup").alias("is_unit_total"))
    book = items.drop("l_linestatus", "total").unionByName(totals).unionByName(ends)
    return K.unit_reconciliation(book, ["section"], ["line_no"]).drop("unit").withColumn("section", F.col("section").cast("string"))


@query("summary_vs_units", f"""with u as (select l_suppkey::varchar as section, {B.STAGE_YEAR.format('l_shipdate')} as y, cast(sum(cast(l_quantity as bigint)) as bigint) as q,
    cast(sum(case when l_linestatus = 'O' then cast(l_quantity as bigint) end) as bigint) as s from lineitem group by all)
select section, case y when 1995 then 'actual_2025' when 1996 then 'adopted_2026' when 1997 then 'requested_2027' else 'proposed_2027' end as stage,
  'unit_totals' as "check", q as printed, coalesce(s, 0) as extracted from u
union all select section, case y when 1995 then 'actual_2025' when 1996 then 'adopted_2026' when 1997 then 'requested_2027' else 'proposed_2027' end,
  'operating', q, q from u""")
def summary_vs_units(spark, sf):
    """A supplier as a section.  Its sheet prints the operating total and the unit total of each year; the units print the
    operating totals of both line states but a unit total for open lines only."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_linestatus", "l_quantity", "l_shipdate")
    year, q = B.stage_year("l_shipdate"), F.col("l_quantity").cast("long")
    per = li.groupBy(F.col("l_suppkey").cast("string").alias("section"), "l_linestatus").agg(
        *B.stage_sums(year, q))
    stages = list(K.STAGES)
    sheet = per.groupBy("section").agg(*[F.sum(s).alias(s) for s in stages]).withColumn("block", F.lit("bcu_summary")).withColumn(
        "l_linestatus", F.lit("O"))
    rows = per.withColumn("block", F.lit("decision_unit")).unionByName(sheet)
    forms = F.array(F.struct(F.lit("OPERATING EXPENDITURES TOTAL").alias("description"), F.lit(False).alias("is_unit_total")),
                    F.struct(F.when(F.col("l_linestatus") == "O", "UNIT TOTAL").alias("description"), F.lit(True).alias("is_unit_total")))
    book = rows.select("section", "block", *stages, F.inline(forms)).where("description is not null").withColumn(
        "row_type", F.lit("rollup"))
    out = K.summary_against_units(book, ["section"])
    # A stage with no lines at all prints nothing on the sheet.
    return out.where((F.col("printed") != 0) | (F.col("extracted") != 0))


@query("section_arithmetic", f"""with {SECTION_TOTALS}, l as (select v, section, line, unnest(['adopted_2026', 'proposed_2027']) as stage, unnest([adopted, proposed]) as x from st),
g as (select v, line, stage, cast(sum(case when section = 'SUBTOTAL_ABCDF' then x else 0 end) as bigint) as s, cast(sum(case when section = 'TOTAL' then x else 0 end) as bigint) as t,
  cast(sum(case when length(section) = 1 then x else 0 end) as bigint) as p from l group by all)
select v as budget_version, line as place, stage, unnest(['levy_subtotal', 'other_subtotal', 'total']) as "check", unnest([s, 0, t]) as printed, unnest([p, 0, s]) as extracted from g
union all select v, section, stage, 'budget_is_levy_plus_other', cast(sum(case when line = 'budget' then x else 0 end) as bigint),
  cast(sum(case when line <> 'budget' then x else 0 end) as bigint) from l group by all""")
def section_arithmetic(spark, sf):
    return K.section_arithmetic(B.section_totals(spark, sf))


@query("revenue_arithmetic", f"""with {SPEND}, r as (select v, lower(c_mktsegment) as fund, o_orderpriority as line, cast(sum(case when yr = 1998 then amount end) as bigint) as x from spend group by all),
p as (select v, fund, coalesce(sum(case when line = '1-URGENT' then x end), 0) as u, coalesce(sum(case when line in ('2-HIGH', '3-MEDIUM') then x end), 0) as c,
  coalesce(sum(case when line = '5-LOW' then x end), 0) as t, coalesce(sum(case when line in ('1-URGENT', '4-NOT SPECIFIED') then x end), 0) as s from r group by all)
select v as budget_version, fund, 'categories' as "check", cast(u as bigint) as printed, cast(c as bigint) as extracted from p
union all select v, fund, 'sources', cast(t as bigint), cast(s as bigint) from p""")
def revenue_arithmetic(spark, sf):
    return K.revenue_arithmetic(B.revenues(spark, sf), ["2-HIGH", "3-MEDIUM"], ["4-NOT SPECIFIED"], "1-URGENT", "5-LOW",
                                keys=["budget_version", "fund"])


@query("category_sums", f"""with {DEPT_SUMMARY}, l as (select v, dept, metric, unnest(['actual_2025', 'adopted_2026', 'requested_2027', 'proposed_2027']) as "column",
  unnest([actual_2025, adopted_2026, requested_2027, proposed_2027]) as x from ds)
select v as budget_version, dept, "column", cast(sum(case when metric = 'total_expenditures' then coalesce(x, 0) else 0 end) as bigint) as printed,
  cast(sum(case when metric <> 'total_expenditures' then coalesce(x, 0) else 0 end) as bigint) as extracted from l group by all""")
def category_sums(spark, sf):
    return K.category_sums(B.dept_summary(spark, sf), ["budget_version", "dept"])


@query("segment_sums", """with e as (select *, cast(floor(value * 100 + 0.5) as bigint) as v, event_type = 'purchase' as t from events),
s as (select *, coalesce(sum(case when t then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as seg from e),
g as (select user_id, seg, max(case when t then v end) as printed, sum(case when not t then v end) as extracted from s group by all)
select user_id, cast(seg as bigint) as segment, printed, cast(extracted as bigint) as extracted, case when printed is null then 'no_total'
  when coalesce(extracted, 0) = printed then 'ok' else 'differs' end as status from g""")
def segment_sums(spark, sf):
    """A visitor's events up to each purchase as a segment, the purchase as its printed total; busy visitors spread over days."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.to_date("ts").alias("day"), B.cents("value").alias("v"),
                                          (F.col("event_type") == "purchase").alias("is_total"))
    return K.segment_sums(e, ["user_id"], ["ts", "event_id"], ["v"], ["day"]).drop("column")


@query("block_sums", f"""with {NUMBERED}, r as (select l_orderkey, rn, l_linestatus as grp, l_returnflag = 'R' as tot, cast(l_quantity as bigint) as q from o),
b as (select *, coalesce(sum(case when tot then 1 else 0 end) over (partition by l_orderkey order by rn rows between unbounded preceding and 1 preceding), 0) as blk,
  coalesce(case when grp <> lag(grp) over (partition by l_orderkey order by rn) then 1 else 0 end, 0) as sw from r),
n as (select *, sum(sw) over (partition by l_orderkey order by rn) as gno from b),
s as (select l_orderkey, blk, sum(case when not tot then q end) as parts, max(case when tot then rn end) as trn, max(case when tot then q end) as printed, max(case when tot then gno end) as g from n group by all),
c as (select *, case when lag(g) over w = g then lag(printed) over w else 0 end as carried from s window w as (partition by l_orderkey order by blk))
select l_orderkey, cast(blk as bigint) as block, printed, cast(parts + coalesce(carried, 0) as bigint) as extracted from c where trn is not null and parts is not null""")
def block_sums(spark, sf):
    li = numbered_lines(spark, sf, "l_returnflag", "l_linestatus", "l_quantity")
    rows = li.select("l_orderkey", "rn", F.col("l_linestatus").alias("group"),
                     F.when(F.col("l_returnflag") == "R", "Total Budget").otherwise("Salaries").alias("label"),
                     F.col("l_quantity").cast("long").alias("proposed_2027"))
    return K.block_sums(rows, ["l_orderkey"], ["rn"], "proposed_2027").drop("label")


@query("change_columns", f"""with {DEPT_SUMMARY} select v as budget_version, dept, metric, 'change_vs_adopted' as "column", proposed_2027 - adopted_2026 + 1 as printed,
  coalesce(proposed_2027, 0) - coalesce(adopted_2026, 0) as extracted from ds where metric = 'fringe' and (proposed_2027 is not null or adopted_2026 is not null)
union all select v, dept, metric, 'change_vs_requested', null, coalesce(proposed_2027, 0) - coalesce(requested_2027, 0) from ds
where metric = 'operating' and (proposed_2027 is not null or requested_2027 is not null) and coalesce(proposed_2027, 0) <> coalesce(requested_2027, 0)
union all select v, dept, metric, "column", null, extracted from (select v, dept, metric, unnest(['change_vs_adopted', 'change_vs_requested']) as "column",
    unnest([proposed_2027 - adopted_2026, proposed_2027 - requested_2027]) as p, unnest([coalesce(proposed_2027, 0) - coalesce(adopted_2026, 0), coalesce(proposed_2027, 0) - coalesce(requested_2027, 0)]) as extracted,
    unnest([coalesce(proposed_2027, adopted_2026), coalesce(proposed_2027, requested_2027)]) as seen from ds)
  where p is null and seen is not null and extracted <> 0 and not (metric = 'fringe' and "column" = 'change_vs_adopted') and not (metric = 'operating' and "column" = 'change_vs_requested')""")
def change_columns(spark, sf):
    """Printed changes one too high for fringe and blank for operating are findings."""
    ds = B.dept_summary(spark, sf)
    ds = ds.withColumn("change_vs_adopted", F.when(F.col("metric") == "fringe", F.col("change_vs_adopted") + 1).otherwise(
        F.col("change_vs_adopted"))).withColumn("change_vs_requested", F.when(F.col("metric") != "operating", F.col("change_vs_requested")))
    return K.change_columns(ds, ["budget_version", "dept", "metric"])


@query("cross_doc", """with a as (select c_nationkey, year(o_orderdate) as yr, count(*) as n from orders join customer on o_custkey = c_custkey group by all),
b as (select c_nationkey, year(o_orderdate) as yr, count(*) as n from orders join customer on o_custkey = c_custkey where o_orderkey in (select l_orderkey from lineitem) group by all)
select coalesce(a.c_nationkey, b.c_nationkey) as c_nationkey, cast(coalesce(a.yr, b.yr) as integer) as year, a.n as printed, b.n as extracted, a.n is not distinct from b.n as agrees
from a full join b on a.c_nationkey = b.c_nationkey and a.yr = b.yr""")
def cross_doc(spark, sf):
    """Orders by nation and year against the orders the line book knows."""
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    c = B.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    both = o.join(c, o.o_custkey == c.c_custkey)
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    count = lambda df: df.groupBy("c_nationkey", "year").agg(F.count("*").alias("value"))
    return K.across_books(count(both), count(both.join(li, "o_orderkey", "left_semi")), ["c_nationkey", "year"])


@query("allowlist", """with f as (select doc_id from labels where quality = 0), a as (select doc_id from labels where toxic = 1)
select doc_id, 'new' as status from f where doc_id not in (select doc_id from a)
union all select doc_id, 'stale' from a where doc_id not in (select doc_id from f)""")
def allowlist(spark, sf):
    labels = table(spark, sf, "labels")
    return allowlist_report(labels.where("quality = 0"), labels.where("toxic = 1"), ["doc_id"])


@query("parcel_checks", """select count(*) as parcels, cast(count_if(c_custkey > 9999999999) as bigint) as malformed_keys, cast(count_if(c_acctbal < 0) as bigint) as negative_values,
  cast(count_if(c_acctbal > 0 and c_mktsegment = 'MACHINERY') as bigint) as taxable_and_exempt, count(*) - count(distinct c_custkey) as duplicate_keys from customer""")
def parcel_checks(spark, sf):
    c = table(spark, sf, "customer")
    parcels = c.select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("taxkey"), B.cents("c_acctbal").alias("c_a_total"),
                       F.when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0).alias("c_a_exm_total"))
    return K.parcel_report(parcels)


@query("orphan_keys", """select 'lineitem' as child, l_orderkey as key, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders) group by all
union all select 'labels', doc_id, count(*) from labels where doc_id not in (select doc_id from documents where lang <> 'es') group by all""")
def orphan_keys(spark, sf):
    """Lines without their order, and labels of documents that are not in the table of texts other than Spanish."""
    a = K.orphans(table(spark, sf, "lineitem"), table(spark, sf, "orders"), ["l_orderkey"], ["o_orderkey"])
    docs = table(spark, sf, "documents").where("lang <> 'es'")
    b = K.orphans(table(spark, sf, "labels"), docs, ["doc_id"], ["doc_id"])
    return a.select(F.lit("lineitem").alias("child"), F.col("l_orderkey").alias("key"), "n").unionByName(
        b.select(F.lit("labels").alias("child"), F.col("doc_id").alias("key"), "n"))


@query("duplicate_ids", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_ids(spark, sf):
    return K.duplicate_ids(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("load_counts", """select 'orders' as "table", count(*) as file, count_if(o_orderstatus <> 'P')::bigint as loaded, count(*) = count_if(o_orderstatus <> 'P') as equal from orders""")
def load_counts(spark, sf):
    o = table(spark, sf, "orders")
    return K.count_against_file(o.where("o_orderstatus <> 'P'"), o, "orders")


@query("size_bounds", r"""with t as (select list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') as w from documents)
select count(*) as passages, cast(min(len(w)) as integer) as min_words, cast(max(len(w)) as integer) as max_words from t""")
def size_bounds(spark, sf):
    return K.size_bounds(table(spark, sf, "documents"))


@query("vector_report", """select label, count(*) as rows, count(embedding) as with_vector, string_agg(distinct len(embedding)::varchar, ',') as dims from embeddings group by label""")
def vector_report(spark, sf):
    return K.vector_report(table(spark, sf, "embeddings"), keys=["label"])


@query("statement_gaps", """select o_orderkey, 'figure' as kind, '$' || format('{:,}', cast(floor(o_totalprice * 100 + 0.5) as bigint) + 1) as item from orders where o_orderstatus = 'F'
union all select o_orderkey, 'quote', 'urgent order' from orders where o_orderpriority <> '1-URGENT'""")
def statement_gaps(spark, sf):
    """Each order's page prints its amount; the statement repeats it (one too many for filled orders) and quotes a phrase that
    only urgent orders print."""
    o = table(spark, sf, "orders")
    amount = B.cents("o_totalprice")
    money = lambda x: F.concat(F.lit("$"), F.format_number(x, 0))
    pages = o.select(F.col("o_orderkey").alias("page"), F.concat(
        F.lit("The total  is "), money(amount), F.lit(". "), F.when(F.col("o_orderpriority") == "1-URGENT", "An urgent order. ").otherwise("")).alias("page_text"))
    said = F.when(F.col("o_orderstatus") == "F", amount + 1).otherwise(amount)
    statements = o.select("o_orderkey", F.col("o_orderkey").alias("page"), F.concat(
        F.lit("The amount "), money(said), F.lit(" is that of an 'urgent order'")).alias("statement"))
    return K.statement_gaps(statements, pages, ["o_orderkey"])
