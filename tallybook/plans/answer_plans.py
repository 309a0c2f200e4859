"""What the answer tools and the book checks return, over budget tables made of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from tallybook import fixed_values as V
from tallybook.functions import dates, money, numbers, text as X
from tallybook.operators import checks as K, dept_tables as D, grounding as G, lookups as L, passages as P, retrieval as R
from tallybook.plans import bindings as B
from tallybook.plans.lookup_plans import CENTS, DEPT_SUMMARY, SPEND, STAGE_SUMS, pct
from tallybook.plans.registry import query, table
from tallybook.plans.retrieval_plans import STEM, STOP_SQL, STOP_WORDS
from tallybook.session import checkpoint_root
from tallybook.streaming import requests as Q

AUTHOR = "a person"


# --- Lookups ---------------------------------------------------------------------------------------------------------------


@query("dept_totals_of_version", f"""with {DEPT_SUMMARY}
select v as budget_version, dept as slug, n_name as name, actual_2025, adopted_2026, requested_2027, proposed_2027,
  proposed_2027 - adopted_2026 as change_from_adopted, proposed_2027 - requested_2027 as change_from_request, {pct('(proposed_2027 - adopted_2026)', 'adopted_2026')} as percent_change_from_adopted
from ds where metric = 'total_expenditures' and v = 'F' and adopted_2026 is not null and requested_2027 is not null and proposed_2027 is not null""")
def dept_totals_of_version(spark, sf):
    """One version of three."""
    return L.department_totals(B.dept_summary(spark, sf), B.departments(spark, sf), "F", section=None).drop("short_name", "cite")


def labelled_facts(spark, sf):
    """Labelled documents as facts of their language's version; good ones are reviewed."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return d.select(F.col("lang").alias("budget_version"), F.concat(F.lit("fact-"), (F.col("doc_id") % 40).cast("string")).alias("id"), F.col("text").alias("statement"),
                    B.cite("summary", F.col("doc_id"), F.lit(1)), F.when(F.col("quality") == 1, AUTHOR).alias("reviewed_by"))


@query("budget_fact", f"""select lang as budget_version, 'fact-7' as id, text as statement, case when quality = 1 then '{AUTHOR}' end as reviewed_by
from documents join labels using (doc_id) where doc_id % 40 = 7""")
def budget_fact(spark, sf):
    return L.budget_fact(labelled_facts(spark, sf), "fact-7").drop("cite")


REASONS = "case c_custkey % 3 when 0 then 'New position, funded' when 1 then 'Moved to Library' end"


@query("position_changes", f"""select c_mktsegment as budget_version, n_name as dept, c_custkey % 5 - 2 as positions, c_name as title, {REASONS} as reason,
  case c_custkey % 3 when 0 then 'new_funded' when 1 then 'transfer' else 'other' end as reason_category,
  case when c_mktsegment <> 'BUILDING' then n_nationkey + 10 end as total_positions_2026, case when c_mktsegment <> 'BUILDING' then n_nationkey + 12 end as total_positions_2027
from customer join nation on c_nationkey = n_nationkey where c_custkey % 17 <> 0""")
def position_changes(spark, sf):
    """A customer as a change of positions in its nation; every seventeenth row is a printed total.  One version has no totals."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    key = F.col("c_custkey")
    reason = F.when(key % 3 == 0, "New position, funded").when(key % 3 == 1, "Moved to Library")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_mktsegment").alias("budget_version"), F.col("n_name").alias("dept"), (key % 5 - 2).alias("positions"), F.col("c_name").alias("title"), reason.alias("reason"),
        X.reason_category(reason).alias("reason_category"), (key % 17 == 0).alias("is_total"), B.cite("summary", key, F.lit(1)))
    segments = c.select(F.col("c_mktsegment").alias("budget_version")).distinct().where("budget_version <> 'BUILDING'")
    totals = segments.join(n.select("n_nationkey", "n_name").hint("broadcast"), F.lit(True)).select(
        "budget_version", F.col("n_name").alias("dept"), F.lit("positions").alias("metric"), (F.col("n_nationkey") + 10).alias("adopted_2026"),
        (F.col("n_nationkey") + 12).alias("proposed_2027"), B.cite("summary", F.col("n_nationkey"), F.lit(2)))
    return L.position_changes_of(rows, totals).drop("cite")


def part_measures(spark, sf):
    p = table(spark, sf, "part")
    kpis = p.select(F.lit("F").alias("budget_version"), F.concat(F.lit("d"), (F.col("p_partkey") % 25).cast("string")).alias("dept"), F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("measure"),
                    F.array(F.lit("2024 Actual"), F.lit("2025 Goal")).alias("col_labels"), F.array(F.col("p_size").cast("string"), F.col("p_type")).alias("values"),
                    F.lit(None).cast("string").alias("footnote"), B.cite("summary", F.col("p_partkey"), F.lit(1)))
    depts = table(spark, sf, "nation").select(F.lit("F").alias("budget_version"), F.concat(F.lit("d"), F.col("n_nationkey").cast("string")).alias("slug"), F.col("n_name").alias("name"))
    return L.performance_measures(kpis, depts)


@query("performance_measures", """with m as (select 'd' || (p_partkey % 25) as dept, n_name as name, concat_ws(' ', p_name, p_brand, p_partkey::varchar) as measure, p_size, p_type
  from part join nation on n_nationkey = p_partkey % 25)
select dept, name, measure, 0 as ordinal, '2024 Actual' as "column", p_size::varchar as value from m union all select dept, name, measure, 1, '2025 Goal', p_type from m""")
def performance_measures(spark, sf):
    """Every measure of every department, a row for each printed column."""
    return L.measure_values(part_measures(spark, sf)).select("dept", "name", "measure", "ordinal", "column", "value")


def order_claims(spark, sf):
    """An order as a claim, its lines in line order as the articles that made it."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    sources = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda s: F.struct(
        s["l_partkey"].alias("article"), s["l_suppkey"].cast("string").alias("quote"))).alias("sources"))
    o = table(spark, sf, "orders").join(sources, F.col("o_orderkey") == F.col("l_orderkey"))
    labels = F.array(*[F.lit(x) for x in V.CLAIM_LABELS])
    return o.select(F.col("o_orderkey").alias("id"), F.get(labels, (F.col("o_orderkey") % len(V.CLAIM_LABELS)).cast("int")).alias("label"),
                    F.when(F.col("o_orderstatus") == "F", AUTHOR).alias("reviewed_by"), "sources")


def part_articles(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("article"), F.date_add(F.lit("2026-01-01").cast("date"), F.col("p_size").cast("int")).alias("date"),
                                           F.col("p_brand").alias("outlet"), F.array(F.col("p_type")).alias("topics"))


@query("reviewed_claims", f"""select o_orderkey as id, case o_orderkey % 4 {' '.join(f"when {i} then '{t}'" for i, t in enumerate(V.CLAIM_LABELS.values()))} end as label_text
from orders where o_orderstatus = 'F' and o_orderkey in (select l_orderkey from lineitem)""")
def reviewed_claims(spark, sf):
    return L.reviewed_claims(order_claims(spark, sf)).select("id", "label_text")


@query("claim_articles", """select l_orderkey as id, string_agg(p_brand || ' ' || p_partkey || ' ' || l_suppkey, '; ' order by l_linenumber, l_partkey, l_suppkey) as articles
from lineitem join part on l_partkey = p_partkey group by 1""")
def claim_articles(spark, sf):
    """Articles in the order in which each claim names them."""
    made = L.claim_articles(order_claims(spark, sf), part_articles(spark, sf))
    said = F.transform("articles", lambda a: F.concat_ws(" ", a["outlet"], a["article"].cast("string"), a["quote"]))
    return made.select("id", F.array_join(said, "; ").alias("articles"))


@query("topic_articles", """select p_type as topic, p_partkey as article, p_brand as outlet, cast(row_number() over (partition by p_type order by p_size desc, p_brand, p_partkey) as bigint) as place from part""")
def topic_articles(spark, sf):
    """Articles under their topic, newest first; the place of each comes from the operator's own order column."""
    topics = table(spark, sf, "part").select(F.col("p_type").alias("topic")).distinct()
    return L.topic_articles(topics, part_articles(spark, sf)).select("topic", "article", "outlet", "place")


def printed_revenues(spark, sf):
    """Customers as the lines of the source of funds, line items as the listing of section 430, parts as fund revenues."""
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    stages = lambda value: [value.alias(s) for s in B.STAGES]
    funds = c.select(F.lit("book").alias("doc"), F.floor(key / 40).alias("page"), (key % 40 * 10.0).alias("top"),
                     F.when(key % 37 == 5, F.concat(F.lit("Amount to be Raised "), "c_name")).when(key % 11 == 3, F.concat(F.lit("Total "), "c_name")).otherwise(F.col("c_name")).alias("label"),
                     F.lit("sources").alias("group"), *stages(B.cents("c_acctbal")))
    items = B.line_items(spark, sf).select(F.lit("430").alias("section"), F.lit("account").alias("row_type"), "fund", F.array("section").alias("hierarchy_path"), "description", "is_subtotal", *B.STAGES, "account")
    p = table(spark, sf, "part")
    sums = p.select(F.col("p_brand").alias("dept"), F.col("p_name").alias("label"), F.lit("revenues").alias("group"), F.when(F.col("p_size") % 5 == 0, "rev_total").otherwise("rev").alias("metric"),
                    *stages(F.col("p_size").cast("long")))
    return D.all_revenues(funds, items, sums)


@query("all_revenues", f"""with f as (select *, case when c_custkey % 37 = 5 then 'Amount to be Raised ' || c_name when c_custkey % 11 = 3 then 'Total ' || c_name else c_name end as label from customer),
g as (select *, coalesce(last_value(case when c_custkey % 37 = 5 then label end ignore nulls) over (order by c_custkey), 'sources') as category from f)
select 'summary' as source, 'general' as fund, category, label as line, label like 'Total%' as is_total, {CENTS.format('c_acctbal')} as proposed_2027, null as account from g
union all select 'detailed', p_type, 'd' || s_nationkey, p_name, l_returnflag = 'R', case when {B.STAGE_YEAR.format('l_shipdate')} = 1998 then {CENTS.format('l_extendedprice')} end,
  lpad(p_partkey::varchar, cast(greatest(6, length(p_partkey::varchar)) as integer), '0') from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
union all select 'summary', p_brand, 'fund revenues', p_name, p_size % 5 = 0, p_size, null from part""")
def all_revenues(spark, sf):
    return printed_revenues(spark, sf).select("source", "fund", "category", "line", "is_total", "proposed_2027", "account")


# --- Facts beside answers ---------------------------------------------------------------------------------------------------


@query("department_facts", f"""with f as (select l_linestatus as v, l_orderkey * 100 + rn as id, p_name || ' for ' || n_name as statement from
    (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rn from lineitem)
    join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_returnflag = 'R'),
ft as (select v, id, {STEM.format('w')} as term from (select v, id, unnest(regexp_extract_all(lower(statement), '[a-z0-9]+')) as w from f) where w not in ({STOP_SQL})),
fc as (select v, id, term, count(*) as n from ft group by all),
d as (select n_name || ' Department of Works' as name, n_name as slug, v from nation, (select unnest(['F', 'O']) as v)),
dt as (select distinct v, slug, {STEM.format('w')} as term from (select v, slug, unnest(regexp_extract_all(lower(regexp_replace(name, 'Department( of)?|Division|-', ' ', 'g')), '[a-z0-9]+')) as w from d) where w not in ({STOP_SQL})),
s as (select v, slug, id, sum(n) as score from fc join dt using (v, term) group by all),
r as (select *, row_number() over (partition by v, slug order by score desc, v || '/' || id) as rank from s)
select v as budget_version, slug, cast(rank as integer) as rank, id, statement from r join f using (v, id) where rank <= 4""")
def department_facts(spark, sf):
    """Returned lines as reviewed facts about a nation; each nation's department gets the four that match its name."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    rows = li.withColumn("rn", F.row_number().over(order)).join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    facts = rows.select(F.col("l_linestatus").alias("budget_version"), (F.col("l_orderkey") * 100 + F.col("rn")).alias("id"), F.lit("").alias("topic"),
                        F.concat_ws(" for ", "p_name", "n_name").alias("statement"), F.when(F.col("l_returnflag") == "R", AUTHOR).alias("reviewed_by"))
    depts = n.select(F.explode(F.array(F.lit("F"), F.lit("O"))).alias("budget_version"), F.col("n_name").alias("slug"), F.concat("n_name", F.lit(" Department of Works")).alias("name"))
    return R.facts_beside_departments(depts, facts, STOP_WORDS)


@query("sales_tax_by_fund", f"""with {SPEND}, r as (select v, lower(c_mktsegment) as fund, o_orderpriority as line, {STAGE_SUMS} from spend group by all),
q as (select distinct item_id as query_id, (['F', 'O', 'P'])[item_id % 3 + 1] as budget_version from benchmark where item_id % 2 = 0)
select query_id, budget_version, fund, line, adopted_2026, requested_2027, proposed_2027 from q join r on r.v = budget_version where line = '3-MEDIUM'""")
def sales_tax_by_fund(spark, sf):
    """Questions that met a fact on the tax get its printed split by fund; questions that met others do not."""
    b = table(spark, sf, "benchmark")
    found = b.select(F.col("item_id").alias("query_id"), F.get(F.array(*[F.lit(v) for v in B.versions(spark)]), (F.col("item_id") % 3).cast("int")).alias("budget_version"),
                     F.when(F.col("item_id") % 2 == 0, "sales_tax").otherwise("act_12").alias("topic"))
    return R.sales_tax_beside(found, L.revenue_line_by_fund(B.revenues(spark, sf), "3-MEDIUM")).drop("cite")


@query("nearest_concepts", """with e as (select vec_id, embedding::double[] as v, label from embeddings),
r as (select q.vec_id as query_id, c.vec_id as id, c.label, row_number() over (partition by q.vec_id order by list_cosine_similarity(c.v, q.v) desc, c.vec_id) as rank
  from e q, e c where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, id, label::varchar as label from r where rank <= 3""")
def nearest_concepts(spark, sf):
    """Vectors with their labels as concepts; every hundredth vector asks."""
    e = table(spark, sf, "embeddings")
    concepts = e.select(F.col("vec_id").alias("id"), F.lit("account").alias("kind"), F.col("label").cast("string").alias("label"), "embedding")
    return R.nearest_concepts(e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding"), concepts).drop("kind")


# --- Checks -------------------------------------------------------------------------------------------------------------------


@query("table_pairs", f"""with {SPEND}, r as (select v, o_orderpriority as line, cast(sum(case when yr = 1998 then amount end) as bigint) as amount from spend where c_mktsegment = 'BUILDING' group by all),
p as (select v, n_nationkey, sum(amount) as printed, count(*) = count(amount) as whole from nation, (select unnest(['1-URGENT', '5-LOW']) as line) join r using (line) group by all),
q as (select v as budget_version, 'pair-' || n_nationkey as id, printed, printed + case when n_nationkey % 4 = 0 then 1 else 0 end as extracted from p),
c as (select c_mktsegment as budget_version, 'ask-' || c_custkey as id, {CENTS.format('c_acctbal')} as printed, {CENTS.format('c_acctbal')} + case when c_custkey % 50 = 0 then 7 else 0 end as extracted from customer)
select budget_version, id, cast(printed as bigint) as printed, cast(extracted as bigint) as extracted from q where printed <> extracted union all select * from c where printed <> extracted""")
def table_pairs(spark, sf):
    """Facts that state the sum of two revenue lines, a quarter of them one too high, and changes of a section's line, some seven
    too high."""
    rev = B.revenues(spark, sf).where("fund = 'building'").withColumn("fund", F.lit("general"))
    n = table(spark, sf, "nation").select("n_nationkey")
    two = rev.where(F.col("line").isin("1-URGENT", "5-LOW")).groupBy("budget_version").agg(F.sum("proposed_2027").alias("sum"))
    high = F.when(F.col("n_nationkey") % 4 == 0, 1).otherwise(0)
    sums = two.join(F.broadcast(n), F.lit(True)).select("budget_version", F.concat(F.lit("pair-"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("revenues").alias("source"),
                                           F.array(F.lit("1-URGENT"), F.lit("5-LOW")).alias("lines"), F.lit(None).cast("string").alias("section"), (F.col("sum") + high).alias("value"))
    c = table(spark, sf, "customer")
    change = B.cents("c_acctbal")
    compared = c.select(F.col("c_mktsegment").alias("budget_version"), F.col("c_name").alias("section"), F.lit("Total Appropriations").alias("line"), change.alias("change_vs_requested"),
                        B.cite("summary", F.col("c_custkey"), F.lit(1)))
    asks = c.select(F.col("c_mktsegment").alias("budget_version"), F.concat(F.lit("ask-"), F.col("c_custkey").cast("string")).alias("id"), F.lit("comparisons").alias("source"),
                    F.array(F.lit("Total Appropriations")).alias("lines"), F.col("c_name").alias("section"), (change + F.when(F.col("c_custkey") % 50 == 0, 7).otherwise(0)).alias("value"))
    return K.table_pair_gaps(sums.unionByName(asks), rev, compared)


@query("extra_citations", r"""with c as (select p_partkey, p_name || ' (part)' as term, split_part(p_name, ' ', 1) as cite_text, p_type as alias, n, case when n = 1 then 'page of ' || p_brand end as own, (p_partkey * 7 + n) % (select max(p_partkey) + 1 from part) as page
  from part, (select unnest([0, 1]) as n)),
g as (select p_partkey as page, lower(p_name || ' printed on a page of ' || p_brand) as t from part)
select term, cast(n as integer) as n, page from c left join g using (page)
where not case when own is not null then coalesce(contains(t, lower(own)), false) else coalesce(contains(t, lower(cite_text)), false) or coalesce(contains(t, lower(alias)), false) or coalesce(contains(t, lower(split_part(term, ' (', 1))), false) end""")
def extra_citations(spark, sf):
    """A part name as a term that is also cited on two other parts' pages, the second time by a phrase of its own."""
    p = table(spark, sf, "part")
    top = p.agg(F.max("p_partkey") + 1).scalar()
    at = lambda n, own: F.struct(((F.col("p_partkey") * 7 + n) % top).alias("page"), own.cast("string").alias("cite_text"))
    glossary = p.select(F.concat("p_name", F.lit(" (part)")).alias("term"), F.array("p_type").alias("aliases"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("cite_text"),
                        F.array(at(0, F.lit(None)), at(1, F.concat(F.lit("page of "), "p_brand"))).alias("also_cite"))
    pages = p.select(F.col("p_partkey").alias("page"), F.concat("p_name", F.lit(" printed on a page of "), "p_brand").alias("page_text"))
    return K.extra_citation_gaps(glossary, pages, ["page"])


@query("golden_values", f"""with {DEPT_SUMMARY} select v as budget_version, dept, metric, proposed_2027 + 5 as expected, proposed_2027 as value from ds where n_nationkey % 6 = 0 and proposed_2027 is not null""")
def golden_values(spark, sf):
    """Hand-read values: those of every sixth nation are five too high."""
    rows = B.dept_summary(spark, sf).select("budget_version", "dept", "metric", F.col("proposed_2027").alias("value"))
    wrong = table(spark, sf, "nation").where(F.col("n_nationkey") % 6 == 0).select(F.lower("n_name").alias("dept"), F.lit(5).alias("off"))
    expected = rows.where("value is not null").join(wrong, "dept", "left").select("budget_version", "dept", "metric", (F.col("value") + F.coalesce("off", F.lit(0))).alias("value"))
    return K.golden_differences(rows, expected, ["budget_version", "dept", "metric"]).select("budget_version", "dept", "metric", "expected", "value")


@query("second_reader", """with r as (select c_custkey as id, case when c_custkey % 7 = 0 then 'MISMATCH' when c_custkey % 5 = 0 then 'values_ok_label_not_on_line' else 'ok' end as status from customer),
a as (select c_custkey as id from customer where c_custkey % 35 in (0, 1))
select id, 'new' as status from r where status <> 'ok' and id not in (select id from a) union all select id, 'stale' from a where id not in (select id from r where status <> 'ok')""")
def second_reader(spark, sf):
    """A customer as a page with one printed line: name, balance in brackets, a dash, key.  Some extracted rows have another value,
    some another label; the allow-list names a few of them and some that are right."""
    c = table(spark, sf, "customer")
    key, cents_ = F.col("c_custkey"), B.cents("c_acctbal")
    shown = F.when(cents_ < 0, F.concat(F.lit("("), F.format_number(-cents_, 0), F.lit(")"))).otherwise(F.concat(F.lit("$"), F.format_number(cents_, 0)))
    word = lambda i, t: F.struct(F.lit(i * 50.0).alias("x0"), F.lit(i * 50.0 + 40).alias("x1"), t.alias("text"))
    words = c.select(key.alias("page"), F.lit(1).alias("line"), F.inline(F.array(word(0, F.lit("Balance")), word(1, F.lit("of")), word(2, F.col("c_name")), word(5, shown), word(6, F.lit("-")), word(7, key.cast("string")))))
    lines = K.value_lines(words, ["page"], x_min=240.0)
    dec = lambda x: x.cast("decimal(20,4)")
    slots = lines.select("page", "line", F.transform("slots", dec).alias("slots"), "label_text")
    rows = c.select(key.alias("page"), key.alias("id"), F.when(key % 5 == 0, "Other words").otherwise("Balance of").alias("label"),
                    F.array(dec(cents_ + F.when(key % 7 == 0, 1).otherwise(0)), F.lit(None).cast("decimal(20,4)"), dec(key)).alias("expected"))
    found = K.found_on_page(rows, slots, ["page"], ["id"])
    return K.crosscheck_report(found, c.where((key % 35).isin(0, 1)).select(key.alias("id")), ["id"])


@query("top_level_lines", """select c_nationkey, c_custkey, c_mktsegment from customer c where c_nationkey % 3 <> 0 and c_mktsegment = 'BUILDING'
union all select c_nationkey, c_custkey, c_mktsegment from customer where c_mktsegment = 'MACHINERY'
  and c_nationkey not in (select c_nationkey from customer where c_nationkey % 3 <> 0 and c_mktsegment = 'BUILDING')""")
def top_level_lines(spark, sf):
    """Customers as lines of their nation's department: two nations of three have a summary sheet, the others only units."""
    c = table(spark, sf, "customer")
    block = F.when((F.col("c_mktsegment") == "BUILDING") & (F.col("c_nationkey") % 3 != 0), "bcu_summary").when(F.col("c_mktsegment") == "MACHINERY", "decision_unit").otherwise("restated")
    return K.top_level_lines(c.withColumn("block", block), ["c_nationkey"]).select("c_nationkey", "c_custkey", "c_mktsegment")


@query("cut_requirements", r"""with i as (select p_partkey as id, unnest([p_name, 'or ' || p_type, '(' || p_brand]) as item, unnest([true, p_size % 3 = 0, p_size % 5 = 0]) as has from part where p_partkey::varchar like '1%')
select id, item from i where has and (regexp_matches(item, '(?i)^(or|nor)\b') or item like '(%')""")
def cut_requirements(spark, sf):
    """Cases whose key starts with 1; some requirements start with "or", some open a bracket."""
    cases = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.array_compact(F.array("p_name", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("or "), "p_type")))).alias("must_include"),
                                            F.when(F.col("p_size") % 5 == 0, F.array(F.concat(F.lit("("), "p_brand"))).alias("must_not"))
    return G.split_requirements(G.selected_cases(cases, ["1"])).select(F.col("id").cast("long").alias("id"), "item")


# --- Cards ---------------------------------------------------------------------------------------------------------------------


@query("cards_beside_passages", """with c as (select p_brand as dept, min(p_partkey) as a, max(p_partkey) as b from part group by 1)
select 'narrative:' || p_partkey as id, 'narrative' as kind, case when p_size % 4 = 0 then '' else 'parts:' || p_brand end as linked from part
union all select 'table:' || dept || ':parts', 'table_card', 'parts:' || dept from c where dept in (select p_brand from part where p_size % 4 <> 0)
union all select 'chart:-:' || p_type, 'chart_card', '' from (select distinct p_type from part)""")
def cards_beside_passages(spark, sf):
    """Parts as passages of their brand's department, a table card for each brand, a chart card for each type, in one table."""
    p = table(spark, sf, "part")
    brand = F.when(F.col("p_size") % 4 != 0, F.col("p_brand"))
    rows = p.where(F.col("p_size") % 4 != 0).select(F.col("p_brand").alias("dept"), B.cite("summary", F.col("p_partkey"), F.lit(1)))
    names = p.select(F.col("p_brand").alias("slug"), F.col("p_brand").alias("name")).distinct()
    tables = P.table_cards(rows, "parts", F.lit("parts"), names)
    charts = P.chart_cards(p.groupBy(F.col("p_type").alias("key")).agg(F.min("p_partkey").cast("int").alias("page")).select("key", "page", F.lit("parts").alias("basis"), F.col("key").alias("text")))
    passages = p.select(F.concat(F.lit("narrative:"), F.col("p_partkey").cast("string")).alias("id"), brand.alias("dept"), F.lit("narrative").alias("kind"))
    every = P.all_cards([P.linked_tables(passages, tables), tables, charts])
    return every.select("id", "kind", F.array_join("linked_tables", ",").alias("linked"))


# --- Words and numbers -----------------------------------------------------------------------------------------------------------


@query("printed_amounts", f"""with a as (select c_custkey, {CENTS.format('c_acctbal')} as v from customer)
select c_custkey, v as dollars, case when c_custkey % 6 = 0 then null else v end as slot, true as is_slot, case when c_custkey % 4 <> 0 then (case when v >= 0 then '+' else '−' end) || printf('%.1f%%', abs(v::double / (c_custkey % 4)) * 100) end as change from a""")
def printed_amounts(spark, sf):
    """Balances as the books print them: dollar signs, brackets for less than nothing, square brackets and stars for the second
    reader, dashes for nothing; and the change of an amount in percent."""
    c = table(spark, sf, "customer")
    v, key = B.cents("c_acctbal"), F.col("c_custkey")
    plain = F.format_number(F.abs(v), 0)
    dollars = F.when(v < 0, F.concat(F.lit("("), plain, F.lit(")"))).otherwise(F.concat(F.lit("$"), plain))
    slot = F.when(key % 6 == 0, "—").otherwise(F.concat(F.when(v < 0, F.concat(F.lit("[("), plain, F.lit(")]"))).otherwise(F.concat(F.lit("["), plain, F.lit("]"))), F.when(key % 2 == 0, "*").otherwise("")))
    before = key % 4
    return c.select("c_custkey", numbers.parse_dollars(dollars).alias("dollars"), numbers.slot_value(slot).cast("long").alias("slot"), numbers.is_slot(slot).alias("is_slot"),
                    money.percent_text(before, before + v).alias("change"))


@query("printed_words", r"""select p_partkey, p_name || ' (A)' as description, '1UX' as pay, array_to_string(regexp_extract_all(lower(p_name || ', ' || p_type), '[a-z0-9]+'), ' or ') as any_words,
  p_size % 2 = 0 as labelled from part""")
def printed_words(spark, sf):
    """Descriptions with a pay range stuck to them, any-word searches, and labels sought on a line by their first two words."""
    p = table(spark, sf, "part")
    raw = F.concat("p_name", F.lit(" (A)1UX"))
    line = F.concat(F.lit("12. "), F.upper("p_name"), F.lit(" -- and more"))
    return p.select("p_partkey", X.glued_pay_range(raw, 1).alias("description"), X.glued_pay_range(raw, 2).alias("pay"), X.any_words(F.concat_ws(", ", "p_name", "p_type")).alias("any_words"),
                    X.label_hit(line, F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.lit("No such label"))).alias("labelled"))


@query("hearing_times", """select event_id, strftime(ts + interval 5 hours, '%Y%m%dT%H%M%SZ') as stamp from events""")
def hearing_times(spark, sf):
    """Event times written with an offset of five hours, read back as moments."""
    e = table(spark, sf, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'-05:00'").alias("start"))
    return e.select("event_id", dates.utc_stamp(dates.offset_to_utc(F.col("start"))).alias("stamp"))


# --- Streams -------------------------------------------------------------------------------------------------------------------------


@query("daily_cap_stream", """with d as (select event_id, ts, strftime(timezone('America/Chicago', ts at time zone 'UTC'), '%Y-%m-%d') as day from events)
select event_id, day, row_number() over (partition by day order by ts, event_id) <= 100 as allowed from d""")
def daily_cap_stream(spark, sf):
    """The daily cap on the event table read as a stream, written to the shared folder and read back."""
    root = f"{checkpoint_root(spark)}/cap-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    asked = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    run = Q.daily_cap_stream(asked, 100).writeStream.format("parquet").option("checkpointLocation", f"{root}/state").option("path", f"{root}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema("day date, event_id long, ts timestamp, allowed boolean").parquet(f"{root}/out")
    return out.select("event_id", F.col("day").cast("string").alias("day"), "allowed")


# --- Position changes without borders -------------------------------------------------------------------------------------------

PER_PAGE = 10
PART_ROWS = 10_000  # parts whose words or cells are in one task


def dealt_parts(spark, sf):
    """Parts by page.  A part becomes some forty words: the number of tasks follows the parts, not their few bytes."""
    p = table(spark, sf, "part")
    return p.repartition(1 + p.count() // PART_ROWS, F.floor(F.col("p_partkey") / PER_PAGE))


def change_pages(spark, sf):
    """Ten parts to a page, printed as position changes without borders.  Three pages share a layout, the third prints no header
    again; every layout lies elsewhere.  A page opens with a group heading.  A reason starts above its numbers, unless it is
    the first, and goes on beneath them; every second title stands beneath its numbers."""
    p = dealt_parts(spark, sf).withColumn("page", F.floor(F.col("p_partkey") / PER_PAGE))
    page, i = F.col("page"), F.col("p_partkey") % PER_PAGE
    layout = F.floor(page / 3)
    shift = layout % 5 * 7.0
    wide = shift + F.when(layout % 2 == 1, 40.0).otherwise(0.0)
    top = i * 30.0 + 120

    def say(text, x, y):
        return F.transform(F.split(text, " "), lambda t, k: F.struct(t.alias("text"), (x + k * 22.0).alias("x0"), (x + k * 22.0 + 20).alias("x1"), y.alias("top")))

    number = lambda text, x: F.array(F.struct(text.cast("string").alias("text"), (x + shift).alias("x0"), (x + shift + 15).alias("x1"), top.alias("top")))
    even = F.col("p_size") % 2 == 0
    none = F.array().cast("array<struct<text:string,x0:double,x1:double,top:double>>")
    rows = p.select("page", F.inline(F.concat(
        number(F.col("p_size"), 50.0), number(F.lit("-"), 90.0), number(F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(".50)")), 130.0),
        say(F.col("p_name"), 200.0 + wide, F.when(even, top + 10).otherwise(top)),
        say(F.concat(F.lit("adds "), "p_brand"), 330.0 + wide, top), say(F.lit("for good ends."), 330.0 + wide, top + 10),
        F.when(i > 0, say(F.concat(F.lit("Needed "), F.lower("p_type")), 330.0 + wide, top - 10)).otherwise(none))))
    pages = p.select("page").distinct()
    at = lambda text, x, y, w=20.0: F.struct(F.lit(text).alias("text"), (F.lit(x) + shift).alias("x0"), (F.lit(x) + shift + w).alias("x1"), F.lit(y).alias("top"))
    header = F.array(at("Positions", 45.0, 80.0, 25.0), at("FTEs", 88.0, 80.0), at("FTEs", 128.0, 80.0), *[F.struct(F.lit(t).alias("text"), (F.lit(x) + wide).alias("x0"),
                     (F.lit(x) + wide + 30).alias("x1"), F.lit(80.0).alias("top")) for t, x in (("Title", 240.0), ("Reason", 380.0))])
    intro = F.array(at("Specific", 40.0, 60.0), at("ADDITIONAL", 65.0, 60.0), at("positions", 95.0, 60.0))
    frame = pages.select("page", F.inline(F.concat(F.when(F.col("page") % 3 == 2, intro).otherwise(header), say(F.concat(F.lit("Group "), F.col("page").cast("string")), 200.0 + wide, F.lit(95.0)),
                                                   F.array(at("PROPOSED", 40.0, 600.0), at("PLAN", 65.0, 600.0), at("AND", 90.0, 600.0), at("EXECUTIVE", 115.0, 600.0)))))
    words = rows.unionByName(frame)
    return words.select(F.lit("summary").alias("doc"), "page", "text", "x0", "x1", "top", (F.col("top") + 8).alias("bottom"))


@query("borderless_changes", f"""select p_partkey // {PER_PAGE} as page, p_name as title, p_size::double as positions, null::double as om_ftes, -(p_size + 0.5)::double as non_om_ftes,
  case when p_partkey % {PER_PAGE} > 0 then 'Needed ' || lower(p_type) || ' ' else '' end || 'adds ' || p_brand || ' for good ends.' as reason, 'Group ' || (p_partkey // {PER_PAGE}) as "group", false as is_total from part""")
def borderless_changes(spark, sf):
    rows = D.borderless_position_changes(D.page_lines(change_pages(spark, sf)))
    return rows.select("page", "title", *[F.col(c).cast("double").alias(c) for c in ("positions", "om_ftes", "non_om_ftes")], "reason", "group", "is_total")


def part_cells(spark, sf):
    """A part as a bordered table on a page of its own: services, measures, position changes, a table that goes on with those of
    the page before without a header, or something else."""
    p = dealt_parts(spark, sf)
    key = F.col("p_partkey")
    five = F.array(key.cast("string"), F.lit("1.00"), F.lit("-"), F.col("p_name"), F.lit("New position"))
    what = F.col("p_partkey") % 5
    rows = (F.when(what == 0, F.array(F.array(F.lit("Description of Services Provided"), F.lit("Operating"), F.lit("FTEs")), F.array(F.col("p_name"), F.lit("$1,234"), F.lit("5.50"))))
            .when(what == 1, F.array(F.array(F.lit("Key Performance Measures"), F.lit("2024 Actual"), F.lit("2025")), F.array(F.concat("p_name", F.lit(" • A • B")), F.lit("1 2"), F.lit("3 4"))))
            .when(what == 2, F.array(F.array(F.lit("Positions"), F.lit("O&M"), F.lit("Other"), F.lit("Position Title"), F.lit("Reason")), five))
            .when(what == 3, F.array(five)).otherwise(F.array(F.array(F.concat(F.lit("What is "), "p_name")))))
    return p.select(F.lit("summary").alias("doc"), key.alias("page"), F.lit(0).alias("table_no"), F.posexplode(rows).alias("row_no", "cells"))


@query("unknown_tables", "select p_partkey as page, 'What is ' || p_name as head from part where p_partkey % 5 = 4")
def unknown_tables(spark, sf):
    return D.unknown_tables(D.table_kinds(part_cells(spark, sf))).select("page", "head")


@query("all_position_changes", f"""select p_partkey as page, p_name as title, p_partkey::double as positions, 'new_funded' as reason_category, true as bordered from part where p_partkey % 5 in (2, 3) and p_partkey > 2
union all select p_partkey, p_name, p_partkey::double, 'new_funded', true from part where p_partkey = 2
union all select p_partkey // {PER_PAGE}, p_name, p_size::double, 'other', false from part where (p_partkey // {PER_PAGE}) % 5 not in (2, 3) or (p_partkey // {PER_PAGE}) < 2""")
def all_position_changes(spark, sf):
    """Bordered tables, and on pages without one the rows printed without borders."""
    rows = D.all_position_changes(part_cells(spark, sf), D.page_lines(change_pages(spark, sf)))
    return rows.select("page", "title", F.col("positions").cast("double").alias("positions"), "reason_category", "bordered")


@query("measure_rows", """select p_partkey as page, unnest(['A', 'B']) as measure, p_name as "group", unnest(['1,3', '2,4']) as "values" from part where p_partkey % 5 = 1""")
def measure_rows(spark, sf):
    """Measures packed into one cell with bullets, a row each with its values."""
    c = part_cells(spark, sf)
    return D.kpis(c, D.table_kinds(c)).select("page", "measure", "group", F.array_join("values", ",").alias("values"))
