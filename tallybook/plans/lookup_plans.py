"""Lookups over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.operators import lookups as L
from tallybook.operators.joins import range_join
from tallybook.plans import bindings as B
from tallybook.plans.registry import query, table

DOUBLE = "double"

# Shared oracle pieces -------------------------------------------------------------------------------------------------
CENTS = "cast(floor({0} * 100 + 0.5) as bigint)"
STAGE_SUMS = ", ".join(
    f"cast(sum(case when yr = {y} then amount end) as bigint) as {s}" for y, s in B.STAGE_BY_YEAR.items())
SPEND = f"""spend as (select o_orderstatus as v, c_nationkey, c_mktsegment, o_orderpriority, o_orderkey,
    {B.STAGE_YEAR.format('o_orderdate')} as yr, {CENTS.format('o_totalprice')} as amount
  from orders join customer on o_custkey = c_custkey)"""
METRIC = "case o_orderpriority " + " ".join(f"when '{p}' then '{m}'" for p, m in B.PRIORITY_METRIC.items()) + " end"
DEPT_SUMMARY = f"""{SPEND}, ds as (
  select v, n_nationkey, lower(n_name) as dept, n_name, n_regionkey, metric, {STAGE_SUMS}
  from (select *, {METRIC} as metric from spend
        union all select *, 'total_expenditures' from spend) s
  join nation on n_nationkey = c_nationkey group by all)"""
LETTER = "(['A', 'B', 'C', 'D', 'F'])[n_regionkey + 1]"
SECTION_TOTALS = f"""parts as (
  select l_returnflag as v, {LETTER} as letter, case when l_linestatus = 'O' then 'levy' else 'non_levy' end as part,
    {B.STAGE_YEAR.format('l_shipdate')} as yr, {CENTS.format('l_extendedprice')} as amount
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  where {B.STAGE_YEAR.format('l_shipdate')} in (1996, 1998)),
spread as (select v, unnest([letter, 'SUBTOTAL_ABCDF', 'TOTAL']) as section, part, yr, amount from parts),
lined as (select v, section, unnest([part, 'budget']) as line, yr, amount from spread),
st as (select v, section, line, cast(sum(case when yr = 1996 then amount end) as bigint) as adopted,
    cast(sum(case when yr = 1998 then amount end) as bigint) as proposed from lined group by all)"""


def pct(change: str, base: str) -> str:
    return (f"case when {base} <> 0 then floor(cast({change} as double) / cast({base} as double) * 1000 + 0.5) / 10 end")


def rate(amount: str) -> str:
    return f"floor(cast({amount} as double) / 1000000 + 0.5) / 100"


@query("dept_totals", f"""with {DEPT_SUMMARY}
select v as budget_version, dept as slug, n_name as name, actual_2025, adopted_2026, requested_2027, proposed_2027,
  proposed_2027 - adopted_2026 as change_from_adopted, proposed_2027 - requested_2027 as change_from_request,
  {pct('(proposed_2027 - adopted_2026)', 'adopted_2026')} as percent_change_from_adopted
from ds where metric = 'total_expenditures' and adopted_2026 is not null and requested_2027 is not null
  and proposed_2027 is not null""")
def dept_totals(spark, sf):
    return L.department_totals(B.dept_summary(spark, sf), B.departments(spark, sf), section=None).drop("short_name", "cite")


@query("headline", f"""with {SECTION_TOTALS}
select v as budget_version,
  max(case when section = 'TOTAL' and line = 'budget' then adopted end) as all_funds_adopted_2026,
  max(case when section = 'TOTAL' and line = 'budget' then proposed end) as all_funds_proposed_2027,
  max(case when section = 'A' and line = 'budget' then adopted end) as gcp_adopted_2026,
  max(case when section = 'A' and line = 'budget' then proposed end) as gcp_proposed_2027,
  max(case when section = 'TOTAL' and line = 'levy' then adopted end) as levy_adopted_2026,
  max(case when section = 'TOTAL' and line = 'levy' then proposed end) as levy_proposed_2027,
  max(case when section = 'TOTAL' and line = 'levy' then {rate('adopted')} end) as rate_2026,
  max(case when section = 'TOTAL' and line = 'levy' then {rate('proposed')} end) as rate_2027
from st group by v""")
def headline(spark, sf):
    out = L.headline(B.section_totals(spark, sf))
    return (out.drop("all_funds_cite", "gcp_cite", "levy_cite").withColumn("rate_2026", F.col("rate_2026").cast(DOUBLE))
            .withColumn("rate_2027", F.col("rate_2027").cast(DOUBLE)))


FIVE = [(s, f"Section {s}", s) for s in B.REGION_SECTION]


@query("section_budgets", f"""with {SECTION_TOTALS}
select b.v as budget_version, b.section, 'Section ' || b.section as name, b.adopted as adopted_2026,
  b.proposed as proposed_2027, {rate('l.proposed')} as tax_rate_2027, l.proposed as levy_2027
from st b join st l on b.v = l.v and b.section = l.section
where b.line = 'budget' and l.line = 'levy' and length(b.section) = 1""")
def section_budgets(spark, sf):
    out = L.section_budgets(B.section_totals(spark, sf), names=FIVE)
    return out.drop("short", "cite").withColumn("tax_rate_2027", F.col("tax_rate_2027").cast(DOUBLE))


@query("section_changes", f"""with {SECTION_TOTALS}, w as (
  select v, section, max(case when line = 'budget' then adopted end) as b0, max(case when line = 'budget' then proposed end) as b1,
    max(case when line = 'levy' then adopted end) as l0, max(case when line = 'levy' then proposed end) as l1,
    max(case when line = 'non_levy' then adopted end) as o0, max(case when line = 'non_levy' then proposed end) as o1
  from st group by all)
select w.v as budget_version, w.section, b0 as budget_2026, b1 as budget_2027, l0 as levy_2026, l1 as levy_2027,
  o0 as other_money_2026, o1 as other_money_2027, b1 - b0 as budget_change, l1 - l0 as levy_change,
  {pct('(b1 - b0)', 'b0')} as budget_percent_change, {pct('(l1 - l0)', 'l0')} as levy_percent_change,
  {pct('l1', 't.proposed')} as levy_share_percent_2027
from w join st t on t.v = w.v and t.section = 'SUBTOTAL_ABCDF' and t.line = 'levy'""")
def section_changes(spark, sf):
    return L.budget_sections(B.section_totals(spark, sf)).drop("label", "cite", "rate_2026", "rate_2027", "rate_change")


MIX = [("urgent", "Urgent and high", ["1-URGENT", "2-HIGH"]), ("medium", "Medium", ["3-MEDIUM"]),
       ("rest", "Everything later", ["4-NOT SPECIFIED", "5-LOW"])]


@query("revenue_mix", f"""with {SPEND}
select v as budget_version, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'urgent'
    when o_orderpriority = '3-MEDIUM' then 'medium' else 'rest' end as key,
  cast(sum(case when yr = 1996 then amount else 0 end) as bigint) as adopted_2026,
  cast(sum(case when yr = 1998 then amount else 0 end) as bigint) as proposed_2027
from spend where c_mktsegment = 'BUILDING' group by all""")
def revenue_mix(spark, sf):
    return L.revenue_mix(B.revenues(spark, sf), fund="building", mix=MIX).drop("label", "cite")


@query("revenues_by_fund", f"""with {SPEND}, r as (select v, lower(c_mktsegment) as fund, o_orderpriority as line, {STAGE_SUMS}
  from spend group by all)
select v as budget_version, fund, line, line < '3' as is_total, adopted_2026, requested_2027, proposed_2027,
  proposed_2027 - adopted_2026 as change_from_adopted, proposed_2027 - requested_2027 as change_from_request,
  {pct('(proposed_2027 - adopted_2026)', 'adopted_2026')} as percent_change_from_adopted
from r where fund <> 'building' or line < '3' or regexp_matches(line, '(?i)urgent|low')""")
def revenues_by_fund(spark, sf):
    rows = B.revenues(spark, sf)
    named = rows.withColumn("line", F.when(F.col("line") == "5-LOW", "5-LOW levy").otherwise(F.col("line")))
    out = L.revenues_of_fund(named, fund=None, totals_only_for="building")
    return out.withColumn("line", F.regexp_replace("line", " levy$", "")).drop("category", "cite")


@query("revenue_line_by_fund", f"""with {SPEND}, r as (select v, lower(c_mktsegment) as fund, o_orderpriority as line, {STAGE_SUMS}
  from spend group by all)
select v as budget_version, fund, line, adopted_2026, requested_2027, proposed_2027 from r where line = '3-MEDIUM'""")
def revenue_line_by_fund(spark, sf):
    return L.revenue_line_by_fund(B.revenues(spark, sf), "3-MEDIUM").drop("cite")


METRIC_ROWS = ", ".join(f"('{m}', {i}, '{label}', '{unit}')" for i, (m, label, unit) in enumerate(L.V.METRICS))


@query("department_breakdown", f"""with {DEPT_SUMMARY}, m(metric, ordinal, label, unit) as (values {METRIC_ROWS})
select v as budget_version, dept, n_name as name, cast(ordinal as integer) as ordinal, metric, label, unit, actual_2025,
  adopted_2026, requested_2027, proposed_2027, proposed_2027 - adopted_2026 as change_from_adopted,
  proposed_2027 - requested_2027 as change_from_request,
  {pct('(proposed_2027 - adopted_2026)', 'adopted_2026')} as percent_change_from_adopted
from ds join m using (metric)""")
def department_breakdown(spark, sf):
    return L.department_breakdown(B.dept_summary(spark, sf), B.departments(spark, sf)).drop("cite")


@query("movers", f"""with {DEPT_SUMMARY}, c as (select v, dept, proposed_2027 - adopted_2026 as change from ds
  where metric = 'total_expenditures' and adopted_2026 is not null and requested_2027 is not null and proposed_2027 is not null),
r as (select v, dept, change, 'up' as direction, row_number() over (partition by v order by change desc, dept) as rank
    from c where change > 0
  union all select v, dept, change, 'down', row_number() over (partition by v order by change, dept) from c where change < 0)
select v as budget_version, dept as slug, change, direction, cast(rank as integer) as rank from r where rank <= 5""")
def movers(spark, sf):
    rows = L.department_totals(B.dept_summary(spark, sf), B.departments(spark, sf), section=None)
    return L.movers(rows, L.diff("adopted_2026", "proposed_2027")).select(
        "budget_version", "slug", "change", "direction", "rank")


@query("top_shares_rest", f"""with b as (select l_linestatus as v, p_brand, cast(sum({CENTS.format('l_extendedprice')}) as bigint) as amount
  from lineitem join part on l_partkey = p_partkey group by all),
t as (select v, cast(sum(amount) as bigint) as total from b group by v),
r as (select *, row_number() over (partition by v order by amount desc, p_brand) as rank from b),
h as (select v, cast(rank as integer) as rank, p_brand as label, amount from r where rank <= 5)
select v as budget_version, rank, label, amount, {pct('amount', 'total')} as share_percent from (
  select * from h union all select t.v, 6, 'Everything else', total - cast((select sum(amount) from h where h.v = t.v) as bigint)
  from t) join t using (v)""")
def top_shares_rest(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_linestatus", "l_extendedprice")
    # Summed by part before the join: the shuffle carries one row per part and status, not one per line.
    per_part = li.groupBy("l_partkey", F.col("l_linestatus").alias("budget_version")).agg(
        F.sum(B.cents("l_extendedprice")).alias("amount"))
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    brands = per_part.join(p, per_part.l_partkey == p.p_partkey).groupBy(
        "budget_version", F.col("p_brand").alias("label")).agg(F.sum("amount").alias("proposed_2027"))
    total = per_part.groupBy("budget_version").agg(F.sum("amount").alias("total"))
    return L.section_shares(brands, total)


@query("section_grand_total", f"""with {SECTION_TOTALS}, s as (select v, section, adopted, proposed from st
  where line = 'budget' and length(section) = 1)
select v as budget_version, section, cast(sum(adopted) as bigint) as adopted_2026, cast(sum(proposed) as bigint) as proposed_2027, false as is_total
from s group by v, section
union all select v, 'Total', cast(sum(adopted) as bigint), cast(sum(proposed) as bigint), true from s group by v""")
def section_grand_total(spark, sf):
    rows = L.section_budgets(B.section_totals(spark, sf), names=FIVE)
    return L.with_grand_total(rows, "section", ["adopted_2026", "proposed_2027"])


@query("gcp_reconciliation", f"""with {SPEND},
sp as (select v, cast(sum(case when yr = 1996 then amount end) as bigint) as a, cast(sum(case when yr = 1998 then amount end) as bigint) as p
  from spend where c_mktsegment = 'MACHINERY' group by v),
o as (select v, cast(sum(case when yr = 1996 then amount end) as bigint) as a, cast(sum(case when yr = 1998 then amount end) as bigint) as p
  from spend where c_mktsegment <> 'MACHINERY' group by v)
select v as budget_version, sp.a as special_purpose_adopted_2026, sp.p as special_purpose_proposed_2027,
  -o.a as fringe_offset_adopted_2026, -o.p as fringe_offset_proposed_2027, sp.a + o.a as total_2026, sp.p + o.p as total_2027
from sp join o using (v)""")
def gcp_reconciliation(spark, sf):
    part = F.when(F.col("c_mktsegment") == "MACHINERY", "special").otherwise("offset")
    sums = B.order_spend(spark, sf).groupBy("budget_version", part.alias("part")).agg(
        *B.stage_sums(F.col("year"), F.col("amount")))
    c = B.cite("summary", F.lit(155), F.lit(1))
    lines = sums.where("part = 'special'").select("budget_version", F.lit("400").alias("section"),
                                                  F.lit("TOTAL SPECIAL PURPOSE ACCOUNTS").alias("description"),
                                                  "adopted_2026", "proposed_2027", c)
    offset = sums.where("part = 'offset'").select(
        "budget_version", F.lit("fringe-benefit-offset").alias("dept"), F.lit("total_expenditures").alias("metric"),
        (-F.col("adopted_2026")).alias("adopted_2026"), (-F.col("proposed_2027")).alias("proposed_2027"), c)
    return (L.gcp_reconciliation(lines, offset).drop("special_purpose_cite", "fringe_offset_cite")
            .withColumn("total_2026", F.col("special_purpose_adopted_2026") - F.col("fringe_offset_adopted_2026"))
            .withColumn("total_2027", F.col("special_purpose_proposed_2027") - F.col("fringe_offset_proposed_2027")))


LINE_STAGES = ", ".join(f"case when {B.STAGE_YEAR.format('l_shipdate')} = {y} then {CENTS.format('l_extendedprice')} end as {s}"
                        for y, s in B.STAGE_BY_YEAR.items())
LINE_ITEMS = f"""li as (select lower(n_name) as slug, n_name, p_name as description, lpad(p_partkey::varchar, cast(greatest(6, length(p_partkey::varchar)) as integer), '0') as account,
    {LINE_STAGES}, l_orderkey, l_linenumber, l_returnflag, p_brand, p_type
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey)"""
GROUPED = """select 'F' as budget_version, slug, n_name as dept_name, count(*) as line_count,
  cast(sum(coalesce(adopted_2026, 0)) as bigint) as adopted_2026, cast(sum(coalesce(requested_2027, 0)) as bigint) as requested_2027,
  cast(sum(coalesce(proposed_2027, 0)) as bigint) as proposed_2027,
  cast(sum(coalesce(proposed_2027, 0)) - sum(coalesce(adopted_2026, 0)) as bigint) as change_from_adopted,
  cast(sum(coalesce(proposed_2027, 0)) - sum(coalesce(requested_2027, 0)) as bigint) as change_from_request,
  cast(min(l_orderkey) as integer) as first_page
from li where l_returnflag <> 'R' and {0} group by slug, n_name"""


@query("line_search_grouped", f"with {LINE_ITEMS} " + GROUPED.format("description ilike '%gear%'"))
def line_search_grouped(spark, sf):
    out = L.search_lines_by_department(B.line_items(spark, sf), B.departments(spark, sf), "gear")
    return out.withColumn("first_page", F.col("cite.pdf_page")).drop("cite")


@query("line_search_account", f"with {LINE_ITEMS} " + GROUPED.format("account like '0001%'"))
def line_search_account(spark, sf):
    out = L.search_lines_by_department(B.line_items(spark, sf), B.departments(spark, sf), "0001")
    return out.withColumn("first_page", F.col("cite.pdf_page")).drop("cite")


@query("line_search_one", f"""with {LINE_ITEMS}
select 'F' as budget_version, slug, n_name as dept_name, description, account, actual_2025, adopted_2026, requested_2027,
  proposed_2027, proposed_2027 - adopted_2026 as change_from_adopted, proposed_2027 - requested_2027 as change_from_request
from li where l_returnflag <> 'R' and description ilike '%rod%' and slug = 'nation_3'
order by l_orderkey, l_linenumber, description, account, actual_2025, adopted_2026, requested_2027, proposed_2027 limit 40""")
def line_search_one(spark, sf):
    rows = B.line_items(spark, sf)
    out = L.matching_lines(rows, B.departments(spark, sf), "rod", "nation_3")
    stages = list(L.STAGES)
    # (page, line) is not unique in these tables, so the figures break the tie.
    return out.orderBy(L.position(), "description", "account", *stages).limit(40).select(
        "budget_version", "slug", "dept_name", "description", "account", *stages,
        L.diff("adopted_2026", "proposed_2027").alias("change_from_adopted"),
        L.diff("requested_2027", "proposed_2027").alias("change_from_request"))


@query("project_search", """select lower(n_name) as dept, n_name as dept_name, p_name as name,
  case when p_size > 40 then null else cast(floor(p_retailprice * 100 + 0.5) as bigint) end as amount, p_type as description,
  case when p_size > 40 then 'The budget prints this as "' || p_brand || '", so the amount is unclear.' end as note, p_partkey
from part left join nation on n_nationkey = p_size
where p_name ilike '%widget%' or p_type ilike '%widget%' or n_name ilike '%widget%'""")
def project_search(spark, sf):
    p, n = table(spark, sf, "part"), table(spark, sf, "nation")
    named = p.join(n, p.p_size == n.n_nationkey, "left")
    projects = named.select(
        F.lit("F").alias("budget_version"), F.lower("n_name").alias("dept"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") <= 40, B.cents("p_retailprice")).alias("amount"), F.col("p_brand").alias("amount_text"),
        F.col("p_type").alias("description"), F.lit("project").alias("kind"),
        B.cite("summary", F.col("p_partkey"), F.lit(1)))
    out = L.capital_projects(projects, B.departments(spark, sf), query="widget")
    return out.withColumn("p_partkey", F.col("cite.pdf_page").cast("long")).drop("budget_version", "amount_text", "cite")


@query("vocabulary", f"""with {LINE_ITEMS}, k as (
  select 'account' as kind, account || '|' || description as key, description as label, account as code, slug from li
  union all select 'position_title', description, description, null, slug from li
  union all select 'org_unit', p_brand, p_brand, null, slug from li)
select kind, min(label) as label, min(code) as code, array_to_string(list_sort(list(distinct slug)), '|') as dept_ids,
  count(*) as occurrences from k group by kind, key""")
def vocabulary(spark, sf):
    rows = B.line_items(spark, sf).join(
        B.departments(spark, sf).where("budget_version = 'F'").select(
            F.col("slug").alias("dept"), F.explode("detailed").alias("section")), "section")
    brand = rows.withColumn("description", F.col("org"))
    out = L.vocabulary(rows, "account", ["account", "description"], "account").unionByName(
        L.vocabulary(rows, "position_title", ["description"])).unionByName(L.vocabulary(brand, "org_unit", ["description"]))
    return out.select("kind", "label", "code", F.array_join("dept_ids", "|").alias("dept_ids"), "occurrences")


@query("crosswalk", f"""with {LINE_ITEMS}, n as (select lower(n_name) as slug, n_nationkey * 5 + 1 as first_page,
    coalesce(lead(n_nationkey * 5 + 1) over (order by n_nationkey), 215) - 1 as last_page, n_nationkey from nation),
c as (select slug, array_to_string(list_sort(list(distinct p_brand)), '|') as org_codes,
    array_to_string(list_sort(list(distinct p_type)), '|') as fund_codes from li group by slug)
select slug, first_page, last_page, 'd' || n_nationkey as detailed, coalesce(org_codes, '') as org_codes,
  coalesce(fund_codes, '') as fund_codes from n left join c using (slug)""")
def crosswalk(spark, sf):
    depts = B.departments(spark, sf).where("budget_version = 'F'")
    out = L.crosswalk(depts, B.line_items(spark, sf))
    return out.select("slug", "first_page", "last_page", F.array_join("detailed_page_prefix", ",").alias("detailed"),
                      F.array_join("org_codes", "|").alias("org_codes"), F.array_join("fund_codes", "|").alias("fund_codes"))


@query("page_ranges", """with s as (select source, min(doc_id) as first_page from documents group by source),
r as (select source as slug, first_page, lead(first_page) over (order by first_page, source) - 1 as last_page from s)
select doc_id, slug, first_page from documents join r on doc_id >= first_page and (last_page is null or doc_id <= last_page)""")
def page_ranges(spark, sf):
    """Documents in the range of the source whose first document comes last before them; the last range is open."""
    pages = table(spark, sf, "documents").select("doc_id", F.lit("d").alias("budget_version"))
    ranges = L.page_ranges(B.document_departments(spark, sf), None)
    return range_join(pages, ranges, ["budget_version"], "doc_id", "first_page", "last_page").select("doc_id", "slug", "first_page")


@query("topic_figures", f"""with {DEPT_SUMMARY}, x as (select v, dept, adopted_2026, proposed_2027 from ds where metric = 'total_expenditures'
  and adopted_2026 is not null and requested_2027 is not null and proposed_2027 is not null),
{SECTION_TOTALS}
select v as budget_version, 'departments' as topic, dept as key, cast(adopted_2026 as double) as adopted_2026,
  cast(proposed_2027 as double) as proposed_2027, 'dollars' as kind from x
union all select v, 'sections', section, adopted, proposed, 'dollars' from st where line = 'budget' and length(section) = 1
union all select v, 'taxes-fees', 'levy', adopted, proposed, 'dollars' from st where line = 'levy' and section = 'TOTAL'
union all select v, 'taxes-fees', 'rate', {rate('adopted')}, {rate('proposed')}, 'rate' from st where line = 'levy' and section = 'TOTAL'
union all select 'F', 'projects', p_name, null, max(floor(p_retailprice * 100 + 0.5)), 'dollars' from part group by p_name""")
def topic_figures(spark, sf):
    totals = L.department_totals(B.dept_summary(spark, sf), B.departments(spark, sf), section=None)
    st = B.section_totals(spark, sf)
    sections, heads = L.section_budgets(st, names=FIVE), L.headline(st)
    projects = table(spark, sf, "part").groupBy(F.col("p_name").alias("name")).agg(
        F.max(B.cents("p_retailprice")).alias("amount")).withColumn("budget_version", F.lit("F")).withColumn(
        "cite", B.cite("summary", F.lit(1), F.lit(1)))
    fees = projects.select("budget_version", F.col("name").alias("fee"), F.col("amount").alias("value_2026"),
                           F.col("amount").alias("value_2027"), "cite").where("false")
    topics = totals.select("budget_version", F.lit("departments").alias("topic"), F.lit("department").alias("source"), F.col("slug").alias("key")).distinct()
    topics = topics.unionByName(sections.select("budget_version", F.lit("sections").alias("topic"), F.lit("section").alias("source"),
                                                F.col("section").alias("key")).distinct())
    topics = topics.unionByName(projects.select("budget_version", F.lit("projects").alias("topic"), F.lit("project").alias("source"),
                                                F.col("name").alias("key")))
    topics = topics.unionByName(heads.select("budget_version", F.lit("taxes-fees").alias("topic"), F.lit("headline").alias("source"),
                                             F.explode(F.array(F.lit("levy"), F.lit("rate"))).alias("key")))
    topics = topics.withColumn("ordinal", F.lit(1)).withColumn("label", F.col("key"))
    out = L.topic_figures(topics, heads, sections, totals, fees, projects)
    return out.select("budget_version", "topic", "key", F.col("adopted_2026").cast(DOUBLE).alias("adopted_2026"),
                      F.col("proposed_2027").cast(DOUBLE).alias("proposed_2027"), "kind")
