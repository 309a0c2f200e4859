"""Budget lookups.  Each works on every budget version at once and keeps the citation of every figure."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook import fixed_values as V
from tallybook.functions.numbers import changes, percent_change
from tallybook.functions.text import like_pattern
from tallybook.schema import STAGES

VERSION = "budget_version"


def position(cite: str = "cite") -> Column:
    """Reading order of a cited row: what 'first' means for a table without row order."""
    return F.struct(f"{cite}.doc", f"{cite}.pdf_page", f"{cite}.line_no")


def scoped(df: DataFrame, version: str | None) -> DataFrame:
    return df if version is None else df.where(F.col(VERSION) == version)


def required(value: Column, what: str) -> Column:
    """Stop the job when a figure the answer cannot do without is missing."""
    return F.coalesce(value, F.raise_error(F.lit(f"missing: {what}")))


def first_where(value: Column, cond: Column, order: Column | None = None) -> Column:
    return F.min_by(value, F.when(cond, position() if order is None else order))


def _known(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """One row per version and entry of a fixed list, so an entry with no data shows up as NULL."""
    entries = F.array(*[F.struct(*[_literal(x).alias(n) for x, n in zip(r, names)]) for r in rows])
    return df.select(VERSION).distinct().select(VERSION, F.inline(entries))


def _literal(x) -> Column:
    return F.array(*[F.lit(v) for v in x]) if isinstance(x, list) else F.lit(x)


def diff(a: str, b: str) -> Column:
    """b - a, NULL when either is."""
    return F.col(b) - F.col(a)


# --- Overview ---------------------------------------------------------------------------------------------------------


def headline(section_totals: DataFrame, version: str | None = None, all_funds: str = "TOTAL", general: str = "A",
             levy_section: str = "TOTAL") -> DataFrame:
    """The budget of all funds and of general purposes, the levy and its rate; one row per version."""
    rows = scoped(section_totals, version).where(F.col("section").isin(all_funds, general, levy_section))
    cells = [("all_funds", all_funds, "budget"), ("gcp", general, "budget"), ("levy", levy_section, "levy")]
    picks = [first_where(F.struct("adopted_2026", "proposed_2027", "tax_rate_2026", "tax_rate_2027", "cite"),
                         (F.col("section") == s) & (F.col("line") == line)).alias(name) for name, s, line in cells]
    got = rows.groupBy(VERSION).agg(*picks)
    out = [F.col(VERSION)]
    for name, s, line in cells:
        for stage in ("adopted_2026", "proposed_2027"):
            out.append(required(F.col(f"{name}.{stage}"), f"section {s} {line}").alias(f"{name}_{stage}"))
        out.append(F.col(f"{name}.cite").alias(f"{name}_cite"))
    out += [F.col("levy.tax_rate_2026").alias("rate_2026"), F.col("levy.tax_rate_2027").alias("rate_2027")]
    return got.select(*out)


def section_budgets(section_totals: DataFrame, version: str | None = None, names: list[tuple] | None = None) -> DataFrame:
    """Each lettered section, no subtotals, so the rows add up to the total."""
    names = names or V.SECTIONS
    rows = scoped(section_totals, version).where(
        F.col("section").isin([n[0] for n in names]) & F.col("line").isin("budget", "levy"))
    budget, levy = F.col("line") == "budget", F.col("line") == "levy"
    got = rows.groupBy(VERSION, "section").agg(
        first_where(F.struct("adopted_2026", "proposed_2027", "cite"), budget).alias("b"),
        first_where(F.struct("tax_rate_2027", "proposed_2027"), levy).alias("l"))
    return (_known(section_totals, names, ["section", "name", "short"]).join(got, [VERSION, "section"], "left")
            .select(VERSION, "section", "name", "short",
                    F.coalesce(required(F.col("b"), "section budget")["adopted_2026"], F.lit(0)).alias("adopted_2026"),
                    F.coalesce(F.col("b.proposed_2027"), F.lit(0)).alias("proposed_2027"),
                    F.coalesce(required(F.col("l"), "section levy")["tax_rate_2027"], F.lit(0)).alias("tax_rate_2027"),
                    F.coalesce(F.col("l.proposed_2027"), F.lit(0)).alias("levy_2027"), F.col("b.cite").alias("cite")))


def budget_sections(section_totals: DataFrame, version: str | None = None,
                    levy_subtotal: str = V.LEVY_SUBTOTAL) -> DataFrame:
    """Every section and subtotal with budget, levy and other money side by side, changes and levy share; TOTAL last."""
    rows = scoped(section_totals, version).where(F.col("line").isin("budget", "levy", "non_levy"))

    def cell(line: str, value: str) -> Column:
        return first_where(F.struct(F.col(value).alias("v")), F.col("line") == line)["v"]

    wide = rows.groupBy(VERSION, "section").agg(
        F.coalesce(first_where(F.col("label"), F.col("line") == "budget"), F.min_by("label", position())).alias("label"),
        cell("budget", "adopted_2026").alias("budget_2026"), cell("budget", "proposed_2027").alias("budget_2027"),
        cell("levy", "adopted_2026").alias("levy_2026"), cell("levy", "proposed_2027").alias("levy_2027"),
        cell("levy", "tax_rate_2026").alias("rate_2026"), cell("levy", "tax_rate_2027").alias("rate_2027"),
        cell("non_levy", "adopted_2026").alias("other_money_2026"),
        cell("non_levy", "proposed_2027").alias("other_money_2027"),
        F.coalesce(first_where(F.col("cite"), F.col("line") == "budget"), F.min_by("cite", position())).alias("cite"))
    total = rows.where((F.col("section") == levy_subtotal) & (F.col("line") == "levy")).groupBy(VERSION).agg(
        F.min_by("proposed_2027", position()).alias("total_levy"))
    return (wide.join(total, VERSION, "left")
            .withColumn("budget_change", diff("budget_2026", "budget_2027"))
            .withColumn("levy_change", diff("levy_2026", "levy_2027"))
            .withColumn("rate_change", diff("rate_2026", "rate_2027"))
            .withColumn("budget_percent_change", percent_change(F.col("budget_change"), F.col("budget_2026")))
            .withColumn("levy_percent_change", percent_change(F.col("levy_change"), F.col("levy_2026")))
            .withColumn("levy_share_percent_2027", percent_change(F.col("levy_2027"), F.col("total_levy")))
            .drop("total_levy").orderBy(VERSION, F.col("section") == "TOTAL", "section"))


def revenue_mix(revenues: DataFrame, version: str | None = None, fund: str = "general", source: str = "summary",
                mix: list[tuple] | None = None) -> DataFrame:
    """Named buckets of printed revenue lines.  A bucket with a line missing stops the job."""
    mix = mix or V.REVENUE_MIX
    rows = scoped(revenues, version).where((F.col("source") == source) & (F.col("fund") == fund))
    wanted = _known(rows, [(k, label, lines) for k, label, lines in mix], ["key", "label", "lines"])
    per_line = rows.join(F.broadcast(_line_keys(rows.sparkSession, mix)), "line").groupBy(VERSION, "key").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("adopted_2026", F.lit(0))).alias("adopted_2026"),
        F.sum(F.coalesce("proposed_2027", F.lit(0))).alias("proposed_2027"), F.min_by("cite", position()).alias("cite"))
    complete = F.when(F.col("n") == F.size("lines"), F.col("proposed_2027"))
    return (wanted.join(per_line, [VERSION, "key"], "left")
            .select(VERSION, "key", "label", "adopted_2026",
                    required(complete, "a revenue line of the mix").alias("proposed_2027"), "cite"))


def _line_keys(spark, mix: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(line, key) for key, _, lines in mix for line in lines], "line string, key string")


def department_totals(dept_summary: DataFrame, departments: DataFrame, version: str | None = None,
                      section: str | None = "A", exclude: list[str] | None = None) -> DataFrame:
    """Total expenditures of each department over the four stages, printed changes and percent; largest first."""
    exclude = V.NOT_DEPARTMENTS if exclude is None else exclude
    depts = departments.where(~F.col("slug").isin(exclude)) if exclude else departments
    depts = depts.where(F.col("section") == section) if section else depts
    rows = scoped(dept_summary, version).where(F.col("metric") == "total_expenditures").dropna(
        subset=["adopted_2026", "requested_2027", "proposed_2027"])
    return (rows.join(depts.select(VERSION, "slug", "name", "short_name"),
                      (rows.dept == F.col("slug")) & (rows[VERSION] == depts[VERSION]))
            .select(rows[VERSION], "slug", "name", "short_name", *STAGES,
                    *changes(F.col("adopted_2026"), F.col("change_vs_adopted"), F.col("change_vs_requested")), "cite")
            .orderBy(VERSION, F.col("proposed_2027").desc(), "slug"))


def gcp_reconciliation(line_items: DataFrame, dept_summary: DataFrame, version: str | None = None,
                       section: str = V.SPECIAL_PURPOSE_SECTION, description: str = V.SPECIAL_PURPOSE_TOTAL,
                       offset_dept: str = V.OFFSET_DEPT) -> DataFrame:
    """The two lines between the departments' total and the general-purpose total."""
    special = scoped(line_items, version).where(
        (F.col("section") == section) & (F.col("description") == description)).groupBy(VERSION).agg(
        F.min_by(F.struct("adopted_2026", "proposed_2027", "cite"), position()).alias("special"))
    offset = scoped(dept_summary, version).where(
        (F.col("dept") == offset_dept) & (F.col("metric") == "total_expenditures")).groupBy(VERSION).agg(
        F.min_by(F.struct("adopted_2026", "proposed_2027", "cite"), position()).alias("offset"))
    both = special.join(offset, VERSION, "full")
    special, offset = required(F.col("special"), "special purpose total"), required(F.col("offset"), "offset total")
    return both.select(
        VERSION, *[part[stage].cast("long").alias(f"{name}_{stage}")
                   for name, part in (("special_purpose", special), ("fringe_offset", offset))
                   for stage in ("adopted_2026", "proposed_2027")],
        special["cite"].alias("special_purpose_cite"), offset["cite"].alias("fringe_offset_cite"))


def budget_fact(budget_facts: DataFrame, fact_id: str, version: str | None = None) -> DataFrame:
    return scoped(budget_facts, version).where(F.col("id") == fact_id).select(
        VERSION, "id", "statement", "cite", "reviewed_by")


def section_shares(sections: DataFrame, total: DataFrame, top: int = 5, amount: str = "proposed_2027",
                   label: str = "label", keys: list[str] | None = None) -> DataFrame:
    """The biggest entries plus everything else: the total less the entries shown.  total holds keys and 'total'."""
    keys = keys or [VERSION]
    rank = Window.partitionBy(*keys).orderBy(F.col(amount).desc(), label)
    head = sections.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).select(
        *keys, "rank", F.col(label).alias("label"), F.col(amount).alias("amount"))
    shown = head.groupBy(*keys).agg(F.sum("amount").alias("shown"))
    rest = total.join(shown, keys, "left").select(
        *keys, F.lit(top + 1).alias("rank"), F.lit("Everything else").alias("label"),
        (F.col("total") - F.coalesce("shown", F.lit(0))).alias("amount"))
    return head.unionByName(rest).join(total, keys).select(
        *keys, "rank", "label", "amount", percent_change(F.col("amount"), F.col("total")).alias("share_percent"))


def movers(rows: DataFrame, change: Column, n: int = 5, keys: list[str] | None = None, tie: str = "slug") -> DataFrame:
    """The n largest increases and the n largest decreases of each version."""
    keys = keys or [VERSION]
    moved = rows.withColumn("change", change)

    def side(name: str, cond: Column, order: Column) -> DataFrame:
        rank = Window.partitionBy(*keys).orderBy(order, tie)
        return (moved.where(cond).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)
                .withColumn("direction", F.lit(name)))

    return side("up", F.col("change") > 0, F.col("change").desc()).unionByName(
        side("down", F.col("change") < 0, F.col("change").asc()))


def with_grand_total(rows: DataFrame, key: str, values: list[str], label: str = "Total") -> DataFrame:
    """The table of each budget version and its grand-total row."""
    sets = rows.groupingSets([[VERSION, key], [VERSION]], VERSION, key)
    return sets.agg(*[F.sum(v).alias(v) for v in values], F.grouping(key).alias("is_total")).select(
        VERSION, F.when(F.col("is_total") == 1, label).otherwise(F.col(key)).alias(key), *values,
        (F.col("is_total") == 1).alias("is_total"))


# --- One department -----------------------------------------------------------------------------------------------------


def metric_labels(spark) -> DataFrame:
    rows = [(i, m, label, unit) for i, (m, label, unit) in enumerate(V.METRICS)]
    return spark.createDataFrame(rows, "ordinal int, metric string, metric_label string, unit string")


def department_breakdown(dept_summary: DataFrame, departments: DataFrame, slug: str | None = None,
                         version: str | None = None) -> DataFrame:
    """What departments spend their money on, in the fixed order of metrics.  slug None: every department."""
    rows = scoped(dept_summary, version)
    rows = rows.where(F.col("dept") == slug) if slug else rows
    first = rows.groupBy(VERSION, "dept", "metric").agg(
        F.min_by(F.struct(*STAGES, "change_vs_adopted", "change_vs_requested", "cite"), position()).alias("r"))
    named = first.join(departments.select(VERSION, F.col("slug").alias("dept"), "name"), [VERSION, "dept"])
    return (named.join(F.broadcast(metric_labels(rows.sparkSession)), "metric")
            .select(VERSION, "dept", "name", "ordinal", "metric", F.col("metric_label").alias("label"), "unit",
                    *[F.col(f"r.{s}").alias(s) for s in STAGES],
                    *changes(F.col("r.adopted_2026"), F.col("r.change_vs_adopted"), F.col("r.change_vs_requested")),
                    F.col("r.cite").alias("cite"))
            .orderBy(VERSION, "dept", "ordinal"))


def revenues_of_fund(revenues: DataFrame, fund: str | None = "general", version: str | None = None,
                     totals_only_for: str = "general") -> DataFrame:
    """Summary revenue lines; of the general fund only totals, withdrawals and the levy."""
    rows = scoped(revenues, version).where(F.col("source") == "summary")
    rows = rows.where(F.col("fund") == fund) if fund else rows
    rows = rows.where((F.col("fund") != totals_only_for) | F.col("is_total") | F.col("line").rlike("(?i)withdrawal|levy"))
    return rows.select(
        VERSION, "fund", "category", "line", "is_total", "adopted_2026", "requested_2027", "proposed_2027",
        *changes(F.col("adopted_2026"), diff("adopted_2026", "proposed_2027"), diff("requested_2027", "proposed_2027")),
        "cite")


def revenue_line_by_fund(revenues: DataFrame, line: str, version: str | None = None) -> DataFrame:
    return scoped(revenues, version).where((F.col("source") == "summary") & (F.col("line") == line)).select(
        VERSION, "fund", "line", "adopted_2026", "requested_2027", "proposed_2027", "cite")


def position_changes_of(position_changes: DataFrame, dept_summary: DataFrame, slug: str | None = None,
                        version: str | None = None) -> DataFrame:
    """Listed position changes with the department's authorised positions beside them; the printed totals left out."""
    rows = scoped(position_changes, version).where(~F.col("is_total"))
    rows = rows.where(F.col("dept") == slug) if slug else rows
    total = scoped(dept_summary, version).where(F.col("metric") == "positions").groupBy(VERSION, "dept").agg(
        F.min_by(F.struct(F.col("adopted_2026").alias("total_positions_2026"),
                          F.col("proposed_2027").alias("total_positions_2027")), position()).alias("t"))
    return rows.join(total, [VERSION, "dept"], "left").select(
        VERSION, "dept", "positions", "title", "reason", "reason_category", "cite", "t.*")


def performance_measures(kpis: DataFrame, departments: DataFrame, slug: str | None = None,
                         version: str | None = None) -> DataFrame:
    rows = scoped(kpis, version)
    rows = rows.where(F.col("dept") == slug) if slug else rows
    depts = departments.select(VERSION, F.col("slug").alias("dept"), "name")
    return rows.join(depts, [VERSION, "dept"]).select(
        VERSION, "dept", "name", "measure", F.col("col_labels").alias("columns"), "values", "footnote", "cite")


def measure_values(measures: DataFrame) -> DataFrame:
    """One row per measure and printed column."""
    return measures.select("*", F.posexplode(F.arrays_zip("columns", "values")).alias("ordinal", "cell")).select(
        *[c for c in measures.columns if c not in ("columns", "values")], "ordinal",
        F.col("cell.columns").alias("column"), F.col("cell.values").alias("value"))


# --- Search in printed lines ----------------------------------------------------------------------------------------------


def all_of(predicates: list[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def any_contains(query: str, columns: list[str], literal: bool = False) -> Column:
    return reduce(or_, [F.col(c).ilike(like_pattern(query, literal)) for c in columns])


def matching_lines(line_items: DataFrame, departments: DataFrame, query: str, slug: str | None = None,
                   version: str | None = None, blocks: list[str] | None = None, literal: bool = False) -> DataFrame:
    """Line items whose description holds the query, or whose account starts with it when it is 4 to 6 digits."""
    q = query.strip()
    by_code = q.isdigit() and 4 <= len(q) <= 6
    match = F.col("account").startswith(q) if by_code else any_contains(q, ["description"], literal)
    wanted = [~F.col("is_subtotal"), ~F.col("is_position"), match]
    if blocks:
        wanted.append(F.col("block").isin(blocks))
    rows = scoped(line_items, version).where(all_of(wanted))
    depts = departments.select(VERSION, "slug", F.col("name").alias("dept_name"), F.explode("detailed").alias("section"))
    depts = depts.where(F.col("slug") == slug) if slug else depts
    return rows.join(depts, [VERSION, "section"])


def search_lines(line_items: DataFrame, departments: DataFrame, query: str, slug: str, version: str | None = None,
                 limit: int = 40, **kw) -> DataFrame:
    """The first matching lines of one department in reading order, with row-level changes."""
    rows = matching_lines(line_items, departments, query, slug, version, **kw)
    return rows.select(
        VERSION, "slug", "dept_name", "description", "account", *STAGES,
        diff("adopted_2026", "proposed_2027").alias("change_from_adopted"),
        diff("requested_2027", "proposed_2027").alias("change_from_request"), "cite").orderBy(
        position(), "description").limit(limit)


def search_lines_by_department(line_items: DataFrame, departments: DataFrame, query: str, version: str | None = None,
                               **kw) -> DataFrame:
    """Matching lines summed by department: blanks count as nothing, changes are worked out on the sums."""
    rows = matching_lines(line_items, departments, query, None, version, **kw)
    sums = [F.sum(F.coalesce(s, F.lit(0))).alias(s) for s in STAGES[1:]]
    return (rows.groupBy(VERSION, "slug", "dept_name").agg(
        F.count("*").alias("line_count"), *sums, F.min_by("cite", position()).alias("cite"))
        .withColumn("change_from_adopted", diff("adopted_2026", "proposed_2027"))
        .withColumn("change_from_request", diff("requested_2027", "proposed_2027"))
        .orderBy(VERSION, F.col("proposed_2027").desc(), "slug"))


def capital_projects(projects: DataFrame, departments: DataFrame, slug: str | None = None, query: str | None = None,
                     version: str | None = None, literal: bool = False) -> DataFrame:
    """Projects with an amount or a note on why the printed amount is unclear; list headings are left out."""
    depts = departments.select(VERSION, F.col("slug").alias("dept"), F.col("name").alias("dept_name"))
    rows = scoped(projects, version).where(F.col("kind") == "project").join(depts, [VERSION, "dept"], "left")
    wanted = [F.col("dept") == slug] if slug else []
    if query and query.strip():
        wanted.append(any_contains(query.strip(), ["name", "description", "dept_name"], literal))
    unclear = F.col("amount").isNull() & (F.coalesce("amount_text", F.lit("")) != "")
    note = F.format_string('The budget prints this as "%s", so the amount is unclear.', F.col("amount_text"))
    return (rows.where(all_of(wanted)).select(
        VERSION, "dept", "dept_name", "name", "amount", "amount_text", "description", F.when(unclear, note).alias("note"),
        "cite").orderBy(F.coalesce("amount", F.lit(0)).desc(), "name"))


# --- News topics, claims, cited articles -----------------------------------------------------------------------------------


def topic_figures(topics: DataFrame, headline_rows: DataFrame, sections: DataFrame, departments: DataFrame,
                  fees: DataFrame, projects: DataFrame) -> DataFrame:
    """topics(budget_version, topic, ordinal, label, source, key): one cited figure per entry from the table its source names.
    A figure that a version lacks stops the job, also when another version has it."""
    def figures(df, source, key, adopted, proposed, kind):
        return df.select(VERSION, F.lit(source).alias("source"), key.alias("key"), F.lit(kind).alias("kind"),
                         adopted.cast("decimal(18,2)").alias("adopted_2026"),
                         proposed.cast("decimal(18,2)").alias("proposed_2027"), "cite")

    c = F.col
    pool = [
        figures(departments, "department", c("slug"), c("adopted_2026"), c("proposed_2027"), "dollars"),
        figures(sections, "section", c("section"), c("adopted_2026"), c("proposed_2027"), "dollars"),
        figures(headline_rows.withColumn("cite", c("levy_cite")), "headline", F.lit("levy"), c("levy_adopted_2026"),
                c("levy_proposed_2027"), "dollars"),
        figures(headline_rows.withColumn("cite", c("levy_cite")), "headline", F.lit("rate"), c("rate_2026"),
                c("rate_2027"), "rate"),
        figures(fees, "fee", c("fee"), c("value_2026"), c("value_2027"), "fee"),
        figures(projects, "project", c("name"), F.lit(None), c("amount"), "dollars"),
    ]
    found = reduce(DataFrame.unionByName, pool)
    return topics.join(found, [VERSION, "source", "key"], "left").select(
        VERSION, "topic", "ordinal", "label", "key", "kind", "adopted_2026",
        required(F.col("proposed_2027"), "a topic figure").alias("proposed_2027"), "cite")


def reviewed_claims(claims: DataFrame) -> DataFrame:
    labels = F.create_map(*[F.lit(x) for pair in V.CLAIM_LABELS.items() for x in pair])
    return claims.where(F.col("reviewed_by").isNotNull()).withColumn("label_text", labels[F.col("label")])


def claim_articles(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Claims with the outlets that made them, in the order in which the claim names them."""
    cited = claims.select("id", F.posexplode("sources").alias("at", "s")).select(
        "id", "at", F.col("s.article").alias("article"), F.col("s.quote").alias("quote"))
    found = F.array_sort(F.collect_list(F.struct("at", "date", "outlet", "article", "quote")))
    return cited.join(articles, "article").groupBy("id").agg(F.transform(found, lambda a: F.struct(
        *[a[c].alias(c) for c in ("date", "outlet", "article", "quote")])).alias("articles"))


def topic_articles(topics: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles under each topic they name with their place there: newest first, then by outlet."""
    tagged = articles.select("article", "date", "outlet", F.explode("topics").alias("topic"))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.col("date").desc(), "outlet", "article")).cast("long")
    return topics.join(tagged, "topic").withColumn("place", place)


# --- Vocabulary --------------------------------------------------------------------------------------------------------------


def vocabulary(rows: DataFrame, kind: str, keys: list[str], code: str | None = None, dept: str = "dept") -> DataFrame:
    """Distinct entries with the first label and code in reading order, their departments and how often they occur.
    Departments are made distinct before they are gathered, so no entry's rows are collected."""
    code_col = F.col(code).cast("string") if code else F.lit(None).cast("string")
    per_dept = rows.groupBy(*keys, F.col(dept).alias("dept")).agg(
        F.count("*").alias("n"),
        F.min_by(F.struct(F.regexp_replace("description", r"^[ .\-]+", "").alias("label"), code_col.alias("code"), "cite"),
                 position()).alias("first"),
        F.min(position()).alias("at"))
    return per_dept.groupBy(*keys).agg(
        F.min_by("first", "at").alias("first"), F.array_sort(F.collect_set("dept")).alias("dept_ids"),
        F.sum("n").alias("occurrences")).select(
        F.lit(kind).alias("kind"), "first.label", "first.code", "dept_ids", "occurrences", F.col("first.cite").alias("cite"))


def concepts(line_items: DataFrame, departments: DataFrame, glosses: DataFrame | None = None) -> DataFrame:
    """The vocabulary of the line-item book: accounts, position titles, units, capital and revenue lines."""
    depts = departments.select(VERSION, F.col("slug").alias("dept"), F.explode("detailed").alias("section"))
    li = line_items.where(F.coalesce("block", F.lit("")) != "restated").join(depts, [VERSION, "section"], "left")
    body = li.where(~F.col("section").isin("430", "480"))
    upper = F.upper("description")
    fragment = (F.col("description").rlike(V.LABEL_FRAGMENT) | upper.startswith("TOTAL")
                | F.exists("flags", lambda f: f.startswith("label_wraps")))
    heads = body.where((F.col("row_type") == "heading") & ~upper.isin(V.CATEGORY_WORDS)
                       & ~F.col("description").rlike("BCU|SUMMARY") & ~fragment)
    parts = [
        vocabulary(body.where("row_type = 'account'"), "account", ["account", "description"], "account"),
        vocabulary(body.where("row_type = 'position'"), "position_title", ["description"]),
        vocabulary(heads, "org_unit", ["description"]),
        vocabulary(li.where((F.col("section") == "480") & F.col("row_type").isin("account", "item")), "capital_line",
                   ["description"], "account"),
        vocabulary(li.where((F.col("section") == "430") & (F.col("row_type") == "account")), "revenue_line",
                   ["account", "description"], "account"),
    ]
    out = reduce(DataFrame.unionByName, parts)
    if glosses is None:
        return out.withColumn("gloss", F.lit(None).cast("string")).withColumn("gloss_reviewed", F.lit(False))
    g = glosses.select(F.lit("account").alias("kind"), F.col("account").cast("string").alias("code"), "account_label",
                       F.col("gloss").alias("g"), "reviewed_by")
    return out.join(g, ["kind", "code"], "left").select(
        "kind", "label", "code", "dept_ids", "occurrences", "cite",
        F.when(F.col("account_label") == F.col("label"), F.col("g")).alias("gloss"),
        F.col("reviewed_by").isNotNull().alias("gloss_reviewed"))


def page_ranges(departments: DataFrame, last_page: int | None = 214) -> DataFrame:
    """slug, first and last printed page: from a title page up to the next one; without a last page the last range is open."""
    order = Window.partitionBy(VERSION).orderBy("summary_page", "slug")
    starts = departments.where(F.col("summary_page").isNotNull())
    end = F.coalesce(F.lead("summary_page").over(order), F.lit(None if last_page is None else last_page + 1)) - 1
    return starts.withColumn("end", end).select(
        VERSION, "slug", F.col("summary_page").alias("first_page"),
        F.least("end", F.coalesce("summary_last_page", "end")).alias("last_page"))


def crosswalk(departments: DataFrame, line_items: DataFrame, last_page: int = 214, page_offset: int = 10) -> DataFrame:
    """Each department's page range, detailed prefixes, and distinct org and fund codes."""
    codes = line_items.select(VERSION, "section", F.explode(F.array(
        F.struct(F.lit("org").alias("kind"), F.col("org").alias("code")),
        F.struct(F.lit("fund").alias("kind"), F.col("fund").alias("code")))).alias("c")).select(
        VERSION, "section", "c.kind", "c.code").where("code is not null").distinct()
    owned = departments.select(VERSION, "slug", F.explode("detailed").alias("section")).join(codes, [VERSION, "section"])
    sets = owned.groupBy(VERSION, "slug").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "org", F.col("code")))).alias("org_codes"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "fund", F.col("code")))).alias("fund_codes"))
    empty = F.array().cast("array<string>")
    return (departments.select(VERSION, "slug", F.col("detailed").alias("detailed_page_prefix"))
            .join(page_ranges(departments, last_page), [VERSION, "slug"], "left").join(sets, [VERSION, "slug"], "left")
            .withColumn("org_codes", F.coalesce("org_codes", empty))
            .withColumn("fund_codes", F.coalesce("fund_codes", empty))
            .withColumn("pdf_pages", F.when(F.col("first_page").isNotNull(), F.array(
                F.col("first_page") + page_offset, F.col("last_page") + page_offset))))
