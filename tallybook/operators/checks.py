"""The documents' own arithmetic, done again.  A finding is a row: where, which check, which stage, printed, extracted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook import fixed_values as V
from tallybook.functions import text as X
from tallybook.functions.numbers import is_slot, slot_value
from tallybook.operators.joins import allowlist_report, excused
from tallybook.operators.lookups import VERSION, position
from tallybook.operators.running import running_count
from tallybook.schema import STAGES

KNOWN = ["check", "section", "column", "printed", "extracted"]


def mismatches(rows: DataFrame, printed: str = "printed", extracted: str = "extracted") -> DataFrame:
    return rows.where(~F.col(printed).eqNullSafe(F.col(extracted)))


def unexplained(findings: DataFrame, known_errors: DataFrame) -> DataFrame:
    """Findings not excused by a known error with the same check, place and both numbers."""
    as_text = findings.withColumn("printed", F.col("printed").cast("string")).withColumn(
        "extracted", F.col("extracted").cast("string"))
    return excused(as_text, known_errors, KNOWN)


def by_stage(df: DataFrame, keys: list[str], values: list[str], stage: str = "stage", value: str = "value") -> DataFrame:
    """Stage columns as rows."""
    return df.unpivot(keys, values, stage, value)


def sums_against_total(parts: DataFrame, totals: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Printed totals beside the sums of their parts, one row per key and column; blanks count as nothing."""
    sums = parts.groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in columns])
    printed = by_stage(totals.select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in columns]), keys, columns, "column", "printed")
    extracted = by_stage(sums, keys, columns, "column", "extracted")
    return printed.join(extracted, [*keys, "column"], "full")


# --- Units of the line-item book -------------------------------------------------------------------------------------------


def with_units(lines: DataFrame, keys: list[str], order: list[str], bucket: list[str] | None = None) -> DataFrame:
    """Number the units of each section.  A unit ends with its unit-total row and begins at its first category heading; rows
    before that heading belong to no unit."""
    heads = [h for h, _ in V.CATEGORY_HEADINGS]
    rows = running_count(lines, keys, order, F.col("is_unit_total"), "unit", bucket, inclusive=False)
    is_head = (F.col("row_type") == "heading") & F.upper("description").isin(heads)
    rows = rows.withColumn("_start", F.min(F.when(is_head, F.struct(*order))).over(Window.partitionBy(*keys, "unit")))
    inside = F.coalesce(F.struct(*order) >= F.col("_start"), F.lit(False)) | F.col("is_unit_total")
    return rows.where(inside).drop("_start")


def unit_reconciliation(lines: DataFrame, keys: list[str], order: list[str], bucket: list[str] | None = None,
                        stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Lines against printed category totals in every decision unit and stage.

    A check runs only where the unit itemises that stage.  Equipment counts printed subtotals and the items after the last
    one; special funds counts items above the first special total.  Incomplete units (no total row) are left out.  What a unit's
    rows are compared with is carried to them by windows over the unit, so that one dealing of the rows by key does for all."""
    unit = Window.partitionBy(*keys, "unit")
    rows = with_units(lines.dropna(subset=keys), keys, order, bucket).withColumn("_at", F.struct(*order))
    upper, kind, category = F.upper("description"), F.col("row_type"), F.col("category")
    total_of = {name: (kind == "rollup") & upper.rlike(pattern) for name, pattern in V.UNIT_TOTALS}
    equipment, subtotal = category == "equipment", upper.startswith("SUBTOTAL") & (kind == "rollup")
    rows = rows.withColumns({
        "_closed": F.max(F.col("is_unit_total")).over(unit), "_special": F.min(F.when(total_of["special"], F.col("_at"))).over(unit),
        "_stop": F.min(F.when(equipment & (kind == "rollup") & ~subtotal, F.col("_at"))).over(unit)}).where("_closed")
    in_equipment = equipment & F.coalesce(F.col("_at") < F.col("_stop"), F.lit(True))
    rows = rows.withColumn("_last", F.max(F.when(in_equipment & subtotal, F.col("_at"))).over(unit))
    item = kind.isin("account", "item")
    part_of = {
        "operating": (category == "operating") & item,
        "net_salaries": (category == "salaries") & kind.isin("position", "adjustment", "deduction"),
        "equipment": in_equipment & (subtotal | (item & F.coalesce(F.col("_at") > F.col("_last"), F.lit(True)))),
        "special": (category == "special") & item & F.coalesce(F.col("_at") < F.col("_special"), F.lit(True)),
    }
    long = by_stage(rows.select(*keys, "unit", *[v.alias(f"t_{k}") for k, v in total_of.items()],
                                *[F.coalesce(v, F.lit(False)).alias(f"p_{k}") for k, v in part_of.items()],
                                *[F.col(s).cast("long").alias(s) for s in stages]),
                    [*keys, "unit", *[f"{x}_{k}" for k in part_of for x in "tp"]], list(stages))
    # no other row changes a count or a sum
    long = long.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(f"t_{k}"), F.lit(False)) | (F.col(f"p_{k}") & F.col("value").isNotNull()) for k in part_of]))
    sums = long.groupBy(*keys, "unit", "stage").agg(*[e for k in part_of for e in (
        F.count_if(F.col(f"t_{k}")).alias(f"n_{k}"), F.sum(F.when(F.col(f"t_{k}"), F.col("value"))).alias(f"printed_{k}"),
        F.count(F.when(F.col(f"p_{k}"), F.col("value"))).alias(f"itemised_{k}"),
        F.sum(F.when(F.col(f"p_{k}"), F.col("value"))).alias(f"extracted_{k}"))])
    checks = F.array(*[F.struct(
        F.lit(k).alias("check"), F.coalesce(F.col(f"printed_{k}"), F.lit(0)).alias("printed"),
        F.coalesce(F.col(f"extracted_{k}"), F.lit(0)).alias("extracted"),
        ((F.col(f"n_{k}") > 0) & (F.col(f"itemised_{k}") > 0)
         & ((F.lit(k) != "net_salaries") | (F.col("stage") != "actual_2025"))).alias("runs")) for k in part_of])
    return sums.select(*keys, "unit", "stage", F.inline(checks)).where("runs").drop("runs")


def summary_against_units(lines: DataFrame, keys: list[str], stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Per section and stage: the summary sheet's category rollups and unit totals against those of its units."""
    kinds = [("net_salaries", "NET SALARIES & WAGES TOTAL"), ("fringe", V.FRINGE_ROLLUP),
             ("operating", "OPERATING EXPENDITURES TOTAL"), ("equipment", "EQUIPMENT PURCHASES TOTAL"),
             ("special", r"^SPECIAL FUNDS( TOTAL)?$")]
    rollup, upper = F.col("row_type") == "rollup", F.upper("description")
    tags = F.array_compact(F.array(*[F.when(rollup & upper.rlike(p), F.lit(k)) for k, p in kinds],
                                   F.when(F.col("is_unit_total"), F.lit("unit_totals"))))
    has_summary = lines.where("block = 'bcu_summary'").select(*keys).distinct()
    rows = lines.where(F.col("block").isin("bcu_summary", "decision_unit")).join(has_summary, keys, "left_semi").select(
        *keys, "block", F.explode(tags).alias("check"), *stages)
    long = by_stage(rows.select(*keys, "block", "check", *[F.col(s).cast("long").alias(s) for s in stages]),
                    [*keys, "block", "check"], list(stages))
    part = lambda b: F.coalesce(F.sum(F.when(F.col("block") == b, F.col("value"))), F.lit(0))
    return long.groupBy(*keys, "check", "stage").agg(part("bcu_summary").alias("printed"), part("decision_unit").alias("extracted"))


def sections_without_unit_total(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.where("block = 'decision_unit'").groupBy(*keys).agg(
        F.count_if("is_unit_total").alias("n")).where("n = 0").drop("n")


# --- Printed tables ----------------------------------------------------------------------------------------------------------


def section_arithmetic(section_totals: DataFrame, columns: tuple[str, ...] = ("adopted_2026", "proposed_2027")) -> DataFrame:
    """Sections sum to their subtotals, the subtotals to TOTAL, and each budget to its levy and other money."""
    long = by_stage(section_totals.select(VERSION, "section", "line", *columns), [VERSION, "section", "line"], list(columns))
    s, v = F.col("section"), F.coalesce("value", F.lit(0))
    part = lambda cond: F.sum(F.when(cond, v).otherwise(0))
    groups = long.groupBy(VERSION, "line", "stage").agg(
        part(s == V.LEVY_SUBTOTAL).alias("p1"), part(s.isin(V.LEVY_SECTIONS)).alias("e1"),
        part(s == V.OTHER_SUBTOTAL).alias("p2"), part(s.isin(V.OTHER_SECTIONS)).alias("e2"),
        part(s == "TOTAL").alias("p3"), part(s.isin(V.LEVY_SUBTOTAL, V.OTHER_SUBTOTAL)).alias("e3"))
    sums = groups.select(VERSION, F.col("line").alias("place"), "stage", F.inline(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(f"p{i}").alias("printed"), F.col(f"e{i}").alias("extracted"))
        for i, c in enumerate(("levy_subtotal", "other_subtotal", "total"), 1)])))
    pairs = long.groupBy(VERSION, "section", "stage").agg(
        part(F.col("line") == "budget").alias("printed"), part(F.col("line").isin("levy", "non_levy")).alias("extracted"))
    return sums.unionByName(pairs.select(VERSION, F.col("section").alias("place"), "stage",
                                         F.lit("budget_is_levy_plus_other").alias("check"), "printed", "extracted"))


def revenue_arithmetic(revenues: DataFrame, categories: list[str] | None = None, reserves: list[str] | None = None,
                       subtotal: str = V.GENERAL_FUND_TOTAL, total: str = V.SOURCES_TOTAL, stage: str = "proposed_2027",
                       keys: list[str] | None = None) -> DataFrame:
    """Categories sum to the fund's revenue; with reserves and levy they sum to the total of sources."""
    categories, reserves = categories or V.GENERAL_FUND_CATEGORIES, reserves or V.RESERVES_AND_LEVY
    line, v = F.col("line"), F.coalesce(F.col(stage), F.lit(0))
    part = lambda cond: F.sum(F.when(cond, v).otherwise(0))
    sums = revenues.groupBy(*(keys or [VERSION])).agg(
        part(line == subtotal).alias("p1"), part(line.isin(categories)).alias("e1"), part(line == total).alias("p2"),
        part((line == subtotal) | line.isin(reserves)).alias("e2"))
    return sums.select(*(keys or [VERSION]), F.inline(F.array(
        F.struct(F.lit("categories").alias("check"), F.col("p1").alias("printed"), F.col("e1").alias("extracted")),
        F.struct(F.lit("sources").alias("check"), F.col("p2").alias("printed"), F.col("e2").alias("extracted")))))


def category_sums(dept_summary: DataFrame, keys: list[str], stages: tuple[str, ...] = STAGES) -> DataFrame:
    """A department's expense categories against its total."""
    total = dept_summary.where("metric = 'total_expenditures'")
    parts = dept_summary.where(F.col("metric").isin(V.EXPENSE_METRICS))
    both = sums_against_total(parts, total, keys, list(stages))
    return both.where(F.col("printed").isNotNull()).withColumn("extracted", F.coalesce("extracted", F.lit(0)))


def segment_sums(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], bucket: list[str] | None = None
                 ) -> DataFrame:
    """Rows of each segment against the total row that ends it.  Rows after the last total have no printed total."""
    seg = running_count(rows, keys, order, F.col("is_total"), "segment", bucket, inclusive=False)
    checked = sums_against_total(seg.where(~F.col("is_total")), seg.where("is_total"), [*keys, "segment"], columns)
    return checked.withColumn("status", F.when(F.col("printed").isNull(), "no_total").when(
        F.coalesce("extracted", F.lit(0)) == F.col("printed"), "ok").otherwise("differs"))


def block_sums(rows: DataFrame, keys: list[str], order: list[str], stage: str) -> DataFrame:
    """Every printed Total against the rows since the last one.  A total followed by more rows of the same group carries
    into the next; a group that changes drops the carried total.  Subtotal rows are not added.  keys name one printed page,
    so the windows stay small."""
    label = F.lower(F.trim("label"))
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    is_total = label.startswith("total")
    is_sub = label.startswith("subtotal") | (label.endswith("total") & ~is_total)
    r = rows.where(F.coalesce(F.col("group"), F.lit("")) != "personnel").withColumns({
        "_total": is_total, "_value": F.coalesce(F.col(stage), F.lit(0)), "_item": ~is_total & ~is_sub})
    r = r.withColumn("_block", F.coalesce(F.sum(F.when(F.col("_total"), 1).otherwise(0)).over(before), F.lit(0)))
    r = r.withColumn("_switch", F.when(~F.col("group").eqNullSafe(F.lag("group").over(w)) & (F.row_number().over(w) > 1), 1).otherwise(0))
    r = r.withColumn("_group_no", F.sum("_switch").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = r.groupBy(*keys, "_block").agg(
        F.sum(F.when(F.col("_item"), F.col("_value"))).alias("parts"),
        F.max(F.when(F.col("_total"), F.struct(*order, "label", F.col("_value").alias("printed"),
                                               F.col("_group_no").alias("g")))).alias("t"))
    chain = Window.partitionBy(*keys).orderBy("_block")
    carried = F.when(F.lag("t.g").over(chain) == F.col("t.g"), F.lag("t.printed").over(chain)).otherwise(0)
    return sums.withColumn("carried", F.coalesce(carried, F.lit(0))).where("t is not null and parts is not null").select(
        *keys, F.col("_block").alias("block"), F.col("t.label").alias("label"), F.col("t.printed").alias("printed"),
        (F.col("parts") + F.col("carried")).alias("extracted"))


def change_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Printed change columns against proposed less base; a blank change is right when nothing changed."""
    zero = F.lit(0)
    long = rows.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(change).alias("column"), F.col(change).alias("printed"), F.col(base).alias("base"),
                 F.col("proposed_2027").alias("proposed"))
        for change, base in (("change_vs_adopted", "adopted_2026"), ("change_vs_requested", "requested_2027"))])))
    want = F.coalesce("proposed", zero) - F.coalesce("base", zero)
    return long.where("proposed is not null or base is not null").select(*keys, "column", "printed", want.alias("extracted")).where(
        ~(F.col("printed").isNull() & (F.col("extracted") == 0)) & ~F.col("printed").eqNullSafe(F.col("extracted")))


def across_books(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two books' figures (keys..., value) side by side; a figure in one book only is a disagreement."""
    return first.withColumnRenamed("value", "printed").join(second.withColumnRenamed("value", "extracted"), keys, "full").withColumn(
        "agrees", F.col("printed").eqNullSafe(F.col("extracted")))


def top_level_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """A department's summary sheet where it has one, its decision units otherwise."""
    has = lines.where("block = 'bcu_summary'").select(*keys).distinct()
    return lines.where("block = 'bcu_summary'").unionByName(
        lines.where("block = 'decision_unit'").join(has, keys, "left_anti"))


def golden_differences(actual: DataFrame, expected: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Hand-read values the tables do not reproduce."""
    return expected.withColumnRenamed(value, "expected").join(actual, keys, "left").where(
        ~F.col("expected").eqNullSafe(F.col(value)))


# --- Second reader ---------------------------------------------------------------------------------------------------------


def value_lines(words: DataFrame, page: list[str], x_min: float | None = None, x1_max: float | None = None) -> DataFrame:
    """Lines (words with a 'line' number) with their text and number slots, dashes as NULL, left to right."""
    ok = is_slot(F.col("text"))
    ok = ok if x_min is None else ok & (F.col("x0") >= x_min)
    ok = ok if x1_max is None else ok & (F.col("x1") <= x1_max)
    slot = F.when(ok, F.struct("x0", F.struct(slot_value(F.col("text")).alias("v")).alias("s")))
    label_words = F.when(F.lit(True) if x_min is None else F.col("x0") < x_min, F.struct("x0", "text"))
    return words.groupBy(*page, "line").agg(
        F.transform(F.array_sort(F.collect_list(slot)), lambda s: s["s"]["v"]).alias("slots"),
        F.array_join(F.transform(F.array_sort(F.collect_list(label_words)), lambda s: s["text"]), " ").alias("label_text"))


def found_on_page(rows: DataFrame, lines: DataFrame, page: list[str], row_id: list[str], near: int = 0) -> DataFrame:
    """rows(page..., row_id..., label, expected array): 'ok' when a line of the page starts with the expected slots and the
    label's first two words stand on it or within near lines; otherwise how far the row was found."""
    hit = rows.join(lines, page).where(F.slice("slots", 1, F.greatest(F.size("expected"), F.lit(1))) == F.col("expected"))
    around = lines.select(*page, F.col("line").alias("_l"), F.col("label_text").alias("_t"))
    named = hit.join(around, page).where(F.abs(F.col("_l") - F.col("line")) <= near).groupBy(*row_id).agg(
        F.bool_or(X.label_hit(F.col("_t"), F.col("label"))).alias("labelled"))
    return rows.join(named, row_id, "left").select(*row_id, F.when(F.col("labelled"), "ok").when(
        F.col("labelled").isNotNull(), "values_ok_label_not_on_line").otherwise("MISMATCH").alias("status"))


def crosscheck_report(results: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    return allowlist_report(results.where("status <> 'ok'"), allowed, keys)


# --- Statements against pages -----------------------------------------------------------------------------------------------


def statement_gaps(statements: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """statements(keys, page, statement): figures and quoted phrases not printed on the cited page (page, page_text)."""
    text = X.tidy(F.col("page_text"))
    wanted = F.concat(F.transform(X.statement_figures(F.col("statement")), lambda f: F.struct(
        F.lit("figure").alias("kind"), f.alias("item"))), F.transform(X.quoted_phrases(F.col("statement")), lambda q: F.struct(
            F.lit("quote").alias("kind"), F.replace(q, F.lit("’"), F.lit("'")).alias("item"))))
    rows = statements.join(pages, "page", "left").withColumn("_text", F.coalesce(text, F.lit("")))
    return rows.select(*keys, "_text", F.inline(wanted)).where(~F.col("_text").contains(F.col("item"))).drop("_text")


def glossary_gaps(glossary: DataFrame, pages: DataFrame) -> DataFrame:
    """Terms whose cited words are not on the page, and definitions that state an amount."""
    low = lambda c: F.replace(F.lower(c), F.lit("’"), F.lit("'"))
    rows = glossary.join(pages, "page", "left")
    missing = ~F.coalesce(low(F.col("page_text")).contains(low(F.col("cite_text"))), F.lit(False))
    states = F.col("plain_definition").rlike(V.DEFINITION_AMOUNT)
    problems = F.array_compact(F.array(F.when(missing, F.lit("term not on page")), F.when(states, F.lit("states an amount"))))
    return rows.select("term", F.explode(problems).alias("problem"))


def fee_revenue_gaps(fees: DataFrame, revenues: DataFrame, names: DataFrame) -> DataFrame:
    """Fees whose stated revenue differs from the revenue line that the summary of the same version prints for the general
    fund (names: fee, line)."""
    general = revenues.where((F.col("source") == "summary") & (F.col("fund") == "general"))
    lines = general.groupBy("budget_version", "line").agg(F.min_by("proposed_2027", position()).alias("printed"))
    return mismatches(fees.join(names, "fee").join(lines, ["budget_version", "line"], "left").select(
        "budget_version", "fee", "printed", F.col("revenue_2027").alias("extracted")))


def table_pair_gaps(pairs: DataFrame, revenues: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Facts whose number is also printed in a table: pairs(budget_version, id, source, lines array, section, value).  A revenue pair is the
    sum of its lines of the general fund in the summary; a comparison pair is the change against the request of one line of
    a section.  What is missing or different is a gap."""
    general = revenues.where((F.col("source") == "summary") & (F.col("fund") == "general")).groupBy("budget_version", "line").agg(
        F.min_by("proposed_2027", position()).alias("amount"))
    lines = pairs.select("budget_version", "id", "source", "section", F.explode("lines").alias("line"))
    from_revenues = lines.where("source = 'revenues'").join(general, ["budget_version", "line"], "left").groupBy("budget_version", "id").agg(
        F.when(F.count("*") == F.count("amount"), F.sum("amount")).alias("printed"))
    compared = comparisons.groupBy("budget_version", "section", "line").agg(F.min_by("change_vs_requested", position()).alias("printed"))
    from_comparisons = lines.where("source = 'comparisons'").join(compared, ["budget_version", "section", "line"], "left").select("budget_version", "id", "printed")
    found = from_revenues.unionByName(from_comparisons)
    return mismatches(pairs.join(found, ["budget_version", "id"], "left").select("budget_version", "id", "printed", F.col("value").alias("extracted")))


def extra_citation_gaps(glossary: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """glossary(term, aliases, cite_text, also_cite array<struct<keys..., cite_text>>), pages(keys..., page_text): further citations whose
    page holds neither its own phrase, if it names one, nor else the term's cited words, an alias or the bare term."""
    low = lambda c: F.replace(F.lower(c), F.lit("’"), F.lit("'"))
    bare = F.get(F.split("term", r" \("), F.lit(0))
    names = F.concat(F.array("cite_text"), F.coalesce("aliases", F.array().cast("array<string>")), F.array(bare))
    cited = glossary.select("term", names.alias("_names"), F.posexplode("also_cite").alias("n", "_c")).select("term", "n", "_names", *[F.col(f"_c.{k}").alias(k) for k in keys],
                                                                                                           F.col("_c.cite_text").alias("_own"))
    want = F.when(F.col("_own").isNotNull(), F.array("_own")).otherwise(F.col("_names"))
    rows = cited.join(pages, keys, "left").withColumn("_page", F.coalesce(low(F.col("page_text")), F.lit("")))
    return rows.where(~F.exists(want, lambda x: F.coalesce(F.col("_page").contains(low(x)), F.lit(False)))).select("term", "n", *keys)


# --- Keys and counts --------------------------------------------------------------------------------------------------------


def parcel_report(parcels: DataFrame) -> DataFrame:
    """One row of counts: malformed keys, negative values, parcels both taxable and exempt.  Duplicate keys are found from
    per-key counts, so nothing is collected."""
    per_key = parcels.groupBy("taxkey").agg(F.count("*").alias("n"))
    duplicated = per_key.agg(F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    money = [c for c in ("c_a_total", "c_a_exm_total", "p_a_total", "p_a_exm_total") if c in parcels.columns]
    negative = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < 0, F.lit(False)) for c in money])
    both = F.lit(False) if "c_a_exm_total" not in money else (
        (F.coalesce("c_a_total", F.lit(0)) > 0) & (F.coalesce("c_a_exm_total", F.lit(0)) > 0))
    counts = parcels.agg(F.count("*").alias("parcels"), F.count_if(~F.col("taxkey").rlike(r"^\d{10}$")).alias("malformed_keys"),
                         F.count_if(negative).alias("negative_values"), F.count_if(both).alias("taxable_and_exempt"))
    return counts.withColumn("duplicate_keys", duplicated.scalar())


def forbidden_columns(df: DataFrame) -> list[str]:
    return sorted(set(V.PARCEL_NEVER) & {c.upper() for c in df.columns})


def orphans(children: DataFrame, parents: DataFrame, child_key: list[str], parent_key: list[str]) -> DataFrame:
    """Child keys without a parent, with how many rows hang on each.  Children are counted per key before the join."""
    per_key = children.groupBy(*child_key).agg(F.count("*").alias("n"))
    same = [per_key[c] == parents[p] for c, p in zip(child_key, parent_key)]
    return per_key.join(parents, same, "left_anti")


def duplicate_ids(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def count_against_file(loaded: DataFrame, source: DataFrame, name: str) -> DataFrame:
    return loaded.agg(F.count("*").alias("loaded")).withColumn("file", source.agg(F.count("*")).scalar()).select(
        F.lit(name).alias("table"), "file", "loaded", (F.col("file") == F.col("loaded")).alias("equal"))


def size_bounds(passages: DataFrame, text: str = "text") -> DataFrame:
    n = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return passages.agg(F.count("*").alias("passages"), F.min(n).alias("min_words"), F.max(n).alias("max_words"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one table only, duplicates counted; empty when the tables are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def vector_report(rows: DataFrame, embedding: str = "embedding", keys: list[str] | None = None) -> DataFrame:
    """Rows with and without a vector, and the distinct vector lengths."""
    return rows.groupBy(*(keys or [])).agg(
        F.count("*").alias("rows"), F.count_if(F.col(embedding).isNotNull()).alias("with_vector"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.size(embedding))), lambda n: n.cast("string")), ",").alias("dims"))
