"""Declared table schemas.  Blank is NULL everywhere; money is whole dollars unless a column says cents."""

from __future__ import annotations

from pyspark.sql import types as T

STAGES = ("actual_2025", "adopted_2026", "requested_2027", "proposed_2027")
MONEY = T.LongType()
FTE = T.DecimalType(10, 2)
STAGE_VALUE = T.DecimalType(14, 2)
RATE = T.DecimalType(8, 2)

CITE = T.StructType([
    T.StructField("doc", T.StringType()),
    T.StructField("pdf_page", T.IntegerType()),
    T.StructField("printed_page", T.StringType()),
    T.StructField("line_no", T.IntegerType()),
])


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


S, B, I, D = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType()
TEXTS = T.ArrayType(T.StringType())

WORDS = _table(("doc", S), ("page", I), ("text", S), ("x0", D), ("x1", D), ("top", D), ("bottom", D))

SECTION_TOTALS = _table(
    ("budget_version", S), ("section", S), ("label", S), ("line", S), ("adopted_2026", MONEY), ("proposed_2027", MONEY),
    ("change", MONEY), ("tax_rate_2026", RATE), ("tax_rate_2027", RATE), ("tax_rate_change", RATE), ("cite", CITE))
SECTION_COMPARISONS = _table(
    ("budget_version", S), ("section", S), ("group_path", TEXTS), ("line", S), ("adopted_2026", MONEY),
    ("requested_2027", MONEY), ("proposed_2027", MONEY), ("change_vs_adopted", MONEY), ("change_vs_requested", MONEY),
    ("cite", CITE))
DEPARTMENTS = _table(
    ("budget_version", S), ("slug", S), ("name", S), ("short_name", S), ("section", S), ("parent", S), ("detailed", TEXTS),
    ("summary_page", I), ("summary_last_page", I), ("aliases", TEXTS))
DEPT_SUMMARY = _table(
    ("budget_version", S), ("dept", S), ("metric", S), ("label", S), ("group", S), ("actual_2025", STAGE_VALUE),
    ("adopted_2026", STAGE_VALUE), ("requested_2027", STAGE_VALUE), ("proposed_2027", STAGE_VALUE),
    ("change_vs_adopted", STAGE_VALUE), ("change_vs_requested", STAGE_VALUE), ("flags", TEXTS), ("label_wrapped", B),
    ("cite", CITE))
SERVICES = _table(
    ("budget_version", S), ("dept", S), ("description", S), ("operating", MONEY), ("capital", MONEY), ("grant", MONEY),
    ("ftes", FTE), ("is_total", B), ("cite", CITE))
KPIS = _table(
    ("budget_version", S), ("dept", S), ("measure", S), ("group", S), ("col_labels", TEXTS), ("values", TEXTS),
    ("footnote", S), ("flags", TEXTS), ("cite", CITE))
POSITION_CHANGES = _table(
    ("budget_version", S), ("dept", S), ("positions", FTE), ("om_ftes", FTE), ("non_om_ftes", FTE), ("title", S),
    ("section", S), ("group", S), ("reason", S), ("reason_category", S), ("is_total", B), ("merged_with_previous", B),
    ("cite", CITE))
CAPITAL_PROJECTS = _table(
    ("budget_version", S), ("dept", S), ("name", S), ("amount", MONEY), ("amount_text", S), ("amount_from_millions", B),
    ("description", S), ("kind", S), ("pdf_pages", T.ArrayType(I)), ("cite", CITE))
LINE_ITEMS = _table(
    ("budget_version", S), ("dept_printed", S), ("section", S), ("row_type", S), ("block", S), ("category", S),
    ("hierarchy_path", TEXTS), ("fund", S), ("org", S), ("sbcl", S), ("account", S), ("description", S),
    ("description_raw", S), ("pay_range", S), ("footnote_codes", TEXTS), ("actual_2025", MONEY),
    ("adopted_2026_units", FTE), ("adopted_2026", MONEY), ("requested_2027_units", FTE), ("requested_2027", MONEY),
    ("proposed_2027_units", FTE), ("proposed_2027", MONEY), ("is_subtotal", B), ("is_unit_total", B), ("is_position", B),
    ("is_deduction", B), ("footnote_flag", B), ("note", S), ("flags", TEXTS), ("pdf_page", I), ("printed_page", S),
    ("line_no", I), ("cite", CITE))
REVENUES = _table(
    ("budget_version", S), ("source", S), ("fund", S), ("dept", S), ("category", S), ("line", S), ("is_total", B),
    ("actual_2025", MONEY), ("adopted_2026", MONEY), ("requested_2027", MONEY), ("proposed_2027", MONEY), ("account", S),
    ("cite", CITE))
CONCEPTS = _table(
    ("kind", S), ("label", S), ("code", S), ("dept_ids", TEXTS), ("occurrences", MONEY), ("gloss", S),
    ("gloss_reviewed", B), ("cite", CITE))
PASSAGES = _table(
    ("id", S), ("doc", S), ("budget_version", S), ("pdf_page", I), ("printed_page", I), ("page_end", I), ("region", S),
    ("dept", S), ("section_type", S), ("heading", S), ("ordinal", I), ("text", S), ("context_header", S),
    ("numbers", TEXTS), ("parent_section_id", S), ("linked_tables", TEXTS), ("kind", S))
FEES = _table(
    ("budget_version", S), ("fee", S), ("unit", S), ("value_2026", T.DecimalType(12, 2)),
    ("value_2027", T.DecimalType(12, 2)), ("pct_change", T.DecimalType(6, 2)), ("revenue_2027", MONEY), ("is_derived", B),
    ("source_text", S), ("narrative_revenue", S), ("reviewed_by", S), ("cite", CITE))
BUDGET_FACTS = _table(
    ("budget_version", S), ("id", S), ("topic", S), ("statement", S), ("value", T.DecimalType(16, 2)), ("unit", S),
    ("reviewed_by", S), ("lead_with", S), ("context", S), ("cite", CITE))
GLOSSARY = _table(
    ("budget_version", S), ("term", S), ("plain_definition", S), ("why_it_matters", S), ("cite_text", S),
    ("aliases", TEXTS), ("definition_source", S), ("reviewed_by", S), ("cite", CITE))
KNOWN_ERRORS = _table(("check", S), ("section", S), ("column", S), ("printed", S), ("extracted", S), ("note", S))
CROSSCHECK_ALLOWLIST = _table(
    ("dept", S), ("table", S), ("row", S), ("pdf_page", I), ("status", S), ("reason", S))
PARCELS = _table(
    ("taxkey", S), ("snapshot_date", T.DateType()), ("yr_assmt", S), ("tax_rate_cd", S), ("house_nr_lo", I),
    ("house_nr_hi", I), ("house_nr_sfx", S), ("sdir", S), ("street", S), ("sttype", S), ("c_a_class", S),
    ("c_a_total", MONEY), ("c_a_exm_type", S), ("c_a_exm_total", MONEY), ("p_a_total", MONEY), ("p_a_exm_total", MONEY),
    ("nr_units", I), ("own_ocpd", S), ("land_use", S), ("land_use_gp", S), ("bldg_type", S), ("dpw_sanitation", S),
    ("geo_alder", S), ("lot_area", T.DecimalType(14, 2)), ("corner_lot", S))
ANSWERS = _table(
    ("id", S), ("q", S), ("before", TEXTS), ("text", S), ("tool_data", S), ("earlier_data", S), ("expected_figures", TEXTS),
    ("must_include", TEXTS), ("must_not", TEXTS), ("declined", B))
REQUESTS = _table(("key", S), ("ts", T.TimestampType()))
RUN_EVENTS = _table(("run_id", S), ("type", S), ("delta", S), ("ts", T.TimestampType()))

TABLES = {
    "section_totals": SECTION_TOTALS, "section_comparisons": SECTION_COMPARISONS, "departments": DEPARTMENTS,
    "dept_summary": DEPT_SUMMARY, "services": SERVICES, "kpis": KPIS, "position_changes": POSITION_CHANGES,
    "capital_projects": CAPITAL_PROJECTS, "line_items": LINE_ITEMS, "revenues": REVENUES, "concepts": CONCEPTS,
    "passages": PASSAGES, "fees": FEES, "budget_facts": BUDGET_FACTS, "glossary": GLOSSARY,
    "known_errors": KNOWN_ERRORS, "crosscheck_allowlist": CROSSCHECK_ALLOWLIST, "parcels": PARCELS, "words": WORDS,
    "answers": ANSWERS,
}
