"""Summary-book tables: header-anchored columns, wrapped labels, headings carried down, cells and capital items.

The unit of work is a page: a line table (one row per printed line with its words) and a geometry row per page.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook import fixed_values as V
from tallybook.functions import text as X
from tallybook.functions.numbers import amount_in_words, is_number_token, parse_decimal
from tallybook.operators.running import carry_last, column_of, indent_paths, running_count, text_of, visual_lines
from tallybook.session import by_key, materialize

PAGE = ["doc", "page"]
STAGE_KEYS = ["actual_2025", "adopted_2026", "requested_2027", "proposed_2027"]
CHANGE_KEYS = ["change_vs_adopted", "change_vs_requested"]
FIVE_KEYS = STAGE_KEYS[1:] + CHANGE_KEYS
BLOCK_TITLES = {"SUMMARY OF EXPENDITURES": "expenditures", "SOURCE OF FUNDS": "source of funds"}
PART_LINES = 50_000  # lines whose position changes one task reads
FOOTER = "PROPOSED PLAN AND EXECUTIVE"


def page_lines(words: DataFrame, tol: float = 3.0) -> DataFrame:
    """doc, page, line, top, ws array<struct<x0,x1,text>> left to right, text."""
    lined = visual_lines(words, PAGE, tol)
    return lined.groupBy(*PAGE, "line", F.col("anchor").alias("top")).agg(
        F.array_sort(F.collect_list(F.struct("x0", "x1", "text"))).alias("ws")).withColumn(
        "text", F.array_join(F.transform("ws", lambda w: w["text"]), " "))


def label(ws: Column, max_x) -> Column:
    return F.trim(F.array_join(F.transform(F.filter(ws, lambda w: w["x1"] <= max_x), lambda w: w["text"]), " "))


def numbers_by_column(ws: Column, columns: Column, left: float, right: float) -> Column:
    """map of column key to printed text; two numbers under one column stop the job (duplicate map keys raise)."""
    nums = F.filter(ws, lambda w: is_number_token(F.regexp_replace(w["text"], r"[$\[\]]", "")))
    keyed = F.filter(F.transform(nums, lambda w: F.struct(column_of(columns, w["x0"], w["x1"], left, right).alias("k"),
                                                          w["text"].alias("v"))), lambda e: e["k"].isNotNull())
    return F.map_from_entries(keyed)


def _column(i: int, key: str, w0: Column, w1: Column) -> Column:
    return F.struct(F.lit(i).alias("ordinal"), F.lit(key).alias("key"), w0.alias("x0"), w1.alias("x1"))


def _word(ws: Column, text: str) -> Column:
    return F.get(F.filter(ws, lambda w: w["text"] == text), F.lit(0))


def _first(lines: DataFrame, cond: Column, name: str) -> DataFrame:
    """The first line of each page that meets a condition."""
    return lines.where(cond).groupBy(*PAGE).agg(F.min_by(F.struct("top", "ws", "text"), "top").alias(name))


def printed_value(text: Column) -> Column:
    """A stage value; brackets are dropped here and flagged by the caller."""
    return parse_decimal(F.regexp_replace(text, r"[\[\]]", ""))


# --- Four-stage department table --------------------------------------------------------------------------------------------


def budget_summary(lines: DataFrame, page_departments: DataFrame, wrap: float = 6.5) -> DataFrame:
    """Rows of the four-stage table of each department page, with group, metric, and wrapped labels joined.

    A line without stage values joins the next row when it ends in a connector, else the nearest row within wrap points;
    any other is a group heading."""
    t = F.col("text")
    header = _first(lines, t.contains("Actual") & t.contains("Proposed") & t.contains("Versus"), "h")
    under = lines.join(header, PAGE).where((F.col("top") > F.col("h.top")) & t.contains("Requested"))
    sub = under.groupBy(*PAGE).agg(F.min_by(F.struct("top", "ws"), "top").alias("s"))
    geo = header.join(sub, PAGE)
    head = {k: _word(F.col("h.ws"), w) for k, w in zip(STAGE_KEYS, ("Actual", "Adopted", "Requested", "Proposed"))}
    change = F.filter("s.ws", lambda w: w["text"].isin("Adopted", "Requested") & (w["x0"] > _word(F.col("h.ws"), "Proposed")["x1"]))
    stages = F.array(*[_column(i, k, w["x0"], w["x1"]) for i, (k, w) in enumerate(head.items())])
    changes = F.transform(change, lambda w, i: F.struct((i + 4).alias("ordinal"), F.when(i == 0, CHANGE_KEYS[0]).otherwise(
        CHANGE_KEYS[1]).alias("key"), w["x0"].alias("x0"), w["x1"].alias("x1")))
    geo = geo.select(*PAGE, F.col("s.top").alias("from"), F.col("h.top").alias("head_top"), F.when(
        F.size(change) == 2, F.concat(stages, changes)).otherwise(stages).alias("cols"))
    body = lines.join(geo, PAGE).where(~t.contains(FOOTER))
    title = F.create_map(*[F.lit(x) for pair in BLOCK_TITLES.items() for x in pair])[F.trim("text")]
    digits = F.size(F.filter("ws", lambda w: w["text"].rlike("[0-9]")))
    prose = (F.size("ws") >= 8) & (digits < 2)
    years = F.filter("ws", lambda w: w["text"].rlike("[0-9]"))
    repeat = t.contains("Budget Budget") | F.exists("ws", lambda w: w["text"].isin("Proposed", "Change", "Versus")) | (
        F.forall(years, lambda w: w["text"].rlike(r"^20\d\d$")) & (label(F.col("ws"), 180.0) == ""))
    below = F.col("top") > F.col("from")
    stops = body.where(below & (prose | t.contains("SUMMARY OF SERVICES"))).groupBy(*PAGE).agg(F.min("top").alias("stop"))
    above = body.where((F.col("top") < F.col("head_top")) & title.isNotNull()).groupBy(*PAGE).agg(
        F.max_by(title, "top").alias("title_above"))
    body = body.where(below).join(stops, PAGE, "left").join(above, PAGE, "left").where(F.col("top") < F.coalesce("stop", F.lit(10_000.0)))
    body = body.withColumn("title", title).where(F.col("title").isNotNull() | ~repeat)
    body = body.withColumns({"label": label(F.col("ws"), F.get("cols", F.lit(0))["x0"] - 5),
                             "vals": F.when(F.col("title").isNull(), numbers_by_column(F.col("ws"), F.col("cols"), 35.0, 16.0))})
    keys = F.coalesce(F.map_keys("vals"), F.array().cast("array<string>"))
    body = body.withColumn("stage", F.arrays_overlap(keys, F.array(*[F.lit(k) for k in STAGE_KEYS]))).where(
        F.col("title").isNotNull() | (F.col("label") != "") | (F.size(keys) > 0))
    rows = body.where("stage").groupBy(*PAGE).agg(F.array_sort(F.collect_list("top")).alias("tops"))
    body = body.join(rows, PAGE, "left")
    near = F.array_min(F.transform("tops", lambda x: F.struct(F.abs(x - F.col("top")).alias("d"), x.alias("top"))))
    next_row = F.get(F.filter("tops", lambda x: x > F.col("top")), F.lit(0))
    connector = F.col("label").rlike(r"(?i)(-|–|\bfor|\bof|\band|\bthe|\bto)\z")
    loose = ~F.col("stage") & F.col("title").isNull()
    target = F.when(F.col("stage"), F.col("top")).when(loose & (F.col("label") != "") & connector & next_row.isNotNull(), next_row).when(
        loose & (near["d"] <= wrap), near["top"])
    body = body.withColumn("target", target)
    group = F.when(F.col("title").isNotNull(), F.col("title")).when(F.col("target").isNull() & (F.col("label") != ""), F.lower("label"))
    w = Window.partitionBy(*PAGE).orderBy("top").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = body.withColumn("group", F.coalesce(F.last(group, ignorenulls=True).over(w), F.col("title_above")))
    merged = body.where("target is not null").groupBy(*PAGE, F.col("target").alias("top")).agg(
        F.trim(text_of(F.collect_list(F.when(F.col("label") != "", F.struct("top", F.col("label").alias("text")))))).alias("label"),
        F.max(F.when(F.col("stage"), F.col("group"))).alias("group"), F.count_if(~F.col("stage")).alias("parts"),
        *[F.min_by(F.col("vals")[k], F.when(F.col("vals")[k].isNotNull(), F.struct(~F.col("stage"), F.col("top")))).alias(k)
          for k in STAGE_KEYS + CHANGE_KEYS])
    revenue = F.col("group").isin("revenues", "source of funds") | F.coalesce(F.col("group").endswith("revenues"), F.lit(False))
    named = F.create_map(*[F.lit(x) for pair in V.SUMMARY_METRICS.items() for x in pair])[F.col("label")]
    metric = (F.when(revenue & (F.col("label") == "Total"), "rev_total").when(revenue, F.concat(F.lit("rev_"), X.slug(F.col("label"))))
              .when(F.col("label") == "Total", "total_expenditures").otherwise(F.coalesce(named, X.slug(F.col("label")))))
    flags = F.array_compact(F.array(*[F.when(F.col(k).startswith("["), F.lit(f"printed_bracketed:{k}")) for k in STAGE_KEYS + CHANGE_KEYS]))
    return merged.join(page_departments.select("page", "dept"), "page").select(
        *PAGE, "top", "dept", metric.alias("metric"), "label", "group", flags.alias("flags"), (F.col("parts") > 0).alias("label_wrapped"),
        *[printed_value(F.col(k)).cast("decimal(14,2)").alias(k) for k in STAGE_KEYS + CHANGE_KEYS])


# --- Section totals, comparisons, department lists ---------------------------------------------------------------------------


def section_totals(lines: DataFrame, label_x: float = 200.0) -> DataFrame:
    """Budget, non-levy and levy lines of each lettered section with their rates; the section is carried down."""
    keys = ["adopted_2026", "proposed_2027", "change", "tax_rate_2026", "tax_rate_2027", "tax_rate_change"]
    header = _first(lines, F.col("text").startswith("2026 2027 CHANGE"), "h")
    geo = header.select(*PAGE, F.col("h.top").alias("from"), F.array(*[
        _column(i, k, F.get("h.ws", F.lit(i))["x0"], F.get("h.ws", F.lit(i))["x1"]) for i, k in enumerate(keys)]).alias("cols"))
    body = lines.join(geo, PAGE).where((F.col("top") >= F.col("from") + 25) & (F.col("top") <= 700))
    first = F.get("ws", F.lit(0))["text"]
    letter = F.nullif(F.regexp_extract(first, r"^([A-N])\.$", 1), F.lit(""))
    sub = F.concat(F.lit("SUBTOTAL_"), F.regexp_replace(F.split_part(F.col("label"), F.lit(" "), F.lit(2)), r"\W", ""))
    body = body.withColumn("label", label(F.col("ws"), label_x))
    section = F.coalesce(letter, F.when(first == "TOTAL", "TOTAL").when(first == "SUBTOTAL", sub))
    body = body.withColumns({"opens": F.when(section.isNotNull(), F.struct(section.alias("section"), F.col("label").alias("label"))),
                             "kind": F.create_map(*[F.lit(x) for x in ("1.", "budget", "2.", "non_levy", "3.", "levy")])[first],
                             "vals": numbers_by_column(F.col("ws"), F.col("cols"), 30.0, 16.0)})
    body = carry_last(body, PAGE, ["top"], F.col("opens"), "own")
    w = Window.partitionBy(*PAGE).orderBy("top")
    # Numbers printed a hair under their label stand on a line of their own.
    spilled = (F.size("vals") == 0) & F.lead("kind").over(w).isNull()
    body = body.withColumn("vals", F.when(spilled, F.coalesce(F.lead("vals").over(w), F.col("vals"))).otherwise(F.col("vals")))
    value = lambda k, t: parse_decimal(F.col("vals")[k]).cast(t).alias(k)
    return body.where("kind is not null").select(
        *PAGE, "own.section", "own.label", F.col("kind").alias("line"), *[value(k, "long") for k in keys[:3]],
        *[value(k, "decimal(8,2)") for k in keys[3:]])


def footnote_amount(lines: DataFrame, word: str = "Assessed") -> DataFrame:
    """The dollar figure of the footnote line that holds a word."""
    note = _first(lines, F.exists("ws", lambda w: w["text"] == word), "n")
    digits = F.regexp_replace(F.regexp_extract("n.text", r"\$([\d,]+)", 1), ",", "")
    return note.select(*PAGE, digits.try_cast("long").alias("value"), F.col("n.text").alias("text"))


def section_comparisons(lines: DataFrame, label_x: float = 235.0) -> DataFrame:
    """Lines of each section with the headings they stand under, by indent."""
    header = _first(lines, F.col("text").startswith("Budget Budget Budget"), "h")
    at = lambda i: F.get("h.ws", F.lit(i))
    spans = [(0, 0), (1, 1), (2, 2), (3, 4), (5, 6)]
    geo = header.select(*PAGE, F.col("h.top").alias("from"), F.array(*[
        _column(n, k, at(a)["x0"], at(b)["x1"]) for n, (k, (a, b)) in enumerate(zip(FIVE_KEYS, spans))]).alias("cols"))
    body = lines.join(geo, PAGE).where((F.col("top") > F.col("from") + 5) & ~F.col("text").contains(FOOTER)).withColumns({
        "label": label(F.col("ws"), label_x), "vals": numbers_by_column(F.col("ws"), F.col("cols"), 30.0, 12.0)})
    bare = F.size("vals") == 0
    opens = F.when(bare, F.nullif(F.regexp_extract("label", r"^([A-N])\.\s+(.*)$", 1), F.lit("")))
    body = body.withColumn("_opens", opens)
    body = carry_last(body, ["doc"], ["page", "line"], F.col("_opens"), "section", ["page"])
    body = running_count(body, ["doc"], ["page", "line"], F.col("_opens").isNotNull(), "_part", ["page"])
    body = body.where("_opens is null").withColumn("_i", (F.col("page").cast("long") * 1000 + F.col("line")))
    row = F.struct(F.col("_i").alias("i"), F.get("ws", F.lit(0))["x0"].alias("indent"), F.col("label"), bare.alias("heading"))
    # One section of one book: a few dozen lines.
    paths = body.groupBy("doc", "_part").agg(F.array_sort(F.collect_list(row)).alias("rows")).select(
        "doc", F.inline(indent_paths(F.col("rows")))).withColumnRenamed("i", "_i").withColumnRenamed("path", "group_path")
    return body.where(~bare).join(paths, ["doc", "_i"]).select(
        *PAGE, "section", "group_path", F.col("label").alias("line"), *[parse_decimal(F.col("vals")[k]).cast("long").alias(k) for k in FIVE_KEYS])


def department_list(lines: DataFrame, label_x: float = 235.0, reach: float = 8.0) -> DataFrame:
    """Department rows with five right-aligned values.  Columns come from the first row that has all five; a value in
    parentheses is a division subtotal, kept positive and flagged."""
    number = r"^\(?-?[\d,]+(\.\d+)?\)?$"
    nums = F.filter("ws", lambda w: w["text"].rlike(number))
    full = _first(lines, F.size(nums) == 5, "f")
    geo = full.select(*PAGE, F.transform(F.filter("f.ws", lambda w: w["text"].rlike(number)), lambda w: w["x1"]).alias("edges"))
    body = by_key(lines, geo, PAGE).where(~F.col("text").contains(FOOTER)).withColumn("raw_label", label(F.col("ws"), label_x))
    body = body.withColumn("label", F.regexp_replace("raw_label", r"[ *]+\z", "")).where((F.col("label") != "") & ~F.col("label").startswith("*"))

    def nearest(w: Column) -> Column:
        return F.array_min(F.transform("edges", lambda e, i: F.struct(F.abs(w["x1"] - e).alias("d"), i.alias("i"))))

    placed = F.filter(F.transform(nums, lambda w: F.struct(nearest(w).alias("n"), w["text"].alias("t"))), lambda p: p["n"]["d"] <= reach)
    body = body.withColumn("cells", placed)
    w = Window.partitionBy(*PAGE).orderBy("top").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    body = body.withColumn("_group", F.last(F.when(F.size("cells") == 0, F.col("label")), ignorenulls=True).over(w)).where(F.size("cells") > 0)
    indent = F.get("ws", F.lit(0))["x0"]

    def at(i: int, p: Column) -> Column:
        return p["n"]["i"] == i

    value = lambda i: parse_decimal(F.regexp_replace(F.element_at(F.filter("cells", partial(at, i)), -1)["t"], "[()]", ""))
    safe = lambda i: F.when(F.exists("cells", partial(at, i)), value(i))
    return body.select(
        *PAGE, "label", F.when(indent > 55, F.col("_group")).alias("group"), F.round(indent, 1).alias("indent"),
        F.col("raw_label").rlike(r"\*\s*\z").alias("footnote_star"),
        F.exists("cells", lambda c: c["t"].startswith("(")).alias("is_division_subtotal"),
        *[safe(i).alias(k) for i, k in enumerate(FIVE_KEYS)])


# --- Bordered tables: cells(doc, page, table_no, row_no, cells array<string>) -------------------------------------------------


def _no_dash(text: Column) -> Column:
    return F.when(~F.trim(text).isin("-", "—", "–", ""), F.regexp_replace(text, r"[\[\]]", ""))


def table_kinds(cells: DataFrame) -> DataFrame:
    """Header row and kind of each table.  A headerless five-column table after a position table goes on with it."""
    heads = cells.where("row_no = 0").withColumn("head", F.array_join("cells", " "))
    h = F.col("head")
    own = (F.when(F.upper("head").startswith("DESCRIPTION OF SERVICES"), "services")
           .when(h.startswith("Key Performance Measures") | h.startswith("Indicators"), "kpis")
           .when(h.contains("Position Title"), "position_changes"))
    heads = heads.withColumn("kind", own)
    order = ["page", "table_no"]
    heads = carry_last(heads, ["doc", "dept"] if "dept" in heads.columns else ["doc"], order, F.when(own == "position_changes", own), "_before",
                       inclusive=False)
    goes_on = (F.size("cells") == 5) & F.col("_before").isNotNull() & F.col("kind").isNull() & ~h.rlike("Description|Key Performance|Indicators")
    return heads.select("doc", "page", "table_no", F.when(goes_on, "position_changes").when(F.col("kind").isNull(), "unknown").otherwise(
        F.col("kind")).alias("kind"), goes_on.alias("headerless"), F.col("cells").alias("head"))


def services(cells: DataFrame, kinds: DataFrame) -> DataFrame:
    """Columns found by header word, not by place."""
    rows = by_key(cells, kinds.where("kind = 'services'"), ["doc", "page", "table_no"]).where("row_no > 0")

    def cell(word: str) -> Column:
        at = F.array_position(F.transform("head", lambda x: F.lower(x).contains(word)), True)
        return F.when(at > 0, F.get("cells", at.cast("int") - 1))

    number = lambda word: parse_decimal(_no_dash(cell(word)))
    desc = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    seen = (desc != "") | F.coalesce(*[F.nullif(cell(w), F.lit("")) for w in ("operating", "capital", "grant", "fte")]).isNotNull()
    return rows.where(seen).select(
        "doc", "page", "table_no", "row_no", desc.alias("description"), *[number(w).cast("long").alias(w) for w in ("operating", "capital", "grant")],
        number("fte").cast("decimal(10,2)").alias("ftes"), F.lower(F.trim(desc)).isin("total", "totals").alias("is_total"))


def kpis(cells: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row per measure.  A cell that packs bullets is split when every value cell holds one value per bullet; otherwise the
    row stays as printed, flagged."""
    rows = by_key(cells, kinds.where("kind = 'kpis'"), ["doc", "page", "table_no"]).where((F.col("row_no") > 0) & (F.get("cells", F.lit(0)) != ""))
    parts = F.transform(F.split(F.get("cells", F.lit(0)), "•"), lambda x: F.trim(x))
    tail = F.slice("cells", 2, F.size("cells"))
    split = F.transform(tail, lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""))
    n = F.size(parts) - 1
    rows = rows.withColumns({"_parts": parts, "_split": split, "_n": n}).withColumn(
        "_ok", (F.col("_n") > 0) & F.forall("_split", lambda c: F.size(c) == F.col("_n")))
    whole = F.array(F.struct(F.get("cells", F.lit(0)).alias("measure"), F.lit(None).cast("string").alias("group"), tail.alias("values"),
                             F.when(F.col("_n") > 0, F.array(F.lit("bulleted_values_not_split"))).otherwise(
                                 F.array().cast("array<string>")).alias("flags")))
    bullets = F.transform(F.slice("_parts", 2, F.size("_parts")), lambda p, i: F.struct(
        p.alias("measure"), F.get("_parts", F.lit(0)).alias("group"), F.transform("_split", lambda c: F.get(c, i)).alias("values"),
        F.array().cast("array<string>").alias("flags")))
    return rows.select("doc", "page", "table_no", "row_no", F.slice("head", 2, F.size("head")).alias("col_labels"),
                       F.inline(F.when(F.col("_ok"), bullets).otherwise(whole)))


def position_changes(cells: DataFrame, kinds: DataFrame) -> DataFrame:
    """Position rows; a row without title and reason takes those of the row above.  Heading rows become the section of the
    rows beneath them, over page breaks."""
    rows = by_key(cells, kinds.where("kind = 'position_changes'"), ["doc", "page", "table_no"]).where((F.col("row_no") > 0) | F.col("headerless"))
    at = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    number = lambda i: parse_decimal(_no_dash(at(i))).cast("decimal(10,2)")
    r = rows.select("doc", "page", "table_no", "row_no", number(0).alias("positions"), number(1).alias("om_ftes"), number(2).alias("non_om_ftes"),
                    at(3).alias("_title"), at(4).alias("_reason"))
    values = F.coalesce("positions", "om_ftes", "non_om_ftes").isNotNull()
    blank = (F.col("_title") == "") & (F.col("_reason") == "")
    table, order = ["doc", "page", "table_no"], ["row_no"]
    r = carry_last(r.where(~blank | values), table, order, F.when(~blank, F.struct("_title", "_reason")), "own").where("own is not null")
    r = r.select("doc", "page", "table_no", "row_no", "positions", "om_ftes", "non_om_ftes", F.col("own._title").alias("title"),
                 F.nullif(F.col("own._reason"), F.lit("")).alias("reason"), blank.alias("merged_with_previous"))
    is_total = F.lower(F.trim("title")).isin("total", "totals")
    r = r.withColumn("is_total", is_total)
    heading = ~values & F.col("reason").isNull() & ~F.col("is_total") & (F.col("title") != "")
    r = r.withColumn("_heading", heading)
    r = carry_last(r, ["doc"], ["page", "table_no", "row_no"], F.when(F.col("_heading"), F.col("title")), "section", ["page"])
    return r.where("not _heading").withColumns({
        "section": F.when(~F.col("is_total"), F.col("section")),
        "reason_category": F.when(~F.col("is_total"), X.reason_category(F.col("reason")))}).drop("_heading")


def unknown_tables(kinds: DataFrame) -> DataFrame:
    """Tables that no header signature names and no table before them goes on into, with the words of their first row."""
    return kinds.where("kind = 'unknown'").select("doc", "page", "table_no", F.substring(F.array_join("head", " "), 1, 80).alias("head"))


def borderless_position_changes(lines: DataFrame) -> DataFrame:
    """Position changes printed without borders, from page_lines (doc, page, [dept,] line, top, ws, text).

    A page is read where it prints the column header, or goes on (it has the introduction's words) with the layout of the last
    page of its document and department that did.  The left edges of titles and reasons are the commonest places at which
    words open a line or follow a gap, since headers are centred over their columns.  A row is anchored on its numbers; a
    reason line between two anchors goes to the upper one until the sentence start nearest to the middle between them, and
    to the lower one from there on; a title line joins the anchor near it, or else heads the rows beneath it.  Lines of a
    row are read from top to bottom."""
    scope = ["doc", *(["dept"] if "dept" in lines.columns else [])]
    page, texts = [*scope, "page"], F.transform("ws", lambda w: w["text"])
    number = lambda t: t.rlike(r"^(\(?-?[\d.,]+\)?|-)$")
    middle = lambda w: (w["x0"] + w["x1"]) / 2
    at = lambda i, name: F.struct(F.lit(i).alias("i"), middle(name).alias("x"))
    lines = materialize(lines)
    # few bytes, much work: dealt by page by their number, which all that follows keeps to
    lines = lines.repartition(1 + lines.count() // PART_LINES, *page)

    # where each page starts and how it is laid out
    is_header = F.array_contains(texts, "Positions") & F.array_contains(texts, "Title") & F.array_contains(texts, "Reason")
    ftes = F.filter("ws", lambda w: w["text"] == "FTEs")
    layout = F.when(F.size(ftes) == 2, F.struct(F.get(ftes, F.lit(1))["x1"].alias("numbers_end"), _word(F.col("ws"), "Title")["x1"].alias("title_end"),
                                                F.array(at(0, _word(F.col("ws"), "Positions")), at(1, F.get(ftes, F.lit(0))), at(2, F.get(ftes, F.lit(1)))).alias("centres")))
    marks = lines.groupBy(*page).agg(F.min_by(F.struct("top", layout.alias("layout")), F.when(is_header, F.col("top"))).alias("h"),
                                     F.min(F.when(F.col("text").startswith("Specific ADDITIONAL"), F.col("top"))).alias("intro"))
    marks = carry_last(marks, scope, ["page"], F.col("h.layout"), "_layout", ["page"])
    begins = F.when(F.col("h").isNotNull(), F.when(F.col("h.layout").isNotNull(), F.col("h.top"))).otherwise(F.col("intro"))
    marks = marks.select(*page, begins.alias("_start"), "_layout").where("_start is not null and _layout is not null")
    body = lines.join(marks, page).where((F.col("top") > F.col("_start")) & ~F.col("text").contains(FOOTER))

    # left edges of titles and reasons
    opening = F.filter(F.transform("ws", lambda w, i: F.struct(w["x0"].alias("x0"), w["text"].alias("text"), F.when(i > 0, F.get("ws", i - 1)["x1"]).alias("before"))),
                       lambda w: (w["x0"] > F.col("_layout.numbers_end")) & ~number(w["text"]) & F.coalesce(w["x0"] - w["before"] > 25, F.lit(True)))
    edges = body.select(*page, "_layout", F.explode(opening).alias("w")).groupBy(*page, "_layout", F.rint("w.x0").alias("x")).agg(F.count("*").alias("n"))
    common = lambda cond: F.max_by("x", F.when(cond, F.struct("n", -F.col("x")))) - 3
    edges = edges.groupBy(*page).agg(common(F.col("x") < F.col("_layout.title_end")).alias("_t"), common(F.col("x") >= F.col("_layout.title_end") - 30).alias("_r"))
    body = body.join(edges, page, "left").withColumns({"_t": F.coalesce("_t", F.col("_layout.numbers_end") + 10), "_r": F.coalesce("_r", F.col("_layout.title_end") + 60)})
    said = lambda cond: F.array_join(F.transform(F.filter("ws", cond), lambda w: w["text"]), " ")
    body = body.select(*page, "line", "top", F.filter("ws", lambda w: (w["x1"] < F.col("_t")) & number(w["text"])).alias("nums"), F.col("_layout.centres").alias("centres"),
                       said(lambda w: (w["x0"] >= F.col("_t")) & (w["x0"] < F.col("_r"))).alias("title"), said(lambda w: w["x0"] >= F.col("_r")).alias("reason"))
    total = F.lower(F.trim("title")).isin("total", "totals")
    ends = F.min(F.when(total, F.col("top"))).over(Window.partitionBy(*page))
    body = body.withColumn("_end", ends).where(F.col("_end").isNull() | (F.col("top") <= F.col("_end")))

    # anchors, and for every other line those above and below it
    down = Window.partitionBy(*page).orderBy("top")
    anchor = F.size("nums") > 0
    up = Window.partitionBy(*page).orderBy(F.col("top").desc())
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(anchor, F.struct("top", "title", "reason")), ignorenulls=True)
    body = body.drop("_end").withColumns({"_anchor": anchor, "_above": F.count_if(anchor).over(before(down)), "up": near.over(before(down))})
    body = body.withColumn("low", near.over(before(up)))

    # the row of each line's reason; a reason line's neighbours are the reason lines between the same two anchors
    beside = ~F.col("_anchor") & (F.col("up").isNotNull() | F.col("low").isNotNull())
    body = body.withColumn("_says", beside & (F.col("reason") != ""))
    said_before = F.last(F.when(F.col("_says"), F.col("reason")), ignorenulls=True).over(before(Window.partitionBy(*page, "_above", "_anchor").orderBy("top")))
    said_before = F.coalesce(said_before, F.when(F.col("up.reason") == "", ".").otherwise(F.col("up.reason")), F.lit("."))
    body = body.withColumn("_starts", F.col("_says") & F.rtrim(said_before).rlike(r"[.)]\z") & F.col("reason").rlike(r"^\p{Lu}"))
    mid = (F.col("up.top") + F.col("low.top")) / 2
    nearest = F.min(F.when(F.col("_starts"), F.struct(F.abs(F.col("top") - mid).alias("d"), F.col("top").alias("t")))).over(Window.partitionBy(*page, "_above", "_anchor"))
    body = body.withColumn("_split", F.coalesce(nearest["t"], mid))
    own = F.col("_above") + 1
    to = F.when(F.col("up").isNull(), 1).when(F.col("low").isNull(), F.col("_above")).when(F.col("top") >= F.col("_split"), own).otherwise(F.col("_above"))

    # the row of each line's title, or the row that it heads
    gap = lambda side: F.abs(F.col(f"{side}.top") - F.col("top"))
    upper = F.col("low").isNull() | (F.col("up").isNotNull() & (gap("up") <= gap("low")))
    side = lambda c: F.when(upper, F.col(f"up.{c}")).otherwise(F.col(f"low.{c}"))
    joins = F.abs(side("top") - F.col("top")) <= F.when(side("title") == "", 20).otherwise(8)
    titled = beside & (F.col("title") != "")
    part = lambda kind, cond, a, text: F.when(cond, F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), text.alias("text")))
    none = F.lit(None).cast("string")
    parts = F.array_compact(F.array(
        part("row", F.col("_anchor"), own, none), part("reason", F.col("_anchor") & (F.col("reason") != ""), own, F.col("reason")), part("reason", F.col("_says"), to, F.col("reason")),
        part("title", F.col("_anchor") & (F.col("title") != ""), own, F.col("title")), part("title", titled & joins, F.when(upper, F.col("_above")).otherwise(own), F.col("title")),
        part("head", titled & ~joins & ~upper, own, F.col("title"))))
    lined = body.select(*page, "line", "top", "nums", "centres", F.explode(parts).alias("p")).select("*", "p.*")
    is_row, kept = F.col("kind") == "row", lambda kind: F.when(F.col("kind") == kind, F.struct("top", "text"))
    gathered = lambda kind: F.when(F.count_if(F.col("kind") == kind) > 0, text_of(F.collect_list(kept(kind))))
    out = lined.groupBy(*page, "a").agg(
        F.max(F.when(is_row, F.struct("line", "nums", "centres"))).alias("_row"), gathered("reason").alias("_reason"), gathered("title").alias("_title"),
        F.max_by("text", F.when(F.col("kind") == "head", F.col("top"))).alias("_head")).where("_row is not null").select("*", "_row.*")

    def value(i: int) -> Column:
        mine = F.filter("nums", lambda w: F.array_min(F.transform("centres", lambda c: F.struct(F.abs(middle(w) - c["x"]).alias("d"), c["i"].alias("i"))))["i"] == i)
        return parse_decimal(_no_dash(F.try_element_at(mine, F.lit(-1))["text"])).cast("decimal(10,2)")

    group = F.last("_head", ignorenulls=True).over(Window.partitionBy(*page).orderBy("a").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    title = F.coalesce("_title", F.lit(""))
    return out.select(*page, "line", value(0).alias("positions"), value(1).alias("om_ftes"), value(2).alias("non_om_ftes"), title.alias("title"), F.col("_reason").alias("reason"), group.alias("group"),
                      F.lower(F.trim(title)).isin("total", "totals").alias("is_total"))


def all_position_changes(cells: DataFrame, lines: DataFrame) -> DataFrame:
    """Position changes of bordered tables, and of pages that have none the rows printed without borders."""
    kinds = table_kinds(cells)
    bordered = position_changes(cells, kinds).withColumn("bordered", F.lit(True))
    pages = kinds.where("kind = 'position_changes'").select("doc", "page").distinct()
    free = borderless_position_changes(lines).join(pages, ["doc", "page"], "left_anti")
    free = free.withColumns({"bordered": F.lit(False), "reason_category": F.when(~F.col("is_total"), X.reason_category(F.col("reason")))})
    columns = ["doc", "page", "positions", "om_ftes", "non_om_ftes", "title", "reason", "reason_category", "is_total", "bordered"]
    return bordered.select(*columns).unionByName(free.select(*columns))


# --- Capital items ----------------------------------------------------------------------------------------------------------


def capital_name(text: Column) -> Column:
    """A project's name: before a parenthesised amount, before a colon, before a dash, or after 'for'."""
    paren_at = F.instr(text, F.regexp_extract(text, V.PAREN_AMOUNT, 0))
    paren = F.regexp_extract(text, V.PAREN_AMOUNT, 0)
    before = F.regexp_replace(text.substr(F.lit(1), paren_at - 1), r"^[ •:–-]+|[ •:–-]+\z", "")
    colon = F.nullif(F.regexp_extract(text, V.COLON_NAME, 1), F.lit(""))
    bare = F.regexp_replace(colon, r"[()]", "")
    colon_ok = ~colon.startswith("The ") & ~bare.substr(F.lit(1), F.length(bare) - 1).contains(".")
    dash = F.nullif(F.regexp_extract(text, V.DASH_NAME, 1), F.lit(""))
    named = F.trim(F.regexp_extract(text, V.FOR_NAME, 1))
    lifted = F.concat(F.upper(F.substring(named, 1, 1)), named.substr(F.lit(2), F.length(named)))
    return (F.when((paren != "") & (paren_at <= 120), before).when(F.coalesce(colon_ok, F.lit(False)), F.trim(colon))
            .when(dash.isNotNull(), F.trim(dash)).when((named != "") & ~F.rtrim(text).endswith(":"), lifted))


def capital_facts(items: DataFrame, text: str = "text") -> DataFrame:
    """Name, amount, printed amount and kind of each item; a misprinted amount keeps its text and no number."""
    t = F.col(text)
    source = F.when(t.rlike(V.PAREN_AMOUNT), V.PAREN_AMOUNT).otherwise(V.SENTENCE_AMOUNT)
    part = lambda i: F.when(t.rlike(V.PAREN_AMOUNT), F.regexp_extract(t, V.PAREN_AMOUNT, i)).otherwise(
        F.regexp_extract(t, V.SENTENCE_AMOUNT, i))
    out = items.withColumns({"name": capital_name(t), "amount_text": F.nullif(F.trim(part(0)), F.lit("")),
                             "amount": F.when(source.isNotNull() & (part(1) != ""), amount_in_words(F.regexp_replace(part(1), r"\.\z", ""), part(2))),
                             "amount_from_millions": part(2) != ""})
    kind = (F.when(F.rtrim(t).rlike(V.FUNDING_SOURCE), "funding_source").when(F.rtrim(t).endswith(":"), "list_heading")
            .when(F.col("name").isNotNull(), "project").otherwise("context"))
    return out.withColumn("kind", kind)


def capital_items(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines(keys..., page, line, text): items under CAPITAL PROJECTS headings, joined across lines and pages until the next
    heading.  A bullet starts an item; outside bullets a finished sentence does."""
    order = ["page", "line"]
    t = F.trim("text")
    opens = t == "CAPITAL PROJECTS"
    closes = t.rlike(V.CAPS_HEADING) | t.rlike(r"^(Key Performance|Description of Services|DESCRIPTION OF SERVICES)") | t.rlike(r"^20\d\d 20\d\d")
    r = carry_last(lines, keys, order, F.when(opens, True).when(closes, False), "_in", ["page"])
    r = running_count(r, keys, order, opens, "_list", ["page"]).where(F.coalesce("_in", F.lit(False)) & ~opens)
    bullet = F.col("text").startswith("•")
    ends = F.rtrim("text").endswith(".") & ~F.rtrim("text").rlike(V.ABBREVIATION_END)
    # In a list that has seen a bullet every other line goes on with it; before that a finished sentence ends an item.
    scope = [*keys, "_list"]
    r = running_count(r.withColumn("_bullet", bullet), scope, order, F.col("_bullet"), "_bullets", ["page"])
    prev_ends = F.lag(ends).over(Window.partitionBy(*scope).orderBy(*order))
    fresh = F.col("_bullet") | ((F.col("_bullets") == 0) & F.coalesce(prev_ends, F.lit(True)))
    r = running_count(r.withColumn("_fresh", fresh), scope, order, F.col("_fresh"), "_item", ["page"])
    clean = F.trim(F.regexp_replace("text", r"^[• ]+", ""))
    items = r.groupBy(*scope, "_item").agg(
        text_of(F.collect_list(F.struct("page", "line", F.when(F.col("_bullet"), clean).otherwise(t).alias("text")))).alias("text"),
        F.array_sort(F.collect_set("page")).alias("pdf_pages"), F.min("page").alias("page"))
    return capital_facts(items).drop("_list", "_item").withColumnRenamed("text", "description")


# --- Revenues ------------------------------------------------------------------------------------------------------------------


def all_revenues(source_of_funds: DataFrame, line_items: DataFrame, fund_summaries: DataFrame) -> DataFrame:
    """Three printed sources under one schema.  source_of_funds and fund_summaries are budget_summary rows; lines after the
    amount to be raised take that line as their category."""
    none = F.lit(None).cast("string")
    stages = [F.col(s).cast("long").alias(s) for s in STAGE_KEYS]
    raised = F.when(F.col("label").startswith("Amount to be Raised"), F.col("label"))
    first = carry_last(source_of_funds, ["doc"], ["page", "top"], raised, "_after", ["page"])
    a = first.select(F.lit("summary").alias("source"), F.lit("general").alias("fund"), none.alias("dept"), F.coalesce("_after", "group").alias("category"),
                     F.col("label").alias("line"), F.lower("label").startswith("total").alias("is_total"), *stages, none.alias("account"))
    listing = line_items.where((F.col("section") == "430") & F.col("row_type").isin("account", "rollup", "item"))
    b = listing.select(F.lit("detailed").alias("source"), F.coalesce("fund", F.lit("general")).alias("fund"), none.alias("dept"),
                       F.try_element_at("hierarchy_path", F.lit(-1)).alias("category"), F.col("description").alias("line"), F.col("is_subtotal").alias("is_total"),
                       *stages, "account")
    c = fund_summaries.where(F.coalesce("group", F.lit("")).contains("revenue")).select(
        F.lit("summary").alias("source"), F.col("dept").alias("fund"), "dept", F.lit("fund revenues").alias("category"), F.col("label").alias("line"),
        (F.col("metric") == "rev_total").alias("is_total"), *stages, none.alias("account"))
    return a.unionByName(b).unionByName(c)
