"""Narrative text to cited passages: clean lines, section modes, sentence packing, cards, and passages for statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallybook import fixed_values as V
from tallybook.functions import text as X
from tallybook.functions.trigrams import let
from tallybook.operators.chains import greedy_starts
from tallybook.operators.running import carry_last, numbered, previous, running_count, running_sums, text_of
from tallybook.session import by_key, forget, materialize



def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


# --- Lines ---------------------------------------------------------------------------------------------------------------


def page_lines(pages: DataFrame, keys: list[str]) -> DataFrame:
    """pages(keys..., page, text) as trimmed lines with their place; blank lines, footers and page numbers are dropped."""
    lines = pages.select(*keys, "page", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    line = F.trim("raw")
    return lines.select(*keys, "page", "pos", line.alias("line")).where(
        (F.col("line") != "") & (F.col("line") != V.PAGE_FOOTER) & ~F.col("line").rlike(r"^\d{1,3}$"))


def drop_label_runs(lines: DataFrame, page: list[str], min_run: int = 3, short: int = 6) -> DataFrame:
    """Drop runs of min_run or more consecutive short lines, which are a table's labels.  Bullets and lines that end a
    sentence are not short; the page's first line is its title and always stays.  A page is small, so one window holds it."""
    w = Window.partitionBy(*page).orderBy("pos")
    is_short = ((word_count(F.col("line")) < short) & ~F.col("line").isin("•", "o")
                & ~F.col("line").rlike(r"[.:]\z") & ~F.col("_title"))
    marked = lines.withColumn("_title", F.row_number().over(w) == 1).withColumn("_short", is_short)
    islands = running_count(marked, page, ["pos"], ~F.col("_short"), "_island")
    run = F.count_if("_short").over(Window.partitionBy(*page, "_island"))
    return islands.withColumn("_run", run).where(~F.col("_short") | (F.col("_run") < min_run)).drop(
        "_short", "_island", "_run")


def region_of(title: Column, pdf_page: Column, table_pages: tuple[int, int] = (17, 34)) -> Column:
    t = F.upper(title)
    return (F.when(t.contains("BUDGET INTRODUCTION"), "intro").when(t.contains("SOURCE OF FUNDS"), "source_of_funds")
            .when(t.startswith("C. CAPITAL"), "capital")
            .when(t.rlike(r"^[G-N]\. (?!CITY BUDGETS)") | t.contains("SPECIAL REVENUE"), "special_fund")
            .when(t.contains("CLARIFICATION OF INTENT"), "clarification_of_intent")
            .when(pdf_page.between(*table_pages), "summary_tables").otherwise("department"))


def is_subheading(line: Column, prev: Column) -> Column:
    """A short title-case line without closing punctuation, after a finished sentence."""
    words = F.split(line, r"\s+")
    last = F.lower(F.element_at(words, -1))
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    return (~last.isin(V.SUBHEAD_TAIL) & (commas < 2) & ~F.get(words, F.lit(0)).isin(V.SUBHEAD_NOT_FIRST)
            & F.size(words).between(2, 9) & ~line.rlike(r"[.:,;]\z") & line.rlike(V.SUBHEAD) & (line != F.upper(line))
            & (prev.isNull() | F.rtrim(prev).rlike(r"[.:”)]\z")))


# --- Sections and passages -------------------------------------------------------------------------------------------------


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def packed_sentences(sentences: DataFrame, keys: list[str], max_words: int = 320, min_words: int = 8) -> DataFrame:
    """sentences(keys..., i, t) in order: passages (keys..., n, text) of whole sentences up to max_words; a longer sentence stands
    alone; a passage under min_words is dropped.  A key may hold any number of sentences: where passages start is a greedy
    cut of the running count of words."""
    s = materialize(sentences.select(*keys, F.col("i").cast("long").alias("i"), "t", word_count(F.col("t")).alias("_words")))
    # The cut is found on counts alone; the sentences themselves move when they are brought together.
    counts = materialize(running_sums(s.select(*keys, "i", "_words", F.floor(F.col("i") / 1024).alias("_part")), keys, ["i"], {"_after": F.col("_words")}, ["_part"]))
    starts = greedy_starts(counts, keys, "i", F.col("_after") - F.col("_words"), F.col("_after"), max_words, 1 << 16)
    counts = materialize(by_key(counts.select(*keys, "i", "_part"), starts.withColumn("_starts", F.lit(True)), [*keys, "i"], "left"))
    n = running_count(counts, keys, ["i"], F.col("_starts"), "n", ["_part"]).select(*keys, "i", "n")
    packed = by_key(s, n, [*keys, "i"]).groupBy(*keys, "n").agg(F.trim(text_of(F.collect_list(F.struct("i", F.col("t").alias("text"))))).alias("text"), F.sum("_words").alias("_words"))
    return packed.where(F.col("_words") >= min_words).drop("_words")


def sentences_of_lines(lines: DataFrame, keys: list[str], order: list[str], bucket: str) -> DataFrame:
    """lines(keys..., order..., t) of one running text as its sentences (keys..., i, t).  A line is cut at its own sentence ends;
    its first piece goes on with the line before unless the seam between them is a sentence end."""
    r = lines.select(*keys, *order, F.col(bucket).alias("_bucket"), squeezed(F.col("t")).alias("t")).where("t <> ''")
    r = materialize(r)
    r = previous(r, keys, order, F.substring("t", -1, 1), "_end", ["_bucket"])
    seam = F.size(F.split(F.concat(F.coalesce("_end", F.lit("")), F.lit(" "), F.substring("t", 1, 1)), V.SENTENCE_BREAK_PACK)) > 1
    pieces = r.select(*keys, *order, "_bucket", seam.alias("_seam"), F.posexplode(F.split("t", V.SENTENCE_BREAK_PACK)).alias("_k", "text"))
    pieces = materialize(pieces.withColumn("_new", F.col("_seam") | (F.col("_k") > 0)))
    pieces = running_count(pieces, keys, [*order, "_k"], F.col("_new"), "i", ["_bucket"])
    return pieces.groupBy(*keys, "i").agg(text_of(F.collect_list(F.struct(*order, "_k", "text"))).alias("t"))


def _heading(line: Column, heads: list[tuple]) -> Column:
    chain = None
    for text, kind in heads:
        hit = F.struct(F.lit(text).alias("head"), F.lit(kind).alias("kind"))
        chain = F.when(line.startswith(text), hit) if chain is None else chain.when(line.startswith(text), hit)
    return chain


def narrative_passages(pages: DataFrame, page_departments: DataFrame, keys: list[str], page_offset: int = 10,
                       max_words: int = 320, front_matter: int = 10, last_department_page: int = 210) -> DataFrame:
    """pages(keys..., page, text), page_departments(page, dept, dept_name, and those of the keys that tell its documents
    apart): passages with id, place, region, department, section, heading, ordinal, text, numbers and context header.

    A document's pages are the buckets of its running state, so a long document spreads over tasks."""
    order = ["page", "pos"]
    # Each stage below reads its input several times, so lines and marked lines are written once.
    lines = materialize(drop_label_runs(page_lines(pages.where(F.col("page") > front_matter), keys), [*keys, "page"]))
    titles = lines.where("_title").select(*keys, "page", F.col("line").alias("title"))
    titles = titles.join(page_departments, [k for k in [*keys, "page"] if k in page_departments.columns], "left").withColumn("region", region_of(F.col("title"), F.col("page")))
    owned = F.col("region").isin("department", "special_fund", "capital")
    titles = titles.withColumns({"dept": F.when(owned, F.col("dept")).when(F.col("region") == "source_of_funds", "gcp-source-of-funds"),
                                 "dept_name": F.when(owned, F.col("dept_name"))})
    lost = (F.col("region") == "department") & F.col("dept").isNull()
    titles = titles.withColumn("region", F.when(lost & (F.col("page") - page_offset > last_department_page), "appendix").when(
        lost, "section_intro").otherwise(F.col("region")))
    place = F.struct("region", F.coalesce("dept", F.lit("-")))
    titles = previous(materialize(titles), keys, ["page"], place, "_was", ["page"])
    titles = materialize(titles.withColumn("_turn", ~place.eqNullSafe(F.col("_was"))).drop("_was"))
    titles = running_count(titles, keys, ["page"], F.col("_turn"), "run", ["page"])
    body = lines.where(~F.col("_title")).join(titles.drop("_turn"), [*keys, "page"])
    body = body.where((F.col("region") != "summary_tables") | ((word_count(F.col("line")) >= 10) & ~X.is_tabular(F.col("line"))))
    heads = [(h, f"n:{k}") for h, k in V.NARRATIVE_HEADS] + [(h, f"t:{k}") for h, k in V.TABLE_HEADS]
    body = body.withColumn("_head", _heading(F.col("line"), heads))
    scope = [*keys, "run"]
    default = F.when(F.col("region") == "department", "n:other").otherwise("n:narrative")
    body = carry_last(body, scope, order, F.col("_head.kind"), "_kind", ["page"])
    body = body.withColumn("_kind", F.coalesce("_kind", default))
    in_table = F.col("_kind").startswith("t:")
    bullets = F.col("_kind").isin("n:service_highlight", "n:capital_project")
    body = body.where(F.col("_head").isNotNull() | ~(in_table | X.is_tabular(F.col("line"))))
    prev = F.lag("line").over(Window.partitionBy(*scope, "page").orderBy("pos"))
    sub = F.col("_head").isNull() & (F.col("region") == "department") & ~in_table & is_subheading(F.col("line"), F.col("_prev"))
    body = body.withColumn("_prev", prev).withColumn("_sub", F.coalesce(sub, F.lit(False)))
    bullet = bullets & (F.col("line") == "•")
    title_text = F.when(F.col("_head").isNotNull() & ~in_table, F.col("_head.head")).when(F.col("_sub"), F.col("line"))
    # Islands and headings are scanned without the lines' text, which then meets them once.
    told = materialize(body.drop("_prev").withColumn("_row", F.monotonically_increasing_id()))
    forget(lines)
    written = materialize(told.select(*scope, *order, "_row", (F.col("_head").isNotNull() | F.col("_sub") | bullet).alias("_opens"), title_text.alias("_heads")))
    marks = running_count(written, scope, order, F.col("_opens"), "_island", ["page"])
    marks = carry_last(marks, scope, order, F.col("_heads"), "heading", ["page"])
    body = by_key(told, marks.select("_row", "_island", "heading"), ["_row"]).drop("_row")
    rest = F.when(F.col("_head").isNotNull(), F.nullif(F.trim(F.expr("substring(line, length(_head.head) + 1)")), F.lit(""))).when(
        ~F.col("_sub") & ~bullet & (F.col("line") != "o"), F.col("line"))
    body = body.where(~in_table).withColumn("_text", rest)
    # A buffer keeps bulleted items apart; prose runs on until a heading.
    island = [*scope, "_island"]
    body = materialize(body)
    forget(told, written)
    islands = body.groupBy(*island, "_kind", "region", "dept", "dept_name").agg(
        F.min("page").alias("pdf_page"), F.max("page").alias("last_page"), F.min_by(F.coalesce("heading", "title"), F.struct("page", "pos")).alias("heading"),
        F.sum(word_count(F.col("_text"))).alias("_words"))
    islands = materialize(islands.withColumn("_whole", F.col("_kind").isin("n:service_highlight", "n:capital_project") & (F.coalesce("_words", F.lit(0)) <= max_words * 1.5)))
    texts = body.where(F.col("_text").isNotNull()).join(islands.select(*island, "_whole"), island).select(*island, "page", "pos", F.col("_text").alias("t"), "_whole")
    items = texts.where("_whole").groupBy(*island).agg(squeezed(text_of(F.collect_list(F.struct("page", "pos", F.col("t").alias("text"))))).alias("text")).where(
        word_count(F.col("text")) >= 8).select(*island, F.lit(1).cast("long").alias("_n"), "text")
    prose = packed_sentences(sentences_of_lines(texts.where("not _whole"), island, ["page", "pos"], "page"), island, max_words)
    kept = items.unionByName(prose.withColumnRenamed("n", "_n"))
    out = islands.join(kept, island).select(*island, "region", "dept", "dept_name", F.expr("substring(_kind, 3)").alias("section_type"), "heading", "pdf_page", "last_page", "_n", "text")
    return with_passage_ids(out, keys, page_offset)


def with_passage_ids(chunks: DataFrame, keys: list[str], page_offset: int = 10) -> DataFrame:
    """Ordinals per run of one region and department; ids stay unique when a region comes back later, taking the numbers
    above those of its first run."""
    chunks = materialize(chunks.withColumns({"_part": F.floor(F.col("_island") / 1024), "_runs": F.floor(F.col("run") / 1024)}))
    marked = numbered(chunks, [*keys, "run"], ["_island", "_n"], "ordinal", ["_part"]).withColumns({
        "ordinal": F.col("ordinal").cast("int"), "base": F.concat_ws(":", "region", F.coalesce("dept", F.lit("-")), "section_type")})
    marked = materialize(marked)
    first = marked.groupBy(*keys, "base").agg(F.min("run").alias("_first"))
    marked = marked.join(first, [*keys, "base"]).withColumn("_again", F.col("run") > F.col("_first"))
    # Ordinals of a first run are free by construction; only later runs of the same base are numbered anew.
    again = marked.groupBy(*keys, "base").agg(F.max(F.when(~F.col("_again"), F.col("ordinal"))).alias("_top"))
    marked = numbered(materialize(marked), [*keys, "base", "_again"], ["run", "ordinal"], "_k", ["_runs"])
    free = F.col("_top") + F.col("_k")
    ided = marked.join(again, [*keys, "base"]).withColumn("_no", F.when(F.col("_again"), free).otherwise(F.col("ordinal")))
    where = F.coalesce("dept_name", F.initcap(F.replace("region", F.lit("_"), F.lit(" "))))
    header = X.context_header(where, F.replace("section_type", F.lit("_"), F.lit(" ")),
                              F.concat(F.lit("Summary p."), (F.col("pdf_page") - page_offset).cast("string")))
    return ided.select(
        *keys, F.concat_ws(":", "base", F.col("_no").cast("string")).alias("id"), "pdf_page",
        (F.col("pdf_page") - page_offset).alias("printed_page"), (F.col("last_page") - page_offset).alias("page_end"), "region",
        "dept", "section_type", "heading", "ordinal", "text", header.alias("context_header"),
        X.passage_numbers(F.col("text")).alias("numbers"), F.col("base").alias("parent_section_id"), F.lit("narrative").alias("kind"))


# --- Cards ---------------------------------------------------------------------------------------------------------------


def table_cards(rows: DataFrame, table: str, description: Column, departments: DataFrame, page_offset: int = 10) -> DataFrame:
    """One routing card per department of a table: where its numbers are, on which pages."""
    span = rows.groupBy("dept").agg(F.min(F.col("cite.printed_page").cast("int")).alias("first"),
                                    F.max(F.col("cite.printed_page").cast("int")).alias("last"))
    names = departments.select(F.col("slug").alias("dept"), "name").distinct()
    pages = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(
        F.concat_ws("–", F.col("first").cast("string"), F.col("last").cast("string")))
    text = F.concat(F.col("name"), F.lit(" "), description,
                    F.lit(". The numbers are in the structured data, not this text. Summary p."), pages, F.lit("."))
    return span.join(names, "dept").select(
        F.concat_ws(":", F.lit("table"), "dept", F.lit(table)).alias("id"), (F.col("first") + page_offset).alias("pdf_page"),
        F.col("first").alias("printed_page"), F.col("last").alias("page_end"), F.lit("department").alias("region"), "dept",
        F.lit(f"{table}_table").alias("section_type"), F.lit(f"{table} table").alias("heading"), F.lit(1).alias("ordinal"),
        text.alias("text"), F.lit("table_card").alias("kind"),
        F.array(F.concat_ws(":", F.lit(table), "dept")).alias("linked_tables"))


def chart_cards(charts: DataFrame, page_offset: int = 10) -> DataFrame:
    """charts(key, page, basis, text): a curated list of charts whose data is not in the text."""
    note = F.concat(F.col("text"), F.lit(" (Summary p."), F.col("page").cast("string"), F.lit("; "), F.col("basis"), F.lit(".)"))
    return charts.select(
        F.concat(F.lit("chart:-:"), "key").alias("id"), (F.col("page") + page_offset).alias("pdf_page"), F.col("page").alias("printed_page"),
        F.col("page").alias("page_end"), F.lit("intro").alias("region"), F.lit(None).cast("string").alias("dept"),
        F.lit("chart").alias("section_type"), F.col("key").alias("heading"), F.lit(1).alias("ordinal"), note.alias("text"),
        F.lit("chart_card").alias("kind"), F.array().cast("array<string>").alias("linked_tables"))


def linked_tables(passages: DataFrame, cards: DataFrame) -> DataFrame:
    """Every department passage with the table cards of its department."""
    per = cards.where("kind = 'table_card' and dept is not null").select("dept", F.explode("linked_tables").alias("t")).distinct()
    sets = per.groupBy("dept").agg(F.array_sort(F.collect_list("t")).alias("linked_tables"))
    return passages.join(sets, "dept", "left").withColumn(
        "linked_tables", F.coalesce("linked_tables", F.array().cast("array<string>")))


# --- Passages for statements -------------------------------------------------------------------------------------------------


def anchors_of(statement: Column) -> Column:
    figures = F.regexp_extract_all(statement, F.lit(V.ANCHOR_FIGURE), F.lit(0))
    return F.concat(X.quoted_phrases(statement), figures)


def content_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9$.%']+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(V.CLAIM_STOP_WORDS) & (F.length(w) > 2)))


def statement_passage(page_text: Column, statement: Column, anchors: Column, window: int = 1, max_words: int = 220) -> Column:
    """The best-matching sentences with their neighbours: 3 per anchor and 1 per shared word; sentences within 80 percent
    of the best, the first three of them.  Nothing when no sentence matches."""
    sentences = F.filter(F.transform(F.split(page_text, V.SENTENCE_BREAK_CLAIM), lambda s: F.trim(s)), lambda s: s != "")

    def scored(g: Column) -> Column:
        return F.transform(g["s"], lambda s: 3 * F.size(F.filter(g["anchors"], lambda a: F.lower(s).contains(F.lower(a))))
                           + F.size(F.array_intersect(g["wanted"], content_words(s))))

    def picked(g: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(g["scores"]) - 1, F.lit(0)))
        top = F.slice(F.filter(at, lambda i: F.get(g["scores"], i) >= g["best"] * 0.8), 1, 3)
        return let(F.struct(top.alias("top"), g["s"].alias("s")), lambda p: F.array_join(
            F.filter(p["s"], lambda s, j: F.exists(p["top"], lambda i: F.abs(i - j) <= window)), " "))

    base = F.struct(sentences.alias("s"), anchors.alias("anchors"), content_words(statement).alias("wanted"))
    found = let(base, lambda g: let(F.struct(g["s"].alias("s"), scored(g).alias("scores")), lambda h: let(
        F.struct(h["s"].alias("s"), h["scores"].alias("scores"), F.array_max(h["scores"]).alias("best")),
        lambda k: F.when(F.coalesce(k["best"], F.lit(0)) > 0, picked(k)).otherwise(F.lit("")))))
    words = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    return F.array_join(F.slice(words(found), 1, max_words), " ")


def sufficient(passage: Column, kind: Column, anchors: Column, names: Column) -> Column:
    """A glossary passage must name the term; a fact's passage must hold every anchor."""
    low = F.lower(passage)
    none = F.array().cast("array<string>")
    named = F.exists(F.coalesce(names, none), lambda n: low.contains(F.lower(n)))
    all_in = F.forall(F.coalesce(anchors, none), lambda a: low.contains(F.lower(a)))
    return (low != "") & F.when(kind == "glossary", named).otherwise(all_in)


def route_verdicts(items: DataFrame, judged: DataFrame, model: str) -> DataFrame:
    """items(id, kind, statement, passage, anchors, names, definition_source), judged(id, key, verdict): our own definitions
    need no check, a stored verdict holds while its key does, a thin passage goes to a person, the rest to a judge."""
    key = F.substring(F.sha2(F.to_json(F.array("statement", "passage", F.lit(model))), 256), 1, 16)
    keyed = items.withColumn("key", key).join(judged.select("id", F.col("key").alias("_old"), "verdict"), "id", "left")
    fresh = F.col("_old") == F.col("key")
    route = (F.when(F.col("definition_source") == "ours", "definition_ours").when(fresh, F.col("verdict"))
             .when(~sufficient(F.col("passage"), F.col("kind"), F.col("anchors"), F.col("names")), "passage_insufficient")
             .otherwise("needs_review"))
    stale = F.col("_old").isNotNull() & ~fresh
    return keyed.select("id", "kind", "key", route.alias("verdict"), F.coalesce(stale, F.lit(False)).alias("stale"))


def without_letter_spacing(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?:\b\S\b ){3,}\S\b", " "), r"\s+", " ")


def without_line_numbers(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^\d{1,2}(?:\s+|$)", ""), r"\s+", " ")


# --- Sections as a whole ----------------------------------------------------------------------------------------------------


def dossier(passages: DataFrame, keys: list[str]) -> DataFrame:
    """All passages of a section in order, as one text.  A section holds a few dozen passages of bounded size."""
    return passages.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id", "text"))), lambda s: s["text"]), "\n\n").alias("text"),
        F.count("*").alias("passages"))


def version_difference(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Passages added, removed or reworded between two versions; texts are compared by hash."""
    a = old.select(key, F.sha2("text", 256).alias("a"))
    b = new.select(key, F.sha2("text", 256).alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "reworded")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def all_cards(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
