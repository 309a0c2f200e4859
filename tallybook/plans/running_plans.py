"""Running state, page lines, number columns and folds over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tallybook.operators import running as R
from tallybook.operators.chains import closing_rows
from tallybook.plans import bindings as B
from tallybook.plans.registry import query, table


def document_words(spark, sf, columns=("doc_id",)):
    """Tokens of whole documents as page words: the n-th line that is not blank prints at height 2n."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.filter(
        F.split("text", "\n"), lambda line: F.trim(line) != "")).alias("k", "line_text"))
    tokens = F.filter(F.split("line_text", r"\s+"), lambda t: t != "")
    w = d.select("doc_id", "k", F.posexplode(tokens).alias("i", "text"))
    x = (F.col("k") % 2) * 1_000_000.0 + F.col("i") * 10.0
    return w.select(F.lit("d").alias("doc"), F.col("doc_id").alias("page"), "text", x.alias("x0"), (x + 8).alias("x1"),
                    (F.col("k") * 2.0).alias("top"), (F.col("k") * 2.0 + 1).alias("bottom"))


@query("word_lines", r"""with l as (select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as line,
    generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 as k from documents),
t as (select doc_id, k, array_to_string(list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> ''), ' ') as words from l)
select doc_id as page, cast(k // 2 * 4 as double) as anchor, string_agg(words, ' ' order by k) as text
from t where words <> '' group by all""")
def word_lines(spark, sf):
    """Tolerance 3 against the first word of a line: heights 0 and 2 share a line, 4 starts the next."""
    lined = R.visual_lines(document_words(spark, sf), tol=3.0)
    return R.line_text(lined).select("page", "anchor", "text")


@query("glyph_words", r"""with t as (select item_id, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) as text from benchmark)
select item_id as page, text, count(*) as n from t group by all""")
def glyph_words(spark, sf):
    """Benchmark texts set glyph by glyph, 4 points apart with real blanks, and joined into words again."""
    g = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split(F.regexp_replace("text", r"\s", " "), "")).alias(
        "i", "text")).where(F.length("text") == 1)
    placed = g.select(F.lit("b").alias("doc"), F.col("item_id").alias("page"), "text",
                      (F.col("i") * 4.0).alias("x0"), (F.col("i") * 4.0 + 4).alias("x1"), F.lit(10.0).alias("top"),
                      F.lit(18.0).alias("bottom"))
    return R.words_from_glyphs(placed).groupBy("page", "text").agg(F.count("*").alias("n"))


@query("split_number_merge", """select o_orderkey as page, format('{:,}', cast(floor(o_totalprice * 100 + 0.5) as bigint)) as amount,
  o_custkey::varchar as account from orders""")
def split_number_merge(spark, sf):
    """Each order prints a label, its customer key, and its amount cut in three fragments half a point apart."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.format_number(B.cents("o_totalprice"), 0).alias("t"))
    cut = [F.substring("t", 1, 1), F.substring("t", 2, 3), F.expr("substring(t, 5)")]
    xs = [(100.0, 110.0), (110.5, 140.0), (140.5, 170.0)]
    parts = [F.struct(F.lit("Order").alias("text"), F.lit(10.0).alias("x0"), F.lit(30.0).alias("x1")),
             F.struct(F.col("o_custkey").cast("string").alias("text"), F.lit(40.0).alias("x0"), F.lit(80.0).alias("x1"))]
    parts += [F.struct(t.alias("text"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for t, (a, b) in zip(cut, xs)]
    words = o.select(F.col("o_orderkey").alias("page"), F.inline(F.array(*parts)))
    merged = R.merge_split_numbers(words, ["page"])
    return merged.groupBy("page").agg(F.max(F.when(F.col("x0") == 100.0, F.col("text"))).alias("amount"),
                                      F.max(F.when(F.col("x0") == 40.0, F.col("text"))).alias("account"))


@query("column_assign", """select l_orderkey as page, cast(sum(case when l_returnflag = 'A' then l_quantity end) as bigint) as a,
  cast(sum(case when l_returnflag = 'N' then l_quantity end) as bigint) as n,
  cast(sum(case when l_returnflag = 'R' then l_quantity end) as bigint) as r from lineitem group by 1""")
def column_assign(spark, sf):
    """An order's quantities by return flag, printed right-aligned under headers whose place shifts from page to page."""
    q = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page"), "l_returnflag").agg(
        F.sum("l_quantity").cast("long").alias("v"))
    shift = F.col("page") % 5 * 1.5
    start = F.when(F.col("l_returnflag") == "A", 200).when(F.col("l_returnflag") == "N", 270).otherwise(340) + shift
    numbers = q.select("page", F.col("v").cast("string").alias("text"), (start + 12).alias("x0"), (start + 49).alias("x1"))
    headers = [F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("key"), (F.lit(200.0 + 70 * i) + shift).alias("x0"),
                        (F.lit(240.0 + 70 * i) + shift).alias("x1")) for i, k in enumerate("anr")]
    geometry = q.select("page").distinct().select("page", F.array(*headers).alias("columns"))
    placed, _ = R.assign_columns(numbers, geometry, ["page"], ["page"], right=16.0)
    return placed.groupBy("page").pivot("column", ["a", "n", "r"]).agg(F.max(F.col("text").cast("long")))


def user_events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"))


@query("running_state", """select event_id, last_value(case when event_type in ('signup', 'purchase') then event_type end ignore nulls)
  over (partition by user_id order by ts, event_id) as category from events""")
def running_state(spark, sf):
    """The last signup or purchase at or before each event of a visitor; a busy visitor spreads over days."""
    event = F.when(F.col("event_type").isin("signup", "purchase"), F.col("event_type"))
    return R.carry_last(user_events(spark, sf), ["user_id"], ["ts", "event_id"], event, "category", ["day"]).select(
        "event_id", "category")


@query("carry_heading", """with h as (select *, last_value(case when event_type = 'signup' then event_id end ignore nulls)
  over (partition by user_id order by ts, event_id) as heading from events)
select event_id, heading, row_number() over (partition by user_id, heading order by ts, event_id) as ordinal
from h where event_type <> 'signup'""")
def carry_heading(spark, sf):
    """Signups are headings: dropped as rows, carried down to the rows beneath, which are numbered under them."""
    heading = F.when(F.col("event_type") == "signup", F.col("event_id"))
    rows = R.carry_last(user_events(spark, sf), ["user_id"], ["ts", "event_id"], heading, "heading", ["day"])
    kept = rows.where(F.col("event_type") != "signup")
    out = R.numbered(kept.withColumn("heading_key", F.coalesce("heading", F.lit(-1))), ["user_id", "heading_key"],
                     ["ts", "event_id"], "ordinal", ["day"])
    return out.select("event_id", "heading", "ordinal")


@query("event_islands", """with g as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts, event_id) > interval 12 hours, true) as brk from events)
select event_id, cast(sum(case when brk then 1 else 0 end) over (partition by user_id order by ts, event_id) as bigint) as island from g""")
def event_islands(spark, sf):
    """A gap of more than twelve hours starts an island."""
    rows = R.previous(user_events(spark, sf), ["user_id"], ["ts", "event_id"], F.col("ts"), "before", ["day"])
    gap = F.coalesce(F.col("ts") - F.col("before") > F.expr("interval 12 hours"), F.lit(True))
    return R.running_count(rows, ["user_id"], ["ts", "event_id"], gap, "island", ["day"]).select("event_id", "island")


@query("note_attachment", """with r as (select *, last_value(case when event_type <> 'error' then event_id end ignore nulls)
  over (partition by user_id order by ts, event_id) as owner from events)
select owner as event_id, string_agg(event_id::varchar, ' ' order by ts, event_id) as note, count(*) as n
from r where event_type = 'error' and owner is not null group by owner""")
def note_attachment(spark, sf):
    """Errors are note lines: their text joins the last row that is not one."""
    owner = F.when(F.col("event_type") != "error", F.col("event_id"))
    rows = R.carry_last(user_events(spark, sf), ["user_id"], ["ts", "event_id"], owner, "owner", ["day"])
    notes = rows.where((F.col("event_type") == "error") & F.col("owner").isNotNull())
    return notes.groupBy(F.col("owner").alias("event_id")).agg(
        R.text_of(F.collect_list(F.struct("ts", "event_id", F.col("event_id").cast("string").alias("text")))).alias("note"),
        F.count("*").alias("n"))


UNIT_SQL = """o as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice, l_suppkey) as rn from lineitem)"""


@query("unit_close", f"""with {UNIT_SQL} select l_orderkey as page, cast(rn as integer) as line from o
where l_returnflag = 'R' and l_linestatus = 'O'""")
def unit_close(spark, sf):
    """Line quantities accumulate.  After each returned line a total is printed: the true running sum since the last unit
    when the line is open, one too many otherwise.  A unit closes exactly at the true totals."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                             "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey")
    li = li.withColumn("rn", F.row_number().over(order))
    true_total = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    li = li.withColumn("unit", F.coalesce(F.sum(F.when(true_total, 1).otherwise(0)).over(before), F.lit(0)))
    unit = Window.partitionBy("l_orderkey", "unit").orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    printed = F.sum("q").over(unit) + F.when(F.col("l_linestatus") == "O", 0).otherwise(1)
    li = li.withColumn("printed", printed)
    value, total = F.struct((F.col("rn") * 2).alias("i"), F.lit(True).alias("anchor"), F.col("q").alias("v")), F.struct(
        (F.col("rn") * 2 + 1).alias("i"), F.lit(False).alias("anchor"), F.col("printed").alias("v"))
    rows = li.select(F.col("l_orderkey").alias("page"), F.inline(F.when(F.col("l_returnflag") == "R", F.array(value, total)).otherwise(F.array(value))))
    rows = rows.withColumn("part", F.floor(F.col("i") / 1024))
    closed = closing_rows(rows, ["page"], ["i"], F.col("anchor"), ~F.col("anchor"), F.lit(False), [F.col("v")], "part")
    return closed.select("page", ((F.col("i") - 1) / 2).cast("int").alias("line"))


@query("indent_paths", """with r as (select p_partkey, p_partkey // 50 as page, (p_size % 5) * 10 as indent, p_name,
    p_type in ('ECONOMY', 'PROMO') as heading from part),
h as (select r.p_partkey, h.p_partkey as hk, h.p_name from r join r h on r.page = h.page and h.heading and h.p_partkey < r.p_partkey
  where not r.heading and not exists (select 1 from r g where g.page = r.page and g.heading and g.p_partkey > h.p_partkey
    and g.p_partkey < r.p_partkey and not (h.indent < g.indent - 2)))
select r.p_partkey, coalesce(string_agg(h.p_name, ' > ' order by hk), '') as path from r left join h using (p_partkey)
where not r.heading group by r.p_partkey""")
def indent_paths(spark, sf):
    """Fifty parts to a page; economy and promo parts are headings, indented by size."""
    p = table(spark, sf, "part")
    row = F.struct(F.col("p_partkey").cast("long").alias("i"), ((F.col("p_size") % 5) * 10.0).alias("indent"),
                   F.col("p_name").alias("label"), F.col("p_type").isin("ECONOMY", "PROMO").alias("heading"))
    pages = p.groupBy(F.floor(F.col("p_partkey") / 50).alias("page")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return pages.select(F.inline(R.indent_paths(F.col("rows")))).select(
        F.col("i").cast("long").alias("p_partkey"), F.array_join("path", " > ").alias("path"))


@query("citation_numbers", """with f as (select l_orderkey, l_partkey, min((l_linenumber, l_extendedprice)) as first, count(*) as uses from lineitem group by all)
select l_orderkey, l_partkey, uses, cast(row_number() over (partition by l_orderkey order by first, l_partkey) as integer) as number from f""")
def citation_numbers(spark, sf):
    """An order as a page of figures and its parts as their sources, numbered by first use."""
    uses = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return R.dense_first_use(uses, ["l_orderkey"], ["l_partkey"], ["l_linenumber", "l_extendedprice"])


@query("source_lines", """with d as (select distinct l_suppkey, l_linestatus as doc, year(l_shipdate) as page from lineitem)
select l_suppkey, doc, string_agg(page::varchar, ', ' order by page) as pages from d group by all""")
def source_lines(spark, sf):
    """Distinct pages per document in numeric order.  Pages are made distinct before they are gathered."""
    li = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_linestatus").alias("doc"), F.year("l_shipdate").alias("page"))
    return li.distinct().groupBy("l_suppkey", "doc").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda p: p.cast("string")), ", ").alias("pages"))
