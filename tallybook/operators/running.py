"""Running state over ordered rows: carried values, running sums, island ids, row numbers, folds.

A key may hold a large part of the table (one document, one visitor).  With a bucket column a running value is a prefix scan
over a tree: rows are summed up inside each (key, bucket), FAN neighbouring buckets into one node, FAN nodes into the next, as
often as the span of the buckets needs, and what stands before each node is handed down again.  No task holds more than one
bucket's rows or FAN summaries.  A bucket must rise with the order (a page, a day, a block of positions) and be a whole number
or a date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from tallybook.session import by_key, materialize

FAN = 2048
#: Heights in one bucket of a page.
SPAN = 512.0


def _before(parts: DataFrame, keys: list[str], totals: dict[str, str]) -> DataFrame:
    """parts(keys, _at, totals), one row per bucket: the combination of all parts of smaller _at, in each column that `totals`
    names, by "sum" or "last" (of those not NULL).  Parts are written once; their span says how deep the tree is."""
    parts = materialize(parts)
    low, high = parts.agg(F.min("_at"), F.max("_at")).first()
    levels = 1
    while low is not None and high - low >= FAN**levels:
        levels += 1
    return _scanned(parts, keys, totals, levels)


def _scanned(parts: DataFrame, keys: list[str], totals: dict[str, str], levels: int) -> DataFrame:
    combine = {"sum": F.sum, "last": lambda c: F.last(c, ignorenulls=True)}
    order = Window.partitionBy(*keys, *(["_up"] if levels > 1 else [])).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_up", F.floor(F.col("_at") / FAN))
    here = parts.select(*keys, "_at", "_up", *[combine[how](c).over(order).alias(c) for c, how in totals.items()])
    if levels == 1:
        return here.drop("_up")
    whole = {"sum": F.sum, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at")))}
    nodes = parts.groupBy(*keys, "_up").agg(*[whole[how](c).alias(c) for c, how in totals.items()]).withColumnRenamed("_up", "_at")
    above = _scanned(nodes, keys, totals, levels - 1).select(*keys, F.col("_at").alias("_up"), *[F.col(c).alias(f"{c}_up") for c in totals])
    joined = {"sum": lambda c: F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"{c}_up"), F.lit(0)), "last": lambda c: F.coalesce(c, f"{c}_up")}
    return by_key(here, above, [*keys, "_up"]).select(*keys, "_at", *[joined[how](c).alias(c) for c, how in totals.items()])


def _bucket_number(df: DataFrame, bucket: str) -> Column:
    return (F.unix_date(bucket) if isinstance(df.schema[bucket].dataType, T.DateType) else F.col(bucket)).cast("long")


def _of_bucket(df: DataFrame, carried: DataFrame, bucket: str) -> DataFrame:
    """carried with the bucket as df has it, so that the join needs no other dealing of the rows than their window."""
    kind = df.schema[bucket].dataType
    value = F.date_from_unix_date(F.col("_at").cast("int")) if isinstance(kind, T.DateType) else F.col("_at").cast(kind)
    return carried.withColumn(bucket, value).drop("_at")


def _rows_so_far(keys: list[str], bucket: list[str], order: list, inclusive: bool):
    return Window.partitionBy(*keys, *bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)


def before_buckets(parts: DataFrame, keys: list[str], bucket: str, value: str, out: str, backwards: bool = False) -> DataFrame:
    """Of parts, one row per (key, bucket): the last non-NULL value of the buckets before each (the first of those after it, backwards)."""
    at = _bucket_number(parts, bucket)
    found = _before(parts.select(*keys, (-at if backwards else at).alias("_at"), F.col(value).alias(out)), keys, {out: "last"})
    return _of_bucket(parts, found.withColumn("_at", -F.col("_at")) if backwards else found, bucket)


def carry_last(df: DataFrame, keys: list[str], order: list, value: Column, out: str, bucket: list[str] | None = None,
               inclusive: bool = True) -> DataFrame:
    """The last non-NULL value at or before each row (before it when not inclusive)."""
    bucket = bucket or []
    row = _rows_so_far(keys, bucket, order, inclusive)
    local = df.withColumn("_rv", value).withColumn("_rl", F.last("_rv", ignorenulls=True).over(row))
    if not bucket:
        return local.withColumn(out, F.col("_rl")).drop("_rv", "_rl")
    at = F.struct(*order)
    tails = df.select(*keys, _bucket_number(df, *bucket).alias("_at"), value.alias("_rv"), at.alias("_ra")).groupBy(*keys, "_at").agg(
        F.max_by("_rv", F.when(F.col("_rv").isNotNull(), F.col("_ra"))).alias("_rc"))
    carried = _of_bucket(df, _before(tails, keys, {"_rc": "last"}), *bucket)
    return by_key(local, carried, [*keys, *bucket]).withColumn(out, F.coalesce("_rl", "_rc")).drop("_rv", "_rl", "_rc")


def running_sums(df: DataFrame, keys: list[str], order: list, values: dict[str, Column], bucket: list[str] | None = None,
                 inclusive: bool = True) -> DataFrame:
    """Sums of whole numbers at or before each row (before it when not inclusive), all columns in one pass; NULL adds nothing."""
    bucket = bucket or []
    row = _rows_so_far(keys, bucket, order, inclusive)
    given = {f"_r{i}": F.coalesce(v, F.lit(0)).cast("long") for i, v in enumerate(values.values())}
    names = dict(zip(given, values))
    local = df.withColumns(given)
    local = local.withColumns({f"{c}l": F.coalesce(F.sum(c).over(row), F.lit(0)) for c in given})
    if not bucket:
        return local.withColumns({out: F.col(f"{c}l") for c, out in names.items()}).drop(*given, *[f"{c}l" for c in given])
    sums = df.select(*keys, _bucket_number(df, *bucket).alias("_at"), *[v.alias(c) for c, v in given.items()]).groupBy(*keys, "_at").agg(
        *[F.sum(c).alias(f"{c}c") for c in given])
    carried = _before(sums, keys, {f"{c}c": "sum" for c in given})
    joined = by_key(local, _of_bucket(df, carried, *bucket), [*keys, *bucket])
    return joined.withColumns({out: F.col(f"{c}l") + F.coalesce(f"{c}c", F.lit(0)) for c, out in names.items()}).drop(
        *[f"{c}{x}" for c in given for x in ("", "l", "c")])


def running_count(df: DataFrame, keys: list[str], order: list, flag: Column, out: str, bucket: list[str] | None = None,
                  inclusive: bool = True) -> DataFrame:
    """How many flagged rows stand at or before each row (before it when not inclusive): the id of its island."""
    return running_sums(df, keys, order, {out: F.when(flag, 1)}, bucket, inclusive)


def numbered(df: DataFrame, keys: list[str], order: list, out: str, bucket: list[str] | None = None) -> DataFrame:
    """Row numbers from 1 in each key."""
    return running_count(df, keys, order, F.lit(True), out, bucket)


def previous(df: DataFrame, keys: list[str], order: list, value: Column, out: str, bucket: list[str] | None = None
             ) -> DataFrame:
    """The value of the row before: the bucket's own, or the last one of the bucket before it."""
    bucket = bucket or []
    wrapped = F.struct(value.alias("v"))
    got = carry_last(df, keys, order, wrapped, "_rp", bucket, inclusive=False)
    return got.withColumn(out, F.col("_rp.v")).drop("_rp")


def following(df: DataFrame, keys: list[str], order: list, value: Column, out: str, bucket: list[str]) -> DataFrame:
    """The value of the row after: the bucket's own, or the first one of the bucket after it."""
    wrapped = F.struct(value.alias("v"))
    row = Window.partitionBy(*keys, *bucket).orderBy(*order)
    heads = df.select(*keys, (-_bucket_number(df, *bucket)).alias("_at"), wrapped.alias("_rv"), F.struct(*order).alias("_ra")).groupBy(*keys, "_at").agg(
        F.min_by("_rv", "_ra").alias("_rc"))
    after = _before(heads, keys, {"_rc": "last"}).withColumn("_at", -F.col("_at"))
    local = df.withColumn("_rl", F.lead(wrapped).over(row))
    return by_key(local, _of_bucket(df, after, *bucket), [*keys, *bucket]).withColumn(out, F.coalesce("_rl", "_rc")["v"]).drop("_rl", "_rc")


def text_of(items: Column, sep: str = " ") -> Column:
    """Join the text of an unordered array of struct(order..., text) in order."""
    return F.array_join(F.transform(F.sort_array(items), lambda s: s["text"]), sep)


# --- Lines, words and columns on a page ----------------------------------------------------------------------------------


def line_anchors(words: DataFrame, page: list[str], top: str = "top", tol: float = 3.0) -> DataFrame:
    """page keys, top, anchor, line: the line each distinct word height belongs to, and its number on the page.

    A word joins a line when it is within tol of the line's first word, so the heights that start a line are a greedy cut of
    the page's heights.  Pages of up to WHOLE heights are cut and numbered in one sorted reading, many to a task; a longer page
    is cut along its chain and scanned, by many tasks.  A page of any length is cut without being gathered."""
    from tallybook.operators import chains

    tops = materialize(words.select(*page, F.col(top).cast("double").alias("top")).distinct().where(F.forall(F.array(*[F.col(c).isNotNull() for c in [*page, "top"]]), lambda known: known)))
    long = materialize(tops.groupBy(*page).count().where(F.col("count") > chains.WHOLE).select(*page))
    some = not long.isEmpty()
    short = by_key(tops, long, page, "left_anti") if some else tops
    kinds = tops.schema.simpleString()[7:-1] + ",anchor:double,line:bigint"
    lines = short.repartition(*page).sortWithinPartitions(*page, "top").mapInPandas(lambda b: chains.lines_in_order(b, page, tol), kinds)
    return lines.unionByName(_anchors_along_chains(by_key(tops, long, page, "left_semi"), page, tol)) if some else lines


def _anchors_along_chains(tops: DataFrame, page: list[str], tol: float) -> DataFrame:
    from tallybook.operators.chains import greedy_starts

    tops = materialize(numbered(tops.withColumn("_span", F.floor(F.col("top") / SPAN)), page, ["top"], "_n", ["_span"]))
    starts = greedy_starts(tops, page, "_n", F.col("top"), F.col("top"), tol, SPAN).withColumn("_starts", F.lit(True))
    marked = materialize(by_key(tops, starts, [*page, "_n"], "left"))
    begins = F.coalesce("_starts", F.lit(False))
    lined = carry_last(marked, page, ["top"], F.when(begins, F.col("top")), "anchor", ["_span"])
    counted = running_count(marked, page, ["top"], begins, "line", ["_span"]).select(*page, "top", "line")
    return by_key(lined, counted, [*page, "top"]).select(*page, "top", "anchor", "line")


def visual_lines(words: DataFrame, page: list[str] | None = None, tol: float = 3.0) -> DataFrame:
    """Words with the anchor of their line and its number on the page."""
    page = page or ["doc", "page"]
    # sorted by the page's number first: its document's name is alike in most rows and tells the sort nothing
    return by_key(words, line_anchors(words, page, tol=tol).withColumn("line", F.col("line").cast("int")), [*reversed(page), "top"])


def line_text(lined: DataFrame, page: list[str] | None = None) -> DataFrame:
    """One row per line with its text, left to right."""
    page = page or ["doc", "page"]
    return lined.groupBy(*page, "line", "anchor").agg(
        text_of(F.collect_list(F.struct("x0", "x1", "text"))).alias("text"), F.min("x0").alias("x0"))


def merge_split_numbers(words: DataFrame, row: list[str], max_gap: float = 1.5,
                        pattern: str = r"^[\d,().-]+$") -> DataFrame:
    """Rejoin numbers cut mid-value: numeric fragments less than max_gap apart on the same row.  Only fragments are gathered; all
    other words pass as they are."""
    order = Window.partitionBy(*row).orderBy("x0", "x1")
    frag = F.col("text").rlike(pattern)
    marked = words.withColumn("_frag", frag)
    marked = marked.withColumn("_glued", F.coalesce(F.col("_frag") & F.lag("_frag").over(order) & (F.col("x0") - F.lag("x1").over(order) < max_gap), F.lit(False)))
    marked = materialize(marked.select(*row, "text", "x0", "x1", "_glued", F.coalesce(F.lead("_glued").over(order), F.lit(False)).alias("_goes_on")))
    alone = ~F.col("_glued") & ~F.col("_goes_on")
    islands = running_count(marked.where(~alone), row, ["x0", "x1"], ~F.col("_glued"), "_island")
    joined = islands.groupBy(*row, "_island").agg(
        text_of(F.collect_list(F.struct("x0", "x1", "text")), "").alias("text"), F.min("x0").alias("x0"),
        F.max_by("x1", F.struct("x0", "x1")).alias("x1")).drop("_island")
    return marked.where(alone).select(*row, "text", "x0", "x1").unionByName(joined)


def merged_numbers(words: Column, max_gap: float = 1.5, pattern: str = r"^[\d,().-]+$") -> Column:
    """merge_split_numbers for the words struct(x0, x1, text, top) of one row in order.  In most rows no two words touch."""
    touch = lambda a, b: F.coalesce((b["x0"] - a["x1"] < max_gap) & a["text"].rlike(pattern) & b["text"].rlike(pattern), F.lit(False))

    def step(done: Column, w: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        grown = F.struct(last["x0"].alias("x0"), w["x1"].alias("x1"), F.concat(last["text"], w["text"]).alias("text"), last["top"].alias("top"))
        return F.when(touch(last, w), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(w)))

    touching = F.size(F.filter(words, lambda w, i: touch(F.get(words, i - 1), w))) > 0
    return F.when(touching, F.aggregate(words, F.filter(words, lambda _: F.lit(False)), step)).otherwise(words)


def words_from_glyphs(glyphs: DataFrame, page: list[str] | None = None, gap: float = 1.0, line_tol: float = 2.0) -> DataFrame:
    """Glyphs joined into words: a new word at a space, a gap, a jump back, or another line."""
    page = page or ["doc", "page"]
    order = Window.partitionBy(*page).orderBy(F.round(F.col("top") / line_tol), "x0")
    prev = lambda c: F.lag(c).over(order)
    breaks = ((F.abs(F.col("top") - prev("top")) > line_tol) | (F.col("x0") - prev("x1") > gap)
              | (F.col("x0") < prev("x1") - 1) | (prev("text") == " "))
    marked = glyphs.withColumn("_new", F.coalesce(breaks, F.lit(True)) | (F.col("text") == " "))
    islands = running_count(marked, page, [F.round(F.col("top") / line_tol), "x0"], F.col("_new"), "_island")
    return islands.where(F.col("text") != " ").groupBy(*page, "_island").agg(
        text_of(F.collect_list(F.struct("x0", "x1", "text")), "").alias("text"), F.min("x0").alias("x0"),
        F.max("x1").alias("x1"), F.min_by("top", "x0").alias("top"), F.min_by("bottom", "x0").alias("bottom")).drop("_island")


def column_of(columns: Column, x0: Column, x1: Column, left: float, right: float) -> Column:
    """The column a number sits under: header span widened by the margins, nearest right edge, first on a tie."""
    hits = F.filter(columns, lambda c: (x0 <= c["x1"] + right) & (x1 >= c["x0"] - left))
    scored = F.transform(hits, lambda c: F.struct(F.abs(x1 - c["x1"]).alias("d"), c["ordinal"].alias("ordinal"),
                                                  c["key"].alias("key")))
    return F.array_min(scored)["key"]


def assign_columns(numbers: DataFrame, geometry: DataFrame, page: list[str], row: list[str], left: float = 30.0,
                   right: float = 12.0) -> tuple[DataFrame, DataFrame]:
    """Numbers with the column they sit under, and the rows where one column got two numbers.
    geometry: one row per page with columns array<struct<ordinal,key,x0,x1>>."""
    placed = numbers.join(geometry, page).withColumn(
        "column", column_of(F.col("columns"), F.col("x0"), F.col("x1"), left, right)).drop("columns").where(
        F.col("column").isNotNull())
    doubled = placed.groupBy(*row, "column").agg(F.count("*").alias("n")).where("n > 1")
    return placed, doubled


# --- Folds -------------------------------------------------------------------------------------------------------------


def keep_within_budget(items: Column, size, limit: int) -> Column:
    """Walk items in order and keep each one that still fits under the limit; a kept item also costs its separator."""
    kept_type = F.filter(items, lambda _: F.lit(False))
    start = F.struct(F.lit(0).alias("used"), kept_type.alias("kept"))

    def step(acc: Column, item: Column) -> Column:
        fits = acc["used"] + size(item) <= limit
        return F.when(fits, F.struct((acc["used"] + size(item) + 1).alias("used"),
                                     F.concat(acc["kept"], F.array(item)).alias("kept"))).otherwise(acc)

    return F.aggregate(items, start, step)["kept"]


def indent_paths(rows: Column, slack: float = 2.0) -> Column:
    """rows struct(i, indent, label, heading) in order.  Each valued row gets the labels of the headings it sits under: a
    heading drops every heading that is not clearly to its left."""
    empty = F.array().cast("array<struct<indent:double,label:string>>")
    start = F.struct(empty.alias("path"), F.array().cast("array<struct<i:bigint,path:array<string>>>").alias("out"))

    def step(state: Column, r: Column) -> Column:
        outer = F.filter(state["path"], lambda p: p["indent"] < r["indent"] - slack)
        pushed = F.concat(outer, F.array(F.struct(r["indent"].alias("indent"), r["label"].alias("label"))))
        labels = F.transform(state["path"], lambda p: p["label"])
        return F.when(r["heading"], F.struct(pushed.alias("path"), state["out"].alias("out"))).otherwise(
            F.struct(state["path"].alias("path"), F.concat(state["out"], F.array(F.struct(
                r["i"].alias("i"), labels.alias("path")))).alias("out")))

    return F.aggregate(rows, start, step)["out"]


def dense_first_use(uses: DataFrame, scope: list[str], cite: list[str], order: list) -> DataFrame:
    """Number the distinct sources of each scope in the order they are first used."""
    first = uses.groupBy(*scope, *cite).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("uses"))
    rank = Window.partitionBy(*scope).orderBy("first", *cite)
    return first.withColumn("number", F.row_number().over(rank)).drop("first")
