"""Do the figures in a written answer come from the data that was looked up?  Projections only: one row in, one row out."""

from __future__ import annotations

from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from tallybook import fixed_values as V
from tallybook.functions.trigrams import let

OUTCOMES = ["correct", "incomplete", "unsourced figure", "couldn't answer"]
# The bound words take any case; the figure after them does not, because M, B and K are capitals.
_STATED = (r"((?i:over\s{0,10}|more than\s{0,5}|above\s{0,9}|nearly\s{0,8}|almost\s{0,8}|under\s{0,9}|less than\s{0,5}"
           r"|below\s{0,9}))?(" + V.ANSWER_FIGURE + ")")


def stated_figures(text: Column) -> Column:
    """array<struct<figure, bound, value, step, scale, unit>>: dollar amounts and percentages with the bound word before them, if any,
    the number as stated, its last stated place, and what its unit multiplies by.  All figures of a text are read in one pass."""
    clean = F.regexp_replace(text, V.RATE_UNIT, "")
    found = let(clean, lambda c: F.struct(F.regexp_extract_all(c, F.lit(_STATED), F.lit(2)).alias("figures"),
                                          F.regexp_extract_all(c, F.lit(_STATED), F.lit(1)).alias("words")))
    shape = F.lit(r"([\d.]+)(%| million| billion|[MBK])?(?:\||$)")

    def bare(figures: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.array_join(figures, "|"), r"\s+", " "), "[$,]", "")

    def read(g: Column, numbers: Column, units: Column) -> Column:
        def figure(f: Column, i: Column) -> Column:
            word, number, unit = F.lower(F.trim(F.get(g["words"], i))), F.get(numbers, i), F.trim(F.get(units, i))
            point = F.instr(number, ".")
            return F.struct(
                f.alias("figure"), F.when(word.isin("over", "more than", "above"), "over").when(word != "", "under").alias("bound"),
                number.try_cast("double").alias("value"), F.pow(F.lit(10.0), F.when(point > 0, point - F.length(number)).otherwise(0)).alias("step"),
                F.when(unit.isin("billion", "B"), 1e9).when(unit.isin("million", "M"), 1e6).when(unit == "K", 1e3).otherwise(1.0).alias("scale"),
                unit.alias("unit"))

        return F.transform(g["figures"], figure)

    def parts(g: Column) -> Column:
        split = let(bare(g["figures"]), lambda b: F.struct(F.regexp_extract_all(b, shape, F.lit(1)).alias("n"), F.regexp_extract_all(b, shape, F.lit(2)).alias("u")))
        return let(split, lambda h: read(g, h["n"], h["u"]))

    return let(found, parts)


def evidence_text(tool_data: Column, earlier_data: Column, question: Column, before: Column) -> Column:
    """Values only: JSON keys are dropped; the questions asked count as evidence."""
    data = F.concat_ws("\n", tool_data, F.coalesce(earlier_data, F.lit("")))
    return F.concat_ws("\n", F.regexp_replace(data, r'"[^"]*"\s*:', " "), question,
                       F.array_join(F.coalesce(before, F.array().cast("array<string>")), "\n"))


def evidence_numbers(text: Column) -> Column:
    """Numbers read whole; 'x million' and 'x billion' at full size."""
    pattern = F.lit(r"(?i)(\d+(?:\.\d+)?)(?:\s*(million|billion))?")
    scale = lambda u: F.when(F.lower(u) == "million", 1e6).when(F.lower(u) == "billion", 1e9).otherwise(1.0)
    return let(F.regexp_replace(text, r"(\d),(?=\d{3})", "$1"), lambda plain: F.zip_with(
        F.regexp_extract_all(plain, pattern, F.lit(1)), F.regexp_extract_all(plain, pattern, F.lit(2)), lambda n, u: n.try_cast("double") * scale(u)))


def rounds_to(p: Column, n: Column) -> Column:
    """Does the number n round to the stated figure p at the precision it was stated?  Dollars may be stored as dollars or cents,
    percentages as 8.9 or 0.089; a year is never read as cents; a bound word widens the match one step its way."""
    def same(n: Column) -> Column:
        return (F.when(p["bound"] == "over", (n >= p["value"]) & (n < p["value"] + p["step"]))
                .when(p["bound"] == "under", (n <= p["value"]) & (n > p["value"] - p["step"]))
                .otherwise(F.abs(n - p["value"]) <= p["step"] / 2 + 1e-9))

    year = (n == F.floor(n)) & n.between(1990, 2040)
    return same(n / p["scale"]) | ((p["scale"] == 1.0) & ~year & same(n / 100)) | ((p["unit"] == "%") & same(n * 100))


def unsupported_figures(answers: DataFrame) -> DataFrame:
    """answers with 'unsupported': figures of the text found neither in lookups, earlier lookups, nor questions.  Text and evidence
    are read once an answer."""
    evidence = evidence_text(F.col("tool_data"), F.col("earlier_data"), F.col("q"), F.col("before"))
    both = F.struct(stated_figures(F.col("text")).alias("said"), F.array_distinct(let(evidence, evidence_numbers)).alias("numbers"))

    def missing(g: Column) -> Column:
        from_data = lambda p: F.coalesce(F.exists(g["numbers"], partial(rounds_to, p)), F.lit(False))
        return F.array_distinct(F.transform(F.filter(g["said"], lambda p: ~from_data(p)), lambda p: p["figure"]))

    return answers.withColumn("unsupported", let(both, missing))


def has_figure(haystack: Column, figure: Column) -> Column:
    """A required figure as written, without $ and commas, as cents, as a shortened decimal, as 'percent', or as a number
    that rounds to 'x million'.  The haystack is lower case."""
    bare = F.regexp_replace(figure, r"[$,]", "")
    number = F.regexp_extract(figure, r"^([\d.]+)", 1).try_cast("double")
    forms = [F.lower(figure), F.lower(bare),
             F.when(figure.rlike(r"\.\d{2}$"), F.regexp_replace(figure, r"[$,.]", "")),
             F.when(figure.rlike(r"\.\d0$"), bare.substr(F.lit(1), F.length(bare) - 1)),
             F.when(figure.endswith("%"), F.format_string("%.1f%%", number)),
             F.when(figure.endswith("%"), F.concat(figure.substr(F.lit(1), F.length(figure) - 1), F.lit(" percent")))]
    written = reduce(or_, [F.coalesce(haystack.contains(f), F.lit(False)) for f in forms])
    shape = r"(?i)^\$?([\d.]+) (million|billion)$"
    stated = F.regexp_extract(figure, shape, 1)
    scale = F.when(F.lower(F.regexp_extract(figure, shape, 2)) == "billion", 1e9).otherwise(1e6)
    places = F.pow(F.lit(10.0), F.length(F.regexp_extract(stated, r"\.(\d+)", 1)))
    longs = F.regexp_extract_all(F.regexp_replace(haystack, ",", ""), F.lit(r"(\d{5,})"), F.lit(1))
    target = F.floor(stated.try_cast("double") * places + 0.5)
    rounded = F.exists(longs, lambda d: F.floor(d.try_cast("double") / scale * places + 0.5) == target)
    return written | F.when(stated != "", F.coalesce(rounded, F.lit(False))).otherwise(F.lit(False))


def bucket(passed: Column, unsupported: Column, declined: Column) -> Column:
    return (F.when(F.size(unsupported) > 0, "unsourced figure").when(passed, "correct")
            .when(declined, "couldn't answer").otherwise("incomplete"))


def graded(answers: DataFrame) -> DataFrame:
    """answers with judged columns include_met and not_violated (array<boolean>): figures found, pass, outcome."""
    hay = F.lower(F.concat_ws("\n", "text", "tool_data"))
    found = F.transform(F.coalesce("expected_figures", F.array().cast("array<string>")),
                        lambda f: F.struct(f.alias("figure"), has_figure(hay, f).alias("found")))
    out = unsupported_figures(answers).withColumn("figures", found)
    passed = ((F.trim("text") != "") & F.forall("figures", lambda x: x["found"])
              & F.forall("include_met", lambda m: m) & F.forall("not_violated", lambda v: ~v))
    return out.withColumn("passed", passed).withColumn("outcome", bucket(F.col("passed"), F.col("unsupported"), F.col("declined")))


def outcome_summary(graded_answers: DataFrame, error: Column | None = None) -> DataFrame:
    """Answers and percent of all answers in each outcome, and whether the run may be published: never with an error."""
    total = graded_answers.agg(F.count("*").alias("n"),
                               F.count_if(F.lit(False) if error is None else error).alias("errors"))
    counts = graded_answers.groupBy("outcome").agg(F.count("*").alias("n"))
    n_all = total.select("n").scalar()
    share = F.floor(F.col("n") * 100.0 / n_all + 0.5).cast("long")
    return counts.withColumn("percent", share).withColumn("publishable", total.select(F.col("errors") == 0).scalar())


def usage_cost(usage: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Dollars per group: fresh input, cache writes, cache reads and output at the model's price per million tokens.
    The price list has one row per model."""
    fresh = F.col("input_tokens") - F.col("cached_input_tokens") - F.col("cache_creation_input_tokens")
    cost = (fresh * F.col("price_in") + F.col("cache_creation_input_tokens") * F.col("price_write")
            + F.col("cached_input_tokens") * F.col("price_read") + F.col("output_tokens") * F.col("price_out"))
    return usage.join(prices, "model").groupBy(*keys).agg((F.sum(cost).cast("double") / 1e6).alias("dollars"))


def price_table(spark) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in V.PRICES.items()],
                                 "model string, a double, b double, c double, d double").select("model", *[
        F.col(x).cast("decimal(12,6)").alias(f"price_{n}") for x, n in zip("abcd", ("in", "write", "read", "out"))])


def split_requirements(cases: DataFrame) -> DataFrame:
    """Requirement items that look cut at a comma: they start with or/nor, or their parentheses do not pair."""
    items = cases.select("id", F.explode(F.concat(F.coalesce("must_include", F.array().cast("array<string>")),
                                                  F.coalesce("must_not", F.array().cast("array<string>")))).alias("item"))
    count = lambda ch: F.length("item") - F.length(F.replace("item", F.lit(ch), F.lit("")))
    return items.where(F.col("item").rlike(r"(?i)^(or|nor)\b") | (count("(") != count(")")))


def selected_cases(cases: DataFrame, prefixes: list[str]) -> DataFrame:
    if not prefixes:
        return cases
    return cases.where(reduce(or_, [F.col("id").startswith(p) for p in prefixes]))
