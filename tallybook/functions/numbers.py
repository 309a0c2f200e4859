"""Printed numbers and changes as Column expressions.  Blank stays NULL; parentheses mean negative."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallybook import fixed_values as V

PARSED = "decimal(20,4)"


def is_number_token(text: Column) -> Column:
    t = F.trim(text)
    return t.rlike(V.NUMBER_TOKEN) & t.rlike(r"\d")


def parse_decimal(text: Column) -> Column:
    """'1,234' 1234; '(150,644)' -150644; '112.36'; blank, dashes and anything else NULL."""
    bare = F.regexp_replace(F.trim(text), r"[,$* ]", "")
    inner = F.regexp_replace(bare, r"^[()]+|[()]+$", "")
    negative = (bare.startswith("(") & bare.endswith(")")) | inner.startswith("-")
    digits = F.regexp_replace(inner, r"^-", "")
    value = F.when(digits.rlike(r"^\d+(\.\d+)?$"), digits.try_cast(PARSED))
    return F.when(negative, -value).otherwise(value)


def parse_dollars(text: Column) -> Column:
    """Whole dollars; cents in a whole-dollar book are a misread and stop the job."""
    value = parse_decimal(text)
    return F.when(value == F.floor(value), value.cast("long")).when(
        value.isNotNull(), F.raise_error(F.concat(F.lit("cents in a whole-dollar amount: "), text)).cast("long"))


def slot_value(text: Column) -> Column:
    """The second reader's number: brackets dropped too.  NULL for a dash or for text; see is_slot."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"[$,]", ""), r"\*+$", "")
    bare = F.regexp_replace(bare, r"^[\[\]]+|[\[\]]+$", "")
    inner = F.regexp_replace(bare, r"^[()]+|[()]+$", "")
    value = F.when(inner.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), inner.try_cast(PARSED))
    return F.when(bare.startswith("(") & bare.endswith(")"), -value).otherwise(value)


def is_slot(text: Column) -> Column:
    return F.trim(text).isin("-", "—", "–") | slot_value(text).isNotNull()


def amount_in_words(number: Column, unit: Column) -> Column:
    """('2.0', 'million') 2000000.  A figure of 1000 or more that also says million is a misprint: NULL."""
    n = F.regexp_replace(number, ",", "").try_cast("decimal(24,4)")
    scale = F.when(F.lower(unit) == "million", 1_000_000).when(F.lower(unit) == "billion", 1_000_000_000).otherwise(1)
    worded = F.coalesce(F.lower(unit), F.lit("")).isin("million", "billion")
    return F.when(~(worded & (n >= 1000)), F.floor(n * scale).cast("long"))


def round_half_up(x: Column) -> Column:
    """Nearest integer, a half always toward plus infinity (Spark's round goes away from zero)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def per_share(cents: Column, share: Column) -> Column:
    """cents / share to the nearest cent, half up, in whole-number arithmetic; cents are not negative."""
    return F.floor((F.lit(2) * cents + share) / (F.lit(2) * share)).cast("long")


def percent_change(change: Column, base: Column) -> Column:
    """change / base in percent to one decimal; NULL when the base is NULL or zero."""
    ratio = change.cast("double") / F.nullif(base.cast("double"), F.lit(0.0))
    return F.floor(ratio * 1000 + 0.5).cast("double") / 10


def changes(adopted: Column, from_adopted: Column, from_request: Column) -> list[Column]:
    """The printed changes, and the percent worked out from them."""
    return [from_adopted.alias("change_from_adopted"), from_request.alias("change_from_request"),
            percent_change(from_adopted, adopted).alias("percent_change_from_adopted")]


def calculate(op: Column, a: Column, b: Column) -> Column:
    """sum, difference, percent_change, share, per.  NULL where the divisor is zero."""
    x, y = a.cast("double"), b.cast("double")

    def fixed(v: Column, places: int) -> Column:
        return F.round(v, places)

    return (F.when(op == "sum", fixed(x + y, 2)).when(op == "difference", fixed(y - x, 2))
            .when(op == "percent_change", fixed(F.try_divide(y - x, x) * 100, 4))
            .when(op == "share", fixed(F.try_divide(x, y) * 100, 4)).when(op == "per", fixed(F.try_divide(x, y), 4)))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
