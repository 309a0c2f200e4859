"""Money as text: dollars, cents, millions and billions, with a true minus sign for signed changes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MINUS = "−"


def _usd(x: Column, places: int) -> Column:
    body = F.format_number(F.abs(x).cast(f"decimal(24,{places})"), places)
    return F.concat(F.when(x < 0, "-$").otherwise("$"), body)


def cents(c: Column) -> Column:
    return _usd(c.cast("decimal(24,2)") / 100, 2)


def dollars(d: Column) -> Column:
    return _usd(d, 0)


def signed_cents(c: Column) -> Column:
    return F.when(c > 0, F.concat(F.lit("+"), cents(c))).when(c < 0, F.concat(F.lit(MINUS), cents(-c))).otherwise(cents(c))


def percent_text(before: Column, after: Column) -> Column:
    change = F.abs(F.try_divide((after - before).cast("double"), before.cast("double")) * 100)
    sign = F.when(after >= before, "+").otherwise(MINUS)
    return F.when(before != 0, F.concat(sign, F.format_string("%.1f%%", change)))


def big_dollars(d: Column) -> Column:
    size, x = F.abs(d), d.cast("double")
    return (F.when(size >= 1e9, F.format_string("$%.2f billion", x / 1e9))
            .when(size >= 1e6, F.format_string("$%.1f million", x / 1e6)).otherwise(dollars(d)))


def signed_big(d: Column) -> Column:
    return (F.when(d > 0, F.concat(F.lit("+"), big_dollars(d))).when(d < 0, F.concat(F.lit(MINUS), big_dollars(-d)))
            .otherwise("$0"))


def millions(d: Column) -> Column:
    m = F.abs(d).cast("double") / 1e6
    tiny = (m > 0) & (m < 0.1)
    body = F.when(tiny, F.format_string("%,.2f", m)).otherwise(F.format_string("%,.1f", m))
    return F.concat(F.when(d < 0, MINUS).otherwise(""), body)


def signed_millions(d: Column) -> Column:
    return F.when(d > 0, F.concat(F.lit("+"), millions(d))).otherwise(millions(d))
