"""Typed street addresses: normalised number and street, and the display form of a parcel's address."""

from __future__ import annotations

from functools import partial
from itertools import chain

from pyspark.sql import Column, functions as F

from tallybook import fixed_values as V
from tallybook.functions.trigrams import let


def _lookup(codes: dict[str, str], token: Column) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(codes.items())])[token]


def _drop_last(tokens: Column, cond: Column) -> Column:
    return F.when(cond, F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)


def _dropped(cond, tokens: Column) -> Column:
    return _drop_last(tokens, cond(tokens))


def _from_end(tokens: Column, back: int) -> Column:
    return F.coalesce(F.try_element_at(tokens, F.lit(-back)), F.lit(""))


def normalize_address(text: Column) -> Column:
    """struct(house_nr int, street string): official direction and street-type codes, no city, state or ZIP."""
    upper = F.regexp_replace(F.upper(text), r"[.,#]", " ")
    tokens = F.filter(F.split(F.trim(upper), r"\s+"), lambda t: t != "")
    zip_code = lambda t: _from_end(t, 1).rlike(r"^\d{5}(-\d{4})?$") & (F.size(t) > 2)
    state = lambda t: (_from_end(t, 1) == V.STATE_CODE) | (
        (_from_end(t, 1) == V.STATE_NAME) & (_from_end(t, 2) == V.CITY))
    city = lambda t: (_from_end(t, 1) == V.CITY) & (F.size(t) > 2)

    def parts(t: Column) -> Column:
        number = F.regexp_extract(F.coalesce(F.get(t, F.lit(0)), F.lit("")), r"^(\d+)-?[A-Z]?$", 1)
        rest = F.when(number == "", t).otherwise(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))))
        return F.struct(number.alias("number"), rest.alias("rest"), F.size(rest).alias("n"))

    def coded(p: Column) -> Column:
        street = F.transform(p["rest"], lambda t, i: F.coalesce(
            F.when(i == 0, _lookup(V.DIRECTIONS, t)), F.when((i > 0) & (i == p["n"] - 1), _lookup(V.STREET_TYPES, t)), t))
        return F.struct(F.nullif(p["number"], F.lit("")).cast("int").alias("house_nr"),
                        F.array_join(street, " ").alias("street"))

    for cond in (zip_code, state, city):
        tokens = let(tokens, partial(_dropped, cond))
    return let(let(tokens, parts), coded)


def typed_direction(street: Column) -> Column:
    """The direction a normalised street starts with, when more words follow it."""
    first = F.split_part(street, F.lit(" "), F.lit(1))
    return F.when(first.isin(list(V.DIRECTIONS)) & street.contains(" "), first)


def parcel_address(house_lo: Column, suffix: Column, direction: Column, street: Column, street_type: Column) -> Column:
    """The searched address of a parcel: its printed parts, blanks left out."""
    number = F.concat(F.coalesce(house_lo.cast("string"), F.lit("")), F.coalesce(suffix, F.lit("")))
    return F.trim(F.concat_ws(" ", F.nullif(number, F.lit("")), direction, street, street_type))


def display_address(lo: Column, hi: Column, suffix: Column, direction: Column, street: Column, kind: Column) -> Column:
    """'2401-2405A W WISCONSIN AV': the number range when a parcel spans several numbers."""
    number = F.when(hi != lo, F.concat_ws("-", lo.cast("string"), hi.cast("string"))).otherwise(lo.cast("string"))
    parts = [F.concat(number, F.coalesce(suffix, F.lit("")))] + [F.nullif(c, F.lit("")) for c in (direction, street, kind)]
    return F.concat_ws(" ", *parts)
