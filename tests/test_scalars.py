from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.functions import address as A, dates, money as M, numbers as N, text as X
from tallybook.functions.register import register_sql_functions
from tallybook.functions.trigrams import word_similarity


def test_parse_decimal(each):
    got = each(["1,234", "(150,644)", "112.36", "30,000*", "", "-", "(-5)", "words"], N.parse_decimal)
    assert got == [1234, -150644, Decimal("112.36"), 30000, None, None, -5, None]


def test_account_codes_keep_their_digits(each):
    assert each(["42", "123456", "1234567", None], X.zero_pad_account) == ["000042", "123456", "1234567", None]


def test_parse_dollars_stops_on_cents(each):
    assert each(["$1,234", "-"], N.parse_dollars) == [1234, None]
    with pytest.raises(Exception, match="cents"):
        each(["12.50"], N.parse_dollars)


def test_second_reader_numbers(each):
    assert each(["[4,998,805]", "(1)", "—", "x"], N.slot_value) == [4998805, -1, None, None]
    assert each(["-", "12", "twelve"], N.is_slot) == [True, True, False]


def test_half_rounds_up(spark):
    row = spark.range(1).select(N.round_half_up(F.lit(-2.5)), N.round_half_up(F.lit(2.5)),
                                N.per_share(F.lit(109350), F.lit(4)), N.percent_change(F.lit(5), F.lit(0))).first()
    assert list(row) == [-2, 3, 27338, None]


REASONS = [
    ("Fund city supported position previoulsy paid as a contract employee through ARPA funded DVHRT grant.", "contract_to_city"),
    ("Delete position previoulsy paid through ARPA funded DVHRT grant.", "arpa_sunset"), ("Moved onto levy", "grant_change"),
    ("Retitled", "reclassification"), ("Correction - Pay Range", "reclassification"), ("Moved to Library", "transfer"),
    ("New position for 2027 Budget", "new_funded"), ("Converting to full time position", "new_funded"),
    ("Position eliminated", "other"), ("Elimination of funded vacant positions", "vacant_elimination"), (None, "other"),
]


def test_reason_rules(each):
    assert each([r for r, _ in REASONS], X.reason_category) == [c for _, c in REASONS]


def test_addresses(each):
    cases = [
        ("2400 w. Wisconsin Ave, Milwaukee, WI 53233", (2400, "W WISCONSIN AV")), ("5 w court st", (5, "W COURT ST")),
        ("123 North Lincoln Memorial Drive", (123, "N LINCOLN MEMORIAL DR")), ("1300 n prospect", (1300, "N PROSPECT")),
        ("2400 w wisconsin", (2400, "W WISCONSIN")), ("2400 W Wisconsin Av Milwaukee Wisconsin", (2400, "W WISCONSIN AV")),
        ("e juneau avenue", (None, "E JUNEAU AV")), ("3rd st", (None, "3RD ST")), ("1234a n 27th st", (1234, "N 27TH ST")),
        ("4500 s 20th lane", (4500, "S 20TH LA"))]
    assert [tuple(r) for r in each([c for c, _ in cases], A.normalize_address)] == [w for _, w in cases]


def test_word_similarity(each):
    assert each(["word", ""], lambda c: word_similarity(c, F.lit("two words"))) == [0.8, 0.0]


def test_money_text(each):
    long = lambda c: c.cast("long")
    assert each(["2261087412", "846796205", "37458"], lambda c: M.big_dollars(long(c))) == ["$2.26 billion", "$846.8 million", "$37,458"]
    assert each(["4386", "-1200", "0"], lambda c: M.signed_cents(long(c))) == ["+$43.86", "−$12.00", "$0.00"]
    assert each(["846796205", "37458", "-5000000"], lambda c: M.millions(long(c))) == ["846.8", "0.04", "−5.0"]


def test_marks_whole_numbers_only(each):
    terms = F.array(F.lit("343,937,125"), F.lit("7.29"))
    assert each(["343,937,125 of 1,343,937,1250 at 7.29, not 7.291 & <b>"], lambda c: X.mark_terms(c, terms)) == [
        "<mark>343,937,125</mark> of 1,343,937,1250 at <mark>7.29</mark>, not 7.291 &amp; &lt;b&gt;"]


def test_excerpt_and_context(each):
    assert each(["a" * 215 + " bcd efg hij"], X.excerpt) == ["a" * 215 + " bcd…"]
    assert each(["A — B — C", "A"], X.short_context) == ["B", "A"]


def test_offset_timestamps(each):
    assert each(["2026-10-05T18:00:00-05:00"], lambda c: dates.utc_stamp(dates.offset_to_utc(c))) == ["20261005T230000Z"]


def test_sql_functions(spark):
    register_sql_functions(spark)
    row = spark.sql("select parse_decimal('(1,234)'), reason_category('Moved to Library'), percent_change(200, 188)").first()
    assert list(row) == [Decimal("-1234.0000"), "transfer", -6.0]
