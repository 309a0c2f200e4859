from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tallybook.operators import grounding as G

DATA = json.dumps({"proposed2027": "172888103.00", "adopted2026": "165408632.00", "change": "7479471.00", "pct": "3.00", "fee": "280.00",
                   "cents": 145800})
Q = "What is the Fire Department budget?"
CASES = [
    (Q, "Proposed: $172.9 million, up $7.5 million (3%). Fee: $280. Total $1,458.00.", DATA, "", []),
    (Q, "It would cost $200 million, a 12.5% jump.", DATA, "", ["$200 million", "12.5%"]),
    ("My home is worth $250,000", "At $7.29 per $1,000 of assessed value on $250,000…", "7.29", "", []),
    (Q, "Library: $1,490,755, and Fire: $7,479,471.", "{}", '{"a":"1490755.00","b":"7479471.00"}', []),
    (Q, "Requested $345.8M; proposed $343.9M; withdrawal $32.3M.", '{"a":345800000,"b":343937125,"c":32300000}', "", []),
    (Q, "each $1,000 of value pays less; por cada $1,000 de valor tasado", "{}", "", []),
    (Q, "It would rise by $8.20, from $271.80 to $280.00.", '{"a":"271.80","b":"280.00"}', "", ["$8.20"]),
    (Q, "That is 200 million dollars.", "{}", "", ["200 million"]),
    (Q, "It costs $20.26.", '{"year2026":999,"fiscalYear":2026}', "", ["$20.26"]),
    ("I pay $2,000", "That rises by $2.", "{}", "", ["$2"]),
    (Q, "About $218.2 million, with $58.8 million to the general fund.",
     json.dumps([{"statement": "an estimated revenue of $218.2 million. Approximately $58.8 million of the sales tax"}]), "", []),
    (Q, "Water Works is over $32 million.", '{"a":32675272}', "", []),
    (Q, "Water Works is over $33 million.", '{"a":32675272}', "", ["$33 million"]),
    (Q, "Proposed: $7.16 million.", '{"a":7165000}', "", []),
    (Q, "Proposed: $7.15 million.", '{"a":7165000}', "", ["$7.15 million"]),
    (Q, "$5\nmillion of $6K, 2\tbillion, $3B and more than $1.5M.", '{"a":5000000,"b":6100,"c":1990000000}', "", ["$3B", "$1.5M"]),
    (Q, "No figures.", "", None, []),
]


def test_unsupported_figures(spark):
    rows = [(i, q, [], t, d, e) for i, (q, t, d, e, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, q string, before array<string>, text string, tool_data string, earlier_data string")
    got = [r["unsupported"] for r in G.unsupported_figures(df).orderBy("id").collect()]
    assert got == [c[-1] for c in CASES]


@pytest.mark.parametrize("hay,fig,want", [
    ("it is $1,458.00 a year", "$1,458.00", True), ("145800", "$1,458.00", True), ("rate 1.8", "$1.80", True),
    ("up 3.0%", "3%", True), ("3 percent", "3%", True), ("343937125", "$343.9 million", True), ("343937125", "$344.0 million", False)])
def test_has_figure(spark, hay, fig, want):
    assert spark.range(1).select(G.has_figure(F.lit(hay), F.lit(fig))).first()[0] is want


def test_outcomes(spark):
    df = spark.createDataFrame([(True, ["$1"], False), (True, [], False), (False, [], True), (False, [], False)],
                               "p boolean, u array<string>, d boolean")
    got = [r[0] for r in df.select(G.bucket(F.col("p"), F.col("u"), F.col("d"))).collect()]
    assert got == ["unsourced figure", "correct", "couldn't answer", "incomplete"]


def test_split_requirements(spark):
    df = spark.createDataFrame([("a", ["or the levy", "fine (both)"], ["broken (half"])], "id string, must_include array<string>, must_not array<string>")
    assert sorted(r["item"] for r in G.split_requirements(df).collect()) == ["broken (half", "or the levy"]
    assert G.selected_cases(df, ["b"]).count() == 0 and G.selected_cases(df, []).count() == 1


def test_halves_of_a_tenth_of_a_million_in_both_engines(spark, tmp_path):
    import duckdb
    import oracle_check

    import __spark_entry__ as entry

    cents = [250000, 350000, 1050000, 1150000, 1249999, 1650000, 8450000, 9950000]
    rows = ", ".join(f"({i}::bigint, {i * 3}::bigint, '{'FO'[i % 2]}', {c / 100}::double, '{'1-URGENT' if i % 3 else '2-HIGH'}')" for i, c in enumerate(cents))
    con = duckdb.connect()
    con.execute(f"copy (select * from (values {rows}) v(o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority)) to '{tmp_path}/orders.parquet' (format parquet)")
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    for name in ("required_figures", "unsupported_figures"):
        assert oracle_check.compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name]) == []
