"""Every registered query beside its oracle SQL at the smallest scale."""

from __future__ import annotations

import oracle_check
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: What SQL cannot express; each has tests of its own against plain versions.
WITHOUT_SQL = {"op1_toxicity", "op2_ngram_join", "op3_secrets", "op5_quality", "op6_pii", "op7_chat", "op10_decontamination", "op12_whitening", "pipeline"}


@pytest.fixture(scope="module")
def duck():
    return oracle_check.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert name in WITHOUT_SQL and df.count() > 0
        return
    assert oracle_check.compare(df, duck, sql) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
