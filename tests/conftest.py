from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1] / "tools"))


@pytest.fixture(scope="session")
def spark():
    from tallybook.session import local_session

    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def each(spark):
    """Apply an expression to a list of texts, in order."""
    from pyspark.sql import functions as F

    def run(values, expr):
        df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
        return [r[0] for r in df.select(expr(F.col("v")).alias("o"), "i").orderBy("i").collect()]

    return run
