"""Two tables where any row of one may meet any row of the other: blocks of bounded size against blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def block_count(rows: int, size: int) -> int:
    """Blocks that keys are dealt to by hash; twice as many as needed, so that an uneven one stays near the size."""
    return 1 if rows <= size else -(-rows // size) * 2


def meet(left: DataFrame, left_key: str, left_blocks: int, right: DataFrame, right_key: str, right_blocks: int,
         work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(left rows, right rows) for each pair of blocks.  Rows with equal keys are in one block; each row is sent to every block
    of the other side once.  There are as many parts as pairs of blocks, so that a task sorts about one pair's rows: few bytes may
    be very many rows."""
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_left", dealt(left_key, left_blocks)).withColumn("_right", every(right_blocks))
    b = right.withColumn("_right", dealt(right_key, right_blocks)).withColumn("_left", every(left_blocks))
    keys = ["_left", "_right"]
    a, b = (side.repartition(left_blocks * right_blocks, *keys) for side in (a, b))
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(
        lambda x, y: work(x.drop(columns=keys), y.drop(columns=keys)), schema)
