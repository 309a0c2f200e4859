"""Exact deduplication by MSD radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import ascii_lower, matched, own, written

FIRST_DIGIT = 48
WIDER = 64


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs` with keep_id (the largest id among rows of equal text), group_size and kept.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one.  Documents are split by their
    length and then by successive digits of bytes, the first of FIRST_DIGIT bytes and each later one WIDER times as wide,
    so that texts of any length need few rounds.  A group with one document leaves at once, one whose text has ended is a
    group of copies; the others are split again.  Digits are compared as they are, without a digest.

    A group is counted with partial sums before the shuffle, so a digit that a third of all rows share is one row per
    task.  Its rows find their group by a join of two plain scans, which adaptive execution splits where a key is hot.
    Rows get their working number in a written table, so it stays what it is when an executor is lost.

    Null ids sort below all others; of repeated rows with the same id and text one is kept.  An empty table gives an empty
    one.  Columns of `docs` named keep_id, group_size or kept are replaced; all others come through unchanged.
    """
    size, digit, rid, gid, octets, n, top = own("size", "digit", "rid", "gid", "octets", "n", "top")
    columns = [c for c in docs.columns if c.lower() not in ("keep_id", "group_size", "kept")]
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    docs = docs.select(*[F.col(f"`{c}`") for c in columns])
    # the first digit: length and leading bytes; lower-casing keeps lengths, and a code point has four bytes at most
    short = docs.withColumns({size: F.octet_length(F.coalesce(F.col(text_col), F.lit(""))),
                              digit: F.substring(ascii_lower(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, FIRST_DIGIT)).cast("binary"), 1, FIRST_DIGIT)})
    shared = short.groupBy(size, digit).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1)
    shared = written(shared.select(size, digit, F.monotonically_increasing_id().alias(gid)))
    first = matched(short, shared, [size, digit], "left").drop(digit)
    first = written(first.withColumn(rid, F.when(F.col(gid).isNotNull(), F.monotonically_increasing_id())))

    single = first.filter(F.col(gid).isNull()).select(*columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                                      F.lit(True).alias("kept"))
    active = first.filter(F.col(gid).isNotNull())
    active = active.withColumn(octets, norm.cast("binary")).select(rid, F.col(id_col).alias(top), gid, size, F.expr(f"substring({octets}, {FIRST_DIGIT + 1})").alias(octets))
    ended, done, width = [], FIRST_DIGIT, FIRST_DIGIT * WIDER
    while True:
        last = F.col(size) <= done + width
        cut = active.select(rid, top, gid, size, F.substring(octets, 1, width).alias(digit),
                            F.when(~last, F.expr(f"substring({octets}, {width + 1})")).alias(octets))
        groups = written(cut.groupBy(gid, digit, size).agg(
            F.count(F.lit(1)).alias("group_size"), F.max(top).alias("keep_id"),
            F.coalesce(F.max_by(rid, top), F.max(rid)).alias("keep_rid"),
        ).withColumn("next_gid", F.monotonically_increasing_id()))
        over = last | (F.col("group_size") == 1)
        joined = written(matched(cut, groups, [gid, digit, size]).select(
            rid, top, F.col("next_gid").alias(gid), size, F.when(~over, F.col(octets)).alias(octets), over.alias("over"),
            "keep_id", "group_size", (F.col(rid) == F.col("keep_rid")).alias("kept")))
        ended.append(joined.filter("over").select(rid, "keep_id", "group_size", "kept"))
        active = joined.filter("not over").select(rid, top, gid, size, octets)
        done, width = done + width, width * WIDER
        if active.isEmpty():
            break
    found = reduce(DataFrame.unionByName, ended)
    copies = matched(first.filter(F.col(gid).isNotNull()), found, rid)
    return single.unionByName(copies.select(*columns, "keep_id", "group_size", "kept"))
