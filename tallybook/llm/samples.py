"""Bounded samples of labelled rows for the models that are fitted on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def usable_labels(labels: DataFrame, label: str, usable: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of the rows of `labels` that can be learnt from."""
    return labels.filter(usable & F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))


def drawn_shares(labels: DataFrame, label: str, usable: Column, per_label: int, id_col: str = "doc_id") -> dict[int, float]:
    """Of each label, how many usable rows stand behind one that labelled_sample draws, over all of `labels`."""
    known = usable_labels(labels, label, usable, id_col).filter(F.col("label").isin(0, 1)).distinct()
    return {r.label: r.n / min(r.n, per_label) for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def prior_shift(shares: dict[int, float]) -> float:
    """What the log odds of label 1 learnt from the sample lack: it is cut for each label apart, so its share of label 1 is
    not that of the table."""
    return math.log(shares[1] / shares[0]) if len(shares) == 2 else 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_label: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of `per_label` labelled rows at most of each label, the first by a hash of the id.  Ids are drawn
    from `labels` first, so that what is broadcast has 2 x per_label rows at most; repeated ids count once."""
    known = usable_labels(labels, label, usable, id_col)
    drawn = None
    for value in (0, 1):
        some = known.filter(F.col("label") == value).groupBy("id", "label").count().orderBy(F.xxhash64("id", F.lit(5)), "id").limit(per_label).select("id", "label")
        drawn = some if drawn is None else drawn.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # of different texts under one id the one of the least hash, so that reruns learn the same
    chosen = texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    return chosen.select("id", "text", "label")
