"""From raw documents to a training mix: quality, exact copies, near copies, benchmark passages, source weights.

What every stage does with odd rows: a null text is an empty one; a text of any length is read whole; repeated rows are told
apart only where copies are dropped, and then one of them stays; ties are settled by id, then by content; an empty table gives
an empty one; all columns of the documents come through, whatever their names.  The result of a stage is to be written before
the next stage is called, which deletes the working tables of the stages before it (unless its input still reads them).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import quality
from tallybook.llm.common import end_stage, forget, stage_tables, table, written
from tallybook.llm.decontamination import contaminated
from tallybook.llm.exact_dedup import exact_dedup
from tallybook.llm.mixing import mix_sources
from tallybook.llm.ngram_join import near_duplicates
from tallybook.llm.samples import fold


def keeping(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], rule: str) -> DataFrame:
    """The rows of `docs` whose judged form meets the rule.  A column that the judge adds may have the name of one in `docs`, so
    the judge sees each of those under another name."""
    hidden = [f"in_{i}_" if c not in ("doc_id", "text", "source") else c for i, c in enumerate(docs.columns)]
    with stage_tables(docs):
        kept = judge(docs.toDF(*hidden)).filter(rule)
    return kept.select(*[F.col(h).alias(c) for h, c in zip(hidden, docs.columns, strict=True)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; it learns from labels as in its query.  Without labels of both
    kinds all stay as good as the one kind says."""
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1)
    return keeping(docs, lambda d: quality.score_quality(d, trees), "predicted = 1")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, but for the case of A-Z, the one of the largest id; of repeated rows, one.  Empty and null
    texts are equal."""
    return keeping(docs, exact_dedup, "kept")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by similar sets of five-word runs, the one of the smallest id; of repeated rows, one.
    Texts without words are alike to none and stay."""
    return keeping(docs, near_duplicates, "kept")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.  An empty benchmark drops none."""
    bench = table(spark, sf_dir, "benchmark")
    return keeping(docs, lambda d: contaminated(d, bench), "not contaminated")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their words, target and the words taken.  Texts without words are not taken."""
    end_stage(docs)
    return mix_sources(docs).filter(F.col("taken") > 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact_copies", exact_stage),
    ("near_copies", near_stage),
    ("benchmark", benchmark_stage),
    ("mix", mixing_stage),
]

#: Trees and random paths have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another.  Of the tables written on the way only those that the result reads are left."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        made = written(stage(spark, docs, sf_dir))
        end_stage(made)
        if k:
            forget(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
