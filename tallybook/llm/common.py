"""Shared folder, written intermediate tables and small column helpers of the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "[^\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Only a local session that names none, as in tests, gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = spark.sparkContext.getCheckpointDir()
    return named


#: Where each written table lies; the folder of the stage at work, if any; those of stages whose result may still be read.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_at_work: list[str] = []
_stages: list[str] = []


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there, a lost executor repeats only what follows,
    and later joins know the table's size.  Spark drops the shuffle files of the write when it has ended."""
    spark, cleanup = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path = f"{_at_work[-1] if _at_work else shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, _paths.pop(df))


@contextmanager
def stage_tables(docs: DataFrame) -> Iterator[None]:
    """Tables written inside lie in a folder of their own, which end_stage deletes; those of earlier stages are deleted now."""
    end_stage(docs)
    _at_work.append(f"{shared_folder(docs.sparkSession)}/llm-stage-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _stages.append(_at_work.pop())


def end_stage(docs: DataFrame) -> None:
    """Deletes the folders of all stages that have ended, but for those that `docs` still reads."""
    files = docs.inputFiles() if _stages else []
    for folder in list(_stages):
        name = folder.rsplit("/", 1)[1]
        if not any(f"/{name}/" in f for f in files):
            _remove(docs.sparkSession, folder)
            _stages.remove(folder)


def matched(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the corpus: a sort-merge join at every size, never a broadcast, so that
    adaptive execution can split its hot keys and small runs show what large ones do."""
    return left.join(right.hint("merge"), on, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def own(*names: str) -> list[str]:
    """Working column names that do not meet a column of the input."""
    return [f"__{name}_" for name in names]


def row_key(df: DataFrame, id_col: str, text_col: str) -> Column:
    """Key of a row by its content: 128 bits of a digest of id and text.  Rows that share it are equal in both columns, so that
    they get equal results; null ids and texts have keys too."""
    tag = F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("n"))
    return F.unhex(F.sha2(F.concat(tag, F.lit("\0"), F.coalesce(F.col(text_col), F.lit(""))), 256).substr(1, 32))


def with_arrays(df: DataFrame, work: Callable[..., dict[str, pa.Array]], inputs: list[str], outputs: dict[str, str], at_once: int = 512) -> DataFrame:
    """`df` without its columns `inputs` and with the columns `outputs` (name: type) that `work` makes of them, `at_once`
    rows at a time.  The other columns pass as Arrow arrays, so that nulls and types stay as they are."""
    rest = [f for f in df.schema.fields if f.name not in inputs]
    schema = T.StructType(rest + [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in outputs.items()])
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                part = batch.slice(lo, at_once)
                made = work(*[part.column(part.schema.get_field_index(c)) for c in inputs])
                arrays = [part.column(part.schema.get_field_index(c)) for c in names] + [made[c] for c in outputs]
                yield pa.RecordBatch.from_arrays(arrays, names + list(outputs))

    return df.mapInArrow(run, schema)


def table_of_longs(counts: DataFrame, size: int) -> np.ndarray:
    """(bucket, n) rows, `size` at most, as an array."""
    out = np.zeros(size, dtype=np.int64)
    for row in counts.collect():
        out[row[0]] = row[1]
    return out
