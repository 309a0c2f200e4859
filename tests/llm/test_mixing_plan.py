"""How often the mix reads its texts, from its plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.llm import mixing


def test_sizes_and_keys_are_read_from_texts_once(spark, monkeypatch):
    rows = [(i, None if i % 7 == 0 else "word " * (i % 5) + "1 2", "ab"[i % 2] if i % 3 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plans, keep = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df: plans.append(df) or keep(df))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    short, whole = mixing.mix_sources(docs, keep_text=False), mixing.mix_sources(docs)
    assert short.columns == [c for c in whole.columns if c != "text"]
    assert sorted(map(str, short.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    reads = ["regexp_replace" in df._jdf.queryExecution().optimizedPlan().toString() for df in [*plans, short]]
    assert sum(reads) == 2 and whole.filter(F.col("text").isNotNull()).count() == sum(r[1] is not None for r in rows)
