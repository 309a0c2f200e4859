from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tallybook.operators import containment as C, postings as P, retrieval as R
from tallybook.operators.blocks import block_count, meet


def plain_ranks(queries, texts, k):
    """Every query with every passage."""
    out = set()
    for q, asked in queries:
        scored = []
        for i, words in texts:
            score = sum(n for w, n in Counter(words).items() if w in asked)
            if score:
                scored.append((-score, i))
        out |= {(q, i, -s, r) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 3, 20])
def test_lists_cut_short_stay_exact(k):
    rng = np.random.default_rng(k)
    vocabulary = pd.Index([f"w{i}" for i in range(40)])
    for _ in range(60):
        ids = rng.integers(0, 60, 700)
        terms = vocabulary.to_numpy()[np.minimum(rng.geometric(0.12, 700) - 1, 39)]
        lists = P.Lists(terms, ids, vocabulary)
        asked = rng.choice(40, rng.integers(1, 12), replace=False)
        texts = [(i, list(terms[ids == i])) for i in np.unique(ids)]
        want = plain_ranks([(0, set(vocabulary[asked]))], texts, k)
        held, scores = lists.best(asked, k)
        assert {(0, lists.ids[p], s, r) for r, (p, s) in enumerate(zip(held, scores), 1)} == want


@pytest.mark.parametrize("shard,block", [(4096, 4096), (7, 3)])
def test_keyword_rank_over_shards(spark, shard, block):
    rng = np.random.default_rng(5)
    words = [f"w{i}x" for i in range(30)]
    texts = [(f"p{i:03d}", [words[j] for j in np.minimum(rng.geometric(0.1, rng.integers(0, 40)) - 1, 29)]) for i in range(90)]
    queries = [(i, {words[j] for j in rng.choice(30, 5, replace=False)}) for i in range(11)]
    wanted = spark.createDataFrame([(q, w) for q, asked in queries for w in asked], "query_id long, term string")
    terms = spark.createDataFrame([(i, w) for i, ws in texts for w in ws], "id string, term string")
    near = P.shard_ranks(wanted, terms, 4, len(texts), len(queries), shard, block)
    assert near.groupBy("query_id").count().agg({"count": "max"}).first()[0] <= 4 * block_count(len(texts), shard)
    got = R.ranked(near, ["query_id"], [near.score.desc(), "id"], 4)
    assert {tuple(r) for r in got.select("query_id", "id", "score", "rank").collect()} == plain_ranks(queries, texts, 4)


def test_keyword_rank_without_rows(spark):
    q = spark.createDataFrame([(1, "parks"), (2, None), (3, "the")], "query_id long, text string")
    p = spark.createDataFrame([(7, None), (8, ""), (9, "Park parks, parking")], "id long, text string")
    rows = lambda a, b: [tuple(r) for r in R.keyword_rank(a, b, ["the"]).select("query_id", "id", "score", "rank").collect()]
    assert rows(q, p) == [(1, 9, 3, 1)]
    assert rows(q, p.limit(0)) == [] and rows(q.limit(0), p) == []


@pytest.mark.parametrize("phrases,texts", [(50_000, 50_000), (9, 5)])
def test_held_phrases(spark, phrases, texts):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("ab é😀"), n))
    some, whole = {word(n) for n in rng.integers(0, 5, 60)} | {""}, {word(n) for n in rng.integers(0, 30, 40)} | {""}
    p = spark.createDataFrame([(x,) for x in some] + [(None,)], "phrase string")
    t = spark.createDataFrame([(x,) for x in whole] + [(None,)], "text string")
    got = [tuple(r) for r in C.held_phrases(p, t, phrases, texts).collect()]
    assert sorted(got) == sorted((a, b) for a in some for b in whole if a and a in b)
    assert C.held_phrases(p.limit(0), t).count() == C.held_phrases(p, t.limit(0)).count() == 0


def test_blocks_meet_in_as_many_parts_as_pairs(spark):
    """Few bytes are not put into one task: each pair of blocks has a part of its own size."""
    df = spark.range(40).withColumnRenamed("id", "a")
    out = meet(df, "a", 5, df.withColumnRenamed("a", "b"), "b", 3, lambda x, y: x.merge(y, how="cross"), "a long, b long")
    assert out.count() == 1600 and out.rdd.getNumPartitions() == 15


def test_one_place_for_all_who_type_it(spark, monkeypatch):
    """Queries of one typed address share its ranks, with a number and without; scored pairs are dealt by their number."""
    ddl = "taxkey string, house_nr_lo int, house_nr_hi int, house_nr_sfx string, sdir string, street string, sttype string"
    parcels = spark.createDataFrame([(f"{i:010d}", 100 * i, 100 * i + 4, None, "N", "POWELL", "AV") for i in range(1, 13)], ddl)
    asked = spark.createDataFrame([(i, "302 n powel avenue") for i in range(5)] + [(i, "n powel avenue") for i in range(5, 9)] + [(9, "zz qq"), (10, None)], "query_id int, typed string")
    parts, real = [], R.materialize
    monkeypatch.setattr(R, "TASK_PAIRS", 3, raising=False)
    monkeypatch.setattr(R, "materialize", lambda df: parts.append("repartition" in df._jdf.queryExecution().logical().toString().lower()) or real(df))
    rows = R.search_addresses(asked, parcels, limit=2).select("query_id", "rank", "taxkey", "exact_number").collect()
    want = {(q, 1, "0000000003", True) for q in range(5)} | {(q, 1, "0000000001", False) for q in range(5, 9)}
    assert {tuple(r) for r in rows if r["rank"] == 1} == want and len(rows) == 18
    assert any(parts)


def test_vectors_beside_passages(spark):
    """Vectors in a table of their own give what vectors in the passages give, and vectors of no passage count for nothing."""
    texts = spark.createDataFrame([(i, f"park {'parks ' * i}", "x — y", None, "narrative", 1) for i in range(4)], "id long, text string, context_header string, heading string, kind string, cite int")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (9, [1.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "parks", [1.0, 0.1]), (2, "roads", [0.0, 1.0])], "query_id long, text string, embedding array<double>")
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "id", "score").collect())
    beside = rows(R.search_passages(asked, texts, ["the"], vectors=vectors))
    assert beside == rows(R.search_passages(asked, texts.join(vectors, "id", "left"), ["the"])) and {r[2] for r in beside} == {0, 1, 2, 3}
