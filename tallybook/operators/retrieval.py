"""Search: keyword and vector ranks, rank fusion, focused passages, glossary terms, typed addresses.

Queries come as a table, so a run answers many at once.  Every candidate join is an equi-join on a term, a gram or a
block; nothing compares all queries with all rows except the exact vector scan, which does so block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallybook import fixed_values as V
from tallybook.functions import address as A, text as X
from tallybook.functions.trigrams import let, ordered_trigrams, run_similarity, trigrams
from tallybook.operators.containment import held_phrases
from tallybook.operators.postings import shard_ranks
from tallybook.operators.running import keep_within_budget
from tallybook.session import materialize

RRF_K = 60
LIST_SIZE = 20
#: Typed streets or addresses that one task compares.
TASK_PHRASES = 2500
#: Candidate pairs whose trigrams one task scores.
TASK_PAIRS = 20_000


def english_stop_words(spark: SparkSession) -> list[str]:
    """Spark's own English stop-word list."""
    remover = spark._jvm.org.apache.spark.ml.feature.StopWordsRemover
    return list(remover.loadDefaultStopWords("english"))


def ranked(df: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each key.  Spark keeps k per partition before it shuffles."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


# --- Keyword rank --------------------------------------------------------------------------------------------------------


def query_terms(queries: DataFrame, stop_words: list[str], text: str = "text") -> DataFrame:
    return queries.select("query_id", F.explode(X.search_terms(F.col(text), stop_words)).alias("term"))


def keyword_rank(queries: DataFrame, passages: DataFrame, stop_words: list[str], k: int = LIST_SIZE, text: str = "text",
                 passage_id: str = "id") -> DataFrame:
    """Passages that hold any query word, by how often they hold them.  Words outside the queries never shuffle, and a shard of
    passages passes on its k best rows of a query."""
    tokens = passages.select(F.col(passage_id).alias("id"), F.explode(X.words(F.col(text))).alias("w"))
    terms = tokens.where(~F.col("w").isin(stop_words)).select("id", X.light_stem(F.col("w")).alias("term"))
    near = shard_ranks(query_terms(queries, stop_words), terms, k, passages.count(), queries.count())
    return ranked(near, ["query_id"], [F.col("score").desc(), "id"], k)


# --- Vector rank -----------------------------------------------------------------------------------------------------------


def _normal(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size == 0, 1, size)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, equal scores by id."""
    keep = np.arange(len(scores))
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    keep = keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return ids[keep], scores[keep]


def _as_rows(query_ids: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({"query_id": np.repeat(query_ids, [len(ids) for ids, _ in best]), "id": np.concatenate([ids for ids, _ in best]),
                         "score": np.concatenate([scores for _, scores in best])})


def vector_rank(queries: DataFrame, corpus: DataFrame, k: int = LIST_SIZE, max_queries: int = 4096,
                block_rows: int = 50_000) -> DataFrame:
    """The k nearest corpus rows of each query by cosine, exactly.  queries(query_id long, embedding), corpus(id long,
    embedding).

    A query set within max_queries goes to every task and the corpus is scanned once, k rows per query leaving each partition.
    A larger one is cut into blocks, and so is the corpus; each pair of blocks is one bounded group."""
    schema = "query_id long, id long, score double"
    held = queries.select("query_id", "embedding").limit(max_queries + 1).collect()
    if len(held) <= max_queries:
        if not held:
            return queries.sparkSession.createDataFrame([], schema + ", rank int")
        matrix = _normal(np.array([r["embedding"] for r in held], dtype="float64")).T
        query_ids = np.array([r["query_id"] for r in held])

        sent = queries.sparkSession.sparkContext.broadcast((query_ids, matrix))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, matrix = sent.value
            best = [(np.empty(0, dtype="int64"), np.empty(0))] * len(query_ids)
            for batch in batches:
                if len(batch):
                    ids = batch["id"].to_numpy()
                    scores = _normal(np.stack(batch["embedding"].to_numpy()).astype("float64")) @ matrix
                    for j, held in enumerate(best):
                        new = _top(ids, scores[:, j], k)
                        best[j] = _top(np.r_[held[0], new[0]], np.r_[held[1], new[1]], k)
            yield _as_rows(query_ids, best)

        near = corpus.select("id", "embedding").mapInPandas(scan, schema)
    else:
        near = _blocked(queries, corpus, k, max_queries, block_rows, schema)
    return ranked(near, ["query_id"], [F.col("score").desc(), "id"], k)


def _blocked(queries: DataFrame, corpus: DataFrame, k: int, max_queries: int, block_rows: int, schema: str) -> DataFrame:
    n_q = -(-queries.count() // max_queries) * 2
    n_c = -(-corpus.count() // block_rows) * 2
    q = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("qb"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))).alias("cb"))
    c = corpus.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(n_c)).alias("cb"),
                      F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))).alias("qb"))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"),
                              "score": pd.Series(dtype="float64")})
        if not len(left) or not len(right):
            return empty
        m = _normal(np.stack(left["embedding"].to_numpy()).astype("float64")).T
        rows = _normal(np.stack(right["embedding"].to_numpy()).astype("float64"))
        ids, scores = right["id"].to_numpy(), rows @ m
        return _as_rows(left["query_id"].to_numpy(), [_top(ids, scores[:, j], k) for j in range(scores.shape[1])])

    return q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(pair, schema)


# --- Fusion and passages -----------------------------------------------------------------------------------------------------


def fuse_ranks(keyword: DataFrame, vector: DataFrame, limit: int = 5, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; a list a passage is missing from adds nothing."""
    a = keyword.select("query_id", "id", F.col("rank").alias("kw"))
    b = vector.select("query_id", "id", F.col("rank").alias("vs"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(c)), F.lit(0.0))
    fused = a.join(b, ["query_id", "id"], "full").withColumn("score", part("kw") + part("vs"))
    return ranked(fused, ["query_id"], [F.col("score").desc(), "id"], limit)


def focus_passage(text: Column, query: Column, limit: int = 1200) -> Column:
    """The sentences that share most words with the question, in their order, within the limit; a short text is whole."""
    asked = F.array_distinct(F.filter(X.words(query), lambda w: (F.length(w) > 2) & ~w.isin(V.FOCUS_STOP_WORDS)))
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))

    def cut(g: Column) -> Column:
        hits = lambda s: F.size(F.filter(X.words(s), lambda w: F.array_contains(g["asked"], w)))
        scored = F.transform(F.split(g["clean"], V.SENTENCE_BREAK_FOCUS),
                             lambda s, i: F.struct((-hits(s)).alias("less"), i.alias("i"), s.alias("t")))
        kept = keep_within_budget(F.array_sort(scored), lambda s: F.length(s["t"]), limit)
        in_order = F.array_sort(F.transform(kept, lambda s: F.struct(s["i"].alias("i"), s["t"].alias("t"))))
        return F.array_join(F.transform(in_order, lambda s: s["t"]), " … ")

    whole = F.struct(asked.alias("asked"), clean.alias("clean"))
    return let(whole, lambda g: F.when(F.length(g["clean"]) <= limit, g["clean"]).otherwise(cut(g)))


def search_passages(queries: DataFrame, passages: DataFrame, stop_words: list[str], limit: int = 5,
                    department: Column | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Hybrid search.  queries(query_id, text[, embedding]); passages(id long, text, context_header, heading, kind, cite
    [, embedding]).  Vectors may stand in a table of their own, vectors(id, embedding), which then meets the ids of the passages and
    not their texts.  Without query vectors the keyword list stands alone."""
    pool = passages.where(F.col("kind") == "narrative")
    pool = pool if department is None else pool.where(department)
    kw = keyword_rank(queries, pool, stop_words)
    if vectors is not None:
        vs = vector_rank(queries.where("embedding is not null"), vectors.where("embedding is not null").join(pool.select("id"), "id", "left_semi"))
    elif "embedding" in queries.columns and "embedding" in pool.columns:
        vs = vector_rank(queries.where("embedding is not null"), pool.where("embedding is not null"))
    else:
        vs = kw.where("false")
    top = fuse_ranks(kw, vs, limit)
    named = top.join(pool, "id").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    return named.select("query_id", "rank", "id", "score", "heading", X.short_context(F.col("context_header")).alias("context"),
                        focus_passage(F.col("text"), F.col("question")).alias("text"), "cite")


def find_facts(queries: DataFrame, facts: DataFrame, stop_words: list[str], limit: int = 4) -> DataFrame:
    """Reviewed facts whose topic or statement holds any query word, best first.  facts(id, topic, statement, ...)."""
    pool = facts.where(F.col("reviewed_by").isNotNull())
    body = pool.select("id", F.concat_ws(" ", F.replace("topic", F.lit("_"), F.lit(" ")), "statement").alias("text"))
    return keyword_rank(queries, body, stop_words, k=limit).join(pool, "id").drop("score")


def facts_beside_departments(departments: DataFrame, facts: DataFrame, stop_words: list[str], limit: int = 4) -> DataFrame:
    """departments(budget_version, slug, name): the reviewed facts of the same version that match a department's name, without the
    words that all names share."""
    name = F.regexp_replace("name", r"Department( of)?|Division|-", " ")
    asked = departments.select(F.concat_ws("/", "budget_version", "slug").alias("query_id"), "budget_version", "slug", name.alias("text"))
    pool = facts.withColumn("_fact", F.col("id")).withColumn("id", F.concat_ws("/", "budget_version", F.col("id").cast("string")))
    found = find_facts_by_key(asked, pool, stop_words, limit)
    return found.select("budget_version", "slug", "rank", F.col("_fact").alias("id"), "statement")


def find_facts_by_key(asked: DataFrame, pool: DataFrame, stop_words: list[str], limit: int) -> DataFrame:
    """find_facts where question and fact must be of one version: their words carry it."""
    tagged = lambda version, term: F.concat_ws(":", version, term)
    wanted = asked.select("query_id", "budget_version", "slug", F.explode(X.search_terms(F.col("text"), stop_words)).alias("t")).withColumn("term", tagged("budget_version", F.col("t")))
    facts = pool.where(F.col("reviewed_by").isNotNull())
    body = facts.select("id", "budget_version", F.explode(X.words(F.concat_ws(" ", F.replace("topic", F.lit("_"), F.lit(" ")), "statement"))).alias("w"))
    terms = body.where(~F.col("w").isin(stop_words)).select("id", tagged("budget_version", X.light_stem(F.col("w"))).alias("term"))
    top = ranked(shard_ranks(wanted.select("query_id", "term"), terms, limit, facts.count(), asked.count()), ["query_id"], [F.col("score").desc(), "id"], limit)
    top = top.join(asked.select("query_id", "slug"), "query_id")
    return top.drop("score", "query_id").join(facts, "id")


def sales_tax_beside(found: DataFrame, revenue_lines: DataFrame, topic: str = "sales_tax") -> DataFrame:
    """found(query_id, budget_version, topic, ...): for each question that met a fact on the topic, the revenue line split by fund
    (revenue_lines of lookups.revenue_line_by_fund) of that version."""
    met = found.where(F.col("topic") == topic).select("query_id", "budget_version").distinct()
    return met.join(revenue_lines, "budget_version")


def nearest_concepts(queries: DataFrame, concepts: DataFrame, k: int = 3) -> DataFrame:
    """The k concepts nearest to each question by vector.  queries(query_id, embedding), concepts(id, label, kind, embedding)."""
    near = vector_rank(queries, concepts.where("embedding is not null"), k=k)
    return near.join(concepts.drop("embedding"), "id").select("query_id", "rank", "id", "kind", "label")


def recall_and_mrr(ranks: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Share of queries with an expected row in the first k, and the mean reciprocal rank of the first one."""
    hit = expected.join(ranks.where(F.col("rank") <= k), ["query_id", "id"], "left").groupBy("query_id").agg(
        F.min("rank").alias("first"))
    return hit.agg(F.count("*").alias("queries"), F.avg(F.col("first").isNotNull().cast("double")).alias("recall"),
                   F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))).alias("mrr"))


# --- Trigram matches -----------------------------------------------------------------------------------------------------------


def similar_pairs(phrases: DataFrame, texts: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """phrases(p, phrase), texts(t, text), both distinct: pairs whose word similarity reaches the threshold, with it.

    A pair at threshold s shares at least s of the phrase's n trigrams, so any n - ceil(s n) + 1 of them include a shared
    one.  Only that many of a phrase's rarest trigrams look for candidates: an exact filter that leaves common ones alone."""
    grams = texts.select("t", F.explode(trigrams(F.col("text"))).alias("g"))
    frequency = grams.groupBy("g").agg(F.count("*").alias("df"))
    mine = phrases.select("p", trigrams(F.col("phrase")).alias("all")).where(F.size("all") > 0)
    exploded = mine.select("p", F.size("all").alias("n"), F.explode("all").alias("g")).join(frequency, "g", "left")
    rarity = Window.partitionBy("p").orderBy(F.coalesce("df", F.lit(0)), "g")
    # The small subtraction keeps ceil exact when s * n is a whole number.
    need = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1
    probes = exploded.withColumn("_r", F.row_number().over(rarity)).where(F.col("_r") <= need).where("df is not null").select(
        "p", "g")
    useful = probes.select("g").distinct()
    pairs = grams.join(useful, "g", "left_semi").join(probes, "g").select("p", "t").distinct()
    # Few bytes, much work: the pairs are written in files by their number before they are scored.
    pairs = materialize(pairs)
    met = materialize(pairs.join(phrases, "p").join(texts, "t").repartition(1 + pairs.count() // TASK_PAIRS, "p", "t"))
    enough = let(trigrams(F.col("phrase")), lambda a: F.size(F.array_intersect(a, trigrams(F.col("text"))))
                 >= F.ceil(F.size(a) * F.lit(threshold) - 1e-9))
    scored = met.where(enough).withColumn(
        "similarity", run_similarity(trigrams(F.col("phrase")), ordered_trigrams(F.col("text"))))
    return scored.where(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold)


def search_addresses(queries: DataFrame, parcels: DataFrame, limit: int = 8,
                     threshold: float = V.WORD_SIMILARITY_ADDRESS) -> DataFrame:
    """Typed addresses (query_id, typed) to parcels: the typed direction first, then numbers inside a parcel's range, the
    best street, the nearest number.  Parcels at one address (flats) are one match without a tax key."""
    parts = ["house_nr_lo", "house_nr_hi", "house_nr_sfx", "sdir", "street", "sttype"]
    places = _spread(parcels.groupBy(*parts).agg(F.count("*").alias("parcels"), F.min("taxkey").alias("taxkey")).withColumn(
        "address", A.parcel_address(F.col("house_nr_lo"), F.col("house_nr_sfx"), F.col("sdir"), F.col("street"), F.col("sttype"))), "address")
    asked = queries.withColumn("_n", A.normalize_address(F.col("typed"))).select(
        "query_id", F.col("_n.house_nr").alias("house_nr"), F.col("_n.street").alias("phrase")).where(F.length("phrase") >= 3)
    asked = materialize(asked)
    # Places are ranked once for all queries that ask for the same number and street.
    typed = _spread(asked.select("house_nr", "phrase").distinct(), "phrase")
    near = _similar_addresses(_spread(typed.select("phrase").distinct(), "phrase"), places, threshold).join(places, "address")
    parts_of = 1 + typed.count() // TASK_PHRASES
    rows = typed.repartition(parts_of, "phrase").join(near.repartition(parts_of, "phrase"), "phrase")
    direction = A.typed_direction(F.col("phrase"))
    rows = rows.withColumns({
        "exact_number": F.coalesce(F.col("house_nr").between(F.col("house_nr_lo"), F.col("house_nr_hi")), F.lit(False)),
        "direction_ok": direction.isNull() | F.coalesce(F.col("sdir") == direction, F.lit(False)),
        "away": F.abs(F.col("house_nr_lo") - F.coalesce("house_nr", "house_nr_lo"))})
    order = [F.col("direction_ok").desc(), F.col("exact_number").desc(), F.col("similarity").desc(), "away", "house_nr_lo",
             "house_nr_hi", "house_nr_sfx", "sdir", "street", "sttype"]
    best = ranked(rows, ["phrase", "house_nr"], order, limit)
    found = asked.withColumnsRenamed({"phrase": "_phrase", "house_nr": "_nr"}).join(
        best, (F.col("_phrase") == F.col("phrase")) & F.col("_nr").eqNullSafe(F.col("house_nr")))
    return found.select(
        "query_id", "rank", F.when(F.col("parcels") == 1, F.col("taxkey")).alias("taxkey"),
        A.display_address(*[F.col(c) for c in parts]).alias("address"), "exact_number", "parcels", "similarity")


def _spread(df: DataFrame, by: str) -> DataFrame:
    """Rows written once, in files of few rows: their bytes are few, but each is compared with many others."""
    df = materialize(df)
    return materialize(df.repartition(1 + df.count() // TASK_PHRASES, by))


def _similar_addresses(phrases: DataFrame, places: DataFrame, threshold: float) -> DataFrame:
    """phrase, address, similarity.  Every trigram of a house number with at most one suffix letter holds a digit, so a
    phrase without digits scores the same on all numbers of a street: it is compared with the street once.  Other pairs are
    compared on the whole address."""
    digits = F.col("phrase").rlike("[0-9]")
    plain = F.length(F.coalesce("house_nr_sfx", F.lit(""))) <= 1
    street = F.trim(F.concat_ws(" ", F.nullif("sdir", F.lit("")), "street", "sttype"))
    texts = places.select("address", street.alias("line"), plain.alias("plain")).distinct()

    def compared(some: DataFrame, column: str, lines: DataFrame) -> DataFrame:
        return similar_pairs(some.select(F.col("phrase").alias("p"), "phrase"), lines.select(
            F.col(column).alias("t"), F.col(column).alias("text")).distinct(), threshold).select(
            "phrase", F.col("text").alias(column), "similarity")

    worded, numbered = phrases.where(~digits), phrases.where(digits)
    by_street = compared(worded, "line", texts.where("plain")).join(texts.where("plain"), "line").select(
        "phrase", "address", "similarity")
    return by_street.unionByName(compared(worded, "address", texts.where("not plain"))).unionByName(
        compared(numbered, "address", texts))


def lookup_glossary(queries: DataFrame, glossary: DataFrame, limit: int = 3,
                    threshold: float = V.WORD_SIMILARITY_TERM) -> DataFrame:
    """Glossary entries for typed terms (query_id, typed): one holds the other, an alias is equal, or the words are alike;
    most alike first.  Containment is one reading of each text, in either direction."""
    asked = queries.select("query_id", F.lower(F.trim("typed")).alias("phrase")).where(F.col("phrase") != "")
    phrases = materialize(asked.select(F.col("phrase").alias("p"), "phrase").distinct())
    texts = materialize(glossary.select(F.lower("term").alias("t"), F.lower("term").alias("text")).distinct())

    held = held_phrases(phrases.select("phrase"), texts.select("text")).toDF("p", "t")
    holds = held_phrases(texts.select(F.col("text").alias("phrase")), phrases.select(F.col("phrase").alias("text"))).toDF("t", "p").select("p", "t")
    alias = glossary.select(F.lower("term").alias("t"), F.explode("aliases").alias("a")).select("t", F.lower("a").alias("p"))
    alias = alias.join(phrases.select("p"), "p", "left_semi").select("p", "t")
    alike = similar_pairs(phrases, texts, threshold, strict=True).select("p", "t")
    pairs = reduce(DataFrame.union, [held, holds, alias, alike]).distinct()
    scored = pairs.withColumn("similarity", run_similarity(trigrams(F.col("p")), ordered_trigrams(F.col("t"))))
    rows = asked.join(scored, asked.phrase == scored.p).join(
        glossary.withColumn("t", F.lower("term")), "t")
    return ranked(rows, ["query_id"], [F.col("similarity").desc(), "term"], limit).drop("t", "p", "phrase")
