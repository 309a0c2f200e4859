"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import matched, own, row_key, written

#: Masks of six positions.  Any 20 words with four substitutions, 13 words with two, or 8 words with none, hold one of them
#: in some place with all its positions equal (tests/llm enumerate this).
MASKS = ("110101011", "1110111", "1110011001")
SPAN, SHORTEST = 20, 8
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Words for comparison: lower case, letters and digits only."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def allowed(length: Column) -> Column:
    """Substitutions among so many words."""
    return F.when(length >= 20, 4).when(length >= 13, 2).otherwise(0)


def seeds(rows: DataFrame, key: str, words: str) -> DataFrame:
    """(key, at, seed): the hash of each mask at each place where all of it lies inside the words.  Shifted copies of the
    array side by side put the words of a place into one row without a lambda."""
    reach = max(map(len, MASKS))
    shifted = F.arrays_zip(*[F.slice(F.col(words), k + 1, F.greatest(F.size(words) - k, F.lit(0))).alias(f"w{k}") for k in range(reach)])
    at = rows.select(key, F.posexplode(shifted).alias("at", "w"))
    hashed = [F.when(F.col(f"w.w{len(m) - 1}").isNotNull(), F.xxhash64(F.lit(i), *[F.col(f"w.w{k}") for k, c in enumerate(m) if c == "1"])) for i, m in enumerate(MASKS)]
    return at.select(key, "at", F.explode(F.array(*hashed)).alias("seed")).filter(F.col("seed").isNotNull())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every row of `docs` with contaminated, n_items and items (smallest id of each matched item text, ascending, joined
    by commas).

    An item is found in a document where SPAN consecutive words of both, aligned word by word, differ in four at most.  An
    item of 13 to 19 words is found whole with two differing words at most, one of 8 to 12 words as it is.  Shorter items
    say too little and are not looked for.  Words are compared in lower case, without anything but letters and digits.

    Documents and items are hashed under the same masks, which ignore some positions; hashes are joined; each (document,
    item, alignment) that any mask hits is compared once over its whole overlap.  The masks miss none by design.  The
    item side of the hash join is broadcast if it has `broadcast_rows` rows at most, which is counted; a larger one is
    joined by shuffle.  Equal items count as one.  Only matched keys meet the texts again.

    Null and empty texts match nothing; a null item id is listed as nothing but counts.  Repeated rows get equal results.
    An empty table gives an empty one, an empty benchmark finds nothing.  Columns of `docs` with the new names are
    replaced; all others come through unchanged.
    """
    (key,) = own("key")
    columns = [c for c in docs.columns if c.lower() not in ("contaminated", "n_items", "items")]
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text)).alias("item_words")).filter(F.size("item_words") >= SHORTEST)
    items = items.groupBy("item_words").agg(F.min("item").alias("item"))
    items = written(items.select("item", "item_words", F.monotonically_increasing_id().alias("n")))
    sought = written(seeds(items, "n", "item_words").select("seed", "n", F.col("at").alias("item_at")))
    if sought.count() <= broadcast_rows:
        sought = F.broadcast(sought)
    keyed = docs.select(row_key(docs, id_col, text_col).alias(key), words_of(F.col(text_col)).alias("words"))
    hits = seeds(keyed, key, "words").join(sought, "seed").select(key, "n", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = written(hits)

    pairs = matched(keyed, hits.join(items, "n"), key)
    start = F.greatest(F.lit(0), -F.col("shift"))
    common = F.least(F.size("item_words"), F.size("words") - F.col("shift")) - start
    same = F.zip_with(F.slice("words", start + F.col("shift") + 1, common), F.slice("item_words", start + 1, common), lambda a, b: (a == b).cast("int"))
    length = F.least(F.size("item_words"), F.lit(SPAN))
    pairs = pairs.withColumns({"length": length, "common": common}).filter(F.col("common") >= F.col("length")).withColumn("same", same)
    total = F.aggregate(F.slice("same", 1, F.col("length")), F.lit(0), lambda a, x: a + x)
    # the window slides over the overlap with its running count, so that long overlaps take one pass
    slide = F.aggregate(F.sequence(F.lit(1), F.col("common") - F.col("length")),
                        F.struct(total.alias("now"), total.alias("best")),
                        lambda a, i: F.struct((a["now"] + F.element_at("same", i + F.col("length")) - F.element_at("same", i)).alias("now"),
                                              F.greatest(a["best"], a["now"] + F.element_at("same", i + F.col("length")) - F.element_at("same", i)).alias("best")))
    best = F.when(F.col("common") == F.col("length"), total).otherwise(slide["best"])
    found = pairs.filter(best >= F.col("length") - allowed(F.col("length"))).select(key, "n", "item").distinct()
    found = found.groupBy(key).agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], row_key(docs, id_col, text_col).alias(key))
    rows = matched(rows, written(found), key, "left").drop(key)
    return rows.select(*columns, F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                       F.coalesce("items", F.lit("")).alias("items"))
