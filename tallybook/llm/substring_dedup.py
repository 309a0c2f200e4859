"""Substring deduplication: winnowed anchors as seeds, extended both ways to repeats of `window` words and more."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import matched, own, row_key, with_arrays, written
from tallybook.llm.textarrays import grams, octets, runs_of, word_borders, word_hashes

WINDOW = 35
SEED = 10


def anchors(words: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """Anchors of one document.  Each window of words has one: the first of its least seeds, a seed being a run of `seed`
    words.  Equal windows have it at the same place.  Per anchor: hash of its seed, and the first and last start of the
    windows that have it."""
    g = grams(words, seed)
    width = window - seed + 1
    if len(g) < width:
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    at = sliding_window_view(g, width).argmin(axis=1) + np.arange(len(g) - width + 1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return g[at[first]], first, np.r_[first[1:], len(at)] - 1


def _seeds(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                owner, columns = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    b = octets(text)
                    words = word_hashes(b, *word_borders(b))
                    a, first, last = anchors(words, window, seed)
                    if len(a):
                        # the block: all words of the windows that share the anchor; equal blocks have all windows equal
                        block = runs_of(words, first, last + window, 1)
                        owner.append(np.full(len(a), i))
                        columns.append((first, last, a.view(np.int64), block.view(np.int64)))
                if owner:
                    arrays = [pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(owner))), *arrays], ["key", "first", "last", "anchor", "block"])

    return run


def flat(lists: pa.ListArray, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows' borders in, and fields of, the structs of a list column; a null list is empty."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    return np.r_[0, np.cumsum(counts)], [values.field(n).to_numpy(zero_copy_only=False) for n in names]


def _extended(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                border, (first, last, anchor) = flat(part.column(2), "first", "last", "anchor")
                owner, columns = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    mine = slice(border[i], border[i + 1])
                    b = octets(text)
                    words = word_hashes(b, *word_borders(b))
                    many = last[mine] - first[mine] + 1
                    start = np.repeat(first[mine] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                    owner.append(np.full(len(start), i))
                    columns.append((start, np.repeat(anchor[mine], many), runs_of(words, start, start + window, 1).view(np.int64)))
                arrays = [pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(owner))), *arrays], ["key", "start", "anchor", "content"])

    return run


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (key, first, last): the windows that start at words first..last of the row `key` all start elsewhere too.

    Seeds: every anchor of every document, joined on its hash; anchors that occur once go.  Where all occurrences of an
    anchor have the same block, the words of the windows that share it, all its windows are repeats.  Elsewhere the
    occurrences agree over some distance to the left and right only: each window around the anchor is compared by its
    anchor, and the hash of its words.  So no pair of occurrences is ever built, and a passage in a third of all documents
    is one row for each of them.  Hashes have 64 bits for candidates and 128 for what is compared."""
    keyed = docs.select(row_key(docs, id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the seeds are made twice, which costs less than to write and read them
    occ = keyed.mapInArrow(_seeds(window, seed), "key binary, first long, last long, anchor long, block long")
    kinds = occ.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), (F.min("block") == F.max("block")).alias("alike"))
    kinds = written(kinds.filter("n > 1").select("anchor", "alike"))
    seeds = written(matched(occ.drop("block"), kinds, "anchor").select("key", "first", "last", "anchor", "alike"))

    rest = seeds.filter("not alike").groupBy("key").agg(F.collect_set(F.struct("first", "last", "anchor")).alias("spans"))
    # rows with the same key are copies: each counts
    windows = matched(keyed, rest, "key").mapInArrow(_extended(window), "key binary, start long, anchor long, content long")
    windows = written(windows)
    again = written(windows.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "content"))
    found = matched(windows, again, ["anchor", "content"]).select("key", F.col("start").alias("first"), F.col("start").alias("last"))
    return seeds.filter("alike").select("key", "first", "last").unionByName(found)


def _kept(window: int):
    def run(texts: pa.Array, spans: pa.Array) -> dict[str, pa.Array]:
        n_words, n_removed, kept, digest = [], [], [], []
        border, (firsts, lasts) = flat(spans, "first", "last")
        for i, text in enumerate(texts.to_pylist()):
            words = text.encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space
            n_words.append(len(words))
            if border[i + 1] > border[i]:
                first, last = firsts[border[i]:border[i + 1]], lasts[border[i]:border[i + 1]]
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(cover, first, 1)
                np.add.at(cover, last + window, -1)
                words = list(compress(words, (np.cumsum(cover)[:-1] == 0).tolist()))
            n_removed.append(n_words[-1] - len(words))
            left = b" ".join(words)
            kept.append(left.decode("utf-8", "surrogatepass"))
            digest.append(hashlib.sha256(left).hexdigest())
        return {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string()),
                "kept_sha256": pa.array(digest, pa.string())}

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs` with n_words, n_removed, kept_text (the words that stay, joined by one space) and kept_sha256.

    Words are runs without ASCII white space, unchanged.  A word goes if a window of `window` consecutive words covers it
    whose words also start anywhere else, in this or another row; all is judged on the input.  A null text has no words.
    Fewer than `window` words have no window.  Repeated rows are copies of each other.  Rows of any length are read whole;
    only one text and its repeats are in memory at a time.  An empty table gives an empty one.  Columns of `docs` with the
    new names are replaced; all others come through unchanged."""
    new = ("n_words", "n_removed", "kept_text", "kept_sha256")
    (key,) = own("key")
    columns = [c for c in docs.columns if c.lower() not in new]
    spans = repeats(docs, window, seed, id_col, text_col).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("__spans_"))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], row_key(docs, id_col, text_col).alias(key), F.coalesce(F.col(text_col), F.lit("")).alias("__text_"))
    rows = matched(rows, spans.withColumnRenamed("key", key), key, "left").drop(key)
    return with_arrays(rows, _kept(window), ["__text_", "__spans_"], {"n_words": "long", "n_removed": "long", "kept_text": "string", "kept_sha256": "string"})
