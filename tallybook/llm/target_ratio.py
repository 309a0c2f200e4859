"""Quality rules: the log-likelihood ratio of hashed word runs between a trusted target and the raw corpus, beside plain counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybook.llm.common import matched, own, table_of_longs, with_arrays, written

BUCKETS = 65_536
#: Joins the CRCs of two neighbouring words into the number of the pair.
PAIR = 1_000_003
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
SPACE = np.array([9, 10, 11, 12, 13, 32])
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
NEW = (*STATS, "base_failed", "ratio", "kept")


def octets(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def features(words: list[bytes], buckets: int) -> np.ndarray:
    """Buckets of a text's words and of its pairs of neighbours."""
    crc = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words))
    return np.concatenate([crc, crc[:-1] * PAIR + crc[1:]]) % buckets


def repeated_words(words: list[bytes]) -> int:
    """Words inside runs of three that the text has twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    at = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    _, pair = np.unique(at[:-1] * len(known) + at[1:], return_inverse=True)
    _, run, count = np.unique(pair[:-1] * len(known) + at[2:], return_inverse=True, return_counts=True)
    again = count[run] > 1
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def statistics(text: bytes, words: list[bytes]) -> tuple[int, ...]:
    """STATS of a text in UTF-8."""
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    chars = int(count[:128].sum() + count[192:].sum() - count[SPACE].sum())  # bytes that start a character, without white space
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), chars, int(count[SYMBOLS].sum()), len(lines) - len(set(lines)), repeated_words(words)


def feature_counts(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; each task sums its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros(buckets, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                waiting.append(features(octets(text).split(), buckets))
                size += len(waiting[-1])
                if size > 1_000_000:
                    total += np.bincount(np.concatenate(waiting), minlength=buckets)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def ratio(found: np.ndarray, raw: np.ndarray, target: np.ndarray, sizes: tuple[int, int], inside: bool) -> int | None:
    """Mean log ratio of a text's features in thousandths, rounded down, by counts without that text itself."""
    if not len(found):
        return None
    buckets, n = len(raw), len(found)
    used, k = np.unique(found, return_counts=True)
    own_k, own_n = (k, n) if inside else (0, 0)
    if (target[used] < own_k).any():  # the target does not hold this text
        return None
    share = ((target[used] - own_k + 1).astype(np.float64) * float(sizes[0] - n + buckets)) / ((raw[used] - k + 1).astype(np.float64) * float(sizes[1] - own_n + buckets))
    return int((k * np.floor(1000 * np.log(share)).astype(np.int64)).sum()) // n


def trusted_ids(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """Ids that labels call good and never bad, once each."""
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label)).alias("least"))
    return known.filter("least = 1").select("id")


def target_ratio_filter(docs: DataFrame, labels: DataFrame, label: str = "quality", lost: float = 0.002, least_words: int = 50, most_repeated: int = 50,
                        buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of `docs`, without its text, with the counts n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words, base_failed, ratio and kept.

    base_failed: under `least_words` words, or more than `most_repeated` of a hundred words in runs of three that come back.
    ratio: words and pairs of neighbours are hashed into `buckets`; the trusted target is every document that `labels` call
    good, the raw corpus every document; both are multinomials smoothed by one.  A document's log ratio is divided by its
    features and given in thousandths, rounded down.  Counts leave the document itself out, so that a trusted one is judged
    like any other.  kept: base_failed is false and ratio is at least the threshold, the ratio that a share of `lost` of the
    trusted documents that pass the base rules stays under.  The threshold comes from exact counts of all of them.

    Two scans: one counts (each task sends `buckets` rows at most), one scores each document both as trusted and as not;
    labels join its small rows.  Texts of trusted documents meet their labels in a sort-merge join, which moves them once.
    Only counts by bucket (two longs each) go to every task.

    Null and empty texts have zero counts, a null ratio and fail the base rules.  Repeated rows each count.  A null id is
    never trusted.  Without a trusted document the base rules alone decide.  An empty table gives an empty one.  Columns of
    `docs` named like a new one are replaced; all others come through unchanged.
    """
    text, inside, outside, label_id = own("text", "inside", "outside", "label_id")
    columns = [c for c in docs.columns if c.lower() not in NEW and c.lower() != text_col.lower()]
    good = written(trusted_ids(labels, label, id_col))
    of_good = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias(text)).join(good.hint("merge"), "id", "left_semi")
    raw, target = table_of_longs(feature_counts(docs, text_col, buckets), buckets), table_of_longs(feature_counts(of_good, text, buckets), buckets)
    sizes = (int(raw.sum()), int(target.sum()))

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        stats, ratios = [], []
        for t in texts.cast(pa.binary()).to_pylist():
            words = octets(t).split()
            found = features(words, buckets)
            stats.append(statistics(octets(t), words))
            ratios.append((ratio(found, raw, target, sizes, False), ratio(found, raw, target, sizes, True)))
        made = {name: pa.array([s[i] for s in stats], pa.int64()) for i, name in enumerate(STATS)}
        return made | {outside: pa.array([r[0] for r in ratios], pa.int64()), inside: pa.array([r[1] for r in ratios], pa.int64())}

    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias(text))
    scored = with_arrays(rows, work, [text], dict.fromkeys((*STATS, outside, inside), "long"))
    scored = matched(scored, good.select(F.col("id").alias(label_id)), F.col(f"`{id_col}`") == F.col(label_id), "left")
    is_good = F.col(label_id).isNotNull()
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    scored = written(scored.withColumns({"ratio": F.when(is_good, F.col(inside)).otherwise(F.col(outside)), "base_failed": failed, label_id: is_good}))

    # a ratio is an average of thousandths of logarithms of counts: tens of thousands of different values at most
    held = scored.filter(F.col(label_id) & ~F.col("base_failed")).groupBy("ratio").agg(F.count(F.lit(1)).alias("n"))
    up = W.orderBy("ratio").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = held.select("ratio", F.sum("n").over(up).alias("under"), F.sum("n").over(W.partitionBy()).alias("all"))
    limit = held.filter(F.col("under") > F.floor(F.col("all") * lost)).agg(F.min("ratio")).first()[0]
    verdict = F.lit(True) if limit is None else F.col("ratio") >= limit
    return scored.select(*[F.col(f"`{c}`") for c in columns], *STATS, "base_failed", "ratio", F.coalesce(~F.col("base_failed") & verdict, F.lit(False)).alias("kept"))
