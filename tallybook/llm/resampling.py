"""Importance resampling towards a target distribution, over word runs that an Aho-Corasick dictionary reads."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybook.llm.common import own, row_key, table_of_longs, with_arrays, written

#: A-Z to lower case, ASCII that is no letter or digit to a space, every other byte (all parts of wider characters) as it is.
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
NEW = ("n_features", "weight", "score", "rank")


def _byte_tables(columns: list[int]) -> np.ndarray:
    """A linear map of 32-bit values, given by the image of each bit, as four tables of 256 entries."""
    tables = np.zeros((4, 256), dtype=np.uint32)
    for bit, image in enumerate(columns):
        tables[bit // 8, (np.arange(256) >> (bit % 8)) & 1 == 1] ^= np.uint32(image)
    return tables


def _applied(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _zero_maps() -> list[np.ndarray]:
    """For each power of two, what so many zero bytes after a text do to its CRC (without the final inversions)."""
    one = np.array([1 << b for b in range(32)], dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    maps = [_byte_tables([int(x) for x in one])]
    for _ in range(31):
        maps.append(_byte_tables([int(x) for x in _applied(maps[-1], _applied(maps[-1], np.array([1 << b for b in range(32)], dtype=np.uint32)))]))
    return maps


_ZEROS = _zero_maps()


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of each first text followed by the second, from their CRCs and the bytes of the second."""
    out, k = first.astype(np.uint32), 0
    while (length >> k).any():
        out = np.where((length >> k) & 1 == 1, _applied(_ZEROS[k], out), out)
        k += 1
    return out ^ second


class WordDictionary:
    """Aho-Corasick automaton over distinct words between delimiters; each pattern stands for the word's CRC and length."""

    def __init__(self, words: set[bytes]):
        ordered = sorted(words)
        self.crc = np.fromiter(map(zlib.crc32, ordered), dtype=np.uint32, count=len(ordered))
        self.length = np.fromiter(map(len, ordered), dtype=np.int64, count=len(ordered))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(ordered):
            self.automaton.add_word(f" {word.decode('latin-1')} ", i)
        if ordered:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> np.ndarray:
        """Places in the dictionary of the words of a text, in their order.  Neighbours share the delimiter between them."""
        if not len(self.crc):
            return np.empty(0, dtype=np.int64)
        return np.fromiter(map(itemgetter(1), self.automaton.iter(f" {text.decode('latin-1')} ")), dtype=np.int64)


def run_crcs(dictionary: WordDictionary, places: np.ndarray, longest: int) -> list[np.ndarray]:
    """CRC of every run of 1 to `longest` words joined by one space: each run of k is the run of k - 1 before its last word,
    composed with a space and that word."""
    crc, length = dictionary.crc[places], dictionary.length[places]
    runs = [crc]
    if longest > 1:
        spaced = joined_crc(np.full(len(crc), zlib.crc32(b" "), dtype=np.uint32), crc, length)
    for k in range(1, min(longest, len(places))):
        runs.append(joined_crc(runs[-1][:-1], spaced[k:], length[k:] + 1))
    return runs


def bucket_reader(longest: int, buckets: int) -> Callable[[pa.Array], Iterator[tuple[int, np.ndarray]]]:
    """A function from an array of texts to (words, buckets of all features) of each.  Its dictionary holds the distinct words of
    those texts, so memory is bounded by one batch, whatever the vocabulary of the corpus."""

    def read(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        plain = [(t or b"").translate(LOWERED) for t in texts.cast(pa.binary()).to_pylist()]
        words: set[bytes] = set()
        for text in plain:
            words.update(text.split())
        dictionary = WordDictionary(words)
        for text in plain:
            places = dictionary.scan(text)
            yield len(places), np.concatenate(run_crcs(dictionary, places, longest)) % np.uint32(buckets)

    return read


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; each task sums its own before anything is shuffled, so it sends `buckets` rows at most."""
    read = bucket_reader(longest, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                for _, found in read(batch.slice(lo, 4096).column(0)):
                    np.add.at(total, found, 1) if len(found) < 64 else np.add(total, np.bincount(found, minlength=buckets), out=total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: the log ratio of its smoothed shares in target and corpus, in thousandths, rounded down."""
    spark = raw.sparkSession
    sides = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    sides = sides.unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    zero = F.lit(0).cast("long")
    sides = sides.unionByName(spark.range(buckets).select(F.col("id").alias("bucket"), zero.alias("s"), zero.alias("t")))
    # one row per bucket; the totals are sums over those rows
    sides = written(sides.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t")))
    totals = sides.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    ratio = (F.col("t") + 1) * F.lit(totals["S"] + buckets) / ((F.col("s") + 1) * F.lit(totals["T"] + buckets))
    return sides.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def noise(id_text: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, that seed and id fix."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024,
                        id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row of `docs` with n_features, weight, score and rank; rows with a rank are the sample drawn towards `target`.

    Words are runs of letters, digits and characters outside ASCII after lower-casing A-Z; features are all runs of 1 to
    `longest` words, repeats counted, hashed by CRC-32 into `buckets`.  A bucket's gain is the log ratio of its share in the
    target to that in the corpus, both smoothed by one; weight is the sum of a document's gains; score adds Gumbel noise of
    the id, so the highest scores are a sample without replacement by weight.  Of the N documents with `least_words` words
    at least, `percent` of a hundred (rounded down) get ranks from 1 by falling score, ties to the smaller id.

    Texts are read by automata over the distinct words of a batch; no vocabulary of the corpus is built.  Counting and
    scoring are two scans, the gains (`buckets` rows) all that goes to every task.  Ranks come from one range-partitioned
    sort of the scored rows: place within the partition plus the rows of those before it, one row per partition.

    Null and empty texts have no feature: weight 0, a score, no rank.  A null id is drawn for as the empty text and comes
    last among ties.  Repeated rows each count and take ranks side by side.  An empty table gives an empty one; an empty
    target draws by the corpus shares alone.  Columns of `docs` named like a new one are replaced; all others come through
    unchanged, without the text if `keep_text` is false.
    """
    text, tie, words, place = own("text", "tie", "words", "place")
    columns = [c for c in docs.columns if c.lower() not in NEW and (keep_text or c.lower() != text_col.lower())]
    gains_table = bucket_gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_text, longest, buckets), buckets)
    gains = table_of_longs(gains_table, buckets)
    read = bucket_reader(longest, buckets)

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        found = [(n, len(b), int(gains[b].sum())) for n, b in read(texts)]
        return {name: pa.array([f[i] for f in found], pa.int64()) for i, name in enumerate((words, "n_features", "weight"))}

    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], row_key(docs, id_col, text_col).alias(tie), F.col(text_col).alias(text))
    scored = with_arrays(rows, work, [text], {words: "long", "n_features": "long", "weight": "long"}, at_once=4096)
    scored = written(scored.withColumn("score", F.col("weight") + noise(id_text, seed)))

    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col(tie)]
    able = scored.filter(F.col(words) >= least_words).repartitionByRange(*order).sortWithinPartitions(*order)
    able = written(able.withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(place, 33)
    sizes = able.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy()).alias("all"))
    able = able.withColumn("part", part).join(F.broadcast(sizes), "part")  # one row per partition of the sort
    rank = F.col("before") + F.col(place).bitwiseAND((1 << 33) - 1) + 1
    ranked = able.withColumn("rank", F.when(rank <= F.floor(F.col("all") * percent / F.lit(100)), rank))
    out = [*[F.col(f"`{c}`") for c in columns], *[F.col(c) for c in NEW]]
    rest = scored.filter(F.col(words) < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out).unionByName(rest.select(*out))
