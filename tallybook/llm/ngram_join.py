"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import forget, matched, own, with_arrays, written
from tallybook.llm.textarrays import U, grams, mix, octets, runs_of, word_borders, word_hashes

N_WORDS, SIMILARITY, RECALL, DEPTH = 5, 0.8, 0.999, 3
BUCKET, BUCKET_TOKENS, SHARD_TOKENS = 512, 4_000_000, 1_000_000


def runs_for(recall: float, depth: int) -> int:
    """Runs until two sets just over the similarity meet with this probability even in a bucket that is split `depth` times.
    A shared path goes on to one child on average, so it dies out by generation as a Poisson branching process does."""
    dead = 0.0
    for _ in range(depth):
        dead = math.exp(dead - 1)
    return math.ceil(math.log(1 - recall) / math.log(dead))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Hashes of the distinct runs of n words, ascending; of all words if there are fewer; none without words."""
    b = octets(text)
    words = word_hashes(b, *word_borders(b))
    if len(words) == 0:
        return words
    return np.unique(grams(words, n) if len(words) >= n else runs_of(words, np.array([0]), np.array([len(words)])))


def children(tokens: np.ndarray, nodes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of a path, the nodes below them and whose child each is: one for each token whose hash with the node is
    under 1 / (similarity x size), so that sets with a shared token choose it together."""
    limit = U(min(int(min(1.0, 1.0 / (similarity * len(tokens))) * 2.0**64), 2**64 - 1))
    factors = nodes | U(1)
    salts = factors * U(0xD1342543DE82EF95)
    found, parents = [nodes[:0]], [np.empty(0, dtype=np.int64)]
    step = max(1, (1 << 20) // len(tokens))
    for lo in range(0, len(nodes), step):
        h = tokens[None, :] * factors[lo:lo + step, None]
        who, at = np.nonzero(h <= limit)
        found.append(mix(h[who, at] + salts[lo + who]))
        parents.append(lo + who)
    return np.concatenate(found), np.concatenate(parents)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def _paths(n: int, runs: int, similarity: float):
    roots = mix(np.arange(1, runs + 1, dtype=U) * U(0x2545F4914F6CDD1D))
    none = np.empty(0, dtype=U)

    def run(texts: pa.Array) -> dict[str, pa.Array]:
        sets, sizes, one, two, three, of_text, of_one, of_two = [], [], [none], [none], [none], [], [none], [none]
        for text in texts.to_pylist():
            tokens = shingles(text, n)
            sizes.append(len(tokens))
            # a text without words is alike to none, so it gets no set
            sets.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None)
            if len(tokens):
                level, _ = children(tokens, roots, similarity)
                below, parent = children(tokens, level, similarity)
                last, parent_of_last = children(tokens, below, similarity)
                one.append(level)
                two.append(below)
                three.append(last)
                of_one.append(np.bincount(parent, minlength=len(level)))
                of_two.append(np.bincount(parent_of_last, minlength=len(below)))
                of_text.append(len(level))
            else:
                of_text.append(0)
        level, below, last = (pa.array(np.concatenate(x).view(np.int64)) for x in (one, two, three))
        below = pa.StructArray.from_arrays([below, _lists(np.concatenate(of_two), last)], ["node", "kids"])
        level = pa.StructArray.from_arrays([level, _lists(np.concatenate(of_one), below)], ["node", "kids"])
        return {"__set_": pa.array(sets, pa.binary()), "__size_": pa.array(sizes, pa.int64()), "__paths_": _lists(np.array(of_text, dtype=np.int64), level)}

    return run


PATHS = "array<struct<node: long, kids: array<struct<node: long, kids: array<long>>>>>"


def packed(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: enough to tell the tokens of two texts apart."""
    return np.ascontiguousarray(tokens).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.int64).ravel()


def _tokens(n: int):
    def run(texts: pa.Array) -> dict[str, pa.Array]:
        return {"tokens": pa.array([packed(shingles(t, n)) for t in texts.to_pylist()], pa.binary())}

    return run


NOTHING = pd.DataFrame({"sid": [], "links": [], "least": []}).astype("int64")


def compare(node: int, same_block: bool, pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """All pairs of a bucket (or between two of its blocks) at once, by a product of incidence matrices.  A pair that meets
    in several buckets counts in the one with the least number.  Per set: its links, weighted by copies, and the least set
    that it hangs together with."""
    pdf = pdf.sort_values("sid", ignore_index=True)
    m = len(pdf)
    sets = [unpacked(t) for t in pdf["tokens"]]
    sizes = np.array([len(t) for t in sets], dtype=np.int64)
    if m == 2 and not 0.999 * similarity <= len(np.intersect1d(*sets, assume_unique=True)) / max(sizes):
        return NOTHING
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    inter = np.zeros((m, m), dtype=np.float64)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]]
    count = np.diff(np.r_[np.flatnonzero(new), len(tokens)])
    shared = np.repeat(count > 1, count)
    column, owner = np.cumsum(new)[shared], owner[shared]
    column = np.unique(column, return_inverse=True)[1]
    for lo in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        inside = (column >= lo) & (column < lo + 4096)
        matrix = np.zeros((m, 4096), dtype=np.float32)
        matrix[owner[inside], column[inside] - lo] = 1
        inter += matrix @ matrix.T
    union = sizes[:, None] + sizes[None, :] - inter
    block = pdf["block"].to_numpy()
    linked = (inter >= similarity * union - 1e-9) & ~np.eye(m, dtype=bool)
    linked &= (block[:, None] == block[None, :]) if same_block else (block[:, None] != block[None, :])
    if not linked.any():
        return NOTHING
    earlier = [(i, x) for i, nodes in enumerate(pdf["nodes"]) for x in nodes if x < node]
    first = linked
    if earlier:
        names = {x: k for k, x in enumerate({x for _, x in earlier})}
        met = np.zeros((m, len(names)), dtype=np.float32)
        for i, x in earlier:
            met[i, names[x]] = 1
        first = linked & (met @ met.T == 0)
    links = first @ pdf["copies"].to_numpy(dtype=np.int64)
    least = np.arange(m)
    while True:
        lower = np.minimum(least, np.where(linked, least[None, :], m).min(axis=1))
        lower = lower[lower]
        if (lower == least).all():
            break
        least = lower
    sid = pdf["sid"].to_numpy()
    some = linked.any(axis=1)
    return pd.DataFrame({"sid": sid[some], "links": links[some], "least": sid[least][some]})


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every end of the edges (a, b): the least end that it hangs together with, by alternating large and
    small stars, each round a written table."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("w").alias("v"), F.col("v").alias("w")))
        least = written(both.groupBy("v").agg(F.min("w").alias("m")).withColumn("m", F.least("m", "v")))
        edges = matched(both.filter("w > v"), least, "v").select(F.col("w").alias("v"), F.col("m").alias("w")).distinct()
        edges = written(edges)
        least = written(edges.groupBy("v").agg(F.min("w").alias("m")))
        edges = matched(edges, least, "v").select(F.when(F.col("w") == F.col("m"), F.col("v")).otherwise(F.col("w")).alias("v"), F.col("m").alias("w")).filter("v <> w").distinct()
        edges = written(edges)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("v", "w"))).first()
        if now == state:
            return edges.select("v", F.col("w").alias("root")).unionByName(edges.select(F.col("w").alias("v"), F.col("w").alias("root")).distinct())
        state = now


def near_duplicates(docs: DataFrame, n_words: int = N_WORDS, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id",
                    text_col: str = "text", bucket: int = BUCKET, bucket_tokens: int = BUCKET_TOKENS) -> DataFrame:
    """Every row of `docs` with class_id, n_links and kept.

    Two rows are linked when the Jaccard similarity of their sets of runs of `n_words` words is `similarity` or more;
    n_links counts the rows that a row is linked to, class_id is the smallest id among all rows that hang together by
    links, and one row of each class, of the smallest id, has kept.  A text with fewer words is one run; a text without
    words, or null, is linked to none.  Repeated rows are linked.  Null ids sort above all others.

    Equal sets are one set with a number of copies.  Each set draws `runs_for(recall, DEPTH)` random paths: it chooses,
    by a hash under a bound, tokens of its own, and sets that chose the same token share a bucket.  A bucket over `bucket`
    sets or `bucket_tokens` tokens is split by the next tokens on the paths; one with a single set goes.  Buckets with the
    same members are compared once.  What is still too large at DEPTH is a dense group of alike texts: it is dealt into
    blocks, and each pair of blocks is a task of bounded size.  Comparing gives sums and one edge per set, never a row
    per pair; the work inside such a dense group still grows with the square of its different texts, as exact links do.
    Links may be missed with the probability 1 - recall at the bound, far less above it or in small buckets.

    An empty table gives an empty one.  Columns of `docs` with the new names are replaced; others come through unchanged.
    """
    (rid,) = own("rid")
    columns = [c for c in docs.columns if c.lower() not in ("class_id", "n_links", "kept")]
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col(text_col), F.lit("")).alias("__text_"))
    rows = with_arrays(rows, _paths(n_words, runs_for(recall, DEPTH), similarity), ["__text_"], {"__set_": "binary", "__size_": "long", "__paths_": PATHS})
    rows = written(rows.withColumn(rid, F.monotonically_increasing_id()))

    row = F.col(rid)
    sets = rows.filter("__set_ is not null").groupBy("__set_").agg(F.min(rid).alias("sid"), F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("low"),
                                                                    F.coalesce(F.min_by(row, F.col(id_col)), F.min(rid)).alias("low_rid"))
    sets = written(sets)
    drawn = matched(rows.select(rid, "__size_", "__paths_"), sets.select(F.col("sid").alias(rid), "copies"), rid).withColumnRenamed(rid, "sid")

    blocks = F.greatest(F.ceil(F.col("n") / bucket), F.ceil(F.col("tokens") / bucket_tokens)).cast("int")
    level, met, kinds, done = drawn.select("sid", F.col("__size_").alias("size"), F.inline("__paths_").alias("node", "kids")), [], [], []
    for depth in range(1, DEPTH + 1):
        groups = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens"), F.bit_xor(F.xxhash64("sid")).alias("members"),
                                           F.min("size").alias("least"), F.max("size").alias("most"))
        # two sets of too different sizes cannot be alike
        groups = written(groups.filter((F.col("n") > 1) & ((F.col("n") > 2) | (F.col("least") >= similarity * F.col("most")))).select("node", "n", "members", blocks.alias("blocks")))
        level = written(matched(level, groups.select("node", "blocks"), "node"))
        done += [groups, level]
        ends = F.col("blocks") == 1 if depth < DEPTH else F.lit(True)
        met.append(level.filter(ends).select("sid", "size", "node", "blocks"))
        kinds.append(groups.filter(ends))
        if depth + 1 < DEPTH:
            level = level.filter(~ends).select("sid", "size", F.inline("kids").alias("node", "kids"))
        elif depth < DEPTH:
            level = level.filter(~ends).select("sid", "size", F.explode("kids").alias("node"))
    once = written(reduce(DataFrame.unionByName, kinds).groupBy("n", "members").agg(F.min("node").alias("node")).select("node"))
    met = written(matched(reduce(DataFrame.unionByName, met), once, "node"))
    forget(*done, once)
    # buckets are compared some at a time, about as many tokens in each shard
    shards = 1 + (met.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0) // SHARD_TOKENS

    # the sets of those that share a bucket are made anew from their texts, each once
    wanted = met.groupBy("sid").agg(F.collect_list(F.struct("node", "blocks")).alias("at"))
    wanted = matched(wanted, sets.select("sid", "copies"), "sid").withColumnRenamed("sid", rid)
    texts = matched(rows.select(rid, F.col(f"`{text_col}`").alias("text")), wanted, rid).select(F.col(rid).alias("sid"), "copies", "at", "text")
    full = with_arrays(texts, _tokens(n_words), ["text"], {"tokens": "binary"})
    full = full.select("sid", "copies", "tokens", F.col("at.node").alias("nodes"), F.inline("at").alias("node", "blocks"))
    full = full.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select("sid", "copies", "tokens", "nodes", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    full = full.withColumn("shard", F.pmod(F.xxhash64("node", "lo", "hi"), F.lit(shards)))

    def job(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [compare(int(key[0]), key[1] == key[2], part, similarity) for key, part in pdf.groupby(["node", "lo", "hi"], sort=False) if len(part) > 1]
        return pd.concat([NOTHING, *parts], ignore_index=True)

    found = written(full.groupBy("shard").applyInPandas(job, "sid long, links long, least long"))
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("sid").alias("a"), F.col("least").alias("b"))).withColumnRenamed("v", "sid")
    known = written(matched(matched(sets, links, "sid", "left"), roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")))
    lows = known.groupBy("root").agg(F.min("low").alias("class_id"), F.coalesce(F.min_by("low_rid", "low"), F.min("low_rid")).alias("stays"))
    known = written(matched(known, lows, "root").select("__set_", "class_id", "stays", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    out = matched(rows.drop("__paths_", "__size_"), known, "__set_", "left")
    alone = F.col("__set_").isNull()
    return out.select(*columns, F.when(alone, F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      (alone | (F.col("stays") == row)).alias("kept"))
