"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import with_arrays, written
from tallybook.llm.samples import drawn_shares, labelled_sample, prior_shift
from tallybook.llm.textarrays import U, byte_values, octets, run_hasher

PER_LABEL, MAX_TOKENS = 1500, 800_000
SLOTS = 1 << 17
#: A token's features: itself, and its first bytes where it has more; 0 stands for none.
HEADS = (4, 5, 6, 7, 8)
FEATURES = 1 + len(HEADS)
SEGMENT = 256
STRETCH = 128
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, dtype=np.int8)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = 1


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, token starts and ends, and the table places of each token's FEATURES.  Tokens are runs of letters and digits, in
    lower case."""
    b = octets(text)
    step = np.diff(np.concatenate(([0], _INSIDE[b], [0])))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    run = run_hasher(byte_values(_LOWER[b]))
    h = np.zeros((len(starts), FEATURES), dtype=U)
    h[:, 0] = run(starts, ends) | U(1)
    for i, k in enumerate(HEADS, 1):
        longer = ends - starts > k
        h[longer, i] = (run(starts[longer], starts[longer] + k) ^ U(0xA5A5 << 8 * i)) | U(1)
    return b, starts, ends, slots_of(h)


def slots_of(h: np.ndarray) -> np.ndarray:
    """Table places of features; the first is kept free for those that are not there."""
    return np.where(h == 0, 0, 1 + (h >> U(8)) % U(SLOTS - 1)).astype(np.int32)


@dataclass(frozen=True)
class Field:
    """States 0 (plain) and 1 (toxic); all weights are log odds of state 1.  `own`, `before` and `after` are hashed tables
    for the features of the token and for the neighbouring tokens; `turn` holds transition scores; `fold` maps marginals to a document's log odds."""

    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    bias: float
    turn: np.ndarray
    fold: np.ndarray

    def emissions(self, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of a stream of documents; starts: where each begins.  Neighbours are of the same document only."""
        e = self.bias + self.own[slots[:, 0]]
        for i in range(1, FEATURES):
            e += self.own[slots[:, i]]
        slots = slots[:, 0]
        if len(slots) > 1:
            inner = np.ones(len(slots), dtype=bool)
            inner[starts[starts < len(slots)]] = False
            e[1:] += np.where(inner[1:], self.before[slots[:-1]], 0)
            e[:-1] += np.where(inner[1:], self.after[slots[1:]], 0)
        return e

    def marginals(self, e: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log odds of state 1 for each token of a stream.  The forward message is the log odds carried over from the left.
        What a message still knows of tokens further back shrinks by a fixed rate a token, so the stream is cut into equal
        segments that run side by side, each warmed up on the tokens before it until the rest is under 1e-9."""
        n = len(e)
        if n == 0:
            return e
        t = self.turn
        rate = np.tanh(abs(t[1, 1] + t[0, 0] - t[0, 1] - t[1, 0]) / 4)
        warm = int(np.ceil(np.log(1e-10) / np.log(max(rate, 1e-3)))) if rate > 0 else 1
        begin = np.zeros(n, dtype=bool)
        begin[starts[starts < n]] = True
        finish = np.r_[begin[1:], True]
        left = self._messages(e, begin, warm, t[0, 0], t[0, 1], t[1, 0], t[1, 1])
        right = self._messages(e[::-1], finish[::-1], warm, t[0, 0], t[1, 0], t[0, 1], t[1, 1])[::-1]
        return e + left + right

    @staticmethod
    def _messages(e: np.ndarray, begin: np.ndarray, warm: int, stay0: float, up: float, down: float, stay1: float) -> np.ndarray:
        n = len(e)
        count = -(-n // SEGMENT)
        first = np.arange(count) * SEGMENT
        out = np.zeros(count * SEGMENT)
        carried = np.zeros(count)
        for k in range(-warm, SEGMENT):
            at = first + k
            inside = (at > 0) & (at < n)
            here = np.where(inside, at, 0)
            seen = carried + np.where(inside, e[here - 1], 0)
            message = np.logaddexp(up, seen + stay1) - np.logaddexp(stay0, seen + down)
            carried = np.where(inside & ~begin[here], message, 0.0)
            if k >= 0:
                out[at] = carried
        return out[:n]


#: Folds marginals where nothing was learnt.
PLAIN = np.array([-4.0, 0.0, 0.0])


def _gradient(field: Field, slots: np.ndarray, gold: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of sequences of one length (rows): gold minus marginal for each token, and for transitions,
    each as often as `counts` says of the (right) token."""
    e = np.full(slots.shape[:2], field.bias)
    for i in range(FEATURES):
        e += field.own[slots[:, :, i]]
    slots = slots[:, :, 0]
    m, n = slots.shape
    e[:, 1:] += field.before[slots[:, :-1]]
    e[:, :-1] += field.after[slots[:, 1:]]
    psi = np.exp(field.turn)
    up = np.stack([np.ones_like(e), np.exp(np.clip(e, -40, 40))], axis=2)
    alpha, beta = np.empty((m, n, 2)), np.ones((m, n, 2))
    a = up[:, 0]
    for k in range(n):
        if k:
            a = (alpha[:, k - 1] @ psi) * up[:, k]
        alpha[:, k] = a / a.sum(axis=1, keepdims=True)
    for k in range(n - 2, -1, -1):
        b = (up[:, k + 1] * beta[:, k + 1]) @ psi.T
        beta[:, k] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    marginal = both[:, :, 1] / both.sum(axis=2)
    right = up[:, 1:] * beta[:, 1:]
    each = counts[:, 1:] / ((alpha[:, :-1] @ psi) * right).sum(axis=2)
    pair = np.array([[(alpha[:, :-1, i] * psi[i, j] * right[:, :, j] * each).sum() for j in (0, 1)] for i in (0, 1)])
    turns = np.bincount((gold[:, :-1] * 2 + gold[:, 1:]).ravel(), weights=counts[:, 1:].ravel(), minlength=4).reshape(2, 2)
    return (gold - marginal) * counts, turns - pair


def toxic_features(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, certain: float = 1.5) -> np.ndarray:
    """Token labels from document labels: a table of the features whose log odds of standing in a toxic document are over
    `certain`, less two standard errors.  toxic, other: how many of the documents of each label have a feature."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    table = odds - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)) > certain
    table[0] = False
    return table


def _mixed(seed: int, count: int) -> np.ndarray:
    """A hash of seed and place for each of `count` places."""
    z = U(seed % 2**64) + np.arange(count, dtype=U) * U(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> U(shift))) * U(factor)
    return z ^ (z >> U(31))


def stretches(slots: np.ndarray, gold: np.ndarray, seed: int, most: int) -> list[np.ndarray]:
    """Stretches of STRETCH tokens of one document to learn from, each as round, place, then rows of FEATURES places and
    gold.  All with a toxic token, and a quarter of the others, which are much alike.  The rounds number either kind in the
    order of a hash, up to `most`: taken round by round, no document has a second stretch before each other has a first."""
    count = -(-len(slots) // STRETCH)
    toxic = np.zeros(count, dtype=bool)
    toxic[np.flatnonzero(gold) // STRETCH] = True
    key = _mixed(seed, count)
    rows = np.c_[slots, gold].astype(np.int32)
    out = []
    for kind in (np.flatnonzero(toxic), np.flatnonzero(~toxic & (key % U(4) == 0))):
        for turn, k in enumerate(kind[np.argsort(key[kind], kind="stable")][:most]):
            out.append(np.r_[np.array([turn, k], dtype=np.int32), rows[k * STRETCH:(k + 1) * STRETCH].ravel()])
    return out


def fit_weights(slots: np.ndarray, gold: np.ndarray, counts: np.ndarray, rounds: int = 40, ridge: float = 1e-4) -> Field:
    """Field of labelled tokens, by gradient steps with a rate for each weight; counts: how many tokens each stands for, one
    on average.  The last row of STRETCH tokens is filled up with tokens that do not count."""
    rows = -(-len(slots) // STRETCH)
    fill = rows * STRETCH - len(slots)
    counts = np.r_[counts, np.zeros(fill)].reshape(rows, STRETCH)
    slots_m = np.r_[slots, np.zeros((fill, FEATURES), dtype=slots.dtype)].reshape(rows, STRETCH, FEATURES)
    gold_m = np.r_[gold, np.zeros(fill, dtype=gold.dtype)].reshape(rows, STRETCH)
    weights = {k: np.zeros(SLOTS) for k in ("own", "before", "after")} | {"bias": np.array(-4.0), "turn": np.zeros((2, 2))}
    sums = {k: np.full_like(v, 1e-8) for k, v in weights.items()}
    for _ in range(rounds):
        diff, turns = _gradient(Field(weights["own"], weights["before"], weights["after"], float(weights["bias"]), weights["turn"], PLAIN), slots_m, gold_m, counts)
        word = slots_m[:, :, 0]
        own = np.zeros(SLOTS)
        for i in range(FEATURES):
            own += np.bincount(slots_m[:, :, i].ravel(), weights=diff.ravel(), minlength=SLOTS)
        own[0] = 0
        step = {"own": own, "before": np.bincount(word[:, :-1].ravel(), weights=diff[:, 1:].ravel(), minlength=SLOTS),
                "after": np.bincount(word[:, 1:].ravel(), weights=diff[:, :-1].ravel(), minlength=SLOTS), "bias": np.array(diff.sum()), "turn": turns}
        for k, g in step.items():
            g = g - ridge * diff.size / 1000 * weights[k] * (k != "bias")
            sums[k] = sums[k] + g * g
            rate = 0.8 if k in ("own", "bias") else 0.15
            weights[k] = weights[k] + rate * g / np.sqrt(sums[k])
        weights["turn"] = np.clip(weights["turn"], -1.0, 1.0)
    return Field(weights["own"], weights["before"], weights["after"], float(weights["bias"]), weights["turn"], PLAIN)


def evidence(field: Field, hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Marginal log odds of all tokens of a stream of documents; per document its largest, and the log of the tokens
    expected to be toxic and one.  A document without tokens has the least evidence."""
    size = np.array([len(h) for h in hashes], dtype=np.int64)
    starts = np.r_[0, np.cumsum(size)[:-1]] if len(size) else size
    slots = np.concatenate(hashes) if size.sum() else np.empty((0, FEATURES), dtype=np.int32)
    odds = field.marginals(field.emissions(slots, starts), starts)
    out = np.tile([-8.0, 0.0], (len(size), 1))
    some = size > 0
    if some.any():
        at = starts[some]
        out[some, 0] = np.clip(np.maximum.reduceat(odds, at), -8, 8)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        out[some, 1] = np.log1p(np.add.reduceat(np.where(p > 0.05, p, 0), at))
    return odds, out


def calibrated(z: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights that turn a document's evidence into its log odds."""
    x = np.c_[np.ones(len(z)), z]
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.1, 0.1])
        w = w + np.linalg.solve(hessian, x.T @ (labels - p) - np.array([0, 0.1, 0.1]) * w)
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_label: int = PER_LABEL, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id",
                 text_col: str = "text") -> Field:
    """Field fitted on `per_label` labelled rows of each label at most.

    Their whole texts say which words are toxic and how marginals become a score; both are worked out on the executors.
    Token weights are learnt on the driver from stretches of `max_tokens` tokens at most, dealt evenly to the documents, so
    that a text of any length neither crowds out others nor is left out.  Rows count by how many usable rows of their label
    they stand for, so that neither spans nor scores move with table size.  Without both labels, or without a word that
    tells them apart, every document scores as plain."""
    sample = written(labelled_sample(docs, labels, label, usable, per_label, id_col, text_col))
    zero = np.zeros(SLOTS)
    plain = Field(zero, zero, zero, -8.0, np.zeros((2, 2)), PLAIN)
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return plain

    def present(texts: pa.Array) -> dict[str, pa.Array]:
        return {"h": pa.array([np.unique(tokens(t)[3]) for t in texts.to_pylist()], pa.list_(pa.int32()))}

    held = with_arrays(sample.select("label", "text"), present, ["text"], {"h": "array<int>"}).select("label", F.explode("h").alias("h"))
    held = held.groupBy("label", "h").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros((2, SLOTS))
    counts[held["label"], held["h"]] = held["n"]
    table = toxic_features(counts[1], counts[0], sizes[1], sizes[0])
    if not table.any():
        return plain
    most = max_tokens // STRETCH
    sent_table = docs.sparkSession.sparkContext.broadcast(table)

    def cut(texts: pa.Array, labels: pa.Array, seeds: pa.Array) -> dict[str, pa.Array]:
        out = []
        for text, value, seed in zip(texts.to_pylist(), labels.to_pylist(), seeds.to_pylist(), strict=True):
            slots = tokens(text)[3]
            out.append(stretches(slots, sent_table.value[slots].any(axis=1) & bool(value), seed, most))
        return {"s": pa.array(out, pa.list_(pa.list_(pa.int32())))}

    seeded = sample.select("id", F.col("label").alias("of"), "label", "text", F.xxhash64("id", F.lit(9)).alias("seed"))
    some = with_arrays(seeded, cut, ["text", "label", "seed"], {"s": "array<array<int>>"}, at_once=64).select("id", "of", F.explode("s").alias("s"))
    got = some.orderBy(F.col("s")[0], F.xxhash64("id", F.lit(9)), "id", "of", F.col("s")[1]).limit(most).toPandas()
    rows = [np.asarray(s, dtype=np.int32) for s in got["s"]]
    order = sorted(range(len(rows)), key=lambda i: (got["id"][i], got["of"][i], rows[i][1]))
    learnt = np.concatenate([rows[i][2:] for i in order] or [np.empty(0, dtype=np.int32)]).reshape(-1, FEATURES + 1)
    if not learnt[:, -1].any():
        raise ValueError(f"no toxic token among {max_tokens} tokens of {sum(sizes.values())} labelled documents")
    shares = drawn_shares(labels, label, usable, per_label, id_col)
    counts = np.repeat([shares[got["of"][i]] for i in order], [(len(rows[i]) - 2) // (FEATURES + 1) for i in order])
    field = fit_weights(learnt[:, :-1], learnt[:, -1].astype(np.int64), counts / counts.mean())
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def weighed(texts: pa.Array) -> dict[str, pa.Array]:
        z = evidence(sent.value, [tokens(t)[3] for t in texts.to_pylist()])[1]
        return {"z": pa.array(list(z), pa.list_(pa.float64()))}

    got = with_arrays(sample, weighed, ["text"], {"z": "array<double>"}).toPandas().sort_values(["id", "label"])
    fold = calibrated(np.array(got["z"].to_list()), got["label"].to_numpy(dtype=np.float64))
    fold[0] += prior_shift(shares)
    return Field(field.own, field.before, field.after, field.bias, field.turn, fold)


def score_toxicity(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with score, predicted, n_spans and spans (start:end of toxic spans in code points, end
    exclusive, comma-joined).

    Whole texts of any length are tagged; touching toxic tokens are one span.  A null or empty text has no span and the least
    score.  Equal texts, repeated rows included, get equal scores and spans; a score of exactly 0.5 is predicted 1.  Token labels
    were made from document labels (see toxic_features), so spans are as good as those.  The field, three tables of SLOTS
    weights, goes to the executors as a broadcast.  An empty table gives an empty one; columns with the new names are
    replaced, all others come through."""
    new = ("score", "predicted", "n_spans", "spans")
    columns = [c for c in docs.columns if c.lower() not in new]
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        field = sent.value
        parts = [tokens(t) for t in texts.to_pylist()]
        odds, z = evidence(field, [p[3] for p in parts])
        score = 1 / (1 + np.exp(-np.clip(field.fold[0] + z @ field.fold[1:], -30, 30)))
        n_spans, spans, done = [], [], 0
        for b, starts, ends, h in parts:
            bad = np.flatnonzero(odds[done:done + len(h)] > 0)
            done += len(h)
            if len(bad):
                new = np.r_[True, bad[1:] != bad[:-1] + 1]
                place = np.r_[0, np.cumsum((b & 0xC0) != 0x80)]
                head, tail = starts[bad[new]], ends[bad[np.r_[new[1:], True]]]
                spans.append(",".join(f"{s}:{e}" for s, e in zip(place[head], place[tail], strict=True)))
                n_spans.append(len(head))
            else:
                spans.append("")
                n_spans.append(0)
        return {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32)), "n_spans": pa.array(n_spans, pa.int64()),
                "spans": pa.array(spans, pa.string())}

    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("__text_"))
    return with_arrays(rows, work, ["__text_"], {"score": "double", "predicted": "int", "n_spans": "long", "spans": "string"})
