"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import with_arrays
from tallybook.llm.samples import drawn_shares, labelled_sample, prior_shift
from tallybook.llm.textarrays import grams, octets, word_borders, word_hashes

PER_LABEL = 5000
FEATURES = 18
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = True


def statistics(text: str | None) -> np.ndarray:
    """FEATURES numbers of a whole text; all finite, also for an empty one."""
    b = octets(text)
    starts, ends = word_borders(b)
    count = np.bincount(b, minlength=256)
    n, w = max(len(b), 1), max(len(starts), 1)
    letters = max(int(count[_LETTER].sum()), 1)
    words = word_hashes(b, starts, ends)
    _, often = np.unique(words, return_counts=True)
    three = grams(words, 3)
    first, last = (b[starts], b[ends - 1]) if len(starts) else (b[:0], b[:0])
    lines = int(count[10]) + 1
    p = often / w
    return np.array([
        np.log1p(len(b)), np.log1p(len(starts)), (ends - starts).sum() / w, count[_LETTER].sum() / n, count[65:91].sum() / letters, count[48:58].sum() / n,
        count[_SYMBOL].sum() / n, count[_SYMBOL & ~_PLAIN].sum() / n, count[33] / w, count[124] / w, count[[44, 46]].sum() / w, lines / w,
        len(often) / w, len(np.unique(three)) / max(len(three), 1), -(p * np.log(p)).sum() / np.log(w + 1), _SYMBOL[last].mean() if len(last) else 0.0,
        (~_LETTER[first]).mean() if len(first) else 0.0, (often.max() / w) if len(often) else 0.0,
    ], dtype=np.float64)


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth as arrays: node i goes on to 2i + 1, or to 2i + 2 if the feature is over the border."""

    feature: np.ndarray  # trees x (2**depth - 1)
    border: np.ndarray
    leaf: np.ndarray  # trees x 2**depth
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        tree = np.arange(len(self.feature))[None, :]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.border[tree, node])
        return self.start + self.leaf[tree, node - (2**depth - 1)].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 5) -> Trees:
    """Logistic boosting on histograms of `bins` quantile bins.  Without both labels it says 0.5, or the one label's share."""
    share = np.clip((y.sum() + 1) / (len(y) + 2), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, 2**depth - 1), dtype=np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), start)
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(borders)], axis=1)
    raw = np.full(len(y), start)
    features, cuts, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), dtype=np.int64)
        feature, cut = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, np.inf)
        for d in range(depth):
            base, wide = 2**d - 1, 2**d
            at = node - base
            best, gain = [(0, np.inf, 0)] * wide, np.full(wide, 1e-9)
            for f in range(x.shape[1]):
                size = len(borders[f]) + 1
                if size == 1:
                    continue
                place = at * size + binned[:, f]
                gs, hs, ns = (np.bincount(place, weights=v, minlength=wide * size).reshape(wide, size).cumsum(axis=1) for v in (g, h, None))
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gs, hs, ns = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                won = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                won = np.where((ns >= least) & (nt - ns >= least), won, 0)
                k = won.argmax(axis=1)
                for i in np.flatnonzero(won[np.arange(wide), k] > gain):
                    gain[i] = won[i, k[i]]
                    best[i] = (f, borders[f][k[i]], int(k[i]))
            over = np.zeros(len(y), dtype=bool)
            for i, (f, border, k) in enumerate(best):
                feature[base + i], cut[base + i] = f, border
                mine = at == i
                over[mine] = binned[mine, f] > k if np.isfinite(border) else False
            node = 2 * node + 1 + over
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, weights=g, minlength=2**depth) / (np.bincount(at, weights=h, minlength=2**depth) + ridge)
        raw = raw + leaf[at]
        features.append(feature)
        cuts.append(cut)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(cuts), np.array(leaves), start)


def _measured(texts: pa.Array) -> dict[str, pa.Array]:
    return {"x": pa.array([statistics(t) for t in texts.to_pylist()], pa.list_(pa.float64()))}


def fit_quality(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees fitted on `per_label` labelled rows at most of each label.  Only their statistics come to the driver.  The
    start value then takes back what the cut did to the share of label 1, so that scores do not move with table size."""
    sample = with_arrays(labelled_sample(docs, labels, label, usable, per_label, id_col, text_col), _measured, ["text"], {"x": "array<double>"})
    got = sample.select("id", "label", "x").toPandas().sort_values(["id", "label"])
    x = np.array(got["x"].to_list(), dtype=np.float64).reshape(len(got), FEATURES)
    trees = boost(x, got["label"].to_numpy(dtype=np.float64))
    return replace(trees, start=trees.start + prior_shift(drawn_shares(labels, label, usable, per_label, id_col)))


def score_quality(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with score, the probability of label 1, and predicted.

    Scores come from statistics of the whole text alone, of any length, so equal texts, repeated rows included, have equal
    scores; null is an empty text, which has a score too.  A score of exactly 0.5 is predicted 1.  The trees go along as small
    arrays.  An empty table gives an empty one; columns named score or predicted are replaced, all others come through."""
    columns = [c for c in docs.columns if c.lower() not in ("score", "predicted")]

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        rows = [statistics(t) for t in texts.to_pylist()]
        p = trees.probability(np.array(rows).reshape(len(rows), FEATURES)) if rows else np.empty(0)
        return {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32))}

    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("__text_"))
    return with_arrays(rows, work, ["__text_"], {"score": "double", "predicted": "int"})
