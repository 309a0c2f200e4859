"""Quality rules by target ratio, whitening and importance resampling against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import resampling, target_ratio, whitening

LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(20_000))
TEXTS = [
    (1, "The quick brown fox, the quick brown fox; Ünïcode wörd 42 the end " * 6), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, "| a | b\n| a | b\nc # $ %\n" * 12),
    (7, " ".join(f"good{i}" for i in range(60))), (8, " ".join(f"good{i}" for i in range(1, 61))), (8, " ".join(f"good{i}" for i in range(1, 61))),
    (None, " ".join(f"good{i % 30} other{i}" for i in range(40))), (9, " ".join(f"good{i}" for i in range(55))), (10, "a b c a b c"), (11, "\x0b\x1fx\x85y z " * 30),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "kept", 1.5, "n") for i, t in TEXTS], "doc_id long, text string, kept string, score double, n_words string")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_joined_crc():
    pairs = [(b"", b""), (b"a", b"bc"), (b"longer text", b" "), (b"x" * 300, b"y" * 1000), (b"q", "wörd".encode())]
    first, second, length = (np.array(x) for x in zip(*[(zlib.crc32(a), zlib.crc32(b), len(b)) for a, b in pairs], strict=True))
    got = resampling.joined_crc(first.astype(np.uint32), second.astype(np.uint32), length)
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, docs, longest):
    target = spark.createDataFrame([("good1 good2 the end",), (None,), ("",)], "text string")
    features = []
    for text in [t for _, t in TEXTS] + ["good1 good2 the end"]:
        w = words_of(text)
        features.append([zlib.crc32(" ".join(w[i:i + k]).encode()) % 500 for k in range(1, longest + 1) for i in range(len(w) - k + 1)])
    s, t = Counter(b for f in features[:-1] for b in f), Counter(features[-1])
    S, T = sum(s.values()), sum(t.values())
    want = []
    for (i, text), f in zip(TEXTS, features, strict=False):
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + 500) / ((s[b] + 1) * (T + 500)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    order = sorted((w for w in want if w[4] >= 20), key=lambda w: (-w[3], math.inf if w[0] is None else w[0]))
    drawn = len(order) * 40 // 100
    got = resampling.importance_resample(docs, target, longest=longest, buckets=500, percent=40, keep_text=False)
    assert got.columns == ["doc_id", "kept", "n_words", "n_features", "weight", "score", "rank"]
    rows = got.collect()
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score) for r in rows) == sorted((str(w[0]), *w[1:4]) for w in want)
    assert [(r.doc_id, r.score) for r in sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])] == [(w[0], w[3]) for w in order[:drawn]]
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, drawn + 1)) and {(r.kept, r.n_words) for r in rows} == {("kept", "n")}
    assert "text" in resampling.importance_resample(docs, target).columns
    assert resampling.importance_resample(docs.limit(0), target).count() == 0
    assert resampling.importance_resample(docs, target.limit(0)).count() == len(TEXTS)


def plain_ratio(buckets, lost, good):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in TEXTS]
    feats = []
    for w in tokens:
        c = [zlib.crc32(x.encode()) for x in w]
        feats.append(Counter([x % buckets for x in c] + [(a * target_ratio.PAIR + b) % buckets for a, b in zip(c, c[1:], strict=False)]))
    raw = sum(feats, Counter())
    target = sum((f for (i, _), f in zip(TEXTS, feats, strict=True) if i in good), Counter())
    S, T, out = sum(raw.values()), sum(target.values()), []
    for (i, text), w, f in zip(TEXTS, tokens, feats, strict=True):
        text, n, g = text or "", sum(f.values()), i in good
        three = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        often = Counter(three)
        again = {k + j for k, x in enumerate(three) if often[x] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        total = sum(k * math.floor(1000 * math.log((target[b] - g * k + 1) * (S - n + buckets) / ((raw[b] - k + 1) * (T - g * n + buckets)))) for b, k in f.items())
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        out.append([i, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), failed, total // n if n else None])
    kept = sorted(r[7] for r in out if r[0] in good and not r[6])
    limit = kept[math.floor(len(kept) * lost)] if kept else None
    return sorted((str(r[0]), *r[1:], not r[6] and (limit is None or r[7] >= limit)) for r in out)


@pytest.mark.parametrize(("lost", "good"), [(0.0, {7, 8, 9}), (0.4, {7, 8, 9, 5}), (0.0, set())])
def test_target_ratio(spark, docs, lost, good):
    rows = [(i, 1) for i in good] + [(1, 0), (1, 1), (None, 1), (99, 1), (10, None)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = target_ratio.target_ratio_filter(docs, labels, lost=lost, buckets=4096)
    assert got.columns == ["doc_id", "score", *target_ratio.NEW]
    want = plain_ratio(4096, lost, good)
    assert sorted((str(r.doc_id), *[r[c] for c in target_ratio.NEW]) for r in got.collect()) == want
    assert target_ratio.target_ratio_filter(docs.limit(0), labels).count() == 0


def test_target_ratio_on_labels(spark):
    # judged against labels that it does not use: of the documents called bad
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = target_ratio.target_ratio_filter(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), labels).join(labels, "doc_id").filter("not base_failed")
    shares = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert shares[1] > 0.99 and shares[0] < 0.1


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, label int")


def test_whitening(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 12)) @ np.diag(np.linspace(0.2, 3, 12))
    rows = [(i, [float(np.float32(c)) for c in v], "n", i % 3) for i, v in enumerate(x)] + [(0, [float(np.float32(c)) for c in x[0]], "n", 0)]
    bad = [(900, None, "n", 1), (901, [1.0] * 11 + [None], "n", 1), (902, [float("nan")] * 12, "n", 1), (903, [float("inf")] * 12, "n", 1), (904, [1.0] * 5, "n", 1), (905, [], "n", 1)]
    got = whitening.whiten(vectors(spark, rows + bad))
    assert got.columns == ["vec_id", "label", *whitening.NEW]
    steps = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v, *_ in rows], dtype=object)
    n, S = len(steps), steps.sum(axis=0)
    centred = steps.astype(float) - S.astype(float) / n
    value, basis = np.linalg.eigh(centred.T @ centred / n)
    white = (centred @ basis[:, ::-1][:, :8]) / np.sqrt(value[::-1][:8])
    deviation = ((n * steps - S) ** 2).sum(axis=1)
    out = got.collect()
    assert len(out) == 8 * n and {r.n for r in out} == {n} and {r.vec_id for r in out} == set(range(300))
    for k in range(1, 9):
        mine = {r.vec_id: r for r in out if r.component == k}
        sign = math.copysign(1, mine[0].whitened * white[0, k - 1])
        assert all(mine[i].whitened * sign == pytest.approx(white[i, k - 1], abs=1e-9) and mine[i].deviation == deviation[i] for i in range(300))
        assert mine[0].explained == pytest.approx(value[::-1][k - 1] / value.sum(), rel=1e-10)
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-10
    assert whitening.whiten(vectors(spark, bad[:4])).count() == 0 and whitening.whiten(vectors(spark, rows).limit(0)).count() == 0
    # equal vectors have no component; two different ones have one
    assert whitening.whiten(vectors(spark, [rows[0], rows[0]])).count() == 0
    assert sorted(abs(r.whitened) for r in whitening.whiten(vectors(spark, rows[:2])).collect()) == pytest.approx([1, 1])
    # entries whose squares leave a float's whole numbers stay exact
    wide = [(i, [1e9 * c, -2e9 + c], "n", 0) for i, c in enumerate([0.0, 1.0, 0.5])]
    steps = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v, *_ in wide]
    want = [sum((3 * v[d] - sum(u[d] for u in steps)) ** 2 for d in (0, 1)) for v in steps]
    assert {r.vec_id: r.deviation for r in whitening.whiten(vectors(spark, wide)).collect()} == {i: w if w < 2**63 else None for i, w in enumerate(want)}


@pytest.mark.parametrize("values", [[5] * 3 + [4] * 7 + [1] * 10, [3] * 20, [9, 8, 7] + [0] * 17, [1 + k * 1e-9 for k in range(20)], list(range(20))])
def test_components(values):
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((20, 20)))
    v = (q * np.array(values, dtype=float)) @ q.T
    v = (v + v.T) / 2
    value, basis = whitening.leading_components(v, 8)
    want = [x for x in sorted(values, reverse=True)[:8] if x > 0]
    assert value == pytest.approx(want, rel=1e-12) and np.abs(basis.T @ basis - np.eye(len(want))).max() < 1e-12
    assert np.abs(v @ basis - basis * value).max() < 1e-12 * max(values)
    for shift in (-1, 0.5, 1.5, 4.5, 100):
        assert whitening.above(v, shift) == sum(x > shift for x in values)
