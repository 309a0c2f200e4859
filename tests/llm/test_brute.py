"""Queries without SQL against plain loops: marginals, trees, base spans, benchmark passages, pipeline stages."""

from __future__ import annotations

import hashlib
import itertools
import math
import os
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm import common, decontamination, pii, quality, secrets, toxicity
from tallybook.llm.ngram_join import near_duplicates
from tallybook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i * 7919 % 1000}" for i in range(400)]
LONG = " ".join(WORDS[i % 397] + str(i % 11) for i in range(20_000))


def documents(sf=SF):
    return pq.read_table(f"{sf}/documents.parquet").to_pydict()


# --- op1: marginals and weights of a chain by enumeration of all taggings

def chain_score(field, e, tags):
    return sum(x for x, y in zip(e, tags, strict=True) if y) + sum(field.turn[a, b] for a, b in itertools.pairwise(tags))


def test_marginals_by_enumeration():
    r = np.random.default_rng(4)
    zero = np.zeros(toxicity.SLOTS)
    field = toxicity.Field(zero, zero, zero, -1.0, r.uniform(-1, 1, (2, 2)), toxicity.PLAIN)
    sizes = [1, 5, 0, 9, 2]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    e = r.normal(0, 2, sum(sizes))
    got = field.marginals(e, starts)
    for s, n in zip(starts, sizes, strict=True):
        weight = {tags: math.exp(chain_score(field, e[s:s + n], tags)) for tags in itertools.product((0, 1), repeat=n)}
        for k in range(n):
            odds = math.log(sum(w for t, w in weight.items() if t[k]) / sum(w for t, w in weight.items() if not t[k]))
            assert got[s + k] == pytest.approx(odds, abs=1e-7)


def test_gradient_by_differences():
    r = np.random.default_rng(5)
    slots = r.integers(1, 40, (3, 5, toxicity.FEATURES)).astype(np.int32)
    gold, counts = r.integers(0, 2, (3, 5)), np.repeat(r.uniform(0.5, 2, (3, 1)), 5, axis=1)
    tables = [np.r_[r.normal(0, 1, 40), np.zeros(toxicity.SLOTS - 40)] for _ in range(3)]
    turn = r.uniform(-1, 1, (2, 2))

    def likelihood(bias, turn):
        field, total = toxicity.Field(*tables, bias, turn, toxicity.PLAIN), 0.0
        for s, g, c in zip(slots, gold, counts, strict=True):
            e = field.emissions(s, np.array([0]))
            all_of_them = [chain_score(field, e, t) for t in itertools.product((0, 1), repeat=5)]
            total += c[0] * (chain_score(field, e, g.tolist()) - math.log(sum(map(math.exp, all_of_them))))
        return total

    diff, turns = toxicity._gradient(toxicity.Field(*tables, -0.3, turn, toxicity.PLAIN), slots, gold, counts)
    assert diff.sum() == pytest.approx((likelihood(-0.3 + 1e-5, turn) - likelihood(-0.3 - 1e-5, turn)) / 2e-5, abs=1e-4)
    for i, j in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = 1e-5
        assert turns[i, j] == pytest.approx((likelihood(-0.3, turn + step) - likelihood(-0.3, turn - step)) / 2e-5, abs=1e-4)


# --- op5: one split and the traversal

def test_split_by_loop():
    r = np.random.default_rng(6)
    x = r.integers(0, 12, (200, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (r.uniform(size=200) < 0.1)).astype(float)
    trees = quality.boost(x, y, trees=1, depth=1, bins=64, rate=1.0, ridge=1.0, least=5)
    p = (y.sum() + 1) / 202
    g, h = y - p, p * (1 - p)
    best = max((((g[x[:, f] <= c].sum()) ** 2 / (h * (x[:, f] <= c).sum() + 1) + (g[x[:, f] > c].sum()) ** 2 / (h * (x[:, f] > c).sum() + 1), f, c)
                for f in range(3) for c in range(12) if 5 <= (x[:, f] <= c).sum() <= 195), key=lambda t: t[0])
    f, border = int(trees.feature[0, 0]), trees.border[0, 0]
    assert f == best[1] == 1 and ((x[:, f] <= border) == (x[:, f] <= best[2])).all()
    for leaf, side in zip(trees.leaf[0], (x[:, f] <= border, x[:, f] > border), strict=True):
        assert leaf == pytest.approx(g[side].sum() / (h * side.sum() + 1))


def test_traversal_by_loop():
    r = np.random.default_rng(7)
    x = r.normal(size=(300, 4))
    trees = quality.boost(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=7, depth=3)

    def walk(row):
        total = trees.start
        for feature, border, leaf in zip(trees.feature, trees.border, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > border[node] else 1)
            total += leaf[node - len(feature)]
        return total

    assert trees.raw(x) == pytest.approx([walk(row) for row in x])


# --- op3 and op6: base columns of the queries by a plain loop over the fixed patterns

def digest(spans, kinds):
    ordered = sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in ordered).encode()).hexdigest()


def plain_secrets(text):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return out + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]


def luhn(said):
    digits = [int(c) for c in said if c in "0123456789"]
    return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_personal(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if luhn(m[0])]
    return out + [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@pytest.mark.parametrize(("name", "plain", "kinds"), [("op3_secrets", plain_secrets, secrets.KINDS), ("op6_pii", plain_personal, pii.KINDS)])
def test_base_columns_of_the_query(spark, name, plain, kinds):
    docs = documents()
    want = {i: plain(t or "") for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    for r in QUERIES[name](spark, SF).collect():
        assert r.base_sha256 == digest(want[r.doc_id], kinds)
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[2] == k for x in want[r.doc_id]) for k in kinds]
        base = {f"{k}:{s}:{e}" for s, e, k in want[r.doc_id]}
        assert base <= set(filter(None, r.spans.split(",")))


def test_changed_personal_data_is_found(spark):
    # base spans written in other ways, in texts that were not learnt from; text outside of them stays free
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    model = pii.train(*pii.training_windows(docs))
    known = docs.filter(F.col("text").rlike("[0-9@]") & pii.held_out(F.xxhash64("text", F.lit(3)))).select("text").distinct()
    rows = [(k, *pii.varied(r.text, 77)) for k, r in enumerate(known.collect())]
    table = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    found = {x.doc_id: [(s.start, s.end, s.kind.removeprefix("lstm_")) for s in x.base + x.added] for x in pii.find_personal_data(table, model).collect()}
    spans = sum(len(g) for _, _, g in rows)
    hit = sum(len(set(g) & set(found[k])) for k, _, g in rows)
    wrong = sum(not any(s < e and b < t for b, e, _ in g) for k, _, g in rows for s, t, _ in found[k])
    assert spans > 80 and hit >= 0.9 * spans and wrong <= 0.1 * spans, (spans, hit, wrong)


ODD = [(1, None, "x"), (2, "", "x"), (3, LONG + " key q9Xf3ZpL0vT7bKc2RwYd8NsH mail a@b.co", "x"), (4, "vile scum a@b.co", "x"), (4, "vile scum a@b.co", "x"), (None, "+1 414 555 01377", "x")]


def test_odd_rows_of_scorers(spark):
    names = ["score", "predicted", "base", "added", "n_spans", "spans", "contaminated", "items", "n_items", "class_id", "n_links", "n_words"]
    docs = spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t, _ in ODD], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(4, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs2 = docs.select("doc_id", "text")
    field = toxicity.fit_toxicity(docs2, labels, "toxic", F.lit(True))
    trees = quality.fit_quality(docs2, labels, "quality", F.lit(True))
    bench = spark.createDataFrame([(1, " ".join(LONG.split()[50:80]))], "item_id long, text string")
    made = [(toxicity.score_toxicity(docs, field), {"score", "predicted", "n_spans", "spans"}), (quality.score_quality(docs, trees), {"score", "predicted"}),
            (secrets.scan_secrets(docs), {"base", "added"}), (pii.find_personal_data(docs, None), {"base", "added"}),
            (decontamination.contaminated(docs, bench), {"contaminated", "items", "n_items"}), (near_duplicates(docs), {"class_id", "n_links", "kept"})]
    for df, new in made:
        assert set(df.columns) == {"doc_id", *(set() if "text" not in df.columns else {"text"}), *names, *new}
        rows = df.collect()
        assert len(rows) == len(ODD) and all(r[n] == "x" for r in rows for n in set(names) - new)
        twice = [tuple(r[c] for c in sorted(new - {"kept"})) for r in rows if r.doc_id == 4]
        assert twice[0] == twice[1]
    by = {r.doc_id: r for r in made[2][0].collect()}
    assert by[1].base == by[2].base == by[2].added == [] and [LONG.__len__() + 5] == [s.start for s in by[3].added]
    by = {r.doc_id: r for r in made[3][0].collect()}
    assert by[1].base == [] and [x.kind for x in by[3].base] == ["email"] and [x.kind for x in by[None].base] == ["phone"]
    assert {r.doc_id: r.contaminated for r in made[4][0].collect()} == {1: False, 2: False, 3: True, 4: False, None: False}
    scores = {r.doc_id: r.score for r in made[0][0].collect()}
    assert scores[1] == scores[2] < 0.5 and all(0 <= s <= 1 for s in scores.values())


# --- op10: every alignment of every item by loops

def plain_contaminated(docs, items):
    split = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    items = {tuple(split(t)): None for t in items}
    number: dict = {}
    number_of = lambda ws: np.array([number.setdefault(w, len(number)) for w in ws], dtype=np.int64)
    rows = [number_of(split(t)) for t in docs]
    out = [False] * len(rows)
    for item in items:
        if len(item) < 8:
            continue
        m, need = number_of(item), min(len(item), 20)
        most = 4 if need >= 20 else 2 if need >= 13 else 0
        for k, d in enumerate(rows):
            for shift in range(need - len(m), len(d) - need + 1):
                lo, hi = max(0, -shift), min(len(m), len(d) - shift)
                same = np.r_[0, np.cumsum(d[lo + shift:hi + shift] == m[lo:hi])]
                if hi - lo >= need and (same[need:] - same[:-need]).max() >= need - most:
                    out[k] = True
                    break
    return out


def test_benchmark_query_by_loops(spark, tmp_path):
    r = random.Random(9)
    items = [" ".join(r.choices(WORDS, k=k)) for k in (7, 8, 12, 13, 19, 20, 25, 40)]
    docs = []
    for i in range(160):
        words = items[i % 8].split()
        a = r.randrange(0, max(1, len(words) - 21)) if i % 3 == 0 else 0
        part = words[a:a + 20 + i % 4] if i % 3 == 0 else words
        for _ in range(i // 8 % 7):
            part[r.randrange(len(part))] = "zz"
        docs.append(" ".join(r.choices(WORDS, k=r.randrange(30))) + ", " + " ".join(part).title() + ". " + " ".join(r.choices(WORDS, k=r.randrange(30))))
    docs += [None, "", LONG, docs[0]]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x.contaminated for x in QUERIES["op10_decontamination"](spark, str(tmp_path)).collect()}
    want = plain_contaminated(docs, items)
    assert [got[i] for i in range(len(docs))] == want and 40 < sum(want) < 140


# --- op2: a dense group over the size of a bucket

def test_dense_group(spark):
    base = [f"b{i}" for i in range(160)]
    r = random.Random(10)
    rows = [(k, " ".join(w if r.random() > 0.02 else f"n{r.randrange(50)}" for w in base)) for k in range(700)] + [(1000 + k, " ".join(r.choices(WORDS, k=120))) for k in range(400)]
    got = {x.doc_id: x.n_links for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    names = {x: i for i, x in enumerate(set().union(*sets))}
    hold = np.zeros((len(rows), len(names)), dtype=np.float32)
    for k, s in enumerate(sets):
        hold[k, [names[x] for x in s]] = 1
    shared = hold @ hold.T
    size = hold.sum(axis=1)
    links = (shared >= 0.8 * (size[:, None] + size[None, :] - shared) - 1e-6).sum(axis=1) - 1
    found, true = sum(got.values()), int(links.sum())
    assert true > 2000 and found <= true and found >= 0.999 * true - 2


# --- pipeline: each stage's kept ids

def test_pipeline_stages_by_loops(spark, tmp_path):
    r = random.Random(11)
    text = lambda n: " ".join(r.choices(WORDS, k=n)) + "."
    item = text(30)
    plain = [text(r.randrange(60, 200)) for _ in range(40)]
    rows = list(enumerate(plain))
    rows += [(100 + i, plain[i].upper()) for i in range(5)]  # copies but for case
    rows += [(200 + i, plain[10 + i] + " new end") for i in range(5)]  # near copies
    rows += [(300 + i, f"{plain[20 + i]} x{i} {item} y{i} {text(40)}") for i in range(5)]  # passages
    rows += [(400, None), (401, ""), (402, LONG), (402, LONG), (None, text(80))]
    path = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "mine") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    docs.coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = lambda df: sorted((x.doc_id is None, x.doc_id or 0) for x in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    good = common.written(stages["quality"](spark, docs, path))
    assert good.columns == docs.columns and ids(good) == ids(docs)  # all labels are good
    exact = common.written(stages["exact_copies"](spark, good, path))
    gone = {*range(5), 400}
    assert exact.columns == docs.columns and ids(exact) == sorted({(i is None, i or 0) for i, _ in rows if i not in gone})
    near = common.written(stages["near_copies"](spark, exact, path))
    gone |= {200 + i for i in range(5)}
    assert ids(near) == sorted({(i is None, i or 0) for i, _ in rows if i not in gone})
    clean = common.written(stages["benchmark"](spark, near, path))
    gone |= {300 + i for i in range(5)}
    assert ids(clean) == sorted({(i is None, i or 0) for i, _ in rows if i not in gone}) and {x.kept for x in clean.collect()} == {"mine"}
    mixed = stages["mix"](spark, clean, path).collect()
    size = {x.doc_id: len((x.text or "").split()) for x in clean.collect()}
    assert all(0 < x.taken <= 2 * size[x.doc_id] and x.size == size[x.doc_id] for x in mixed) and {x.doc_id for x in mixed} <= set(size)
    for s in {x.source for x in mixed}:
        mine = [x for x in mixed if x.source == s]
        assert abs(sum(x.taken for x in mine) - mine[0].target) <= max(x.size for x in mine)

    # a whole run leaves the table that its result reads, and small ones of the last stage
    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, path)
    assert sorted((x.doc_id is None, x.doc_id or 0, x.taken) for x in got.collect()) == sorted((x.doc_id is None, x.doc_id or 0, x.taken) for x in mixed)
    left = set(os.listdir(folder)) - before
    assert not any("stage" in name for name in left) and len(left) <= 5
    none = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, path).count() == 0, name


def test_empty_pipeline(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("op1_toxicity", "op5_quality", "op10_decontamination", "op11_quality_rules", "op13_resampling"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0, name
