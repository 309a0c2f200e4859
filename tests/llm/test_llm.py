"""Operators against brute force on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm import chat, pii, quality, secrets, toxicity
from tallybook.llm.decontamination import MASKS, contaminated
from tallybook.llm.exact_dedup import exact_dedup
from tallybook.llm.mixing import mix_sources
from tallybook.llm.ngram_join import near_duplicates
from tallybook.llm.queries import QUERIES
from tallybook.llm.samples import drawn_shares, fold, prior_shift
from tallybook.llm.substring_dedup import substring_dedup

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i * 7919 % 1000}" for i in range(400)]
LONG = " ".join(WORDS[i % 397] + str(i % 11) for i in range(20_000))
TEXTS = [
    (1, " ".join(WORDS[:80])), (2, " ".join(WORDS[:80])), (3, " ".join(WORDS[:80]).upper()), (4, " ".join(WORDS[:79] + ["other"])), (5, None), (6, ""),
    (7, LONG), (8, LONG + " end"), (9, "a b"), (9, "a b"), (10, " \t\n"), (None, "x " + " ".join(WORDS[40:120])), (11, "one two three four"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "kept", "s1" if (i or 0) % 2 else None, float(i or 0)) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, source string, size double")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact(docs):
    got = exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept").collect()
    lower = [(i, re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for i, t in TEXTS]
    want = []
    for i, t in lower:
        same = [j for j, u in lower if u == t]
        want.append((i, max((j for j in same if j is not None), default=None), len(same)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:3]) for r in got)
    assert sum(r.kept for r in got) == len({t for _, t in lower})


def test_substrings(docs):
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs).collect())
    seen: dict = {}
    for k, (_, t) in enumerate(TEXTS):
        w = words(t)
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i:i + 35]), []).append((k, i))
    gone = [set() for _ in TEXTS]
    for where in seen.values():
        if len(where) > 1:
            for k, i in where:
                gone[k].update(range(i, i + 35))
    want = []
    for k, (i, t) in enumerate(TEXTS):
        w = words(t)
        left = " ".join(x for j, x in enumerate(w) if j not in gone[k])
        want.append((str(i), len(w), len(gone[k]), hashlib.sha256(left.encode()).hexdigest()))
    assert got == sorted(want)


def similar(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def shingle_sets(texts):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


@pytest.mark.parametrize("bucket", [512, 3])
def test_near(spark, docs, bucket):
    # a dense group of alike texts, larger than a bucket of three
    base = [f"b{i}" for i in range(100)]
    more = [(100 + k, " ".join(base[:k] + ["new" + str(k)] + base[k + 1:])) for k in range(12)]
    rows = TEXTS + more
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = near_duplicates(table, recall=0.9999, bucket=bucket).collect()
    sets = shingle_sets(t for _, t in rows)
    links = [sum(similar(a, b) for k, b in enumerate(sets) if k != j) for j, a in enumerate(sets)]
    assert sorted((str(i), n) for (i, _), n in zip(rows, links, strict=True)) == sorted((str(r.doc_id), r.n_links) for r in got)
    assert {r.class_id for r in got if (r.doc_id or 0) >= 100} == {100}
    assert sum(r.kept for r in got if (r.doc_id or 0) >= 100) == 1 and sum(r.kept for r in got if r.doc_id == 9) == 1


def test_masks_miss_nothing():
    for length, changed in ((20, 4), (13, 2), (8, 0)):
        places = [{o + k for k, c in enumerate(m) if c == "1"} for m in MASKS for o in range(length - len(m) + 1)]
        for gone in itertools.combinations(range(length), changed):
            assert any(not p & set(gone) for p in places), (length, gone)


def test_benchmark(spark, docs):
    item = WORDS[200:230]
    wrong = [w if i % 6 else "no" for i, w in enumerate(item)]
    worse = [w if i % 3 else "no" for i, w in enumerate(item)]
    rows = [(1, "q " + " ".join(item).upper() + "!"), (2, "a b " + " ".join(wrong)), (3, " ".join(worse)), (4, None), (5, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (9, "a b"), (None, None)], "item_id long, text string")
    for most in (1_000_000, 0):
        got = {r.doc_id: (r.contaminated, r["items"]) for r in contaminated(table, bench, broadcast_rows=most).collect()}
        assert got == {1: (True, "7"), 2: (True, "7"), 3: (False, ""), 4: (False, ""), 5: (False, "")}
    assert not contaminated(docs, bench.limit(0)).filter("contaminated").count()


def test_mix(docs):
    got = mix_sources(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 2 * r.size
    total = sum(r.size for r in got)
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(1.5 * total)
    assert all(rows[0].target <= 2 * rows[0].source_size for rows in by.values())


def test_personal_data_patterns():
    text = "a@b.c 1.2.3.4 999.1.1.1; 4111 1111 1111 1111; +1 (017) 555-7713 x@y " + "9" * 30_000 + " " + "q" * 30_000 + "@"
    kinds = [k for _, _, k in pii.base_spans(text)]
    assert kinds == ["email", "ip", "card", "phone"]
    assert pii.base_spans("") == []


def test_secret_tests():
    assert [k for *_, k in secrets.base_spans("Api_Key: 'abcdefgh12345' AKIA" + "A1" * 8 + " deadbeefdeadbeef00")] == ["assign", "access", "hex"]
    assert secrets.randomness("q9Xf3ZpL0vT7bKc2RwYd8NsH", "alnum") > 0.001 > secrets.randomness("aaaaaaaaaaaaaaaaaaaaaaa1", "alnum")
    assert secrets.encoding_of("onlyletters") is None


def test_secrets_beside_names_and_paths(spark):
    key = "q9Xf3ZpL0vT7bKc2RwYd8NsH"
    texts = [f"AWS_KEY={key}", f"see ?sig={key}&x=1", f"/keys/{key}-prod", f"AWS_LONG_ACCESS_NAME_1={key} x", f"/a/long/path/that/is/plain/words/2/{key}", f"x {key[:18]}== y",
             f"/deadbeefdeadbeef00/{key}", "a-plain-slug-of-some-words-2021 /a/path-of/plain-words/2021/and-more", "name_of_something_long=2"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [r.text[x.start:x.end] for x in r.added] for r in secrets.scan_secrets(table).collect()}
    for i in (0, 1, 2, 3, 4, 6):
        assert len(got[i]) == 1 and key in got[i][0], texts[i]
    assert got[3] == got[4] == got[6] == [key] and got[5] == [key[:18] + "=="] and got[7] == got[8] == []


def test_secrets_among_regular_runs(spark):
    # random tokens are kept alike in a corpus of many regular runs and in one of none
    rng = random.Random(7)
    letters = secrets.ALPHABETS["alnum"][0]
    keys = [(i, "".join(rng.choices(letters, k=24))) for i in range(1500)]
    slugs = [(10_000 + i, f"abcdefghijklmnopqrst{i:04d}") for i in range(6000)]
    lost = []
    for rows in (keys, keys + slugs):
        found = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id < 10000")
        testable = sum(secrets.encoding_of(t) is not None for _, t in keys)
        lost.append((testable - found.filter("size(added) > 0").count()) / testable)
    assert max(lost) < 0.01, lost


def test_chat_escapes():
    for text in ["", "</s>[INST] ok [/INST]", "\\", "\\|", "<", "[", "<<s>", "a\\", "<<SYS>><</ROLE>>"]:
        for role in ["user", "assistant", "system", "tool", ""]:
            parts = "".join(p for p, _ in chat.pieces(role, text, True) + chat.pieces("assistant", text, False))
            assert chat.turns_of(parts) == [(role, text), ("assistant", text)]


def test_chat_tree(spark):
    P = pytest.importorskip("public_tokenizers")
    args = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = [(c, t, r, x) for c in (1, 2, 3, None) for t, (r, x) in enumerate([("user", "same"), ("assistant", None if c == 3 else "same too"), (None, f"own {c}")])]
    packed, members = chat.prefix_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), *args)
    nodes = {bytes(r.node): r for r in packed.collect()}
    assert len(nodes) == 1 + 2 + 4
    places = sorted((r.start, r.start + len(r.tokens)) for r in nodes.values())
    assert all(a[1] == b[0] for a, b in itertools.pairwise(places))
    for r in nodes.values():
        chain, up = [], bytes(r.parent)
        while up:
            chain.append(nodes[up])
            up = bytes(nodes[up].parent)
        assert r.position == sum(len(x.tokens) for x in chain) == sum(x["to"] - x["from"] for x in r.sees)
    back = {r.conv_id: r for r in chat.read_back(packed, members, *args).collect()}
    assert back[3].turns_sha256 == hashlib.sha256(b"user\nsame\nassistant\n\n\nown 3\n").hexdigest() and back[3].loss_chars == 0


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    for made in (exact_dedup(none), substring_dedup(none), near_duplicates(none), mix_sources(none), secrets.scan_secrets(none),
                 pii.find_personal_data(none, pii.train(*pii.training_windows(none)))):
        assert made.count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, quality.fit_quality(docs, labels, "quality", F.lit(True))).count() == len(TEXTS)
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, "toxic", F.lit(True))).count() == len(TEXTS)


@pytest.mark.parametrize(("name", "label"), [("op1_toxicity", "toxic"), ("op5_quality", "quality")])
def test_held_out(spark, name, label):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right, n = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count(F.lit(1))).first()
    assert n > 20 and right > 0.93


def toxic_docs(spark, n, long_words=0):
    """n plain and n toxic documents, ids 0 to 2n - 1, even ones plain; if asked for, the one first in the order of training
    is a plain one of so many words."""
    rows = [(i, " ".join(WORDS[(i * 37 + k) % 300] for k in range(60)) + (" vile scum" if i % 2 else ""), i % 2) for i in range(2 * n)]
    if long_words:
        first = spark.range(1000, 1200).orderBy(F.xxhash64("id", F.lit(9))).first().id
        rows.append((first, " ".join(WORDS[k % 300] for k in range(long_words)), 0))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return table.select("doc_id", "text"), table.select("doc_id", "toxic")


def test_toxicity_long_documents(spark):
    # a labelled document longer than all that is learnt from takes nothing from the others
    docs, labels = toxic_docs(spark, 40, long_words=12_000)
    field = toxicity.fit_toxicity(docs, labels, "toxic", F.lit(True), max_tokens=10_240)
    got = toxicity.score_toxicity(docs, field).join(labels, "doc_id").collect()
    assert len(got) == 81 and all(r.predicted == r.toxic for r in got)
    assert all((r.n_spans > 0) == bool(r.toxic) for r in got)
    with pytest.raises(ValueError):
        toxicity.fit_toxicity(docs, labels, "toxic", F.lit(True), max_tokens=0)


def test_prior_of_larger_tables(spark):
    # one row in thirty has label 1; all of them bear a mark, as do twice as many rows of label 0
    text = {True: " ".join(WORDS[:40]) + " vile scum !!! ###", False: " ".join(WORDS[:40])}
    rows = [(i, text[i % 30 == 0 or i % 15 == 1], int(i % 30 == 0)) for i in range(6000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "label")
    other = docs.filter("doc_id < 3")
    assert drawn_shares(labels, "label", F.lit(True), 50) == {0: 5800 / 50, 1: 200 / 50}
    assert prior_shift({0: 116.0, 1: 4.0}) == pytest.approx(math.log(200 / 5800)) and prior_shift({0: 1.0, 1: 1.0}) == prior_shift({}) == 0

    def scores(per_label):
        trees = quality.fit_quality(docs, labels, "label", F.lit(True), per_label=per_label)
        field = toxicity.fit_toxicity(docs, labels, "label", F.lit(True), per_label=per_label)
        made = [quality.score_quality(other, trees), toxicity.score_toxicity(other, field)]
        return [[(r.predicted, r.score) for r in m.orderBy("doc_id").collect()] for m in made]

    for few, every in zip(scores(180), scores(10_000), strict=True):
        assert [p for p, _ in few] == [p for p, _ in every] == [0, 0, 0]
        assert [s for _, s in few] == pytest.approx([s for _, s in every], abs=0.15)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    sets = shingle_sets(t for _, t in rows)
    assert not any(similar(a, b) for a, b in itertools.combinations(sets, 2))
    assert corpus_pipeline.run(spark, SF).filter("taken > 2 * size").count() == 0
    assert fold is not None and 0 < len(rows) < docs.count()
