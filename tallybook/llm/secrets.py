"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control."""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import with_arrays, written

# fixed values: the base patterns and their shortest matches
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
# a candidate: a whole run of these characters, "=" only as padding at its end, or else a part of it between separators
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]++(?:=++(?![A-Za-z0-9+/_-]))?+")
PARTS = tuple(re.compile(c + "++=*+") for c in ("[A-Za-z0-9_-]", "[A-Za-z0-9+/]", "[A-Za-z0-9]"))
SHORTEST = 20

# fixed values: alphabets in their own order, and the classes whose shares are tested
ALPHABETS = {
    "hex": ("0123456789abcdef", (10, 6)),
    "HEX": ("0123456789ABCDEF", (10, 6)),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (26, 6)),
    "alnum": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", (26, 26, 10)),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (26, 26, 10, 2)),
    "base64url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", (26, 26, 10, 2)),
}
_PLACE = {name: {c: i for i, c in enumerate(a)} for name, (a, _) in ALPHABETS.items()}
LENGTH_CLASSES = (20, 32, 48, 96)
BINS = 2000


def encoding_of(token: str) -> str | None:
    """The narrowest alphabet that holds the token and of whose letters and digits it has both; None for plain words and
    numbers, which no test could tell from text."""
    body = token.rstrip("=")
    if not (any(c.isdigit() for c in body) and any(c.isalpha() for c in body)):
        return None
    return next((name for name, place in _PLACE.items() if all(c in place for c in body)), None)


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    z = ((x / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str, encoding: str) -> float:
    """Probability, were the token drawn at random from its alphabet, of tests that speak as strongly against it: uniform
    symbols, uniform classes of symbols, runs above and below the middle, serial correlation; joined by Fisher's rule."""
    alphabet, classes = ALPHABETS[encoding]
    v = np.array([_PLACE[encoding][c] for c in token.rstrip("=")], dtype=np.int64)
    n, size = len(v), len(alphabet)
    count = np.bincount(v, minlength=size)
    p = [chi_tail(float(((count - n / size) ** 2).sum() * size / n), size - 1)]
    ends = np.cumsum(classes)
    held = np.array([((v >= e - c) & (v < e)).sum() for c, e in zip(classes, ends, strict=True)])
    expected = n * np.array(classes) / size
    p.append(chi_tail(float(((held - expected) ** 2 / expected).sum()), len(classes) - 1))
    high = v >= size / 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        mean = 2 * a * b / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p.append(normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)) if spread > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    x = v - v.mean()
    p.append(normal_tail(float((x[1:] * x[:-1]).sum() / (x * x).sum() + 1 / n) * math.sqrt(n)) if (x * x).sum() else 2.0 ** (1 - n))
    half = -sum(math.log(max(q, 1e-300)) for q in p)  # half of Fisher's statistic, on 2 x len(p) degrees of freedom
    term, total = 1.0, 1.0
    for k in range(1, len(p)):
        term *= half / k
        total += term
    return min(1.0, total * math.exp(-half))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the whole matches, by start, then kind as listed."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def candidates(text: str, found: list[tuple[int, int, str]], doubt: float) -> list[tuple[int, int, float]]:
    """(start, end, p-value) of the runs outside of the base spans `found` that mix letters and digits of one encoding.  A
    run that is not of one encoding, that touches a base span or has a p-value under `doubt` may have a name or a path
    before or behind a secret: its parts between / and +, between - and _, and between any of these are tested, and those
    that reach `doubt` take its place."""
    merged: list[list[int]] = []
    for s, e, _ in found:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    ends = [e for _, e in merged]

    def tested(start: int, end: int) -> tuple[int, int, float] | None:
        k = bisect.bisect_right(ends, start)
        if end - start < SHORTEST or (k < len(merged) and merged[k][0] < end):
            return None
        token = text[start:end]
        encoding = encoding_of(token)
        return (start, end, randomness(token, encoding)) if encoding else None

    out = []
    for m in RUN.finditer(text):
        if m.end() - m.start() < SHORTEST:
            continue
        whole = tested(*m.span())
        if whole and whole[2] >= doubt:
            out.append(whole)
            continue
        good, regular = [], []
        for part in PARTS:
            for x in part.finditer(text, *m.span()):
                t = tested(*x.span()) if x.span() != m.span() else None
                if t and not any(t[0] < e and t[1] > s for s, e, _ in good):
                    (good if t[2] >= doubt else regular).append(t)
        # without a random part the run, or else its first part of one encoding, is still one of the regular ones
        out += sorted(good) if good else [whole] if whole else regular[:1]
    return out


def _scan(texts: pa.Array, doubt: float) -> dict[str, pa.Array]:
    base, some = [], []
    for text in texts.to_pylist():
        text = text or ""
        found = base_spans(text)
        base.append([{"start": s, "end": e, "kind": k} for s, e, k in found])
        some.append([{"start": s, "end": e, "length_class": sum(e - s >= x for x in LENGTH_CLASSES), "bin": min(BINS, int(-100 * math.log10(max(p, 1e-30))))}
                     for s, e, p in candidates(text, found, doubt)])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    cand = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length_class", pa.int32()), ("bin", pa.int32())]))
    return {"__base_": pa.array(base, span), "__some_": pa.array(some, cand)}


def not_random(candidates: DataFrame, rate: float) -> dict[int, int]:
    """Per length class, the lowest bin of p-values that the step-up rule rejects at this false-discovery rate.  Counted in
    bins of a hundredth of a decade over all documents: as many rows as there are classes and bins, whatever the input."""
    counts = candidates.groupBy("length_class", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    limits = {}
    for c in {r.length_class for r in counts}:
        bins = sorted(((r.bin, r.n) for r in counts if r.length_class == c), reverse=True)
        total, seen, limit = sum(n for _, n in bins), 0, BINS + 1
        for b, n in bins:
            seen += n
            if 10 ** (-b / 100) <= rate * seen / total:
                limit = b
        limits[c] = limit
    return limits


def scan_secrets(docs: DataFrame, rate: float = 0.05, doubt: float = 1e-3, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with base (array of start, end, kind), added (the same, kind "random"), in code points.

    Base spans are the whole matches of the fixed patterns.  Added are runs of 20 characters and more outside of them, or
    parts of runs (see candidates), that mix letters and digits of one encoding and pass for random: the false-discovery
    control of their length class, over all documents, does not call them regular, or their own p-value is over `doubt`.
    That control rejects "is random", so its limit nears `rate` where most are regular; held at `doubt`, it loses the
    random tokens with a p-value up to that and no others in any corpus.  Longer runs are tested more sharply, so classes of length are
    controlled apart.

    Null texts are empty and have no span.  Texts of any length are read whole, once.  Equal texts, repeated rows included,
    get equal spans; each of them counts in the control.  An empty table gives an empty one; columns named base or added are
    replaced, all others come through."""
    columns = [c for c in docs.columns if c.lower() not in ("base", "added")]
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("__scan_"))
    rows = written(with_arrays(rows, lambda texts: _scan(texts, doubt), ["__scan_"], {"__base_": "array<struct<start: long, end: long, kind: string>>",
                                                          "__some_": "array<struct<start: long, end: long, length_class: int, bin: int>>"}))
    limits = not_random(rows.select(F.inline("__some_")), rate)
    own = int(-100 * math.log10(doubt))
    passes = F.lit(False)
    added = F.filter("__some_", lambda x: _below(x, limits, own) if limits else passes)
    added = F.transform(added, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("random").alias("kind")))
    return rows.select(*columns, F.col("__base_").alias("base"), added.alias("added"))


def _below(x, limits: dict[int, int], own: int):
    ok = F.lit(False)
    for c, limit in sorted(limits.items()):
        ok = ok | ((x["length_class"] == c) & (x["bin"] < max(limit, own)))
    return ok
