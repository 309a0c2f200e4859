"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions."""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import with_arrays

KINDS = ("email", "ip", "card", "phone")
# fixed values: the base patterns.  An address is sought at each @; see email_spans
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW, STRIDE, REACH = 64, 32, 24
HIDDEN, TAGS = 14, 9  # plain, then first and further character of each kind
_CLASS = {c: i + 7 for i, c in enumerate("@.-+() %_\n:,/[]")}
#: Digit, lower, upper, other, letters outside ASCII, the words "at" and "dot", single signs.
CLASSES = 7 + len(_CLASS)
AT_DOT = re.compile(r"(?<![^\W_])(?:([Aa][Tt])|[Dd][Oo][Tt])(?![^\W_])")
#: An address in words: "at", a name, and a dot or "dot" that goes on.
SPELLED = re.compile(r"[\s(\[][Aa][Tt][\s)\]]\s?[^\s.@()\[\]]+(?:\.[^\W\d_]|\s?[\s(\[][Dd][Oo][Tt][\s)\]])")
#: Of the texts, one in so many, by a hash of the text, is never learnt from.
HELD_OUT = 5


def email_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain, in time linear in the text: a match goes through an @, starts at
    the earliest character of the run before it, and its domain is read from the @ on."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1) if start == at else done
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


_ANY = re.compile(r"[0-9@]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; a match that fails its check is dropped, not tried again."""
    if not _ANY.search(text):
        return []
    out = [(s, e, 0) for s, e in email_spans(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return [(s, e, KINDS[k]) for s, e, k in sorted(out, key=lambda x: (x[0], x[2], x[1]))]


def classes_of(text: str) -> np.ndarray:
    """Character classes, see CLASSES."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.full(len(points), 3, dtype=np.int64)
    out[(points >= 48) & (points <= 57)] = 0
    out[(points >= 97) & (points <= 122)] = 1
    out[(points >= 65) & (points <= 90)] = 2
    wide = np.flatnonzero(points > 127)
    out[wide[[chr(p).isalpha() for p in points[wide]]]] = 4
    for c, i in _CLASS.items():
        out[points == ord(c)] = i
    for m in AT_DOT.finditer(text):
        out[m.start():m.end()] = 5 if m.group(1) else 6
    return out


@dataclass
class Tagger:
    """`x*`: gate inputs by character class; `h*`: recurrent weights; forward and backward; `out`, `bias`: tag scores;
    `turn`: transition scores.  Gates stand in the order input, forget, output, candidate."""

    xf: np.ndarray
    hf: np.ndarray
    xb: np.ndarray
    hb: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    turn: np.ndarray

    @staticmethod
    def fresh(seed: int = 7) -> Tagger:
        r = np.random.default_rng(seed)
        gates = lambda: r.normal(0, 0.3, (CLASSES, 4 * HIDDEN)) + np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        back = lambda: r.normal(0, 0.25, (HIDDEN, 4 * HIDDEN))
        return Tagger(gates(), back(), gates(), back(), r.normal(0, 0.3, (2 * HIDDEN, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def lstm(x: np.ndarray, h: np.ndarray, chars: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states, batch x time x HIDDEN; with `keep` also what the way back needs."""
    m, n = chars.shape
    state, cell = np.zeros((m, HIDDEN)), np.zeros((m, HIDDEN))
    out, tape = np.empty((m, n, HIDDEN)), []
    for t in range(n):
        z = x[chars[:, t]] + state @ h
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:], np.tanh(z[:, 3 * HIDDEN:])
        if keep:
            tape.append((i, f, o, g, cell, state))
        cell = f * cell + i * g
        state = o * np.tanh(cell)
        out[:, t] = state
        if keep:
            tape[-1] += (cell,)
    return out, tape


def lstm_back(h: np.ndarray, chars: np.ndarray, tape: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dx, dh = np.zeros((CLASSES, 4 * HIDDEN)), np.zeros_like(h)
    ds, dc = np.zeros_like(grad[:, 0]), np.zeros_like(grad[:, 0])
    for t in range(chars.shape[1] - 1, -1, -1):
        i, f, o, g, cell, state, new = tape[t]
        ds = ds + grad[:, t]
        th = np.tanh(new)
        dc = dc + ds * o * (1 - th * th)
        dz = np.concatenate([dc * g * i * (1 - i), dc * cell * f * (1 - f), ds * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        np.add.at(dx, chars[:, t], dz)
        dh += state.T @ dz
        ds, dc = dz @ h.T, dc * f
    return dx, dh


def _states(model: Tagger, chars: np.ndarray, keep: bool = False):
    a, ta = lstm(model.xf, model.hf, chars, keep)
    b, tb = lstm(model.xb, model.hb, chars[:, ::-1], keep)
    return np.concatenate([a, b[:, ::-1]], axis=2), ta, tb


def _gradients(model: Tagger, chars: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log likelihood of the gold tags, through CRF and both LSTMs."""
    m, n = chars.shape
    states, ta, tb = _states(model, chars, True)
    e = np.exp(np.clip(states @ model.out + model.bias, -30, 30))
    psi = np.exp(model.turn)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    for t in range(n):
        a = e[:, t] if t == 0 else (alpha[:, t - 1] @ psi) * e[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    for t in range(n - 2, -1, -1):
        b = (e[:, t + 1] * beta[:, t + 1]) @ psi.T
        beta[:, t] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=2, keepdims=True)
    d = (np.eye(TAGS)[gold] - p) / m
    turn = np.zeros((TAGS, TAGS))
    np.add.at(turn, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1 / m)
    for t in range(n - 1):
        right = e[:, t + 1] * beta[:, t + 1]
        norm = ((alpha[:, t] @ psi) * right).sum(axis=1)
        turn -= psi * ((alpha[:, t] / norm[:, None]).T @ right) / m
    ds = d @ model.out.T
    dxf, dhf = lstm_back(model.hf, chars, ta, ds[:, :, :HIDDEN])
    dxb, dhb = lstm_back(model.hb, chars[:, ::-1], tb, ds[:, ::-1, HIDDEN:])
    return {"xf": dxf, "hf": dhf, "xb": dxb, "hb": dhb, "out": states.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, TAGS), "bias": d.sum(axis=(0, 1)), "turn": turn}


def train(chars: np.ndarray, gold: np.ndarray, steps: int = 300, batch: int = 96, seed: int = 3) -> Tagger | None:
    """Tagger of windows x WINDOW classes and tags; None without any tagged window."""
    if len(chars) == 0 or not gold.any():
        return None
    model, r = Tagger.fresh(), np.random.default_rng(seed)
    first = {f.name: 0.0 for f in fields(model)}
    second = dict(first)
    for k in range(1, steps + 1):
        pick = r.integers(0, len(chars), batch)
        for name, g in _gradients(model, chars[pick], gold[pick]).items():
            g = g / max(1.0, float(np.sqrt((g * g).sum())) / 5)
            first[name] = 0.9 * first[name] + 0.1 * g
            second[name] = 0.99 * second[name] + 0.01 * g * g
            step = 0.03 * min(1.0, 2 - 2 * k / steps + 0.05)
            setattr(model, name, getattr(model, name) + step * first[name] / (1 - 0.9**k) / (np.sqrt(second[name] / (1 - 0.99**k)) + 1e-8))
    return model


def decode(model: Tagger, chars: np.ndarray) -> np.ndarray:
    """Best tags of each window, by Viterbi."""
    m, n = chars.shape
    e = _states(model, chars)[0] @ model.out + model.bias
    back = np.empty((m, n, TAGS), dtype=np.int8)
    best = e[:, 0]
    for t in range(1, n):
        paths = best[:, :, None] + model.turn[None]
        back[:, t] = paths.argmax(axis=1)
        best = paths.max(axis=1) + e[:, t]
    tags = np.empty((m, n), dtype=np.int64)
    tags[:, -1] = best.argmax(axis=1)
    row = np.arange(m)
    for t in range(n - 1, 0, -1):
        tags[:, t - 1] = back[row, t, tags[:, t]]
    return tags


def window_starts(text: str, chars: np.ndarray) -> np.ndarray:
    """Starts of the windows, STRIDE apart, that come within REACH of a digit, an @ or an address in words.  No kind can do
    without one, so the tags of all other windows are plain."""
    sign = (chars == 0) | (chars == _CLASS["@"])
    for m in SPELLED.finditer(text):
        sign[m.start():m.end()] = True
    seen = np.r_[0, np.cumsum(sign)]
    starts = np.arange(0, max(1, len(chars) - WINDOW + STRIDE), STRIDE)
    return starts[seen[np.minimum(starts + WINDOW + REACH, len(chars))] > seen[np.maximum(np.minimum(starts, len(chars)) - REACH, 0)]]


def padded(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    whole = np.r_[chars, np.full(WINDOW, 3, dtype=np.int64)]
    return whole[starts[:, None] + np.arange(WINDOW)[None, :]]


def reconciled(tags: np.ndarray, starts: np.ndarray, n: int) -> list[tuple[int, int, str]]:
    """Spans of a whole text from the tags of overlapping windows.  Each character takes its tag from the window in which it
    stands farthest from an edge; then one pass over all tags joins them to spans across windows."""
    depth, tag = np.full(n, -1), np.zeros(n, dtype=np.int64)
    inner = np.minimum(np.arange(WINDOW), WINDOW - 1 - np.arange(WINDOW))
    for s, row in zip(starts.tolist(), tags, strict=True):
        e = min(n, s + WINDOW)
        better = inner[: e - s] > depth[s:e]
        depth[s:e][better] = inner[: e - s][better]
        tag[s:e][better] = row[: e - s][better]
    kind = np.where(tag > 0, (tag - 1) // 2, -1)
    cut = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | ((tag[1:] > 0) & (tag[1:] % 2 == 1))]) if n else []
    return [(int(s), int(e), KINDS[kind[s]]) for s, e in zip(cut, np.r_[cut[1:], n], strict=True) if kind[s] >= 0] if n else []


def plausible(text: str, start: int, end: int, kind: str) -> list[tuple[int, int]]:
    """The parts of a tagged span that can be of their kind, judged by digits alone: cut numbers are made whole, a card must pass
    its check, alone or as one of several numbers side by side, a network address is four numbers of 255 at most, a phone
    number has 10 to 15 digits; a mail address needs an @ or "at" inside."""
    while start > 0 and text[start].isdigit() and text[start - 1].isdigit():
        start -= 1
    while end < len(text) and text[end - 1].isdigit() and text[end].isdigit():
        end += 1
    said = text[start:end]
    digits = re.sub("[^0-9]", "", said)
    if kind == "card":
        if 14 <= len(digits) <= 19 and luhn(digits):
            return [(start, end)]
        parts = [(start + m.start(), start + m.end()) for m in re.finditer(r"(?<![0-9-])[0-9](?:-?[0-9]){13,18}(?![0-9-])", said)]
        return [(s, e) for s, e in parts if luhn(text[s:e].replace("-", ""))]
    if kind == "email":
        ok = re.search(r"\w\W{0,2}(?:@|(?<![^\W_])[Aa][Tt](?![^\W_]))\W{0,2}\w", said)
    elif kind == "ip":
        numbers = re.findall("[0-9]+", said)
        ok = len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    else:
        ok = 10 <= len(digits) <= 15
    return [(start, end)] if ok else []


def changed(said: str, kind: str, r: random.Random) -> str:
    """Another way to write a base span that the base patterns do not cover: a phone number without "+" and with other signs
    between its groups; a mail address with "at" and "dot" in words, or with letters outside ASCII; a network address with
    its dots in brackets or words; a card with other signs between its groups."""
    digits = re.sub("[^0-9]", "", said)
    if kind == "phone":
        far, a, b, c = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
        sign = r.choice((" ", ".", "-", "/"))
        near = r.choice((f"({a}) {b}-{c}", sign.join((a, b, c)), sign.join((a, b, c))))
        return near if not far else f"{r.choice(('', '00'))}{far}{sign}{near}" if len(far) < 4 else sign.join((far, near))
    if kind == "email":
        name, host = said.rsplit("@", 1)
        way = r.randrange(4)
        if way == 3:
            return f"{name[:-1]}{r.choice('äöüéèñçßø')}@{re.sub('[aeou]', lambda m: {'a': 'ä', 'e': 'é', 'o': 'ö', 'u': 'ü'}[m.group()], host, count=1)}"
        at, dot = ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"))[way]
        return name + at + (host.replace(".", dot) if r.random() < 0.7 else host)
    if kind == "ip":
        return said.replace(".", r.choice(("[.]", "(.)", " dot ", " . ")))
    return r.choice((".", "/", "_", "  ", " - ")).join(digits[i:i + 4] for i in range(0, len(digits), 4))


def varied(text: str, seed: int) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its base spans changed, each by a draw that text and seed fix, and where they stand now."""
    r = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) * 31 + seed)
    parts, spans, done, size = [], [], 0, 0
    for s, e, kind in base_spans(text):
        if s < done:
            continue
        new = changed(text[s:e], kind, r)
        parts += [text[done:s], new]
        size += s - done
        spans.append((size, size + len(new), kind))
        size, done = size + len(new), e
    return "".join([*parts, text[done:]]), spans


def labelled_windows(text: str, spans: list[tuple[int, int, str]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags of a text: those that touch a span, then others evenly, `most` in all."""
    chars, gold = classes_of(text), np.zeros(len(text) + WINDOW, dtype=np.int64)
    for s, e, kind in spans:
        gold[s:e] = 2 + 2 * KINDS.index(kind)
        gold[s] -= 1
    starts = window_starts(text, chars)
    tagged = np.array([gold[s:s + WINDOW].any() for s in starts], dtype=bool)
    hit, rest = starts[tagged][:most], starts[~tagged]
    rest = rest[np.linspace(0, len(rest) - 1, min(most - len(hit), len(rest))).astype(int)] if len(rest) else rest
    starts = np.r_[hit, rest].astype(np.int64)
    return padded(chars, starts), gold[starts[:, None] + np.arange(WINDOW)[None, :]]


def held_out(text_hash: Column) -> Column:
    return F.pmod(text_hash, F.lit(HELD_OUT)) == 0


def training_windows(docs: DataFrame, rows: int = 1500, per_row: int = 8, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from `rows` different texts that have a digit or an @ at most, the first by a hash of the text;
    `per_row` windows at most of each, and of two versions of it whose base spans are changed.

    Only hashes are ranked; the texts of the chosen ones are cut into windows where they lie, once in each task, and of the
    copies in different tasks one is kept."""
    h = F.xxhash64(text_col, F.lit(3))
    known = docs.filter(F.col(text_col).rlike("[0-9@]")).select(h.alias("h"), F.col(text_col).alias("text"))
    chosen = known.select("h").filter(~held_out(F.col("h"))).distinct().orderBy("h").limit(rows)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            out = []
            for key, text in zip(pdf["h"], pdf["text"], strict=True):
                if key not in seen:
                    seen.add(key)
                    made = [labelled_windows(t, spans, per_row) for t, spans in ((text, base_spans(text)), varied(text, 1), varied(text, 2))]
                    chars, gold = (np.concatenate([m[k] for m in made]).astype(np.uint8).tobytes() for k in (0, 1))
                    out.append((key, chars, gold))
            yield pd.DataFrame(out, columns=["h", "chars", "gold"])

    got = known.join(F.broadcast(chosen), "h").mapInPandas(cut, "h long, chars binary, gold binary")
    got = got.groupBy("h").agg(F.min(F.struct("chars", "gold")).alias("w")).select("h", "w.chars", "w.gold").toPandas().sort_values("h")
    chars, gold = (np.frombuffer(b"".join(got[c]), dtype=np.uint8).astype(np.int64).reshape(-1, WINDOW) for c in ("chars", "gold"))
    return chars, gold


def find_personal_data(docs: DataFrame, model: Tagger | None, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with base and added, arrays of (start, end, kind) in code points.

    Base spans are the matches of the fixed patterns.  Added are the plausible parts of the tagger's spans, kind "lstm_"
    and the kind, that touch no base span: other ways to write what the patterns describe (see `changed`).  Windows overlap,
    so a span at the edge of one lies inside the next; characters further than REACH from any digit, @ or address in words
    are plain without a run.

    A null text is an empty one and has no span; long texts are decoded whole, some windows at a time.  Equal texts, repeated
    rows included, get equal spans; spans that start together stand in the order of their end.  Without a model nothing is
    added.  An empty table gives an empty one; columns named base or added are replaced, all others come through."""
    columns = [c for c in docs.columns if c.lower() not in ("base", "added")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    as_rows = lambda spans: [{"start": s, "end": e, "kind": k} for s, e, k in spans]

    def work(texts: pa.Array) -> dict[str, pa.Array]:
        rows = [t or "" for t in texts.to_pylist()]
        base = [base_spans(t) for t in rows]
        added: list[list] = [[] for _ in rows]
        if sent.value is not None:
            todo = []
            for i, t in enumerate(rows):
                if _ANY.search(t) or SPELLED.search(t):
                    chars = classes_of(t)
                    todo.append((i, chars, window_starts(t, chars)))
            windows = (padded(c, s[k:k + 2048]) for _, c, s in todo for k in range(0, len(s), 2048))
            tags = _decoded(sent.value, windows)
            for i, chars, starts in todo:
                mine = np.concatenate([next(tags) for _ in range(0, len(starts), 2048)]) if len(starts) else np.empty((0, WINDOW), dtype=np.int64)
                taken = np.zeros(len(chars) + 1, dtype=np.int64)
                for s, e, _ in base[i]:
                    taken[s:e] = 1
                taken = np.r_[0, np.cumsum(taken)]
                tagged = {(*part, k) for s, e, k in reconciled(mine, starts, len(chars)) for part in plausible(rows[i], s, e, k)}
                added[i] = [(s, e, f"lstm_{k}") for s, e, k in sorted(tagged) if taken[e] == taken[s]]
        return {"base": pa.array([as_rows(x) for x in base], kind), "added": pa.array([as_rows(x) for x in added], kind)}

    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text_col).alias("__scan_"))
    spans = "array<struct<start: long, end: long, kind: string>>"
    return with_arrays(rows, work, ["__scan_"], {"base": spans, "added": spans})


def _decoded(model: Tagger, windows: Iterator[np.ndarray], most: int = 2048) -> Iterator[np.ndarray]:
    """Tags of each group of windows, decoded together up to `most` at a time."""
    held: list[np.ndarray] = []
    for w in windows:
        if held and sum(map(len, held)) + len(w) > most:
            yield from _split(model, held)
            held = []
        held.append(w)
    if held:
        yield from _split(model, held)


def _split(model: Tagger, held: list[np.ndarray]) -> Iterator[np.ndarray]:
    tags = decode(model, np.concatenate(held))
    yield from np.split(tags, np.cumsum([len(h) for h in held])[:-1])
