"""Chat formatting: conversations as a prefix tree, shared turns emitted once, with positions and attention intervals."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybook.llm.common import written

# fixed values: the template's control strings
BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END = "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>"
CONTROL = re.compile("|".join(re.escape(c) for c in (ROLE_END, SYSTEM_END, ROLE, SYSTEM, USER_END, USER, END, BEGIN)))
_ESCAPED = re.compile(r"\\([\\|])")


def escaped(text: str) -> str:
    """No control string is left: a backslash is doubled, and a backslash and a bar stand behind the first character of
    each control string."""
    return CONTROL.sub(lambda m: f"{m.group()[0]}\\|{m.group()[1:]}", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m.group(1) == "\\" else "", text)


def pieces(role: str, text: str, first: bool) -> list[tuple[str, bool]]:
    """A turn as pieces of the template, each with whether the loss counts it: only an assistant's words do."""
    body = escaped(text)
    head = BEGIN if first else ""
    if role == "user":
        return [(f"{head}{USER} ", False), (body, False), (f" {USER_END}", False)]
    if role == "assistant":
        return [(head, False), (body, True), (END, False)]
    if role == "system":
        return [(f"{head}{SYSTEM}", False), (body, False), (SYSTEM_END, False)]
    return [(f"{head}{ROLE}{escaped(role)}{ROLE_END}", False), (body, False), (END, False)]


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, by its control strings alone."""
    out, at, opened, role = [], 0, None, ""
    for m in CONTROL.finditer(formatted):
        between, sign = formatted[at:m.start()], m.group()
        at = m.end()
        if sign in (USER, SYSTEM, ROLE):
            opened = sign
        elif sign == USER_END:
            out.append(("user", unescaped(between[1:-1])))
            opened = None
        elif sign == SYSTEM_END:
            out.append(("system", unescaped(between)))
            opened = None
        elif sign == ROLE_END:
            role = unescaped(between)
        elif sign == END:
            out.append((role if opened == ROLE else "assistant", unescaped(between)))
            opened = None
    return out


_encoders: dict = {}


def encoder(vocabulary: str, pattern: str):
    """Byte-level BPE of a rank file; one for each process."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[vocabulary] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and turn, each with the key of the path that leads to it; the last row of a
    conversation also has the path itself.  Holds one path at a time."""
    empty, state, waiting, kind = object(), None, None, pa.int64()
    last = empty
    for batch in batches:
        out, kind = [], batch.schema.field(0).type
        for conv, role, text in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            role, text = role or "", text or ""
            new = last is empty or conv != last
            if waiting:
                out.append((*waiting, state[2] if new else None))
            if new:
                last, state = conv, (b"", 0, b"")
            parent, depth, path = state
            node = hashlib.blake2b(b"\0".join([parent, role.encode(), text.encode()]), digest_size=16).digest()
            state = (node, depth + 1, path + node[:8])
            waiting = (conv, depth + 1, node, parent, role, text)
        if out:
            yield _chain_batch(out, kind)
    if waiting:
        yield _chain_batch([(*waiting, state[2])], kind)


def _chain_batch(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    kinds = [conv, pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.binary()]
    names = ["conv", "depth", "node", "parent", "role", "text", "path"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def prefix_tree(conversations: DataFrame, vocabulary: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(packed, members).

    packed has one row per distinct prefix of turns: node, parent, depth, tokens (of its last turn), loss_start and
    loss_end (tokens under the loss mask), start (place in the one stream of all tokens, depth first), position (of its
    first token: the tokens of its ancestors) and sees (the ancestors' places as intervals [from, to), neighbours joined).
    members has a row per conversation and turn: conv, depth, node.

    Turns go by turn, then role, then text; null roles and texts are empty, and a null id is a conversation of its own.
    Conversations that share their first turns share nodes, so a first turn of a third of all conversations is tokenised
    and emitted once.  Depth-first order comes from sorting conversations by their paths in ranges, not from walking a
    tree; a node stands where the first conversation that has it puts it.  Paths are followed in sorted partitions, row by
    row, so that no conversation is gathered.  An empty table gives empty ones; further columns are ignored.
    """
    turns = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kind = turns.schema["conv"].dataType.simpleString()
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")
    chained = written(ordered.mapInArrow(_chains, f"conv {kind}, depth long, node binary, parent binary, role string, text string, path binary"))

    ranks = chained.filter("path is not null").select("conv", "path").repartitionByRange("path", "conv").sortWithinPartitions("path", "conv")
    ranks = written(ranks.select("conv", F.monotonically_increasing_id().alias("rank")))
    steps = written(chained.select("conv", "depth", "node").join(ranks, chained["conv"].eqNullSafe(ranks["conv"])).select(
        chained["conv"], "depth", "node", "rank"))
    visits = steps.groupBy("node").agg(F.min("rank").alias("rank"))
    texts = chained.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("role").alias("role"), F.first("text").alias("text"))

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            tokens, start, end = [], [], []
            for depth, role, text in zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("depth", "role", "text")], strict=True):
                ids, mask = [], (0, 0)
                for piece, counts in pieces(role, text, depth == 1):
                    new = enc.encode_ordinary(piece)
                    if counts:
                        mask = (len(ids), len(ids) + len(new))
                    ids += new
                tokens.append(ids)
                start.append(mask[0])
                end.append(mask[1])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("node", "parent", "depth", "rank")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(tokens, pa.list_(pa.int32())), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                                             ["node", "parent", "depth", "rank", "tokens", "loss_start", "loss_end"])

    nodes = texts.join(visits, "node").mapInArrow(tokenised, "node binary, parent binary, depth long, rank long, tokens array<int>, loss_start long, loss_end long")
    nodes = written(nodes.repartitionByRange("rank", "depth").withColumn("part", F.spark_partition_id()))
    parts = nodes.groupBy("part").agg(F.sum(F.size("tokens")).alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("offset"))  # one row per partition
    place = nodes.select("node", "part", "rank", "depth", F.size("tokens").cast("long").alias("n"))
    place = place.withColumn("here", F.sum("n").over(W.partitionBy("part").orderBy("rank", "depth")) - F.col("n"))
    place = written(place.join(parts, "part").select("node", "rank", "n", (F.col("offset") + F.col("here")).alias("start")))

    # along the first conversation that has a node: positions, and the ancestors' intervals
    walk = steps.withColumnRenamed("rank", "by").join(place, "node").select("by", "depth", "node", "n", "start", (F.col("by") == F.col("rank")).alias("first"))
    walk = walk.repartition("by").sortWithinPartitions("by", "depth").select("by", "node", "n", "start", "first").mapInArrow(
        _ancestors, "node binary, start long, position long, sees array<struct<from: long, to: long>>")
    packed = nodes.drop("part", "rank").join(walk, "node")
    return packed, steps.select("conv", "depth", "node")


def _ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, position, sees = None, 0, []
    for batch in batches:
        out = []
        for by, node, n, start, first in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if by != last:
                last, position, sees = by, 0, []
            if first:
                out.append((node, start, position, [{"from": a, "to": b} for a, b in sees]))
            position += n
            if sees and sees[-1][1] == start:
                sees = [*sees[:-1], (sees[-1][0], start + n)]
            else:
                sees = [*sees, (start, start + n)]
        if out:
            node, start, position_of, intervals = zip(*out, strict=True)
            interval = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(start, pa.int64()), pa.array(position_of, pa.int64()), pa.array(intervals, interval)],
                                             ["node", "start", "position", "sees"])


def read_back(packed: DataFrame, members: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, from the tokens,
    masks and memberships of prefix_tree alone.  Digests grow turn by turn; no conversation is held whole."""
    kind = members.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        empty = object()
        last, state, conv_type = empty, None, pa.int64()

        def result(done: list) -> pa.RecordBatch:
            columns = list(zip(*[(c, n, t.hexdigest(), lc, x.hexdigest(), f) for c, (n, t, lc, x, f) in done], strict=True))
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            conv_type = batch.schema.field(0).type
            done = []
            for conv, tokens, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if last is empty or conv != last:
                    if state:
                        done.append((last, state))
                    last, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted, loss = enc.decode(tokens), unescaped(enc.decode(tokens[a:b]))
                for role, text in turns_of(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(formatted)
            if done:
                yield result(done)
        if state:
            yield result([(last, state)])

    rows = members.join(packed.select("node", "tokens", "loss_start", "loss_end"), "node")
    rows = rows.repartition("conv").sortWithinPartitions("conv", "depth").select("conv", "tokens", "loss_start", "loss_end")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
