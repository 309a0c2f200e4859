"""Request rules over event tables and event streams: sliding-window admission, a daily cap, runs without an answer.

The batch and streaming forms give the same result when a stream brings a key's events in time order.  A stream drops
events later than its watermark; that, and the eviction of idle keys, is the only difference.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallybook import fixed_values as V
from tallybook.functions.dates import local_day
from tallybook.operators.chains import whole_groups
from tallybook.operators.running import previous, running_sums
from tallybook.session import materialize

BLOCK = 65_536
ADMITTED = "key string, event_id long, ts timestamp, allowed boolean"


def _admit(times: np.ndarray, limit: int, window_us: int) -> np.ndarray:
    """times in order, microseconds.  A request is admitted unless the limit-th admitted one before it is less than a window old;
    what lies in between is passed over in one step, and rejected requests leave no trace."""
    out, recent, i = np.zeros(len(times), dtype=bool), deque(maxlen=limit), 0
    while i < len(times):
        if len(recent) == limit and times[i] - recent[0] < window_us:
            i = int(np.searchsorted(times, recent[0] + window_us))
            continue
        out[i] = True
        recent.append(int(times[i]))
        i += 1
    return out


def _judged(times: np.ndarray, group: np.ndarray, limit: int, window_us: int) -> np.ndarray:
    """Whole groups of rows, in order, at once.  A group without `limit` + 1 requests inside a window is admitted without a look
    at its rows."""
    if limit == 0:
        return np.zeros(len(times), dtype=bool)
    out, dense = np.ones(len(times), dtype=bool), np.zeros(len(times), dtype=bool)
    dense[limit:] = (group[limit:] == group[:-limit]) & (times[limit:] - times[:-limit] < window_us)
    for g in np.unique(group[dense]):
        a, b = np.searchsorted(group, [g, g + 1])
        out[a:b] = _admit(times[a:b], limit, window_us)
    return out


def admission(requests: DataFrame, limit: int, window_seconds: int, block: int = BLOCK) -> DataFrame:
    """requests(key, event_id, ts): was each request under the limit, counting only admitted ones in the window?

    A pause of a whole window forgets everything, so a key's requests are cut there.  A longer stretch is cut into blocks of
    `block` requests, all judged at once: first as if nothing had been admitted before, then again where the admitted requests
    that a block starts from turn out to be others, until none changes.  The first block is right from the start and each round
    makes one more right at least.  A task holds one block and `limit` times.  Keys are not NULL."""
    order, bucket, window_us = ["ts", "event_id"], ["_bucket"], window_seconds * 1_000_000
    rows = requests.select("key", "event_id", "ts").withColumn("_bucket", F.to_date("ts"))
    rows = previous(rows, ["key"], order, F.col("ts"), "_before", bucket)
    us = lambda c: F.unix_micros(c)
    pause = F.coalesce(us(F.col("ts")) - us(F.col("_before")) >= window_us, F.lit(True))
    cut = running_sums(rows.withColumn("_pause", pause), ["key"], order, {"_stretch": F.when(F.col("_pause"), 1), "_n": F.lit(1)}, bucket)
    place = F.col("_n") - 1
    keys = ["key", "_stretch", "_block"]
    placed = materialize(cut.select("key", "_stretch", F.floor(place / block).alias("_block"), "event_id", "ts", us(F.col("ts")).alias("us"),
                                    F.lit(False).alias("given"), ((place % block == 0) & ~F.col("_pause")).alias("_goes_on")))
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    names = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def sorted_rows(some: DataFrame, entries: DataFrame | None) -> DataFrame:
        """The rows of blocks behind the admitted requests that they start from."""
        if entries is not None:
            held = entries.select(*keys, F.explode("entry").alias("us"))
            some = some.unionByName(held.withColumns({"event_id": F.lit(None).cast(kinds["event_id"]), "ts": F.timestamp_micros("us"), "given": F.lit(True)}))
        return some.repartition(*keys).sortWithinPartitions(*keys, "us", F.col("given").desc(), "event_id")

    def leaves(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        """The admitted requests inside the window at the end of each block: the next one starts from them."""
        times = pdf["us"].to_numpy()
        allowed = _judged(times, group, limit, window_us)
        ends = np.flatnonzero(np.r_[group[1:] != group[:-1], True])
        begins = np.r_[0, ends[:-1] + 1]
        held = [times[a:b + 1][allowed[a:b + 1]][-limit:] for a, b in zip(begins, ends)] if limit else [times[:0]] * len(ends)
        out = pdf.loc[ends, keys].assign(entry=[h[times[b] - h < window_us] for h, b in zip(held, ends)])
        return out.assign(_block=out["_block"] + 1)

    def judge(pdf: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        return pdf.assign(allowed=_judged(pdf["us"].to_numpy(), group, limit, window_us)).loc[~pdf["given"].to_numpy(), ["key", "event_id", "ts", "allowed"]]

    def left_by(some: DataFrame, entries: DataFrame | None) -> DataFrame:
        return materialize(sorted_rows(some, entries).mapInPandas(lambda b: whole_groups(b, keys, leaves), f"{names}, entry array<bigint>"))

    entries, more = None, placed.where("_goes_on").select(*keys)
    placed = placed.drop("_goes_on")
    if not more.isEmpty():
        # the blocks that another one follows
        led = placed.join(more.withColumn("_block", F.col("_block") - 1), keys, "left_semi")
        known = entries = left_by(led, None)
        changed = known.where(F.size("entry") > 0)
        while not changed.isEmpty():
            again = left_by(led.join(changed, keys, "left_semi"), changed)
            old = known.withColumnRenamed("entry", "_old")
            turned = again.join(old, keys).where(F.col("entry") != F.col("_old")).drop("_old")
            known = materialize(known.join(turned.select(*keys), keys, "left_anti").unionByName(turned))
            changed = known.join(turned.select(*keys), keys, "left_semi")
        entries = known
    return sorted_rows(placed, entries).mapInPandas(lambda b: whole_groups(b, keys, judge), ADMITTED)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Admission(StatefulProcessor):
    """A key's admitted times inside the window, as a list; a timer drops them a window after the last of them."""

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.window_us = limit, window_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "ts long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # The requests of one key in one micro-batch; the source's rate limit bounds them.
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        before = np.array([t[0] for t in self.recent.get()] if self.recent.exists() else [], dtype="int64")
        times = np.r_[before, batch["us"].to_numpy()]
        allowed = _judged(times, np.zeros(len(times), dtype="int64"), self.limit, self.window_us)
        allowed[:len(before)] = True
        kept = times[allowed][-self.limit:] if self.limit else times[:0]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(kept):
            self.recent.put([(int(t),) for t in kept])
            self.handle.registerTimer(max(int(kept[-1] + self.window_us) // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key": key[0], "event_id": batch["event_id"], "ts": batch["ts"], "allowed": allowed[len(before):]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def admission_stream(requests: DataFrame, limit: int, window_seconds: int, watermark: str = "1 hour") -> DataFrame:
    """The same rule on a stream.  State per key: the admitted times inside the window, dropped when the watermark passes the last
    of them by a window.  Start it inside rocksdb_state, which sets the state store that lists and timers need."""
    return requests.withWatermark("ts", watermark).withColumn("us", F.unix_micros("ts")).groupBy("key").transformWithStateInPandas(
        Admission(limit, window_seconds), ADMITTED, "append", "eventTime")


def daily_cap(requests: DataFrame, limit: int, zone: str = V.LOCAL_ZONE) -> DataFrame:
    """The first `limit` requests of each local day are allowed.

    Spark keeps `limit` rows per day and partition to find each day's last allowed request; a busy day is never sorted whole.
    Every request is then compared with its day's mark."""
    from tallybook.operators.retrieval import ranked

    days = requests.withColumn("day", local_day(F.col("ts"), zone))
    at = F.struct("ts", "event_id")
    marks = ranked(days.select("day", "ts", "event_id"), ["day"], ["ts", "event_id"], limit, "_n").groupBy("day").agg(
        F.max(at).alias("_mark"))
    return days.join(marks, "day", "left").withColumn("allowed", F.coalesce(at <= F.col("_mark"), F.lit(False))).drop("_mark")


def daily_cap_stream(requests: DataFrame, limit: int, zone: str = V.LOCAL_ZONE, watermark: str = "1 day") -> DataFrame:
    """The daily cap on a stream: one counter per local day, dropped a day after the watermark leaves it."""
    def take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        allowed = [used + i < limit for i in range(len(rows))]
        state.update((min(limit, used + len(rows)),))
        end = int(pd.Timestamp(rows["ts"].max()).timestamp() * 1000) + 48 * 3600 * 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"day": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "allowed": allowed})

    dated = requests.withWatermark("ts", watermark).withColumn("day", local_day(F.col("ts"), zone))
    return dated.groupBy("day").applyInPandasWithState(
        take, "day date, event_id long, ts timestamp, allowed boolean", "used long", "append", GroupStateTimeout.EventTimeTimeout)


def has_text(event_type: Column, delta: Column) -> Column:
    return event_type.isin(V.TEXT_EVENTS) & (F.trim(F.coalesce(delta, F.lit(""))) != "")


def blank_runs(run_events: DataFrame, text: str = V.FALLBACK_TEXT) -> DataFrame:
    """run_events(run_id, type, delta, ts) with a fallback message for every run that finished without answer text before."""
    at = F.col("ts")
    runs = run_events.groupBy("run_id").agg(
        F.min(F.when(F.col("type") == V.RUN_FINISHED, at)).alias("finished"),
        F.min(F.when(has_text(F.col("type"), F.col("delta")), at)).alias("first_text"))
    blank = runs.where("finished is not null and (first_text is null or first_text > finished)")
    extra = blank.select("run_id", F.inline(F.array(*[
        F.struct(F.lit(kind).alias("type"), F.lit(delta).cast("string").alias("delta"), F.col("finished").alias("ts"))
        for kind, delta in (("TEXT_MESSAGE_START", None), ("TEXT_MESSAGE_CONTENT", text), ("TEXT_MESSAGE_END", None))])))
    return run_events.select("run_id", "type", "delta", "ts").withColumn("added", F.lit(False)).unionByName(
        extra.withColumn("added", F.lit(True)))


def blank_runs_stream(run_events: DataFrame, text: str = V.FALLBACK_TEXT, watermark: str = "10 minutes") -> DataFrame:
    """Fallback messages on a stream: emitted when a run's end arrives and no text came before it."""
    def guard(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        saw = bool(state.get[0]) if state.exists else False
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for kind, delta, ts in zip(rows["type"], rows["delta"], rows["ts"]):
            saw = saw or (kind in V.TEXT_EVENTS and bool((delta or "").strip()))
            if kind == V.RUN_FINISHED and not saw:
                out.append((key[0], text, ts))
                saw = True
        state.update((saw,))
        end = int(pd.Timestamp(rows["ts"].max()).timestamp() * 1000) + 3600 * 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["run_id", "delta", "ts"])

    return run_events.withWatermark("ts", watermark).groupBy("run_id").applyInPandasWithState(
        guard, "run_id string, delta string, ts timestamp", "saw boolean", "append", GroupStateTimeout.EventTimeTimeout)
