"""Incremental operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from sigflow.functions.derive import derive, row_wise


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stats(df: DataFrame, key: list[str], ts: str, v: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    g = df.withWatermark(ts, late).groupBy(*key, F.window(ts, window).alias("w"))
    return g.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def blocks(df: DataFrame, key: list[str], ts: str, v: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Reduced blocks and min/max/first buckets of event time."""
    g = df.withWatermark(ts, late).groupBy(*key, F.window(ts, window).alias("w"))
    return g.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"), F.sqrt(F.avg(F.col(v) * F.col(v))).alias("rms"), F.min_by(v, ts).alias("first"), F.count(v).alias("n"))


def derived(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Row-wise expressions only; those that need the order of rows raise."""
    return derive(df, {n: row_wise(e) for n, e in exprs.items()})


def alerts(df: DataFrame, limits: DataFrame, key: list[str], v: str) -> DataFrame:
    return df.join(limits, key).where((F.col(v) < F.col("lo")) | (F.col(v) > F.col("hi")))


class _InOrder(StatefulProcessor):
    """Rows of a series folded in the order of their times, however they arrive within the watermark's delay.

    Rows wait in state until the watermark has passed them; a timer at the earliest one then wakes the series. What has been
    folded is one small tuple. If no row is left and `idle` has passed since the last one, what is open is closed.
    Subclasses give schema, fold(state, rows) and flush(state), both with the finished rows.
    """

    schema: str
    columns: list[str]

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, tie long, v double")
        self.folded = handle.getValueState("folded", self.schema)
        self.wake = handle.getValueState("wake", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for some in rows:
            some = some[["us", "tie", "v"]]
            self.waiting.appendList(list(some.itertuples(index=False, name=None)))
            first = min(first or some["us"].min(), some["us"].min())
        if first is not None:
            self._wake_at(int(first) // 1000 + 1, earlier=self.waiting.exists())
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.wake.clear()
        now = timerValues.getCurrentWatermarkInMs()
        rows = pd.DataFrame(list(self.waiting.get()), columns=["us", "tie", "v"])
        ripe = rows["us"] // 1000 < now
        left, state, out = rows[~ripe], self.folded.get() if self.folded.exists() else None, []
        if ripe.any():
            state, out = self.fold(state, rows[ripe].sort_values(["us", "tie", "v"], kind="stable"))
        if len(left):
            self.waiting.put(list(left.itertuples(index=False, name=None)))
            self._wake_at(int(left["us"].min()) // 1000 + 1)
        else:
            self.waiting.clear()
            end = self.last(state) // 1000 + self.idle_ms
            if end >= now:
                self._wake_at(end + 1)
            else:
                state, more = self.flush(state)
                out = out + more
        self.folded.update(state)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["key", *self.columns])

    def _wake_at(self, ms: int, earlier: bool = False) -> None:
        set_ = self.wake.get()[0] if self.wake.exists() else None
        if set_ is not None and (set_ == ms or earlier and set_ < ms):
            return
        if set_ is not None:
            self.handle.deleteTimer(set_)
        self.handle.registerTimer(ms)
        self.wake.update((ms,))

    def close(self) -> None:
        pass


class _Runs(_InOrder):
    """State: rows so far, time of the last one, the open run (start, end, first row, rows; no rows: none)."""

    schema, columns = "seen long, last long, start long, end long, first long, n long", ["start_us", "end_us", "start_idx", "end_idx", "n"]

    def fold(self, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        seen, _, start, end, first, n = state or (0, 0, 0, 0, 0, 0)
        us, ok = rows["us"].to_numpy(), rows["v"].to_numpy() > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[n > 0], ok, [False]]).astype(np.int8)))
        runs, out = edges.tolist(), []
        if n:
            runs = [None, *runs]
        for a, b in zip(runs[::2], runs[1::2]):
            if a is None:
                run = (start, int(us[b - 1]) if b else end, first, n + b)
            else:
                run = (int(us[a]), int(us[b - 1]), seen + a, b - a)
            out.append(run)
        open_ = out.pop() if out and runs[-1] == len(ok) else (0, 0, 0, 0)
        return (seen + len(ok), int(us[-1]), *open_), [(s, e, f, f + m - 1, m) for s, e, f, m in out]

    def flush(self, state: tuple) -> tuple[tuple, list[tuple]]:
        seen, last, start, end, first, n = state
        return (seen, last, 0, 0, 0, 0), [(start, end, first, first + n - 1, n)] if n else []

    def last(self, state: tuple) -> int:
        return state[1]


class _Blocks(_InOrder):
    """State: rows so far, time of the last one, and of the open block the values and their sums, least and greatest."""

    schema, columns = "seen long, last long, n long, s1 double, s2 double, lo double, hi double", ["block", "min", "max", "avg", "rms", "n"]

    def __init__(self, idle_ms: int, size: int):
        super().__init__(idle_ms)
        self.size = size

    def fold(self, state: tuple | None, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
        seen, _, *open_ = state or (0, 0, 0, 0.0, 0.0, np.inf, -np.inf)
        v, out, at = rows["v"].to_numpy(dtype=float), [], 0
        while at < len(v):
            some = v[at : at + self.size - seen % self.size]
            at, seen = at + len(some), seen + len(some)
            some = some[~np.isnan(some)]  # nulls
            n, s1, s2, lo, hi = open_
            open_ = [n + len(some), s1 + some.sum(), s2 + (some * some).sum(), min([lo, *some]), max([hi, *some])]
            if seen % self.size == 0:
                out += self._row(seen, open_)
                open_ = [0, 0.0, 0.0, np.inf, -np.inf]
        return (seen, int(rows["us"].iloc[-1]), int(open_[0]), *map(float, open_[1:])), out

    def _row(self, seen: int, open_: list) -> list[tuple]:
        n, s1, s2, lo, hi = open_
        block = (seen - 1) // self.size
        return [(block, float(lo), float(hi), float(s1 / n), float(np.sqrt(s2 / n)), int(n)) if n else (block, None, None, None, None, 0)]

    def flush(self, state: tuple) -> tuple[tuple, list[tuple]]:
        seen, last, *open_ = state
        if seen % self.size == 0:
            return state, []
        # rows that still come open the next block
        return (-(-seen // self.size) * self.size, last, 0, 0.0, 0.0, np.inf, -np.inf), self._row(seen, open_)

    def last(self, state: tuple) -> int:
        return state[1]


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(df: DataFrame, key: str, ts: str, tie: str | None, v: Column, late: str, processor: _InOrder, result: str) -> DataFrame:
    """v is what a row adds, as a double. The watermark drops rows later than `late`; null keys are a series, null times none."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the only one with timers
    x = df.where(F.col(ts).isNotNull()).withWatermark(ts, late)
    x = x.select(F.col(key).cast("string").alias("key"), F.col(ts), F.unix_micros(ts).alias("us"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("tie"), v.cast("double").alias("v"))
    return x.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"key string, {result}", outputMode="append", timeMode="eventTime")


def _ms(interval: str) -> int:
    return int(pd.Timedelta(interval).total_seconds() * 1000)


def segments(df: DataFrame, key: str, ts: str, passing: str, late: str = "1 hour", idle: str = "1 hour", tie: str | None = None) -> DataFrame:
    """key, start_us, end_us, start_idx, end_idx, n: runs of passing rows in the order of time (and `tie`), as the batch operator
    gives them, whatever micro-batch a row came in. A run is emitted when the watermark has passed the failing row after it,
    or `idle` after the series' last row."""
    ok = F.coalesce(F.expr(passing).cast("double"), F.lit(0.0))
    return _in_order(df, key, ts, tie, ok, late, _Runs(_ms(idle)), "start_us long, end_us long, start_idx long, end_idx long, n long")


def count_blocks(df: DataFrame, key: str, ts: str, v: str, size: int = 500, late: str = "1 hour", idle: str = "1 hour", tie: str | None = None) -> DataFrame:
    """key, block, min, max, avg, rms, n: blocks of `size` rows of each series in the order of time (and `tie`). A block that is
    not full waits in state for the rows to come; it is emitted short `idle` after the series' last row. Null and NaN
    values take a row's place but no part."""
    return _in_order(df, key, ts, tie, F.col(v), late, _Blocks(_ms(idle), size), "block long, min double, max double, avg double, rms double, n long")


def limit_buckets(df: DataFrame, limits: DataFrame, key: list[str], ts: str, v: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Per window of event time: least and greatest value, the first row, and the first row outside the limits (key, lo, hi) of
    its series, each as (ts, v) with ties to the smaller value; without limits for a series it has no such row."""
    x = df.withWatermark(ts, late).join(limits, key, "left")
    row = F.struct(F.col(ts).alias("ts"), F.col(v).alias("v"))
    out = (F.col(v) < F.col("lo")) | (F.col(v) > F.col("hi"))
    by = lambda c: F.min(F.when(F.col(v).isNotNull() & ~F.isnan(v), F.struct(c.alias("by"), row.alias("row"))))["row"]
    g = x.groupBy(*key, F.window(ts, window).alias("w"))
    return g.agg(by(F.col(v)).alias("least"), by(-F.col(v)).alias("greatest"), F.min(row).alias("first"), F.min(F.when(out, row)).alias("first_outside"), F.count(v).alias("n"))
