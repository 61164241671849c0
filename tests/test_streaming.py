"""Streams over the events give what a batch gives over the same rows."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigflow.operators import filters, segments, series, stats
from sigflow.streaming import stream

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """The events in time order as eight files, and a last row far ahead that closes every window."""
    path = str(tmp_path_factory.mktemp("events"))
    x = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    for k in range(8):
        x.where((F.dayofmonth("ts") - 1) % 32 >= 4 * k).where((F.dayofmonth("ts") - 1) % 32 < 4 * k + 4).coalesce(1).write.mode("append").parquet(path)
    return path, spark.read.parquet(path)


def run(spark, df, tmp_path, mode="append"):
    name = f"sink_{abs(hash(str(tmp_path)))}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def keyed(df, *cols):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("operator", [stream.stats, stream.blocks])
def test_windows_as_in_batch(spark, events, tmp_path, operator):
    path, batch = events
    source = stream.read(spark, path, batch.schema, 1)
    late = {"window": "1 day", "late": "40 days"}
    got = run(spark, operator(source, ["event_type"], "ts", "value", **late), tmp_path, "complete")
    want = operator(batch, ["event_type"], "ts", "value", **late)
    cols = ["event_type", "w.start", *[c for c in want.columns if c not in ("event_type", "w")]]
    assert keyed(got, *cols) == keyed(want, *cols) and got.count() > 50


def test_derived_and_alerts_as_in_batch(spark, events, tmp_path):
    path, batch = events
    limits = batch.groupBy("event_type").agg(F.lit(5.0).alias("lo"), F.lit(100.0).alias("hi"))
    limits = spark.createDataFrame(limits.collect(), limits.schema)
    both = lambda x: stream.alerts(stream.derived(x, {"double_": "value * 2"}), limits, ["event_type"], "value")
    got = run(spark, both(stream.read(spark, path, batch.schema, 2)), tmp_path)
    assert keyed(got, "event_id", "double_") == keyed(both(batch), "event_id", "double_") and got.count() > 10


@pytest.fixture(scope="module")
def shuffled(spark, events, tmp_path_factory):
    """The events dealt over eight files in any order, all within the delay, then a row far ahead."""
    path, batch = str(tmp_path_factory.mktemp("shuffled")), events[1]
    x = batch.withColumn("f", F.pmod(F.xxhash64("event_id"), F.lit(8)))
    x = x.withColumn("value", F.when(F.col("event_id") % 50 == 0, None).otherwise(F.col("value"))).withColumn("event_type", F.when(F.col("event_type") == "click", None).otherwise(F.col("event_type")))
    for k in range(8):
        x.where(F.col("f") == k).drop("f").coalesce(1).write.mode("append").parquet(path)
    rows = spark.read.parquet(path).where("event_type is null or event_type <> 'far'")
    far = rows.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("event_type", F.lit("far"))
    far.coalesce(1).write.mode("append").parquet(path)
    return path, rows


def test_segments_of_late_rows_are_those_of_the_batch(spark, shuffled, tmp_path):
    path, batch = shuffled
    source = stream.read(spark, path, batch.schema, 1)
    got = run(spark, stream.segments(source, "event_type", "ts", "value >= 50", "60 days", "1 day", "event_id"), tmp_path)
    x = batch.withColumn("t", F.unix_micros("ts"))
    want = segments.segments(x, ["event_type"], ["ts", "event_id"], "t", filters.cond("value", ">=", 50))
    rows = lambda df, *c: sorted((str(r) for r in df.select(*c).collect()))
    got = got.where("key is null or key <> 'far'").select(F.col("key").alias("event_type"), F.col("start_us").alias("start_t"), F.col("end_us").alias("end_t"), "start_idx", "end_idx", "n")
    assert rows(got, *got.columns) == rows(want.select(*got.columns), *got.columns) and got.count() > 100


@pytest.mark.parametrize("size", [1, 7, 500])
def test_count_blocks_of_late_rows_are_those_of_the_batch(spark, shuffled, tmp_path, size):
    path, batch = shuffled
    source = stream.read(spark, path, batch.schema, 3)
    got = run(spark, stream.count_blocks(source, "event_type", "ts", "value", size, "60 days", "1 day", "event_id"), tmp_path)
    x = series.with_row_index(batch, ["event_type"], ["ts", "event_id"])
    want = stats.reduce_blocks(x, ["event_type"], "row_idx", "value", size).withColumnRenamed("event_type", "key")
    flat = lambda df: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in df.select("key", "block", "min", "max", "avg", "rms", "n").collect())
    assert flat(got.where("key is null or key <> 'far'")) == flat(want)


def test_runs_and_blocks_fold_alike_however_they_are_cut():
    rng = np.random.default_rng(2)
    for trial in range(60):
        n = int(rng.integers(1, 40))
        rows = pd.DataFrame({"us": np.arange(n) * 10, "tie": 0, "v": (rng.random(n) < 0.6).astype(float)})
        cuts = sorted({0, n, *rng.integers(0, n, 4).tolist()})
        for whole in (stream._Runs(0), stream._Blocks(0, 6)):
            state, want = whole.fold(None, rows)
            part, got = None, []
            for a, b in zip(cuts, cuts[1:]):
                part, more = whole.fold(part, rows.iloc[a:b])
                got += more
            assert (part, got) == (state, want) and whole.flush(part) == whole.flush(state)
    ok = rows["v"] > 0
    state, out = stream._Runs(0).fold(None, rows)
    assert sum(r[-1] for r in out) + state[-1] == ok.sum()


def test_limit_buckets_as_in_batch(spark, events, tmp_path):
    path, batch = events
    limits = spark.createDataFrame([("click", 20.0, 100.0), ("view", 5.0, 60.0)], "event_type string, lo double, hi double")
    f = lambda x: stream.limit_buckets(x, limits, ["event_type"], "ts", "value", "1 day", "40 days").select("event_type", F.col("w.start").alias("at"), "least", "greatest", "first", "first_outside", "n")
    got = run(spark, f(stream.read(spark, path, batch.schema, 2)), tmp_path, "complete")
    same = lambda df: sorted(map(str, df.collect()))
    assert same(got) == same(f(batch)) and got.where("first_outside is not null").count() > 10
    row = f(batch).where("event_type = 'click' and first_outside is not null").first()
    assert not 20 <= row["first_outside"]["v"] <= 100 and row["first"]["ts"] <= row["first_outside"]["ts"]
