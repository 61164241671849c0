"""Stored recordings: regions that skip chunks, views over levels, sketches of chunks, merged regions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sigflow.operators import cells, segments, series, stats, stored

SCHEMA = "k string, t double, v double"


def recording(spark, n=1200):
    rng = random.Random(1)
    rows = [("a", float(k), rng.gauss(0, 1) + (50 if 300 <= k < 420 or k in (7, 8, 777) else 0)) for k in range(n)]
    rows += [("b", float(k), float("nan") if k % 9 == 0 else None if k % 7 == 0 else float(k % 5)) for k in range(300)]
    rows += [("low", float(k), -9.0) for k in range(130)] + [(None, 1.0, 99.0), ("free", 1.0, 99.0)]
    return spark.createDataFrame(rows, SCHEMA)


LIMITS = [("a", -30.0, 30.0), ("b", 1.0, 3.0), ("low", 0.0, 1.0)]


def test_regions_by_chunks_are_those_of_all_rows(spark, tmp_path):
    df, limits = recording(spark), spark.createDataFrame(LIMITS, "k string, lo double, hi double")
    stored.store(df, ["k"], ["t", "v"], "t", ["v"], f"{tmp_path}/s", 40, 2, ())
    got = stored.violation_regions(spark, f"{tmp_path}/s", limits, ["k"], "v", 2)
    want = segments.half_open(segments.violations(df, limits, ["k"], ["t", "v"], "t", "v"))
    rows = lambda x: sorted(map(tuple, x.select("k", "start_row", "end_row").collect()))
    assert rows(got) == rows(want) and ("a", 300, 420) in rows(got) and ("low", 0, 130) in rows(got)
    assert stored.violation_regions(spark, f"{tmp_path}/s", limits.limit(0), ["k"], "v", 2).count() == 0


def scanned(df):
    """Rows that the scans of an executed plan gave."""
    plan, total = [df._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            plan.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            plan.append(p.plan())
        elif name == "FileSourceScanExec" and "start_row" not in p.simpleString(99):
            total += p.metrics().apply("numOutputRows").value()
        else:
            plan += [p.children().apply(k) for k in range(p.children().size())]
    return total


def test_only_folders_with_mixed_chunks_are_read(spark, tmp_path):
    df = spark.range(20_000).selectExpr("'a' AS k", "CAST(id AS double) AS t", "CAST(if(id BETWEEN 5990 AND 6010, 100, id % 10) AS double) AS v")
    stored.store(df, ["k"], ["t"], "t", ["v"], f"{tmp_path}/s", 100, 4, ())
    limits = spark.createDataFrame([("a", -1.0, 50.0)], "k string, lo double, hi double")
    got = stored.violation_regions(spark, f"{tmp_path}/s", limits, ["k"], "v", 4)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("a", 5990, 6011)]
    assert 0 < scanned(got) <= 1600


def test_choice_of_level():
    c = stored.choose_level
    assert c(19_999, [100], 1, 1920) is None and c(20_000, [100, 10_000], 1, 1920) == 100 and c(3_000_000, [100, 10_000], 1, 1920) == 10_000
    assert c(30_000_000, [100, 10_000, 100_000], 1, 1920) == 100_000 and c(30_000_000, [100], 1, 1920) == 100 and c(50_000, [10_000, 100_000], 1, 1920) == 10_000
    assert c(50_000, [], 1, 1920) is None and c(5000, [100], 6, 1920, 10) is None and c(5000, [100], 4, 1920, 10) == 100


def test_views(spark, tmp_path):
    df = recording(spark)
    path = f"{tmp_path}/s"
    stored.store(df, ["k"], ["t", "v"], "t", ["v"], path, 100, 4, (10, 100))
    rows = stored.view(spark, path, ["k"], "t", "v", 100.0, 199.0)
    assert sorted(map(str, rows.collect())) == sorted(map(str, df.where("t BETWEEN 100 AND 199").select("k", "t", "v", F.lit(0).alias("level")).collect()))
    far = stored.view(spark, path, ["k"], "t", "v", 0.0, 1199.0, 400, 100)
    assert {r["level"] for r in far.select("level").distinct().collect()} == {100}
    x = series.with_row_index(df, ["k"], ["t", "v"]).groupBy("k", F.floor(F.col("row_idx") / 100)).agg(F.min("t"), F.min("v"), F.max("t"), F.max("v")).collect()
    assert sorted(str(p) for r in x for p in ((r["k"], r[2], r[3]), (r["k"], r[4], r[5]))) == sorted(str((r["k"], r["t"], r["v"])) for r in far.collect())
    middle = stored.view(spark, path, ["k"], "t", "v", 0.0, 1199.0, 2, 100).where("k = 'a'").groupBy("t").count().collect()
    assert all(r["count"] == 2 for r in middle) and len(middle) == 12
    stored.store(df.limit(0), ["k"], ["t", "v"], "t", ["v"], f"{tmp_path}/none", 100, 4, (10,))
    assert stored.view(spark, f"{tmp_path}/none", ["k"], "t", "v", 0.0, 9.0).count() == 0


@pytest.mark.parametrize("span", [(0, 1200), (37, 1111), (5, 9)])
def test_quantiles_of_a_range_within_the_rank_error(spark, span):
    df = series.with_row_index(recording(spark), ["k"], ["t", "v"])
    fractions = [0.1, 0.5, 0.9]
    pre = stats.sketches(df, ["k"], "row_idx", "v", 50, 200)
    got = {r["k"]: r["q"] for r in stats.range_quantiles(pre, df, ["k"], "row_idx", "v", *span, 50, fractions, 200).collect()}
    values = {}
    for r in df.where(F.col("row_idx").between(span[0], span[1] - 1)).collect():
        if r["v"] is not None and r["v"] == r["v"]:
            values.setdefault(r["k"], []).append(r["v"])
    assert got.keys() == values.keys()
    for k, v in values.items():
        for f, q in zip(fractions, got[k]):
            below, upto = sum(x < q for x in v) / len(v), sum(x <= q for x in v) / len(v)
            assert below - 0.02 - 1 / len(v) <= f <= upto + 0.02 + 1 / len(v)


@pytest.mark.parametrize("small", [0, 1 << 70])
def test_merged_regions(spark, monkeypatch, small):
    monkeypatch.setattr(cells, "SMALL", small)
    monkeypatch.setattr(series, "CHUNK", 40)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), a, a + rng.choice([0, 1, 3, 60])) for a in (rng.randint(0, 4000) for _ in range(500))]
    got = sorted(map(str, segments.merge_regions(spark.createDataFrame(rows, "k string, s int, e int"), ["k"], "s", "e").collect()))
    want = []
    for k in {r[0] for r in rows}:
        mine = []
        for a, b in sorted(r[1:] for r in rows if r[0] == k):
            if mine and a <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], b)
            else:
                mine.append([a, b])
        want += [f"Row(k={k!r}, s={a}, e={b})" for a, b in mine]
    assert got == sorted(want)


def test_folders_do_not_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """Longer series have wider folders, not more of them, and the same regions."""
    monkeypatch.setattr(stored, "FOLDERS", 8, raising=False)
    df, limits = recording(spark, 4000), spark.createDataFrame(LIMITS, "k string, lo double, hi double")
    stored.store(df, ["k"], ["t", "v"], "t", ["v"], f"{tmp_path}/s", 40, 2, ())
    assert len(list((tmp_path / "s" / "rows").glob("part=*"))) <= 8
    got = stored.violation_regions(spark, f"{tmp_path}/s", limits, ["k"], "v", 2)
    want = segments.half_open(segments.violations(df, limits, ["k"], ["t", "v"], "t", "v"))
    rows = lambda x: sorted(map(tuple, x.select("k", "start_row", "end_row").collect()))
    assert rows(got) == rows(want) and ("a", 300, 420) in rows(got) and ("low", 0, 130) in rows(got)
