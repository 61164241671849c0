"""Cells with about equally many rows, exact quantiles, and conditions that reach the scan."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigflow.operators import cells, filters, series, stats
from sigflow.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def large(monkeypatch):
    monkeypatch.setattr(cells, "SMALL", 0)


def sizes(df, key, order, rows):
    x = cells.balanced(df, key, order, rows)
    return [(r["k"], r["n"], r["count"], r["lo"], r["hi"]) for r in x.groupBy("_chunk").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*order)).alias("lo"), F.max(F.struct(*order)).alias("hi")).select("_chunk.k", "_chunk.n", "count", "lo", "hi").collect()]


def test_cells_with_a_far_time_a_burst_and_a_heavy_series(spark):
    x = spark.range(300_000).selectExpr("if(id % 10 = 0, 'small', 'large') AS k", "CASE WHEN id = 7 THEN 1e15 WHEN id BETWEEN 100000 AND 199999 THEN 5e4 ELSE id * 0.5 END AS t", "id AS i")
    found = sizes(x, ["k"], ["t", "i"], 4000)
    assert sum(f[2] for f in found) == 300_000 and max(f[2] for f in found) <= 8000
    assert min(sum(1 for f in found if f[0]["k"] == k) for k in ("small", "large")) >= 4
    for k in ("small", "large"):
        mine = sorted((f for f in found if f[0]["k"] == k), key=lambda f: f[1])
        assert all(tuple(a[4]) < tuple(b[3]) for a, b in zip(mine, mine[1:]))


@pytest.mark.parametrize(("kind", "of"), [("string", "concat('same beginning ', lpad(id % 5000, 6, '0'))"), ("long", "(id % 5000) * 1844674407370955 - 4611686018427387904"), ("timestamp_ntz", "timestamp_ntz'2024-03-10 01:59:00' + make_interval(0, 0, 0, 0, 0, 0, (id % 5000) / 1000.0)"), ("date", "date_add(date'1970-01-01', CAST(id % 5000 AS int))"), ("decimal(20,4)", "CAST((id % 5000) / 10000.0 AS decimal(20,4))"), ("boolean", "id % 2 = 0"), ("timestamp", "timestamp_micros(id % 5000)")])
def test_cells_of_other_types(spark, kind, of):
    x = spark.range(10_000).selectExpr(f"CAST({of} AS {kind}) AS t", "id AS i")
    found = sorted(sizes(x, [], ["t", "i"], 500), key=lambda f: f[1])
    assert max(f[2] for f in found) <= 1000 and sum(f[2] for f in found) == 10_000
    assert all(tuple(a[4]) < tuple(b[3]) for a, b in zip(found, found[1:]))


def test_cells_of_rows_that_agree_and_of_no_rows(spark):
    x = spark.range(3000).selectExpr("CAST(null AS string) AS k", "1.5D AS t")
    assert [f[2] for f in sizes(x, ["k"], ["t"], 100)] == [3000]
    assert sizes(x.limit(0), ["k"], ["t"], 100) == []
    odd = spark.range(3000).selectExpr("CASE WHEN id % 5 = 0 THEN null WHEN id % 5 = 1 THEN double('NaN') WHEN id % 5 = 2 THEN double('-inf') WHEN id % 5 = 3 THEN double('inf') ELSE 1.0D END AS t", "id AS i")
    found = sizes(odd, [], ["t", "i"], 100)
    assert max(f[2] for f in found) <= 200 and sum(f[2] for f in found) == 3000
    x = series.with_row_index(odd, [], ["t", "i"]).orderBy("row_idx").collect()
    place = lambda t: (0, 0) if t is None else (2, 0) if t != t else (1, t)
    assert [r["i"] for r in x] == [r["i"] for r in sorted(x, key=lambda r: (place(r["t"]), r["i"]))]


def straight_quantile(values, f):
    v = sorted((x for x in values if x is not None), key=lambda x: (x != x, x))
    if not v:
        return None
    p = (len(v) - 1) * f
    a, b = v[math.floor(p)], v[math.ceil(p)]
    return a if a == b or p == math.floor(p) else (math.ceil(p) - p) * a + (p - math.floor(p)) * b


@pytest.mark.parametrize("parts", [1, 6])
def test_quantiles_are_exact(spark, monkeypatch, parts):
    monkeypatch.setattr(cells, "BUCKETS", 16)
    rng = random.Random(parts)
    rows = [("a", rng.gauss(0, 1)) for _ in range(2001)] + [("a", 1e300)] + [(None, float(rng.randint(0, 3))) for _ in range(500)]
    rows += [("one", 4.5), ("none", None), ("odd", float("nan")), ("odd", 2.0), ("odd", float("-inf")), ("two", -0.0), ("two", 1e-320)]
    rows += [("wide", x) for x in (-1.7e308, 1.7e308, 0.0, 5.0)] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(parts)
    fractions = [0.0, 0.05, 0.25, 0.5, 0.999, 1.0]
    got = {r["k"]: r["q"] for r in cells.quantiles(df, ["k"], "v", fractions).collect()}
    want = {k: [straight_quantile([v for x, v in rows if x == k], f) for f in fractions] for k in {r[0] for r in rows}}
    assert got.keys() == want.keys() and got["none"] is None
    for k in got:
        if k != "none":
            assert all(a == b or (a != a and b != b) for a, b in zip(got[k], want[k])), (k, got[k], want[k])
    assert cells.quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0
    monkeypatch.setattr(cells, "SMALL", 1 << 70)
    same = {r["k"]: r["q"] for r in cells.quantiles(df, ["k"], "v", fractions).collect()}
    assert same["a"] == got["a"] and same[None] == got[None]


def test_median_beside_statistics(spark, monkeypatch):
    df = spark.createDataFrame([("a", float(x * x % 17)) for x in range(60)] + [(None, 3.0), (None, None)], "k string, v double")
    got = sorted(map(str, stats.stats(df, ["k"], "v").select("k", "median", "count", "max").collect()))
    monkeypatch.setattr(cells, "SMALL", 1 << 70)
    assert got == sorted(map(str, stats.stats(df, ["k"], "v").select("k", "median", "count", "max").collect()))


def test_no_task_sorts_a_series_or_holds_its_values(spark):
    df = spark.range(1000).selectExpr("'a' AS k", "CAST(id AS double) AS t", "CAST(id % 7 AS double) AS v")
    for x in (series.with_row_index(df, ["k"], ["t"]), stats.stats(df, ["k"], "v"), stats.quartiles(df, ["k"], "v")):
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert "windowspecdefinition(k#" not in plan and "percentile(" not in plan and "median(" not in plan


# --- conditions


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize(("name", "wants"), [("p12_mask", ["Or(", "GreaterThan(value,100.0)", "LessThan(user_id,50)", "LessThanOrEqual(value,1.0)"]), ("p13_parameter_filter", ["GreaterThanOrEqual(value,20.0)", "LessThan(value,80.0)", "GreaterThan(user_id,10)"]), ("p18_segment_load", ["GreaterThan(l_quantity,20.0)", "LessThanOrEqual(l_discount,0.05)", "l_shipdate"])])
def test_comparisons_reach_the_scan(spark, name, wants):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: ")[1]
    assert all(w in pushed for w in wants) and not pushed.startswith("[]")


def test_conditions_of_null_and_nan(spark, tmp_path):
    values = [None, float("nan"), float("inf"), float("-inf"), 1.0, 2.0, 2.0 + 5e-11]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "i int, v double")
    passing = lambda c: sorted(r["i"] for r in df.where(c).collect())
    c = filters.cond
    assert passing(c("v", ">", 1)) == [2, 5, 6] and passing(c("v", ">=", 1)) == [2, 4, 5, 6] and passing(c("v", "<", 2)) == [3, 4] and passing(c("v", "<=", 2)) == [3, 4, 5]
    assert passing(c("v", "=", 2)) == [5, 6] and passing(c("v", "!=", 2)) == [2, 3, 4] and passing(c("v", "between", 1, 2)) == [4, 5]
    assert passing(filters.outside("v", 1, 2)) == [2, 3, 6] and passing(~filters.mask(c("v", ">", 1))) == [0, 1, 3, 4]
    assert df.select(filters.mask(c("v", ">", 1)).alias("m")).where("m is null").count() == 0
    df.write.parquet(f"{tmp_path}/t")
    plan = spark.read.parquet(f"{tmp_path}/t").where(filters.fold([("and", c("v", "=", 2)), ("and", c("i", "!=", 3))]))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v," in plan.split("PushedFilters: ")[1]


def test_cells_stay_balanced_as_noise_grows(spark):
    t = np.random.default_rng(1).lognormal(0, 6, 20_000)
    df = spark.createDataFrame([(float(x), k) for k, x in enumerate(t)], "t double, i int")
    found = sizes(df, [], ["t", "i"], 500)
    assert max(f[2] for f in found) <= 1000 and len(found) >= 20
