"""Every query with SQL against the small tables, and invariants of those without."""

from __future__ import annotations

import collections
import os

import numpy as np
import pytest

import compare
from sigflow.operators import asof, cells, downsample, filters, rolling, series, stats
from sigflow.operators import segments as S
from sigflow.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, duck, name, monkeypatch):
    monkeypatch.setattr(series, "CHUNK", 256)  # several cells and chunks a series, even here
    monkeypatch.setattr(cells, "SMALL", 0)
    got = compare.plain(catalog.QUERIES[name](spark, DATA).toPandas())
    want = compare.plain(duck.execute(catalog.ORACLE[name]).fetchdf())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


@pytest.fixture
def small(monkeypatch):
    """Tables made in memory have no known size; these tests are not about large ones."""
    monkeypatch.setattr(cells, "SMALL", 1 << 70)


def straight_lttb(t, v, points):
    n, width = len(t), (len(t) - 2) / (points - 2)
    bucket = np.minimum(np.floor((np.arange(n) - 1) / width).astype(int) + 1, points - 2)
    bucket[0], bucket[-1] = 0, points - 1
    mt = np.array([t[bucket == b].mean() for b in range(points)])
    mv = np.array([v[bucket == b].mean() for b in range(points)])
    return downsample.lttb_pick(bucket, t, v, mt, mv)


def test_lttb_by_hulls_is_the_straight_pass(spark):
    rng = np.random.default_rng(3)
    t, v = np.arange(3000.0), np.cumsum(rng.normal(size=3000))
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(t, v)], "k string, t double, v double")
    got = sorted(r["row_idx"] for r in downsample.lttb(df, ["k"], ["t"], "t", "v", 100).collect())
    assert got == straight_lttb(t, v, 100).tolist()


def lttb_series():
    """Walks, whole numbers with ties, equal values, lines, bursts at one time, bends and NaN."""
    rng = np.random.default_rng(8)
    t = np.arange(2500.0)
    return {
        "walk": (t, np.cumsum(rng.normal(size=2500))), "whole": (t, rng.integers(-3, 4, 2500) * 1.0), "flat": (t, np.full(2500, 2.0)), "line": (t, 3 * t),
        "burst": (np.sort(rng.integers(0, 40, 2500)) * 1.0, rng.integers(-9, 9, 2500) * 1.0), "bend": (t, (t - 1000) ** 2), "nan": (t, np.where(t % 611 == 17, np.nan, rng.integers(-5, 5, 2500) * 1.0)),
        "short": (t[:90], t[:90] % 7), None: (t, rng.integers(0, 2, 2500) * 1.0),
    }


@pytest.mark.parametrize("chunk", [10_000_000, 170])
def test_lttb_in_ranges_is_the_straight_pass(spark, monkeypatch, chunk):
    monkeypatch.setattr(series, "CHUNK", chunk)
    rows = [(k, int(n), float(a), float(b)) for k, (t, v) in lttb_series().items() for n, (a, b) in enumerate(zip(t, v))]
    df = spark.createDataFrame(rows, "k string, n long, t double, v double").repartition(5)
    want = {k: list(range(90)) if k == "short" else straight_lttb(t, v, 100).tolist() for k, (t, v) in lttb_series().items()}
    for together in (4096, 10):
        got = collections.defaultdict(list)
        for r in downsample.lttb(df, ["k"], ["t", "n"], "t", "v", 100, together).collect():
            got[r["k"]].append(r["row_idx"])
        assert {k: sorted(x) for k, x in got.items()} == want, together
    assert downsample.lttb(df.limit(0), ["k"], ["t", "n"], "t", "v", 100, 10).count() == 0


def corners(t, v):
    """Positions of a convex hull by the plain chain, both sides."""
    out = set()
    for sign in (1, -1):
        chain = []
        for k in range(len(t)):
            while len(chain) > 1 and sign * ((t[chain[-1]] - t[chain[-2]]) * (v[k] - v[chain[-2]]) - (v[chain[-1]] - v[chain[-2]]) * (t[k] - t[chain[-2]])) <= 0:
                chain.pop()
            chain.append(k)
        out.update(chain)
    return out


def test_hulls_stay_small_and_hold_every_corner():
    rng = np.random.default_rng(9)
    t, bucket = np.arange(20_000.0), np.arange(20_000) // 5000
    for v in (rng.normal(size=20_000), np.full(20_000, 1.0), 2 * t, np.sin(t / 300)):
        at = downsample.hull_rows(t, v, bucket)
        for angle in rng.normal(size=(50, 2)):
            for b in range(4):
                own, kept = bucket == b, at[bucket[at] == b]
                assert np.isclose((angle[0] * t[own] + angle[1] * v[own]).max(), (angle[0] * t[kept] + angle[1] * v[kept]).max())
        exact = sum(len(corners(t[bucket == b], v[bucket == b])) for b in range(4))
        assert exact <= len(at) <= exact + 4 * 8, (exact, len(at))
    assert len(downsample.hull_rows(t, np.full(20_000, 1.0), bucket)) <= 16


def test_spikes_survive_smart(spark, small):
    v = np.sin(np.arange(4000) / 100) * 5
    v[[1000, 2500]] = [100, -80]
    df = spark.createDataFrame([("a", float(k), float(x)) for k, x in enumerate(v)], "k string, t double, v double")
    got = {r["row_idx"] for r in downsample.smart(df, ["k"], ["t"], "t", "v", 400, -50, 50).collect()}
    assert {1000, 2500} <= got and len(got) < 800


def straight_prominence(v, at, lowest):
    left = [k for k in range(at) if v[k] > v[at]]
    right = [k for k in range(at + 1, len(v)) if v[k] > v[at]]
    a, b = (left[-1] + 1 if left else 0), (right[0] if right else len(v))
    depths = v[at] - np.nanmin(v[a : at + 1]), v[at] - np.nanmin(v[at:b])
    return max(depths) if lowest else min(depths)


@pytest.mark.parametrize(("fan", "variant", "parts"), [(3, "B", 1), (4, "A", 16), (256, "B", 4)])
def test_prominence_is_the_straight_scan(spark, fan, variant, parts):
    rng = np.random.default_rng(5)
    k = np.arange(400)
    series = {"walk": np.cumsum(rng.normal(size=400)), "ramp": k * 0.1 + (k % 6) * 1.0, "fall": -k * 0.1 + (k % 6) * 1.0, "level": np.where(k % 5 == 0, 3.0, 1.0), "short": np.array([1.0, 2.0]), None: rng.integers(0, 5, 300).astype(float)}
    series["gaps"] = np.where(k % 41 == 7, np.nan, series["walk"][::-1])
    rows = [(name, i, float(x) if x == x or i % 2 else None) for name, v in series.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(parts)
    got = {(r["k"], r["row_idx"], r["kind"]): r["prominence"] for r in downsample.with_prominence(df, ["k"], ["t"], "v", 2, 0.0, variant, fan).collect()}
    want = {}
    for name, v in series.items():
        for r in downsample.extrema(df.where(df["k"].eqNullSafe(name)), ["k"], ["t"], "v", 2).collect():
            if r["v"] == r["v"]:
                sign = 1 if r["kind"] == "peak" else -1
                want[name, r["row_idx"], r["kind"]] = straight_prominence(sign * v, r["row_idx"], variant == "A")
    assert len(want) > 200 and got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_prominence_of_no_rows(spark, small):
    df = spark.createDataFrame([], "k string, t int, v double")
    assert downsample.with_prominence(df, ["k"], ["t"], "v").count() == 0
    flat = spark.range(50).selectExpr("'a' AS k", "id AS t", "CAST(id % 5 AS double) AS v")
    assert downsample.with_prominence(flat, [], ["t"], "v", 2, 0.0).count() > 0


def test_smart_fill_keeps_its_distance(spark, small):
    df = spark.range(3000).selectExpr("'a' AS k", "CAST(id AS double) AS t", "sin(id / 50.0) AS v")
    rows = sorted((r["row_idx"], r["kind"]) for r in downsample.smart(df, ["k"], ["t"], "t", "v", 2000).collect())
    assert all(b[0] - a[0] > 3 for a, b in zip(rows, rows[1:]) if "lttb" in (a[1], b[1]))


def test_smart_stats(spark, small):
    df = spark.range(3000).selectExpr("if(id < 2900, 'a', null) AS k", "CAST(id AS double) AS t", "sin(id / 50.0) + if(id = 1500, 9, 0) AS v")
    picked = downsample.quick(df.where("k = 'a'"), ["k"], ["t"], "t", "v", 300, 5.0)
    (row,) = downsample.smart_stats(picked, df, ["k"]).collect()
    assert row["spike"] == 1 and row["picked"] == picked.count() == sum(row[x] for x in ("spike", "peak", "valley", "change", "lttb"))
    assert row["rows"] == 2900 and abs(row["ratio"] - 2900 / row["picked"]) < 1e-12


ODD = "k string, t double, v double"


def odd_rows():
    rng = np.random.default_rng(11)
    t = np.cumsum(rng.exponential(size=400)).round(1)
    t[300:] += 5000  # a gap: most cells are empty
    rows = [("a", float(x), float(y)) for x, y in zip(t, rng.normal(size=400).cumsum())]
    rows += [(None, float(x), float(x % 7)) for x in range(150)]
    return rows + [("b", None, 1.0), ("b", float("-inf"), 2.0), ("b", 3.0, 3.0), ("b", float("inf"), 4.0), ("b", float("nan"), 5.0), ("one", 1.0, 1.0)]


@pytest.mark.parametrize("parts", [1, 16])
def test_row_index_in_cells(spark, monkeypatch, parts):
    rows = odd_rows()
    place = lambda t: (0, 0.0) if t is None else (2, 0.0) if t != t else (1, t)
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (place(r[1]), r[2]))
        want |= {(k, r[2], str(r[1])): (i, len(mine)) for i, r in enumerate(mine)}
    monkeypatch.setattr(series, "CHUNK", 40)
    df = spark.createDataFrame(rows, ODD).repartition(parts)
    got = series.with_row_index(df, ["k"], ["t", "v"], total="n").collect()
    assert {(r["k"], r["v"], str(r["t"])): (r["row_idx"], r["n"]) for r in got} == want and len(got) == len(rows)
    assert series.with_row_index(df.limit(0), ["k"], ["t"]).count() == 0
    assert sorted(r["row_idx"] for r in series.with_row_index(df, [], ["k", "t", "v"]).collect()) == list(range(len(rows)))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("parts", [5])
def test_chunks_change_no_result(spark, monkeypatch, parts):
    df = spark.createDataFrame([r for r in odd_rows() if r[1] is not None and abs(r[1]) < 1e9], ODD).repartition(parts)
    key, order = ["k"], ["t", "v"]
    limits = spark.createDataFrame([("a", -2.0, 2.0)], "k string, lo double, hi double")
    probes = spark.createDataFrame([("a", x * 37.7) for x in range(-2, 160)], "k string, probe_t double")
    forms = {
        "rolling": lambda: rolling.rolling_stats(df, key, order, "v", 7), "running": lambda: rolling.running(df, key, order, "v"), "deviation": lambda: rolling.deviation(df, key, order, "v", 5),
        "previous": lambda: rolling.deviation(df, key, order, "v", 5, "previous"), "smooth": lambda: rolling.smooth(df, key, order, "v", 6), "slopes": lambda: rolling.derivative(df, key, order, "t", "v"),
        "inflections": lambda: rolling.inflections(df, key, order, "t", "v"), "extrema": lambda: rolling.extrema(df, key, order, "v", 3), "threshold": lambda: stats.threshold_stats(df, key, order, "t", "v", 1.0),
        "duty": lambda: stats.duty_cycle(df, key, order, "t", "v"), "rank": lambda: stats.percentile_rank(df, key, "v", 30), "violations": lambda: S.violations(df, limits, key, order, "t", "v"),
        "inside": lambda: S.in_segments(df, S.violations(df, limits, key, order, "t", "v"), key, "t", "start_t", "end_t", "left_anti"), "at": lambda: asof.value_at(df, probes, key, "t", "v"),
        "snap": lambda: asof.snap(df, probes, key, "t", "v"), "lttb": lambda: downsample.lttb(df.where("k = 'a'"), key, order, "t", "v", 20),
    }
    flat = lambda rows: sorted(str([round(x, 6) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)
    for name, form in forms.items():
        monkeypatch.setattr(cells, "SMALL", 1 << 70)
        want = flat(form().collect())
        monkeypatch.setattr(cells, "SMALL", 0)
        monkeypatch.setattr(series, "CHUNK", 60)
        got = form()
        assert flat(got.collect()) == want and want, name
        assert "windowspecdefinition(k#" not in plan_of(got), name


def test_snap_takes_the_nearest_of_all_series(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("b", 1.0, 11.0), ("b", 4.0, 12.0), ("a", 4.0, None), (None, 9.0, 13.0)], ODD)
    probes = spark.createDataFrame([(0.0,), (2.5,), (2.6,), (8.0,), (99.0,), (2.6,), (None,)], "probe_t double")
    got = {r["probe_t"]: (r["k"], r["at"], r["value"]) for r in asof.snap(df, probes, ["k"], "t", "v").collect()}
    assert got == {0.0: ("a", 1.0, 10.0), 2.5: ("a", 1.0, 10.0), 2.6: ("b", 4.0, 12.0), 8.0: (None, 9.0, 13.0), 99.0: (None, 9.0, 13.0)}
    assert asof.snap(df.limit(0), probes, ["k"], "t", "v").count() == 0


def straight_dedup(points, distance):
    kept = []
    for p in sorted(points, key=lambda p: (p[0], -p[1], p[2])):
        if kept and p[0] - kept[-1][0] <= distance:
            if p[1] > kept[-1][1]:
                kept[-1] = p
        else:
            kept.append(p)
    return kept


@pytest.mark.parametrize(("chunk", "distance"), [(1, 3), (64, 5)])
def test_proximity_dedup_by_chunks(spark, monkeypatch, chunk, distance):
    monkeypatch.setattr(series, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    rows = [(k, int(i), float(s), str(rng.choice(["peak", "limit", "change"]))) for k in ("a", None) for i, s in zip(np.sort(rng.integers(0, 300, 220)), rng.integers(0, 6, 220) / 5)]
    rows += [("ramp", k, float(k), "peak") for k in range(150)] + [("fall", k, float(-k), "peak") for k in range(150)] + [("one", 4, 0.5, "peak")]
    rows += [("far", k * 9, 0.5, "peak") for k in range(40)]
    df = spark.createDataFrame(rows, "k string, row_idx long, significance double, kind string")
    got = sorted(map(str, downsample.proximity_dedup(df, ["k"], distance).collect()))
    want = [f"Row(k={k!r}, row_idx={p[0]}, significance={p[1]!r}, kind={p[2]!r})" for k in {r[0] for r in rows} for p in straight_dedup([r[1:] for r in rows if r[0] == k], distance)]
    assert got == sorted(want)
    assert downsample.proximity_dedup(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("chunk", [30, 1_000_000])
def test_wide_extrema(spark, monkeypatch, chunk):
    monkeypatch.setattr(series, "CHUNK", chunk)
    monkeypatch.setattr(cells, "SMALL", 0 if chunk == 30 else 1 << 70)
    rng = np.random.default_rng(8)
    rows = [(k, i, float(x)) for k in ("a", None) for i, x in enumerate(rng.integers(0, 2000, 300))]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    forms = {}
    for wide in (1, 10_000):
        monkeypatch.setattr(rolling, "WIDE", wide)
        for w in (3, 50):
            forms[wide, w] = sorted(map(str, rolling.extrema(df, ["k"], ["t"], "v", w).select("k", "t", "v", "kind").collect()))
    assert all(forms[1, w] == forms[10_000, w] for w in (3, 50)) and len(forms[1, 50]) >= 2
