"""What the findings of round 3 named, on small tables that show it."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as entry
from sigflow.operators import cells, downsample, series


def test_logarithm_of_zero_and_below(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(1, 0.0), (2, -4.0), (3, 100.0), (4, None), (5, float("nan"))], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: r["l"] for r in entry.queries()["f03_functions"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view events as select event_id, value from '{tmp_path}/events.parquet/*.parquet' where event_id <> 2")
    want = {r[0]: r[1] for r in con.execute("select event_id, round(log10(value), 8) from events").fetchall()}
    assert got[1] == want[1] == -math.inf and got[3] == want[3] == 2.0 and got[4] is want[4] is None
    assert math.isnan(got[5]) and math.isnan(want[5]) and math.isnan(got[2])


@pytest.mark.parametrize("small", [cells.SMALL, 0])
def test_gaps_leave_out_rows_that_share_a_time_with_a_segment(spark, tmp_path, monkeypatch, small):
    import duckdb

    monkeypatch.setattr(cells, "SMALL", small)
    duckdb.sql(f"""COPY (FROM (VALUES (1, 'a', 1, 60.0), (2, 'a', 1, 10.0), (3, 'a', 2, 20.0), (4, 'a', 3, 5.0), (5, 'a', 3, 70.0), (6, 'a', 3, 80.0), (7, 'a', 3, 1.0), (8, NULL, 1, 90.0), (9, NULL, 1, 2.0))
        v(event_id, event_type, s, value) SELECT event_id::BIGINT AS event_id, event_type, 1::BIGINT AS user_id, TIMESTAMP '2024-01-01' + to_seconds(s) AS ts, value::DOUBLE AS value, '' AS props) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    got = sorted(tuple(r) for r in entry.queries()["g06_gaps"](spark, str(tmp_path)).fillna({"value": -1.0, "event_type": "-"}).collect())
    con = duckdb.connect()
    con.execute(f"set timezone = 'UTC'; create view events as from '{tmp_path}/events.parquet'")
    want = con.execute(f"select coalesce(event_type, '-'), t, coalesce(value, -1) from ({entry.oracle_sql()['g06_gaps']})").fetchall()
    assert len(got) == 7 and got == sorted(want)


def test_depth_of_the_join_does_not_follow_the_pairs_at_hand(spark, monkeypatch):
    from sigflow.llm import jaccard

    rows = []
    for k in range(40):
        base = [f"w{k}x{j}" for j in range(400)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:-1], "other"]))]  # likeness 0.995
    depths, real = [], jaccard.candidate_groups
    monkeypatch.setattr(jaccard, "candidate_groups", lambda sets, depth: depths.append(depth) or real(sets, depth))
    out = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("n_links = 1").count() == 80
    assert depths == [6] and jaccard.forest_recall(0.8, 24, 6) >= 0.999


@pytest.mark.parametrize("held", [1_000_000, 7])
def test_uniques_are_counted_in_tasks_of_bounded_size(spark, monkeypatch, held):
    from sigflow.operators import quality

    monkeypatch.setattr(quality, "HELD", held)
    df = spark.range(40).selectExpr("if(id % 5 = 0, null, id % 7) as a", "1 as b", "cast(null as string) as c")
    out = quality.profile(df, ["a", "b", "c"])
    assert [(r["column"], r["total"], r["nulls"], r["uniques"]) for r in out.collect()] == [("a", 40, 8, 7), ("b", 40, 0, 1), ("c", 40, 40, 0)]
    assert quality.profile(df.limit(0), ["a"]).first()["uniques"] == 0
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [cells.SMALL, 0])
def test_series_functions_get_cells_and_what_was_before(spark, tmp_path, monkeypatch, small):
    import duckdb

    from sigflow.operators import downsample, series

    monkeypatch.setattr(cells, "SMALL", small)
    monkeypatch.setattr(series, "CHUNK", 64)
    duckdb.sql(f"""COPY (SELECT range AS event_id, CASE WHEN range % 3 = 0 THEN 'a' END AS event_type, range AS user_id, TIMESTAMP '2024-01-01' + to_seconds(range // 2) AS ts,
        CASE WHEN range > 4 AND range % 7 <> 0 THEN range / 4 END AS value, '' AS props FROM range(600)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    sizes = downsample.apply_series(spark.read.parquet(f"{tmp_path}/events.parquet"), ["event_type"], ["ts", "event_id"], lambda x: x.iloc[:1].assign(n=len(x))[["n"]], "n long")
    assert max(r["n"] for r in sizes.collect()) <= (400 if small else 32)
    got = {r["event_id"]: r["total"] for r in entry.queries()["x03_series_functions"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view events as from '{tmp_path}/events.parquet'")
    assert got == dict(con.execute(entry.oracle_sql()["x03_series_functions"]).fetchall())


def test_rows_are_numbered_once_for_all_steps(spark, monkeypatch):
    times, real = [], cells.balanced
    monkeypatch.setattr(cells, "SMALL", 0)
    monkeypatch.setattr(series, "CHUNK", 400)
    monkeypatch.setattr(cells, "balanced", lambda *a: times.append(1) or real(*a))
    df = spark.range(1500).selectExpr("'a' AS k", "CAST(id AS double) AS t", "if(id % 3 = 1, NULL, CAST(pmod(hash(id), 1000) AS double)) AS v")
    got = {r["row_idx"]: (r["t"], r["v"]) for r in downsample.lttb_critical(df, ["k"], ["t"], "t", "v", 200, 20).collect()}
    assert len(times) == 1
    # rows without a value are none that LTTB picks, and row_idx is the place among all rows
    assert {0, 1499} <= got.keys() and all(t == i and v is not None for i, (t, v) in got.items())
