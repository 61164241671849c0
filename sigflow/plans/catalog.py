"""Registered queries of the series operators, each with the SQL that gives the same rows.

Floats are rounded alike on both sides; times are seconds from epoch microseconds.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigflow.functions import derive as D
from sigflow.operators import asof, cells, downsample, filters, quality, rolling, scratch, segments, series, stats, stored
from sigflow.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEY, ORDER = ["event_type"], ["ts", "event_id"]
EV = "ev AS (SELECT event_id, event_type, user_id, ts, epoch_us(ts) / 1e6 AS t, value, props, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events)"
WIN = "PARTITION BY event_type ORDER BY ts, event_id"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql if sql.lstrip().upper().startswith(("WITH", "SELECT")) else f"WITH {EV} " + sql.lstrip("+ ")
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return x.withColumn("t", F.unix_micros("ts") / F.lit(1e6))


def r(c: str | Column, n: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def rounded(df: DataFrame, *cols: str, n: int = 4) -> DataFrame:
    return df.withColumns({c: r(c, n) for c in cols})


# --- scans, projections, filters


@query("s08_parquet_scan", "SELECT event_id, event_type, value FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", "event_type", "value")


@query("s11_sample_rate", "+, g AS (SELECT event_type, i, t - lag(t) OVER (PARTITION BY event_type ORDER BY i) AS dt FROM ev) SELECT event_type, round(1 / median(dt), 4) AS hz FROM g WHERE i < 100 GROUP BY event_type")
def _(s, d):
    return rounded(series.rate(ev(s, d), KEY, ORDER, "t"), "hz")


@query("p02_filter", "SELECT event_id, value FROM events WHERE value > 100 AND event_type = 'click'")
def _(s, d):
    return table(s, d, "events").where((F.col("value") > 100) & (F.col("event_type") == "click")).select("event_id", "value")


@query("p03_head", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 50")
def _(s, d):
    return series.head(ev(s, d), ORDER, 50).select("event_id", "value")


@query("p03_tail", "SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(s, d):
    return series.tail(ev(s, d), ORDER, 50).select("event_id", "value")


@query("p03_slice", "+SELECT event_type, i AS row_idx, value FROM ev WHERE i BETWEEN 100 AND 149")
def _(s, d):
    return series.slice_rows(ev(s, d), KEY, ORDER, 100, 50).select("event_type", "row_idx", "value")


@query("p04_row_index", "+SELECT event_id, i AS row_idx FROM ev")
def _(s, d):
    return series.with_row_index(ev(s, d), KEY, ORDER).select("event_id", "row_idx")


@query("p04_row_index_giant", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx FROM events")
def _(s, d):
    return series.with_row_index_wide(ev(s, d), ORDER).select("event_id", "row_idx")


@query("p06_time_range", "SELECT event_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")
def _(s, d):
    return series.time_range(ev(s, d), "ts", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-10").cast("timestamp")).select("event_id", "value")


@query("p07_clean", "SELECT event_id, CASE WHEN isnan(value) OR isinf(value) THEN NULL ELSE value END AS value FROM events")
def _(s, d):
    return quality.clean(table(s, d, "events"), ["value"]).select("event_id", "value")


@query("p08_normalize_time", "SELECT event_id, round(epoch_us(ts) / 1e6, 3) AS t FROM events")
def _(s, d):
    x = ev(s, d).withColumn("text", F.replace(r("t", 3).cast("decimal(20,3)").cast("string"), F.lit("."), F.lit(",")))
    return rounded(quality.normalize_time(x.drop("t"), "text").select("event_id", "t"), "t", n=3)


@query("p09_synthetic_time", "+SELECT event_id, round(10 + i / 50.0, 6) AS t FROM ev")
def _(s, d):
    return rounded(series.synthetic_time(ev(s, d), KEY, ORDER, 50.0, 10.0).select("event_id", "t"), "t", n=6)


@query("p10_unix_time", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS label FROM events")
def _(s, d):
    ms = F.unix_micros("ts") / 1000.0
    return ev(s, d).select("event_id", F.date_format(F.timestamp_seconds(F.floor(D.unix_seconds(ms))), "yyyy-MM-dd HH:mm").alias("label"))


@query("p10_axis_labels", "SELECT event_id, strftime(ts, '%d/%m/%Y %H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') AS fine, strftime(ts, '%d/%m/%Y %H:%M:%S') AS seconds, strftime(ts, '%d/%m %H:%M') AS hours, strftime(ts, '%d/%m/%Y') AS days FROM events")
def _(s, d):
    v = F.unix_micros("ts") / 1e6
    return ev(s, d).select("event_id", *[D.time_label(v, n).alias(c) for c, n in (("fine", 0.5), ("seconds", 30), ("hours", 7200), ("days", 90_000))])


@query("p11_conditions", "SELECT event_id, value BETWEEN 10 AND 50 AS a, value > 50 AS b, abs(value - 20) < 1e-10 AS c, abs(value - 20) >= 1e-10 AS d FROM events")
def _(s, d):
    c = filters.cond
    return table(s, d, "events").select("event_id", c("value", "between", 10, 50).alias("a"), c("value", ">", 50).alias("b"), c("value", "=", 20).alias("c"), c("value", "!=", 20).alias("d"))


@query("p12_mask", "SELECT event_id FROM events WHERE (value > 100 AND user_id < 50) OR value <= 1")
def _(s, d):
    c = filters.cond
    return table(s, d, "events").where(filters.fold([("and", c("value", ">", 100)), ("and", c("user_id", "<", 50)), ("or", c("value", "<=", 1))])).select("event_id")


@query("p13_parameter_filter", "SELECT event_id FROM events WHERE value >= 20 AND value < 80 AND user_id > 10")
def _(s, d):
    spec = [{"parameter": "value", "ranges": [{"operator": ">=", "value": 20}, {"operator": "<", "value": 80}]}, {"parameter": "user_id", "ranges": [{"operator": ">", "value": 10}]}]
    return table(s, d, "events").where(filters.parameter_filter(spec)).select("event_id")


@query("p15_filter_counts", "WITH f AS (SELECT value BETWEEN 10 AND 50 AS a, NOT value BETWEEN 20 AND 90 AS b FROM events), u AS (SELECT 'low' AS name, a AS x FROM f UNION ALL SELECT 'far', b FROM f UNION ALL SELECT '*', a AND b FROM f) SELECT name, count(*) FILTER (WHERE x) AS visible, count(*) FILTER (WHERE NOT x) AS hidden FROM u GROUP BY name")
def _(s, d):
    return filters.filter_counts(table(s, d, "events"), {"low": filters.cond("value", "between", 10, 50), "far": filters.outside("value", 20, 90)})


@query("p16_expression_filter", "SELECT event_id FROM events WHERE value > 30 AND user_id < 20")
def _(s, d):
    return table(s, d, "events").where(F.expr("value > 30 and user_id < 20")).select("event_id")


@query("p18_segment_load", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' AND l_quantity > 20 AND l_discount <= 0.05")
def _(s, d):
    x = table(s, d, "lineitem").where(F.col("l_shipdate").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-01-01").cast("timestamp_ntz")))
    return x.where(filters.cond("l_quantity", ">", 20) & filters.cond("l_discount", "<=", 0.05)).select("l_orderkey", "l_linenumber", "l_extendedprice")


# --- segments and joins

SEG = f"p AS (SELECT *, i - row_number() OVER ({WIN}) AS run FROM ev WHERE value >= 50), seg AS (SELECT event_type, min(t) AS start_t, max(t) AS end_t, min(i) AS start_idx, max(i) AS end_idx, count(*) AS n, min(value) AS vmin, max(value) AS vmax, avg(value) AS mean FROM p GROUP BY event_type, run)"


def _seg(s, d, extra=None):
    return segments.segments(ev(s, d), KEY, ORDER, "t", filters.cond("value", ">=", 50), extra)


@query("g01_segments", f"+, {SEG} SELECT event_type, start_idx, end_idx, n, round(start_t, 3) AS start_t, round(end_t, 3) AS end_t FROM seg")
def _(s, d):
    return rounded(_seg(s, d), "start_t", "end_t", n=3)


@query("g02_segment_stats", f"+, {SEG} SELECT event_type, start_idx, n, round(end_t - start_t, 3) AS duration, vmin, vmax, round(mean, 4) AS mean FROM seg")
def _(s, d):
    x = _seg(s, d, [F.min("value").alias("vmin"), F.max("value").alias("vmax"), F.avg("value").alias("mean")])
    return x.select("event_type", "start_idx", "n", r(F.col("end_t") - F.col("start_t"), 3).alias("duration"), "vmin", "vmax", r("mean").alias("mean"))


LIM = "lim AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY event_type)"
VIO = f"{LIM}, q AS (SELECT ev.*, ev.i - row_number() OVER (PARTITION BY ev.event_type ORDER BY ts, event_id) AS run FROM ev JOIN lim USING (event_type) WHERE value < lo OR value > hi), vio AS (SELECT event_type, min(i) AS start_idx, max(i) AS end_idx, count(*) AS n, min(value) AS vmin, max(value) AS vmax FROM q GROUP BY event_type, run)"


def _lim(s, d):
    return cells.quantiles(table(s, d, "events"), KEY, "value", [0.05, 0.95]).select("event_type", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def _vio(s, d):
    return segments.violations(ev(s, d), _lim(s, d), KEY, ORDER, "t", "value")


@query("g03_violations", f"+, {VIO} SELECT * FROM vio")
def _(s, d):
    return _vio(s, d).select("event_type", "start_idx", "end_idx", "n", "vmin", "vmax")


@query("g03_violation_summary", f"+, {VIO} SELECT event_type, count(*) AS segments, CAST(sum(n) AS BIGINT) AS points, min(vmin) AS vmin, max(vmax) AS vmax FROM vio GROUP BY event_type")
def _(s, d):
    return segments.violation_summary(_vio(s, d), KEY)


@query("g04_half_open", f"+, {VIO} SELECT event_type, start_idx AS start_row, end_idx + 1 AS end_row FROM vio")
def _(s, d):
    return segments.half_open(_vio(s, d)).select("event_type", "start_row", "end_row")


RARE = "lim AS (SELECT event_type, quantile_cont(value, 0.001) AS lo, quantile_cont(value, 0.999) AS hi FROM events GROUP BY event_type)"


@query("g04_skip_chunks", f"+, {VIO.replace(LIM, RARE)} SELECT event_type, start_idx AS start_row, end_idx + 1 AS end_row FROM vio")
def _(s, d):
    path = f"{scratch.shared_dir(s)}/stored-{uuid.uuid4().hex}"
    stored.store(ev(s, d).select("event_type", "ts", "event_id", "t", "value"), KEY, ORDER, "t", ["value"], path, 50, 4, ())
    limits = cells.quantiles(table(s, d, "events"), KEY, "value", [0.001, 0.999]).select("event_type", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    return stored.violation_regions(s, path, limits, KEY, "value", 4)


REG = "reg AS (SELECT user_id AS k, t AS a, t + 6 * 3600 AS b FROM ev WHERE value > 200), m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY k ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS new FROM reg), g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY a, b) AS grp FROM m)"


@query("g05_merge_regions", f"+, {REG} SELECT k, round(min(a), 3) AS a, round(max(b), 3) AS b FROM g GROUP BY k, grp")
def _(s, d):
    reg = ev(s, d).where("value > 200").select(F.col("user_id").alias("k"), F.col("t").alias("a"), (F.col("t") + 6 * 3600).alias("b"))
    return rounded(segments.merge_regions(reg, ["k"], "a", "b"), "a", "b", n=3)


@query("g06_gaps", f"+, {SEG} SELECT event_type, round(t, 3) AS t, value FROM ev WHERE value >= 50 UNION ALL SELECT event_type, round(end_t, 3), NULL FROM seg")
def _(s, d):
    return rounded(segments.with_gaps(ev(s, d), _seg(s, d), KEY, ORDER, "t", "value"), "t", n=3)


@query("j01_in_segments", f"+, {SEG} SELECT event_id FROM ev WHERE EXISTS (SELECT 1 FROM seg WHERE seg.event_type = ev.event_type AND ev.t BETWEEN start_t AND end_t)")
def _(s, d):
    return segments.in_segments(ev(s, d), _seg(s, d), KEY, "t", "start_t", "end_t").select("event_id")


@query("j02_concatenated", f"+, {SEG}, o AS (SELECT *, coalesce(sum((end_t - start_t) * 1.01) OVER (PARTITION BY event_type ORDER BY start_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM seg) SELECT event_id, round(ev.t - start_t + off, 2) AS t_cat FROM ev JOIN o ON o.event_type = ev.event_type AND ev.t BETWEEN start_t AND end_t")
def _(s, d):
    return segments.concatenate(ev(s, d), _seg(s, d), KEY, "t").select("event_id", r("t_cat", 2).alias("t_cat"))


@query("j03_hide_regions", f"+, {VIO} SELECT event_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM vio WHERE vio.event_type = ev.event_type AND ev.i BETWEEN start_idx AND end_idx)")
def _(s, d):
    return segments.in_segments(series.with_row_index(ev(s, d), KEY, ORDER), _vio(s, d), KEY, "row_idx", "start_idx", "end_idx", "left_anti").select("event_id")


@query("j04_limits_join", f"WITH {LIM} SELECT event_id, round(lo, 6) AS lo, round(hi, 6) AS hi FROM events JOIN lim USING (event_type)")
def _(s, d):
    return rounded(table(s, d, "events").join(_lim(s, d), "event_type").select("event_id", "lo", "hi"), "lo", "hi", n=6)


BITS = "b AS (SELECT p_partkey, p_size, unnest(range(0, 64)) AS bit FROM part), a AS (SELECT p_partkey, CAST(bit AS INTEGER) AS bit FROM b WHERE (p_size::BIGINT >> bit) & 1 = 1)"


@query("j05_active_bits", f"WITH {BITS} SELECT p_partkey, bit, CASE bit WHEN 0 THEN 'odd' WHEN 5 THEN 'large' ELSE 'Undefined Bit ' || bit END AS description FROM a")
def _(s, d):
    part = table(s, d, "part")
    names = part.select(F.explode(F.array(F.struct(F.lit(0).alias("bit"), F.lit("odd").alias("description")), F.struct(F.lit(5).alias("bit"), F.lit("large").alias("description")))).alias("x")).select("x.*").distinct()
    return D.active_bits(part, ["p_partkey"], "p_size", names).select("p_partkey", "bit", "description")


PROBE = "pr AS (SELECT event_type, min(t) + unnest(range(1, 40)) * 50000.0 AS pt FROM ev GROUP BY event_type)"
AROUND = f"{PROBE}, sm AS (SELECT event_type, t, max(value) AS v FROM ev GROUP BY event_type, t), lo AS (SELECT pr.event_type, pt, max(sm.t) AS ta, arg_max(sm.v, sm.t) AS va FROM pr JOIN sm ON sm.event_type = pr.event_type AND sm.t <= pt GROUP BY ALL), hi AS (SELECT pr.event_type, pt, min(sm.t) AS tb, arg_min(sm.v, sm.t) AS vb FROM pr JOIN sm ON sm.event_type = pr.event_type AND sm.t >= pt GROUP BY ALL), ab AS (SELECT pr.event_type, pr.pt, ta, va, tb, vb FROM pr LEFT JOIN lo USING (event_type, pt) LEFT JOIN hi USING (event_type, pt))"


def _probes(s, d):
    return ev(s, d).groupBy("event_type").agg(F.min("t").alias("m")).select("event_type", F.explode(F.transform(F.sequence(F.lit(1), F.lit(39)), lambda k: F.col("m") + k * 50000.0)).alias("probe_t"))


def _lookup(method, bounds="null"):
    return lambda s, d: asof.value_at(ev(s, d), _probes(s, d), KEY, "t", "value", method, bounds).select("event_type", r("probe_t", 3).alias("probe_t"), r("value").alias("value"))


query("j06_interpolate", f"+, {AROUND} SELECT event_type, round(pt, 3) AS probe_t, round(CASE WHEN ta IS NULL OR tb IS NULL THEN NULL WHEN ta = tb THEN va ELSE va + (vb - va) * (pt - ta) / (tb - ta) END, 4) AS value FROM ab")(_lookup("linear"))
query("j06_interpolate_clamp", f"+, {AROUND} SELECT event_type, round(pt, 3) AS probe_t, round(CASE WHEN ta IS NULL THEN vb WHEN tb IS NULL THEN va WHEN ta = tb THEN va ELSE va + (vb - va) * (pt - ta) / (tb - ta) END, 4) AS value FROM ab")(_lookup("linear", "clamp"))
query("j07_hold", f"+, {AROUND} SELECT event_type, round(pt, 3) AS probe_t, round(va, 4) AS value FROM ab")(_lookup("hold"))
query("j08_nearest", f"+, {AROUND} SELECT event_type, round(pt, 3) AS probe_t, round(CASE WHEN ta IS NULL OR tb IS NULL THEN NULL WHEN pt - ta <= tb - pt THEN va ELSE vb END, 4) AS value FROM ab")(_lookup("nearest"))


# --- statistics

STATS = "round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS min, max(value) AS max, round(median(value), 4) AS median, round(sum(value), 2) AS sum, round(sqrt(avg(value * value)), 4) AS rms, round(max(value) - min(value), 4) AS peak_to_peak, count(*) AS count, count(value) AS valid_count"


def _st(df):
    return rounded(rounded(df, "mean", "std", "median", "rms", "peak_to_peak"), "sum", n=2)


@query("a01_statistics", f"SELECT event_type, {STATS} FROM events GROUP BY event_type")
def _(s, d):
    return _st(stats.stats(table(s, d, "events"), KEY, "value"))


@query("a02_row_range_statistics", f"+SELECT event_type, {STATS} FROM ev WHERE i >= 50 AND i < 250 GROUP BY event_type")
def _(s, d):
    return _st(stats.stats(series.slice_rows(ev(s, d), KEY, ORDER, 50, 200), KEY, "value"))


@query("a03_time_range_statistics", f"SELECT event_type, {STATS} FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10' GROUP BY event_type")
def _(s, d):
    return _st(stats.stats(series.time_range(ev(s, d), "ts", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-10").cast("timestamp")), KEY, "value"))


@query("a04_multi_signal", "WITH u AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON COLUMNS(*) INTO NAME signal VALUE value) SELECT signal, round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max, count(*) AS n FROM u GROUP BY signal")
def _(s, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    x = table(s, d, "lineitem").select(*cols).unpivot([], cols, "signal", "value")
    return x.groupBy("signal").agg(r(F.avg("value")).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("n"))


@query("a05_threshold_stats", f"+, g AS (SELECT *, t - lag(t) OVER ({WIN}) AS dt FROM ev) SELECT event_type, count(*) FILTER (WHERE value > 60) AS above, count(*) FILTER (WHERE NOT value > 60) AS below, round(100.0 * count(*) FILTER (WHERE value > 60) / count(value), 4) AS above_pct, round(100.0 * count(*) FILTER (WHERE NOT value > 60) / count(value), 4) AS below_pct, round(coalesce(sum(dt) FILTER (WHERE value > 60), 0), 2) AS time_above, round(coalesce(sum(dt) FILTER (WHERE NOT value > 60), 0), 2) AS time_below FROM g GROUP BY event_type")
def _(s, d):
    return rounded(rounded(stats.threshold_stats(ev(s, d), KEY, ORDER, "t", "value", 60), "above_pct", "below_pct"), "time_above", "time_below", n=2)


@query("a06_percentile_floor", "WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value FROM x WHERE i = floor(0.95 * (n - 1))")
def _(s, d):
    return stats.percentile_rank(table(s, d, "events"), KEY, "value", 95)


@query("a07_quartiles", "SELECT event_type, round(quantile_cont(value, 0.25), 4) AS q1, round(quantile_cont(value, 0.5), 4) AS q2, round(quantile_cont(value, 0.75), 4) AS q3, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr FROM events GROUP BY event_type")
def _(s, d):
    return rounded(stats.quartiles(table(s, d, "events"), KEY, "value"), "q1", "q2", "q3", "iqr")


@query("a08_histogram", "WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type), g AS (SELECT event_type, lo, (hi - lo) / 20 AS w, CAST(unnest(range(0, 20)) AS INTEGER) AS bin FROM s), c AS (SELECT e.event_type, CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM events e JOIN s USING (event_type) GROUP BY ALL) SELECT event_type, bin, round(lo + bin * w, 4) AS lower, round(lo + (bin + 1) * w, 4) AS upper, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (event_type, bin)")
def _(s, d):
    return rounded(stats.histogram(table(s, d, "events"), KEY, "value", 20), "lower", "upper")


@query("a09_shape", "WITH m AS (SELECT event_type, value, avg(value) OVER (PARTITION BY event_type) AS m FROM events) SELECT event_type, round(avg(power(value - m, 3)) / power(avg(power(value - m, 2)), 1.5), 4) AS skewness, round(avg(power(value - m, 4)) / power(avg(power(value - m, 2)), 2) - 3, 4) AS kurtosis FROM m GROUP BY event_type")
def _(s, d):
    return rounded(stats.shape(table(s, d, "events"), KEY, "value"), "skewness", "kurtosis")


DUTY = f"+, g AS (SELECT *, t - lag(t) OVER ({WIN}) AS dt, value > avg(value) OVER (PARTITION BY event_type) AS up FROM ev)"


@query("a10_duty_cycle", f"{DUTY} SELECT event_type, round(100 * coalesce(sum(dt) FILTER (WHERE up), 0) / (max(t) - min(t)), 4) AS duty, round(avg(CASE WHEN up THEN 100.0 ELSE 0 END), 4) AS duty_samples FROM g GROUP BY event_type")
def _(s, d):
    return rounded(stats.duty_cycle(ev(s, d), KEY, ORDER, "t", "value"), "duty", "duty_samples")


@query("a12_sampling", "+SELECT event_type, round((count(t) - 1) / (max(t) - min(t)), 8) AS rate, round(max(t) - min(t), 3) AS duration FROM ev GROUP BY event_type")
def _(s, d):
    return rounded(rounded(stats.sampling(ev(s, d), KEY, "t"), "rate", n=8), "duration", n=3)


@query("a13_rms_to_cursor", "SELECT event_type, round(sqrt(avg(value * value)), 4) AS rms FROM events WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY event_type")
def _(s, d):
    return ev(s, d).where(F.col("ts") <= F.lit("2024-01-15").cast("timestamp")).groupBy("event_type").agg(r(F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("rms"))


def _idx(s, d):
    return series.with_row_index(ev(s, d), KEY, ORDER)


@query("a14_preaggregate", "+SELECT event_type, i // 100 AS chunk, min(i) AS start_row, count(*) AS row_count, round(sum(value), 3) AS s1, round(sum(value * value), 2) AS s2, min(value) AS vmin, max(value) AS vmax, count(value) AS valid FROM ev GROUP BY ALL")
def _(s, d):
    return rounded(rounded(stats.preaggregate(_idx(s, d), KEY, "row_idx", "value", 100), "s1", n=3), "s2", n=2)


@query("a15_range_from_chunks", "+SELECT event_type, count(value) AS valid, round(CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) / count(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS min, max(value) AS max FROM ev WHERE i >= 130 AND i < 1570 GROUP BY event_type")
def _(s, d):
    x = _idx(s, d).withColumn("value", F.col("value").cast("decimal(18,4)"))
    return rounded(stats.range_stats(stats.preaggregate(x, KEY, "row_idx", "value", 100), x, KEY, "row_idx", "value", 130, 1570, 100), "mean", "std")


@query("a16_reduced_blocks", "+SELECT event_type, i // 500 AS block, min(value) AS min, max(value) AS max, round(avg(value), 4) AS avg, round(sqrt(avg(value * value)), 4) AS rms, count(value) AS n FROM ev GROUP BY ALL")
def _(s, d):
    return rounded(stats.reduce_blocks(_idx(s, d), KEY, "row_idx", "value"), "avg", "rms")


@query("a16_merged_blocks", "SELECT event_type, min(value) AS min, max(value) AS max, round(avg(value), 4) AS avg, round(sqrt(avg(value * value)), 4) AS rms, CAST(count(value) AS BIGINT) AS n FROM events GROUP BY event_type")
def _(s, d):
    return rounded(stats.merge_blocks(stats.reduce_blocks(_idx(s, d), KEY, "row_idx", "value"), KEY), "avg", "rms")


@query("a17_correlation", "WITH c AS (SELECT corr(l_extendedprice, l_quantity) AS l_quantity, corr(l_extendedprice, l_discount) AS l_discount, corr(l_extendedprice, l_tax) AS l_tax FROM lineitem), u AS (UNPIVOT c ON COLUMNS(*) INTO NAME signal VALUE r) SELECT signal, round(r, 6) AS r, CAST(row_number() OVER (ORDER BY abs(r) DESC, signal) AS INTEGER) AS rank FROM u")
def _(s, d):
    return rounded(stats.correlate(table(s, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), "r", n=6)


@query("a18_violation_count", f"WITH {LIM} SELECT event_type, count(*) FILTER (WHERE value < lo OR value > hi) AS n FROM events JOIN lim USING (event_type) GROUP BY event_type")
def _(s, d):
    return table(s, d, "events").join(_lim(s, d), "event_type").groupBy("event_type").agg(F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("n"))


@query("a20_light_stats", "SELECT event_type, count(value) AS count, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max, round(median(value), 4) AS median FROM events GROUP BY event_type")
def _(s, d):
    return rounded(stats.light_stats(table(s, d, "events"), KEY, "value"), "mean", "std", "median")


@query("a21_summary", "+SELECT event_type, count(*) AS rows, round(min(t), 3) AS start_t, round(max(t), 3) AS end_t, min(value) AS min_v, max(value) AS max_v FROM ev GROUP BY event_type")
def _(s, d):
    return rounded(series.summary(ev(s, d), KEY, "t", "value"), "start_t", "end_t", n=3)


@query("a22_expression_aggregates", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 4) AS centred, round(sqrt(avg(value * value) OVER (PARTITION BY event_type)), 4) AS rms FROM events")
def _(s, d):
    x = D.derive(table(s, d, "events"), {"rms": "sqrt(ms)", "centred": "value - m"}, {"ms": "avg(value * value)", "m": "avg(value)"}, KEY)
    return rounded(x.select("event_id", "centred", "rms"), "centred", "rms")


# --- windows


@query("w01_rolling", "+, x AS (SELECT event_id, i, avg(value) OVER w AS r_mean, stddev_pop(value) OVER w AS r_std, min(value) OVER w AS r_min, max(value) OVER w AS r_max, sum(value) OVER w AS r_sum, sqrt(avg(value * value) OVER w) AS r_rms, quantile_cont(value, 0.5) OVER w AS r_median FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT event_id, round(r_mean, 3) AS r_mean, round(r_std, 3) AS r_std, r_min, r_max, round(r_sum, 3) AS r_sum, round(r_rms, 3) AS r_rms, round(r_median, 3) AS r_median FROM x WHERE i >= 9")
def _(s, d):
    return rounded(rolling.rolling_stats(ev(s, d), KEY, ORDER, "value", 10).select("event_id", "r_mean", "r_std", "r_min", "r_max", "r_sum", "r_rms", "r_median"), "r_mean", "r_std", "r_sum", "r_rms", "r_median", n=3)


@query("w02_running", "+SELECT event_id, round(sqrt(avg(value * value) OVER w), 7) AS run_rms, round(avg(value) OVER w, 7) AS run_mean, max(value) OVER w AS run_max FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def _(s, d):
    return rounded(rolling.running(ev(s, d), KEY, ORDER, "value").select("event_id", "run_rms", "run_mean", "run_max"), "run_rms", "run_mean", n=7)


DEV = f"+, x AS (SELECT *, (sum(value) OVER w + (20 - count(*) OVER w) * first_value(value) OVER ({WIN})) / 20 AS e FROM ev WINDOW w AS ({WIN} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), dv AS (SELECT *, abs((value - e) / (e + 1e-9)) * 100 AS dev FROM x)"


@query("w03_deviation", f"{DEV} SELECT event_id, round(e, 6) AS expected, round(dev, 5) AS deviation FROM dv")
def _(s, d):
    x = rolling.deviation(ev(s, d), KEY, ORDER, "value", 20)
    return x.select("event_id", r("expected", 6).alias("expected"), r("deviation", 5).alias("deviation"))


@query("w04_alerts", f"{DEV} SELECT event_type, i AS row_idx, value, round(e, 6) AS expected FROM dv WHERE dev > 150")
def _(s, d):
    x = rolling.deviation(ev(s, d), KEY, ORDER, "value", 20).where("deviation > 150")
    return x.select("event_type", "row_idx", "value", r("expected", 6).alias("expected"))


@query("w05_previous_mean", f"+, x AS (SELECT *, avg(value) OVER ({WIN} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS e FROM ev) SELECT event_id, round(e, 6) AS expected, round(abs((value - e) / e) * 100, 5) AS deviation FROM x WHERE i >= 20")
def _(s, d):
    return rolling.deviation(ev(s, d), KEY, ORDER, "value", 20, "previous").select("event_id", r("expected", 6).alias("expected"), r("deviation", 5).alias("deviation"))


@query("w06_bands", f"+SELECT event_id, round(avg(value) OVER w * 1.2, 6) AS upper, round(avg(value) OVER w * 0.8, 6) AS lower FROM ev WINDOW w AS ({WIN} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def _(s, d):
    return rounded(rolling.bands(ev(s, d), KEY, ORDER, "value", 20, 20).select("event_id", "upper", "lower"), "upper", "lower", n=6)


@query("w07_red_segments", f"{DEV}, p AS (SELECT *, i - row_number() OVER ({WIN}) AS run FROM dv WHERE dev > 80) SELECT event_type, min(i) AS start_idx, max(i) AS end_idx, round(max(dev), 2) AS worst FROM p GROUP BY event_type, run")
def _(s, d):
    x = rolling.deviation(ev(s, d), KEY, ORDER, "value", 20).drop("row_idx")
    return segments.segments(x, KEY, ORDER, "t", F.col("deviation") > 80, [r(F.max("deviation"), 2).alias("worst")]).select("event_type", "start_idx", "end_idx", "worst")


@query("w08_trend", "+SELECT event_id, round(regr_intercept(value, i) OVER (PARTITION BY event_type) + regr_slope(value, i) OVER (PARTITION BY event_type) * i, 3) AS trend FROM ev")
def _(s, d):
    return rolling.trend(ev(s, d), KEY, ORDER, "value").select("event_id", r("trend", 3).alias("trend"))


@query("w09_smooth", f"+SELECT event_id, round(sum(value) OVER ({WIN} ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10, 3) AS smooth FROM ev")
def _(s, d):
    return rolling.smooth(ev(s, d), KEY, ORDER, "value", 10).select("event_id", r("smooth", 3).alias("smooth"))


D1 = f"+, g AS (SELECT *, t - lag(t) OVER ({WIN}) AS dt, value - lag(value) OVER ({WIN}) AS dv FROM ev), d AS (SELECT *, CASE WHEN dt IS NULL THEN NULL WHEN dt <= 0 THEN 0 ELSE dv / dt END AS d1 FROM g)"


@query("w10_derivative", f"{D1} SELECT event_id, round(d1, 4) AS d1 FROM d")
def _(s, d):
    return rolling.derivative(ev(s, d), KEY, ORDER, "t", "value").select("event_id", r("d1").alias("d1"))


@query("w11_second_derivative", f"{D1}, e AS (SELECT *, (dt + lag(dt) OVER ({WIN})) / 2 AS mid, d1 - lag(d1) OVER ({WIN}) AS dd FROM d) SELECT event_id, round(CASE WHEN dd IS NULL THEN NULL WHEN mid <= 0 THEN 0 ELSE dd / mid END, 4) AS d2 FROM e")
def _(s, d):
    return rolling.derivative(ev(s, d), KEY, ORDER, "t", "value").select("event_id", r("d2").alias("d2"))


@query("w12_level_crossings", f"+, g AS (SELECT *, lag(value) OVER ({WIN}) - 50 AS a, value - 50 AS b FROM ev) SELECT event_id, i AS row_idx FROM g WHERE (a <= 0 AND b > 0) OR (a >= 0 AND b < 0)")
def _(s, d):
    return rolling.zero_crossings(ev(s, d), KEY, ORDER, "value", 50.0).select("event_id", "row_idx")


@query("w13_limit_crossings", f"+, g AS (SELECT *, lag(value) OVER ({WIN}) AS p, unnest([20.0, 90.0]) AS lim FROM (SELECT * FROM ev)) SELECT event_id, CAST(lim AS DOUBLE) AS \"limit\" FROM (SELECT ev.*, lag(value) OVER ({WIN}) AS p FROM ev) q, (SELECT unnest([20.0, 90.0]) AS lim) l WHERE (p <= lim AND value > lim) OR (p >= lim AND value < lim)")
def _(s, d):
    return rolling.limit_crossings(ev(s, d), KEY, ORDER, "value", [20, 90]).select("event_id", "limit")


@query("w14_sudden_changes", f"{D1}, z AS (SELECT *, avg(d1) OVER (PARTITION BY event_type) AS m, stddev_pop(d1) OVER (PARTITION BY event_type) AS sd FROM d) SELECT event_id, round(least(1, abs(d1 - m) / (2 * 3 * sd)), 4) AS significance FROM z WHERE abs(d1 - m) > 3 * sd")
def _(s, d):
    return rolling.sudden_changes(ev(s, d), KEY, ORDER, "t", "value").select("event_id", r("significance").alias("significance"))


@query("w15_extrema", f"+, x AS (SELECT *, max(value) OVER l AS lx, min(value) OVER l AS ln, max(value) OVER q AS rx, min(value) OVER q AS rn, count(*) OVER l AS lc, count(*) OVER q AS rc FROM ev WINDOW l AS ({WIN} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), q AS ({WIN} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)) SELECT event_id, CASE WHEN value > lx AND value > rx THEN 'peak' ELSE 'valley' END AS kind FROM x WHERE lc = 10 AND rc = 10 AND ((value > lx AND value > rx) OR (value < ln AND value < rn))")
def _(s, d):
    return rolling.extrema(ev(s, d), KEY, ORDER, "value").select("event_id", "kind")


for _m, _sql in {"peak": "value / max(abs(value)) OVER k", "rms": "value / sqrt(avg(value * value) OVER k)", "minmax": "(value - min(value) OVER k) / (max(value) OVER k - min(value) OVER k)", "zscore": "(value - avg(value) OVER k) / stddev_pop(value) OVER k"}.items():
    query(f"n0{'peak rms minmax zscore'.split().index(_m) + 1}_normalize_{_m}", f"SELECT event_id, round({_sql}, 5) AS v_norm FROM events WINDOW k AS (PARTITION BY event_type)")(lambda s, d, m=_m: rolling.normalize(table(s, d, "events"), KEY, "value", m).select("event_id", r("v_norm", 5).alias("v_norm")))


@query("n06_outliers", "WITH x AS (SELECT event_id, abs(value - avg(value) OVER k) / stddev_pop(value) OVER k AS score FROM events WINDOW k AS (PARTITION BY event_type)) SELECT event_id, round(score, 4) AS score FROM x WHERE score > 3")
def _(s, d):
    return rolling.outliers(table(s, d, "events"), KEY, "value").select("event_id", r("score").alias("score"))


def _outliers(base: str, scale: str, cut: float) -> str:
    return f"+, b AS (SELECT event_id, event_type, value, {base} AS b FROM ev) SELECT event_id, round(score, 4) AS score FROM (SELECT event_id, abs(value - b) / ({scale}) AS score FROM b WINDOW k AS (PARTITION BY event_type)) WHERE score > {cut}"


_LINE = "regr_intercept(value, i) OVER (PARTITION BY event_type) + regr_slope(value, i) OVER (PARTITION BY event_type) * i"
for _n, _m, _b, _f, _q in (("aad", "aad", "mean", "avg(value) OVER (PARTITION BY event_type)", "avg(abs(value - b)) OVER k"), ("mad", "mad", "median", "median(value) OVER (PARTITION BY event_type)", "median(abs(value - b)) OVER k"), ("iqr", "iqr", "median", "median(value) OVER (PARTITION BY event_type)", "quantile_cont(value, 0.75) OVER k - quantile_cont(value, 0.25) OVER k"), ("rolling", "std", "rolling", f"avg(value) OVER ({WIN} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)", "stddev_pop(value) OVER k"), ("trend", "std", "trend", _LINE, "stddev_pop(value) OVER k")):
    query(f"n06_outliers_{_n}", _outliers(_f, _q, 2.5))(lambda s, d, m=_m, b=_b: rolling.outliers(ev(s, d), KEY, "value", m, 2.5, b, ORDER).select("event_id", r("score").alias("score")))


# --- downsampling and level of detail


@query("d01_uniform", "+, x AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n FROM ev) SELECT event_id FROM x WHERE i % greatest(n // 200, 1) = 0")
def _(s, d):
    return downsample.uniform(ev(s, d), KEY, ORDER, 200).select("event_id")


MM = "+, x AS (SELECT *, i // greatest(CAST(ceil(count(*) OVER (PARTITION BY event_type) / 100.0) AS BIGINT), 1) AS bucket FROM ev), b AS (SELECT *, row_number() OVER (PARTITION BY event_type, bucket ORDER BY value, i) AS a, row_number() OVER (PARTITION BY event_type, bucket ORDER BY value DESC, i) AS z, row_number() OVER (PARTITION BY event_type, bucket ORDER BY i) AS f, row_number() OVER (PARTITION BY event_type, bucket ORDER BY CASE WHEN value < 5 OR value > 150 THEN 0 ELSE 1 END, i) AS h FROM x)"


@query("d02_minmax", f"{MM} SELECT event_type, bucket, i AS row_idx, value AS v FROM b WHERE a = 1 OR z = 1")
def _(s, d):
    return downsample.minmax(ev(s, d), KEY, ORDER, "t", "value", 100).select("event_type", "bucket", "row_idx", "v")


@query("d03_minmax_first_limit", f"{MM} SELECT event_type, bucket, i AS row_idx, value AS v FROM b WHERE a = 1 OR z = 1 OR f = 1 OR (h = 1 AND (value < 5 OR value > 150))")
def _(s, d):
    return downsample.minmax(ev(s, d), KEY, ORDER, "t", "value", 100, 5, 150, True).select("event_type", "bucket", "row_idx", "v")


LT = f"""WITH RECURSIVE {EV},
x AS (SELECT event_type, t, value AS v, row_number() OVER ({WIN}) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ev WHERE value IS NOT NULL),
b AS (SELECT *, CAST(CASE WHEN n <= 200 THEN i WHEN i = 0 THEN 0 WHEN i = n - 1 THEN 199 ELSE least(floor((i - 1) / ((n - 2) / 198::DOUBLE)) + 1, 198) END AS BIGINT) AS k FROM x),
m AS (SELECT event_type, k, sum(t) / count(*) AS mt, sum(v) / count(*) AS mv FROM b GROUP BY ALL),
walk AS (SELECT event_type, k, i, t, v FROM b WHERE k = 0
UNION ALL SELECT event_type, k, p.i, p.t, p.v FROM (
SELECT b.event_type, b.k, max({{'area': CASE WHEN m.k IS NULL THEN 0 ELSE abs((w.t - m.mt) * (b.v - w.v) - (w.t - b.t) * (m.mv - w.v)) END, 'first': -b.i, 'i': b.i, 't': b.t, 'v': b.v}}) AS p
FROM walk w JOIN b ON b.event_type = w.event_type AND b.k = w.k + 1 LEFT JOIN m ON m.event_type = b.event_type AND m.k = b.k + 1 GROUP BY b.event_type, b.k))
SELECT event_type, i AS row_idx, t, v FROM walk"""


@query("d04_lttb", LT)
def _(s, d):
    return downsample.lttb(ev(s, d), KEY, ORDER, "t", "value", 200)


@query("d04_lttb_ranges", LT)
def _(s, d):
    return downsample.lttb(ev(s, d), KEY, ORDER, "t", "value", 200, together=20)


@query("d05_lttb_critical")
def _(s, d):
    return downsample.lttb_critical(ev(s, d), KEY, ORDER, "t", "value", 300, 100, [20.0, 150.0])


@query("d07_smart")
def _(s, d):
    return downsample.smart(ev(s, d), KEY, ORDER, "t", "value", 300)


def _prominence(depth: str, least: float) -> str:
    return f"""+, x AS (SELECT *, max(value) OVER l AS lx, min(value) OVER l AS ln, max(value) OVER q AS rx, min(value) OVER q AS rn, count(*) OVER l AS lc, count(*) OVER q AS rc
 FROM ev WINDOW l AS ({WIN} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), q AS ({WIN} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)),
 c AS (SELECT event_type, i, value AS v, CASE WHEN value > lx AND value > rx THEN 1 ELSE -1 END AS g FROM x WHERE lc = 10 AND rc = 10 AND ((value > lx AND value > rx) OR (value < ln AND value < rn))),
 a AS (SELECT c.event_type, c.i, c.v, c.g, max(e.i) FILTER (e.i < c.i AND g * e.value > g * v) AS l, min(e.i) FILTER (e.i > c.i AND g * e.value > g * v) AS r FROM c JOIN ev e USING (event_type) GROUP BY ALL),
 p AS (SELECT event_type, i, v, g, g * v - ml AS dl, g * v - mr AS dr FROM (SELECT a.event_type, a.i, a.v, a.g, min(g * e.value) FILTER (e.i <= a.i AND e.i > coalesce(l, -1)) AS ml, min(g * e.value) FILTER (e.i >= a.i AND (r IS NULL OR e.i < r)) AS mr FROM a JOIN ev e USING (event_type) GROUP BY ALL)),
 s AS (SELECT event_type, {least} * stddev_pop(value) AS low FROM ev GROUP BY event_type)
 SELECT event_type, i AS row_idx, v, CASE WHEN g = 1 THEN 'peak' ELSE 'valley' END AS kind, round({depth}(dl, dr), 4) AS prominence, round(least(1.0, {depth}(dl, dr) / (3 * low)), 4) AS significance
 FROM p JOIN s USING (event_type) WHERE {depth}(dl, dr) >= low"""


for _n, _v, _f, _m in (("w16_prominence", "B", "least", 0.3), ("w16_prominence_lowest", "A", "greatest", 0.5)):
    query(_n, _prominence(_f, _m))(lambda s, d, v=_v: rounded(downsample.with_prominence(ev(s, d), KEY, ORDER, "value", variant=v), "prominence", "significance"))


@query("w18_critical_points")
def _(s, d):
    return downsample.critical_points(ev(s, d), KEY, ORDER, "t", "value", limits=[20.0, 150.0], least=0.3, most=200)


@query("d08_spikes", "WITH x AS (SELECT event_id, value, avg(value) OVER k AS m, stddev_samp(value) OVER k AS sd FROM events WINDOW k AS (PARTITION BY event_type)) SELECT event_id FROM x WHERE value < m - 3 * sd OR value > m + 3 * sd")
def _(s, d):
    return downsample.spikes(ev(s, d), KEY, ORDER, "value").select("event_id")


def _lod(s, d):
    return downsample.build_lod(ev(s, d), KEY, ORDER, "t", ["value"], (10, 100, 1000))


LOD = "lod AS (SELECT event_type, i // 100 AS bucket, min(t) AS time_min, max(t) AS time_max, count(*) AS rows, min(value) AS value_min, max(value) AS value_max FROM ev GROUP BY ALL)"


@query("d09_lod", f"+, {LOD} SELECT event_type, bucket, round(time_min, 3) AS time_min, round(time_max, 3) AS time_max, CAST(rows AS BIGINT) AS rows, value_min, value_max FROM lod")
def _(s, d):
    return rounded(_lod(s, d)[100], "time_min", "time_max", n=3)


@query("d11_envelope", f"+, {LOD}, o AS (SELECT * FROM lod WHERE time_max >= 1704844800 AND time_min <= 1705276800) SELECT event_type, bucket, round(time_min, 3) AS t, value_min AS v FROM o UNION ALL SELECT event_type, bucket, round(time_max, 3), value_max FROM o")
def _(s, d):
    return rounded(downsample.envelope(_lod(s, d)[100], KEY, "value", 1704844800.0, 1705276800.0), "t", n=3)


@query("a19_lod_range", f"+, {LOD} SELECT event_type, min(value_min) AS low, max(value_max) AS high FROM lod GROUP BY event_type")
def _(s, d):
    return _lod(s, d)[1000].groupBy("event_type").agg(F.min("value_min").alias("low"), F.max("value_max").alias("high"))


SPAN = "time_max >= 1704844800 AND time_min <= 1705276800"
VIEW = f"{LOD}, c AS (SELECT event_type, i // 100000 AS b, min(t) AS time_min, max(t) AS time_max, count(*) AS n FROM ev GROUP BY ALL), k AS (SELECT coalesce(sum(n), 0) AS n FROM c WHERE {SPAN}), o AS (SELECT lod.* FROM lod WHERE {SPAN})"


@query("d12_view", f"+, {VIEW} SELECT event_type, t, value AS v FROM ev, k WHERE n < 20000 AND t BETWEEN 1704844800 AND 1705276800 UNION ALL SELECT event_type, time_min, value_min FROM o, k WHERE n >= 20000 UNION ALL SELECT event_type, time_max, value_max FROM o, k WHERE n >= 20000")
def _(s, d):
    return downsample.view(_lod(s, d), ev(s, d), KEY, "t", "value", 1704844800.0, 1705276800.0)


@query("d12_view_levels", f"+, {VIEW} SELECT event_type, round((time_min + time_max) / 2, 3) AS t, unnest([value_min, value_max]) AS v, 100 AS level FROM o")
def _(s, d):
    path = f"{scratch.shared_dir(s)}/stored-{uuid.uuid4().hex}"
    stored.store(ev(s, d).select("event_type", "ts", "event_id", "t", "value"), KEY, ORDER, "t", ["value"], path, 1000, 64, (100, 10_000))
    return rounded(stored.view(s, path, KEY, "t", "value", 1704844800.0, 1705276800.0, 1, 200), "t", n=3)


# --- expressions and quality


@query("f01_expressions", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 5) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS gross, round(sqrt(l_quantity) + ln(l_extendedprice) + sin(l_tax), 5) AS mixed, CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS large, least(greatest(l_quantity, 10), 40) AS clipped FROM lineitem")
def _(s, d):
    x = D.derive(table(s, d, "lineitem"), {"gross": "round(net0 * (1 + l_tax), 7)", "net": "round(net0, 5)", "net0": "l_extendedprice * (1 - l_discount)", "mixed": "round(sqrt(l_quantity) + ln(l_extendedprice) + sin(l_tax), 5)", "large": "cast(l_quantity > 25 as double)"})
    return x.withColumn("clipped", D.clip(F.col("l_quantity"), 10, 40)).select("l_orderkey", "l_linenumber", "l_partkey", "net", "gross", "mixed", "large", "clipped")


@query("f02_division_and_mod", "SELECT event_id, CASE WHEN user_id = 0 THEN 0 ELSE round(value / user_id, 9) END AS ratio, round(value - 7 * floor(value / 7), 6) AS rest FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", r(D.divide(F.col("value"), F.col("user_id"), 0.0), 9).alias("ratio"), r(D.floor_mod(F.col("value"), F.lit(7.0)), 6).alias("rest"))


@query("f09_round_half_even", "SELECT event_id, round_even(value, 0) AS even, round(value) AS away FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", F.rint("value").alias("even"), F.round("value").alias("away"))


@query("f03_functions", "SELECT event_id, round(power(value / 100, 3), 6) AS cube, abs(value - 50) AS off, round(exp(value / 500), 8) AS e, round(cos(value), 8) AS c, round(tan(value / 400), 8) AS t, round(log10(value), 8) AS l, round(power(value, 0.5) - sqrt(value), 8) AS zero FROM events")
def _(s, d):
    exprs = {"cube": "round(power(value / 100, 3), 6)", "off": "abs(value - 50)", "e": "round(exp(value / 500), 8)", "c": "round(cos(value), 8)", "t": "round(tan(value / 400), 8)", "l": f"round({D.log10('value')}, 8)", "zero": "round(power(value, 0.5) - sqrt(value), 8)"}
    return D.derive(table(s, d, "events"), exprs).select("event_id", *exprs)


@query("f10_smaller_and_greater", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE least(value, user_id) END AS a, CASE WHEN user_id % 7 = 0 THEN NULL ELSE greatest(value, user_id) END AS b FROM events")
def _(s, d):
    other = F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("double"))
    return table(s, d, "events").select("event_id", D.smaller(F.col("value"), other).alias("a"), D.greater(F.col("value"), other).alias("b"))


@query("f12_where", "SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN value ELSE -value END AS v FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", D.where(F.col("user_id") % 3, F.col("value"), -F.col("value")).alias("v"))


@query("f16_row_range", "+SELECT event_id, round(value * 2 + i, 6) AS twice FROM ev WHERE i BETWEEN 20 AND 119")
def _(s, d):
    return D.derive(series.slice_rows(ev(s, d), KEY, ORDER, 20, 100), {"twice": "round(value * 2 + row_idx, 6)"}).select("event_id", "twice")


@query("f18_scalar", "SELECT event_id, 3 AS one, round(value - (SELECT avg(value) FROM events), 4) AS off FROM events")
def _(s, d):
    return D.derive(table(s, d, "events"), {"one": "1 + 2", "off": "round(value - mean, 4)"}, {"mean": "avg(value)"}).select("event_id", "one", "off")


@query("u04_filters_together", "SELECT event_id FROM events WHERE value BETWEEN 10 AND 60 AND NOT value BETWEEN 20 AND 30 AND user_id > 40")
def _(s, d):
    named = {"mid": filters.cond("value", "between", 10, 60), "gap": filters.outside("value", 20, 30), "user": filters.cond("user_id", ">", 40), "off": filters.cond("value", "<", 0)}
    return filters.apply_filters(table(s, d, "events"), named, ["mid", "gap", "user"]).select("event_id")


NEAR = "pts AS (SELECT event_type, i, value, row_number() OVER (PARTITION BY event_type ORDER BY i) AS k FROM ev WHERE value > 150)"


@query("u02_proximity", f"WITH RECURSIVE {EV}, {NEAR}, f AS (SELECT event_type, k, i AS ki, value AS kv, false AS fresh FROM pts WHERE k = 1 UNION ALL SELECT p.event_type, p.k, CASE WHEN p.i - f.ki > 5 OR p.value > f.kv THEN p.i ELSE f.ki END, CASE WHEN p.i - f.ki > 5 OR p.value > f.kv THEN p.value ELSE f.kv END, p.i - f.ki > 5 FROM f JOIN pts p ON p.event_type = f.event_type AND p.k = f.k + 1), g AS (SELECT *, lead(fresh) OVER (PARTITION BY event_type ORDER BY k) AS next_fresh FROM f) SELECT event_type, ki AS row_idx, kv AS significance FROM g WHERE coalesce(next_fresh, true)")
def _(s, d):
    x = _idx(s, d).where("value > 150").select("event_type", "row_idx", F.col("value").alias("significance"), F.lit("high").alias("kind"))
    return downsample.proximity_dedup(x, KEY, 5).drop("kind")


@query("x03_user_functions", "SELECT event_id, round(value * value + user_id, 6) AS v FROM events")
def _(s, d):
    return D.vectorised(table(s, d, "events"), "v", lambda v, u: (v * v + u).round(6), ["value", "user_id"]).select("event_id", "v")


@query("x03_series_functions", "+, x AS (SELECT event_id, i, sum(value) OVER (PARTITION BY event_type ORDER BY i) AS total FROM ev) SELECT event_id, round(total, 4) AS total FROM x")
def _(s, d):
    def totals(pdf):
        so_far, known = pdf["_sum"].fillna(0) + pdf["value"].fillna(0).cumsum(), pdf["_sum"].notna() | pdf["value"].notna().cummax()
        return pdf.assign(total=so_far.where(known).round(4))[["event_id", "total"]]

    x = ev(s, d).select("event_type", "event_id", "t", "value")
    return downsample.apply_series(x, KEY, ["t", "event_id"], totals, "event_id long, total double", _sum=(F.sum("value"), F.sum))


@query("s14_export", "SELECT round(epoch_us(ts) / 1e6, 3) AS t, value, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")
def _(s, d):
    path = f"{scratch.shared_dir(s)}/export-{uuid.uuid4().hex}"
    io.export_range(rounded(ev(s, d), "t", n=3), "t", 1704412800.0, 1704844800.0, ["value", "user_id"], path)
    return io.read_csv(s, path, "t double, value double, user_id long")


@query("s15_derived_sink", "+SELECT event_type, i // 200 AS block, round(min(value * 2), 6) AS min, round(max(value * 2), 6) AS max, count(value) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS rows FROM ev GROUP BY ALL")
def _(s, d):
    path = f"{scratch.shared_dir(s)}/derived-{uuid.uuid4().hex}"
    x = D.derive(_idx(s, d), {"twice": "value * 2"}).select("event_type", "row_idx", "twice")
    io.write_derived(x, path, stats.reduce_blocks(x, KEY, "row_idx", "twice", 200))
    signal, blocks = io.read_derived(s, path)
    return rounded(blocks.select("event_type", "block", "min", "max", "n").crossJoin(signal.agg(F.count(F.lit(1)).alias("rows"))), "min", "max", n=6)


@query("q01_profile", "WITH u AS (SELECT 'c_nationkey' AS \"column\", CAST(c_nationkey AS VARCHAR) AS x FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer) SELECT \"column\", count(*) AS total, count(*) FILTER (WHERE x IS NULL) AS nulls, 100.0 * count(*) FILTER (WHERE x IS NULL) / count(*) AS null_pct, count(DISTINCT x) AS uniques, min(TRY_CAST(x AS DOUBLE)) AS min, max(TRY_CAST(x AS DOUBLE)) AS max, round(avg(TRY_CAST(x AS DOUBLE)), 4) AS mean, round(stddev_samp(TRY_CAST(x AS DOUBLE)), 4) AS std FROM u GROUP BY \"column\"")
def _(s, d):
    return rounded(quality.profile(table(s, d, "customer"), ["c_nationkey", "c_mktsegment"]), "mean", "std")


@query("q02_types", "WITH u AS (SELECT 'c_nationkey' AS \"column\", CAST(c_nationkey AS VARCHAR) AS x FROM customer UNION ALL SELECT 'c_name', c_name FROM customer), h AS (SELECT \"column\", count(TRY_CAST(x AS DOUBLE)) / greatest(count(x), 1) AS share FROM u GROUP BY \"column\") SELECT \"column\", CASE WHEN share * (CASE WHEN share > 0.9 THEN 1 WHEN share > 0.7 THEN 0.9 ELSE 0.5 END) > 0.8 THEN 'numeric' WHEN share > 0.1 THEN 'mixed' ELSE 'string' END AS type FROM h")
def _(s, d):
    return quality.detect_types(table(s, d, "customer"), ["c_nationkey", "c_name"]).select("column", "type")


@query("q03_outliers", "WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer) SELECT count(*) FILTER (WHERE c_acctbal < a - 1.5 * (b - a) OR c_acctbal > b + 1.5 * (b - a)) AS outliers, count(*) FILTER (WHERE isinf(c_acctbal)) AS infinite FROM customer, q")
def _(s, d):
    return quality.iqr_outliers(table(s, d, "customer"), "c_acctbal")


@query("q04_strings", "SELECT count(*) FILTER (WHERE text = '') AS empty, count(*) FILTER (WHERE length(text) > 1000) AS long, CAST(max(length(text)) AS INTEGER) AS longest FROM conversations")
def _(s, d):
    return quality.string_checks(table(s, d, "conversations"), "text")


@query("q06_issues", "WITH u AS (SELECT 'c_custkey' AS \"column\", CAST(c_custkey AS VARCHAR) AS x FROM customer UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer), p AS (SELECT \"column\", count(*) AS n, count(DISTINCT x) AS u, 100.0 * count(*) FILTER (WHERE x IS NULL) / count(*) AS gaps FROM u GROUP BY \"column\") SELECT \"column\", concat_ws(',', CASE WHEN gaps > 50 THEN 'mostly_null' END, CASE WHEN gaps > 20 AND gaps <= 50 THEN 'many_nulls' END, CASE WHEN u = 1 THEN 'constant' END, CASE WHEN u = 2 THEN 'few_values' END, CASE WHEN n > 100 AND u / n > 0.95 THEN 'id_like' END) AS issues FROM p")
def _(s, d):
    return quality.issues(quality.profile(table(s, d, "customer"), ["c_custkey", "c_nationkey"]))


@query("q07_value_types", "SELECT CASE WHEN TRY_CAST(props AS DOUBLE) IS NOT NULL THEN 'numeric' ELSE 'string' END AS type, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1")
def _(s, d):
    return quality.value_types(table(s, d, "events").where("props is not null"), "props")


@query("q08_auto_fix", "SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events")
def _(s, d):
    return quality.auto_fix(table(s, d, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0)), {"k": "numeric"}).select("event_id", "k")


@query("t02_top_significance", f"{D1}, z AS (SELECT *, abs(d1) AS s FROM d WHERE d1 IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY s DESC, i) AS rn FROM z) SELECT event_id, i AS row_idx FROM k WHERE rn <= 20")
def _(s, d):
    x = series.with_row_index(rolling.derivative(ev(s, d), KEY, ORDER, "t", "value"), KEY, ORDER).where("d1 is not null")
    return downsample.top_significant(x.withColumn("significance", F.abs("d1")), KEY, most=20).select("event_id", "row_idx")


MIXED = "m AS (SELECT CASE WHEN c_custkey % 20 = 0 THEN 'x' WHEN c_custkey % 20 = 1 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS id, CAST(c_acctbal AS VARCHAR) AS bal, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END AS half, c_name AS name FROM customer)"
SHARE = "count(TRY_CAST({0} AS DOUBLE)) / greatest(count({0}), 1)"


@query("q08_fix_plan", f"WITH {MIXED}, u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {SHARE.format(c)} AS share, count(*) FILTER (WHERE {c} IS NULL) AS gaps FROM m" for c in ("id", "bal", "half", "name")) + ") SELECT \"column\", CASE WHEN share >= 0.9 AND share < 1 THEN 'numeric' WHEN share > 0.1 AND share < 0.9 THEN 'split' END AS fix, CASE WHEN gaps > 0 THEN CASE WHEN share >= 0.9 THEN 'mean,median,interpolate' ELSE 'constant,drop' END END AS nulls FROM u")
def _(s, d):
    k = F.col("c_custkey")
    x = table(s, d, "customer").select(F.when(k % 20 == 0, "x").when(k % 20 != 1, k.cast("string")).alias("id"), F.col("c_acctbal").cast("string").alias("bal"), F.when(k % 2 == 0, F.col("c_name")).otherwise(k.cast("string")).alias("half"), F.col("c_name").alias("name"))
    return quality.fix_plan(quality.detect_types(x, x.columns), quality.profile(x, x.columns))


# --- cursors, alignment, reports


@query("a23_cursor_delta", "+, c AS (SELECT unnest([1704844800.0, 1705276800.0]) AS pt), sm AS (SELECT event_type, t, max(value) AS v FROM ev GROUP BY event_type, t), k AS (SELECT DISTINCT event_type FROM events), lo AS (SELECT event_type, pt, max(t) AS ta, arg_max(v, t) AS va FROM sm JOIN c ON t <= pt GROUP BY ALL), hi AS (SELECT event_type, pt, min(t) AS tb, arg_min(v, t) AS vb FROM sm JOIN c ON t >= pt GROUP BY ALL), x AS (SELECT event_type, pt, CASE WHEN ta = tb THEN va ELSE va + (vb - va) * (pt - ta) / (tb - ta) END AS v FROM k LEFT JOIN lo USING (event_type) LEFT JOIN hi USING (event_type, pt)) SELECT event_type, round(max(v) FILTER (WHERE pt = 1704844800), 4) AS v1, round(max(v) FILTER (WHERE pt = 1705276800), 4) AS v2, round(max(v) FILTER (WHERE pt = 1705276800) - max(v) FILTER (WHERE pt = 1704844800), 4) AS dv, 432000.0::DOUBLE AS dt, round(1 / 432000.0::DOUBLE, 9) AS freq FROM x GROUP BY event_type")
def _(s, d):
    return rounded(rounded(asof.delta_between(ev(s, d), KEY, "t", "value", 1704844800.0, 1705276800.0), "v1", "v2", "dv"), "freq", n=9)


@query("j09_overlapping_buckets", f"+, {LOD} SELECT event_type, bucket, round(time_min, 3) AS time_min, round(time_max, 3) AS time_max, value_min, value_max FROM lod WHERE time_max >= 1704844800 AND time_min <= 1705276800")
def _(s, d):
    x = downsample.overlapping(_lod(s, d)[100], 1704844800.0, 1705276800.0)
    return rounded(x.select("event_type", "bucket", "time_min", "time_max", "value_min", "value_max"), "time_min", "time_max", n=3)


@query("j10_align_by_position", "+, m AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events) SELECT x.i AS row_idx, x.value AS a, y.value AS b FROM ev x JOIN ev y ON x.i = y.i WHERE x.event_type = (SELECT a FROM m) AND y.event_type = (SELECT b FROM m)")
def _(s, d):
    a, b = table(s, d, "events").agg(F.min("event_type"), F.max("event_type")).first()
    return series.align(ev(s, d), "event_type", ORDER, "value", a, b)


@query("w17_inflections", f"{D1}, e AS (SELECT *, (dt + lag(dt) OVER ({WIN})) / 2 AS mid, d1 - lag(d1) OVER ({WIN}) AS dd FROM d), f AS (SELECT *, nullif(sign(CASE WHEN dd IS NULL THEN NULL WHEN mid <= 0 THEN 0 ELSE dd / mid END), 0) AS sg FROM e), h AS (SELECT *, last_value(sg IGNORE NULLS) OVER ({WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pr FROM f) SELECT event_id, i AS row_idx FROM h WHERE sg * pr < 0")
def _(s, d):
    return rolling.inflections(ev(s, d), KEY, ORDER, "t", "value").select("event_id", "row_idx")


@query("q05_datetime_checks", "SELECT 0::BIGINT AS failed, count(*) FILTER (WHERE year(o_orderdate) < 1900) AS before_1900, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1998-01-01' + INTERVAL 365 DAY) AS ahead, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS INTEGER) AS span_days FROM orders")
def _(s, d):
    return quality.datetime_checks(table(s, d, "orders"), "o_orderdate", F.lit("1998-01-01").cast("timestamp"))


ODD_ID = "CASE WHEN c_custkey % 5 = 0 THEN 'x' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END"


@query("q02_confidence", f"""WITH x AS (SELECT {ODD_ID} AS id FROM customer), n AS (SELECT count(TRY_CAST(id AS DOUBLE)) / count(id) AS share, count(*) FILTER (WHERE regexp_matches(id, '^[0-9]{{5}}([.][0-9]+)?$')) / count(id) * 0.7 AS dated FROM x),
 o AS (SELECT count(*) FILTER (WHERE regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')) / count(o_orderdate) * 0.9 AS dated FROM orders)
 SELECT 'id' AS "column", round(share * CASE WHEN share > 0.9 THEN 1 WHEN share > 0.7 THEN 0.9 ELSE 0.5 END, 4) AS numeric, round(dated, 4) AS dated, CASE WHEN share > 0.9 THEN 'numeric' ELSE 'mixed' END AS type, CASE WHEN share > 0.9 THEN round(share, 4) ELSE 0.6 END AS confidence FROM n
 UNION ALL SELECT 'day', 0.0, round(dated, 4), 'datetime', round(dated, 4) FROM o""")
def _(s, d):
    ids = quality.detect_types(table(s, d, "customer").select(F.expr("if(c_custkey % 5 = 0, concat('x', c_custkey), string(c_custkey))").alias("id")), ["id"])
    days = quality.detect_types(table(s, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), ["day"])
    return rounded(ids.union(days), "numeric", "dated", "confidence").select("column", "numeric", "dated", "type", "confidence")


@query("q05_epoch_checks", "SELECT count(*) FILTER (WHERE event_id % 7 = 0) AS failed, 0::BIGINT AS before_1900, count(*) FILTER (WHERE event_id % 7 <> 0 AND ts > TIMESTAMP '2023-01-15' + INTERVAL 365 DAY) AS ahead, CAST(date_diff('day', min(ts) FILTER (WHERE event_id % 7 <> 0), max(ts) FILTER (WHERE event_id % 7 <> 0)) AS INTEGER) AS span_days FROM events")
def _(s, d):
    x = ev(s, d).withColumn("at", F.expr("if(event_id % 7 = 0, 'none', string(cast(t AS decimal(20, 6))))"))
    return quality.datetime_checks(x, "at", F.lit("2023-01-15").cast("timestamp"), "epoch")


@query("q05_serial_checks", "SELECT 0::BIGINT AS failed, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS before_1900, count(*) FILTER (WHERE o_orderkey % 9 <> 0 AND CAST(o_orderdate AS DATE) > DATE '1998-01-01' + 365) AS ahead, CAST(date_diff('day', min(CAST(o_orderdate AS DATE) - CASE WHEN o_orderkey % 9 = 0 THEN 50000 ELSE 0 END), max(CAST(o_orderdate AS DATE) - CASE WHEN o_orderkey % 9 = 0 THEN 50000 ELSE 0 END)) AS INTEGER) AS span_days FROM orders")
def _(s, d):
    x = table(s, d, "orders").withColumn("at", F.expr("datediff(o_orderdate, date'1899-12-30') - if(o_orderkey % 9 = 0, 50000, 0)"))
    return quality.datetime_checks(x, "at", F.lit("1998-01-01").cast("timestamp"), "serial")


@query("q09_type_counts", "SELECT 'numeric' AS type, 2::BIGINT AS n FROM (SELECT count(c_custkey) AS k FROM customer) WHERE k > 0 UNION ALL SELECT 'string', 2 FROM (SELECT count(c_name) AS k FROM customer) WHERE k > 0")
def _(s, d):
    return quality.type_counts(quality.detect_types(table(s, d, "customer"), ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]))


@query("q09_issue_counts", "SELECT 'id_like' AS issue, count(*) AS n FROM (SELECT count(DISTINCT o_orderkey) / count(*) AS u, count(*) AS k FROM orders UNION ALL SELECT count(DISTINCT o_orderstatus) / count(*), count(*) FROM orders UNION ALL SELECT count(DISTINCT o_totalprice) / count(*), count(*) FROM orders) WHERE u > 0.95 AND k > 100")
def _(s, d):
    return quality.issue_counts(quality.issues(quality.profile(table(s, d, "orders"), ["o_orderkey", "o_orderstatus", "o_totalprice"])))


@query("q09_report", "SELECT 'event_type' AS \"column\", count(TRY_CAST(event_type AS DOUBLE)) AS valid, count(*) - count(TRY_CAST(event_type AS DOUBLE)) AS invalid, 100.0::DOUBLE * count(TRY_CAST(event_type AS DOUBLE)) / count(*) AS success_pct FROM events UNION ALL SELECT 'value', count(value), count(*) - count(value), 100.0::DOUBLE * count(value) / count(*) FROM events UNION ALL SELECT 'ts', count(ts), count(*) - count(ts), 100.0::DOUBLE * count(ts) / count(*) FROM events")
def _(s, d):
    return quality.report(table(s, d, "events"), {"event_type": "numeric", "value": "numeric", "ts": "datetime"})


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Time segments per event type where value >= 50, with duration, count, least, greatest and mean value."""
    return QUERIES["g02_segment_stats"](s, d)
