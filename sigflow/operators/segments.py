"""Runs of passing rows as segments, limit violations, and joins of rows with segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigflow.operators.series import in_cells, with_carry, with_row_index


def segments(df: DataFrame, key: list[str], order: list[str], t: str, predicate: Column, extra: list[Column] | None = None) -> DataFrame:
    """Maximal runs of passing rows: start_t, end_t, start_idx, end_idx (inclusive), n and extra aggregates.

    A run has one value of row index minus rank among the passing rows; the ranks are counted per cell and carried on.
    """
    passing = with_row_index(df, key, order, passing=predicate).where(predicate)
    runs = passing.withColumn("_run", F.col("row_idx") - F.col("_rank"))
    base = [F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.min("row_idx").alias("start_idx"), F.max("row_idx").alias("end_idx"), F.count(F.lit(1)).alias("n")]
    return runs.groupBy(*key, "_run").agg(*base, *(extra or [])).drop("_run")


def violations(df: DataFrame, limits: DataFrame, key: list[str], order: list[str], t: str, v: str) -> DataFrame:
    """Runs outside their series' limits (limits: key, lo, hi), with the least and greatest value."""
    with_limits = df.join(limits, key)
    bad = F.coalesce((F.col(v) < F.col("lo")) | (F.col(v) > F.col("hi")), F.lit(False)) & ~F.isnan(F.col(v).cast("double"))
    return segments(with_limits, key, order, t, bad, [F.min(v).alias("vmin"), F.max(v).alias("vmax")])


def violation_summary(found: DataFrame, key: list[str]) -> DataFrame:
    return found.groupBy(*key).agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("points"), F.min("vmin").alias("vmin"), F.max("vmax").alias("vmax"))


def half_open(found: DataFrame) -> DataFrame:
    """Regions [start, end) of row indices."""
    return found.withColumn("end_row", F.col("end_idx") + 1).withColumnRenamed("start_idx", "start_row")


def merge_regions(regions: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Unite overlapping and touching regions. The furthest end so far, and the number of regions begun, go from cell to cell
    of a series, so no task sorts all its regions."""
    x, w = in_cells(regions.select(*key, start, end), key, [start, end])
    x = with_carry(x, _m=(F.max(end), F.max))
    far = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_m"))
    x = x.withColumn("_new", F.coalesce((F.col(start) > far).cast("int"), F.lit(1)))
    x = with_carry(x, _begun=(F.sum("_new"), F.sum))
    x = x.withColumn("_g", F.coalesce("_begun", F.lit(0)) + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def _with_latest(df: DataFrame, segs: DataFrame, key: list[str], x: str, start: str, end: str | None = None) -> DataFrame:
    """Rows of df with _at: the last segment of their series that starts at or before x, or, given an end column, the
    greatest end of all those.

    Rows and segment starts go through one order by x, in cells, so no row is compared with every segment and no task
    sorts a series.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    names = [f"_k{j}" for j in range(len(key))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col(x).cast("double").alias("_x"), F.lit(1).alias("_p"), row.alias("_row"), F.lit(None).cast(segs.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_seg"))
    starts = segs.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col(start).cast("double").alias("_x"), F.lit(0).alias("_p"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.struct("*").alias("_seg"))
    both, w = in_cells(rows.unionByName(starts), names, ["_x", "_p"])
    f = w.rowsBetween(Window.unboundedPreceding, 0)
    if end is None:
        both = with_carry(both, _old=(F.max_by(F.col("_seg"), F.when(F.col("_seg").isNotNull(), F.col("_x"))), lambda c: F.last(c, True)))
        latest = F.coalesce(F.last("_seg", True).over(f), F.col("_old"))
    else:
        ends = F.col(f"_seg.{end}").cast("double")
        both = with_carry(both, _old=(F.max(ends), F.max))
        latest = F.greatest(F.max(ends).over(f), F.col("_old"))
    known = F.lit(True)
    for n in names:
        known &= F.col(n).isNotNull()
    return both.withColumn("_at", F.when(known, latest)).where("_p = 1").select("_row.*", "_x", "_at")


def in_segments(df: DataFrame, segs: DataFrame, key: list[str], x: str, start: str, end: str, how: str = "left_semi") -> DataFrame:
    """Rows inside (left_semi) or outside (left_anti) any segment; end inclusive. Segments may overlap: a row is inside if
    the furthest end of those begun is not before it. Rows with a null key or x are inside none."""
    found = _with_latest(df, segs, key, x, start, end)
    inside = F.coalesce(F.col("_at") >= F.col("_x"), F.lit(False))
    return found.where(inside if how == "left_semi" else ~inside).select(*df.columns)


def concatenate(df: DataFrame, segs: DataFrame, key: list[str], t: str, gap: float = 0.01) -> DataFrame:
    """Rows inside segments (that do not overlap) on a continuous time t_cat: each segment starts (1 + gap) spans after the
    one before."""
    x, w = in_cells(segs.withColumn("_span", (F.col("end_t") - F.col("start_t")) * (1 + gap)), key, ["start_t"])
    x = with_carry(x, _before=(F.sum("_span"), F.sum))
    s = x.withColumn("_off", F.coalesce("_before", F.lit(0.0)) + F.coalesce(F.sum("_span").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select(*segs.columns, "_off")
    found = _with_latest(df, s, key, t, "start_t").where(F.col("_x") <= F.col("_at.end_t"))
    return found.withColumn("t_cat", F.col(t) - F.col("_at.start_t") + F.col("_at._off")).select(*df.columns, "t_cat")


def with_gaps(df: DataFrame, segs: DataFrame, key: list[str], order: list[str], t: str, v: str) -> DataFrame:
    """Rows inside segments plus one null value at the end of each, so that plots break there. Rows count by their index, so
    one outside that shares its time with a segment's end stays out; null keys are a series."""
    x = with_row_index(df, key, order).withColumn("_series", F.struct(*key))
    inside = in_segments(x, segs.withColumn("_series", F.struct(*key)), ["_series"], "row_idx", "start_idx", "end_idx").select(*key, t, v)
    return inside.unionByName(segs.select(*key, F.col("end_t").alias(t), F.lit(None).cast("double").alias(v)))
