"""Rolling windows, deviations, trends, derivatives, crossings and normalization. Frames are of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sigflow.operators.cells import quantiles
from sigflow.operators.series import beside, in_cells, in_chunks, own, with_carry, with_row_index, with_totals


def rolling_stats(df: DataFrame, key: list[str], order: list[str], v: str, w: int) -> DataFrame:
    """Full windows only: n - w + 1 rows a series."""
    x, o = in_chunks(df, key, order, before=w - 1)
    f = o.rowsBetween(-(w - 1), 0)
    c = F.col(v)
    out = x.withColumns({"r_mean": F.avg(c).over(f), "r_std": F.stddev_pop(c).over(f), "r_min": F.min(c).over(f), "r_max": F.max(c).over(f), "r_sum": F.sum(c).over(f), "r_rms": F.sqrt(F.avg(c * c).over(f)), "r_median": F.percentile(c, F.lit(0.5)).over(f)})
    return own(out).where(F.col("row_idx") >= w - 1)


def running(df: DataFrame, key: list[str], order: list[str], v: str) -> DataFrame:
    """Mean, rms and maximum of a series' rows so far: those of the row's cell and, carried, of the cells before."""
    x, o = in_cells(df, key, order)
    f, c = o.rowsBetween(Window.unboundedPreceding, 0), F.col(v)
    x = with_carry(x, _s1=(F.sum(c), F.sum), _s2=(F.sum(c * c), F.sum), _m=(F.max(c), F.max), _k=(F.count(c), F.sum))
    so_far = lambda carried, within: (F.coalesce(F.col(carried), F.lit(0)) + F.coalesce(within.over(f), F.lit(0))).cast("double")
    n = so_far("_k", F.count(c))
    x = x.withColumns({"run_rms": F.sqrt(F.try_divide(so_far("_s2", F.sum(c * c)), n)), "run_mean": F.try_divide(so_far("_s1", F.sum(c)), n), "run_max": F.greatest("_m", F.max(c).over(f))})
    return x.select(*df.columns, "run_rms", "run_mean", "run_max")


def deviation(df: DataFrame, key: list[str], order: list[str], v: str, w: int, mode: str = "trailing") -> DataFrame:
    """expected and deviation (percent). trailing: the last w rows, padded at the start with the first value;
    previous: the w rows before, from row w on, 0 where their mean is 0."""
    x, o = in_chunks(df, key, order, before=w)
    if mode == "previous":
        mean = F.avg(v).over(o.rowsBetween(-w, -1))
        x = own(x.withColumn("expected", mean)).where(F.col("row_idx") >= w)
        return x.withColumn("deviation", F.when(F.col("expected") == 0, 0.0).otherwise(F.abs(F.try_divide(F.col(v) - F.col("expected"), F.col("expected"))) * 100))
    f = o.rowsBetween(-(w - 1), 0)
    first = F.first(v).over(o.rowsBetween(Window.unboundedPreceding, 0))
    short = w - F.count(F.lit(1)).over(f)  # above 0 in a series' first chunk only, where `first` is the series' own
    x = own(x.withColumn("expected", (F.sum(v).over(f) + F.when(short > 0, short * first).otherwise(F.lit(0))) / w))
    return x.withColumn("deviation", F.abs((F.col(v) - F.col("expected")) / (F.col("expected") + 1e-9)) * 100)


def bands(df: DataFrame, key: list[str], order: list[str], v: str, w: int, percent: float) -> DataFrame:
    """Growing window at the start; mean plus and minus a percentage."""
    x, o = in_chunks(df, key, order, before=w - 1)
    x = own(x.withColumn("mid", F.avg(v).over(o.rowsBetween(-(w - 1), 0)))).select(*df.columns, "mid")
    return x.withColumn("upper", F.col("mid") * (1 + percent / 100)).withColumn("lower", F.col("mid") * (1 - percent / 100))


def trend(df: DataFrame, key: list[str], order: list[str], v: str) -> DataFrame:
    """Least-squares line over the row index."""
    x = with_totals(with_row_index(df, key, order), key, slope=F.regr_slope(v, "row_idx"), intercept=F.regr_intercept(v, "row_idx"))
    return x.withColumn("trend", F.col("intercept") + F.col("slope") * F.col("row_idx"))


def smooth(df: DataFrame, key: list[str], order: list[str], v: str, w: int) -> DataFrame:
    """Centred moving average of w rows with zeros beyond the ends: rows i - w//2 .. i + ceil(w/2) - 1."""
    x, o = in_chunks(df, key, order, before=w // 2, after=-(-w // 2) - 1)
    return own(x.withColumn("smooth", F.sum(v).over(o.rowsBetween(-(w // 2), -(-w // 2) - 1)) / w)).select(*df.columns, "smooth")


def _slopes(x: DataFrame, o: WindowSpec, t: str, v: str) -> DataFrame:
    dt, dv = F.col(t) - F.lag(t).over(o), F.col(v) - F.lag(v).over(o)
    x = x.withColumn("_dt", dt).withColumn("d1", F.when(dt.isNull(), F.lit(None)).when(dt <= 0, 0.0).otherwise(F.try_divide(dv, dt)))
    mid = (F.col("_dt") + F.lag("_dt").over(o)) / 2
    x = x.withColumn("d2", F.when(F.lag("d1").over(o).isNotNull(), F.when(mid <= 0, 0.0).otherwise(F.try_divide(F.col("d1") - F.lag("d1").over(o), mid))))
    return x.drop("_dt")


def derivative(df: DataFrame, key: list[str], order: list[str], t: str, v: str) -> DataFrame:
    """d1 (0 where time stands still) and d2 (with the centred step), at the later sample."""
    x, o = in_chunks(df, key, order, before=2)
    x = own(_slopes(x, o, t, v))
    return x if "row_idx" in df.columns else x.drop("row_idx")


def zero_crossings(df: DataFrame, key: list[str], order: list[str], v: str, level: float | Column = 0.0) -> DataFrame:
    x, o = in_chunks(df, key, order, before=1)
    a, b = F.lag(v).over(o) - level, F.col(v) - level
    x = x.withColumn("_c", ((a <= 0) & (b > 0)) | ((a >= 0) & (b < 0)))
    return own(x).where("_c").drop("_c")


def inflections(df: DataFrame, key: list[str], order: list[str], t: str, v: str) -> DataFrame:
    """Rows where the second derivative changes its sign, its zeros aside."""
    x, o = in_chunks(df, key, order, before=2)
    x = own(_slopes(x, o, t, v).withColumn("_s", F.when(F.col("d2") != 0, F.signum("d2"))), keep=True)
    x = with_carry(x, _q=(F.max_by(F.col("_s"), F.when(F.col("_s").isNotNull(), F.col("row_idx"))), lambda c: F.last(c, True)))
    x = x.withColumn("_p", F.coalesce(F.last("_s", True).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.col("_q")))
    return x.where(F.col("_s") * F.col("_p") < 0).drop("_s", "_p", "_q", "d1", "_chunk")


def limit_crossings(df: DataFrame, key: list[str], order: list[str], v: str, limits: list[float]) -> DataFrame:
    """A row per crossing and limit, in either direction; leaving equality counts."""
    x, o = in_chunks(df, key, order, before=1)
    x = own(x.withColumn("_p", F.lag(v).over(o))).withColumn("limit", F.explode(F.array(*[F.lit(float(x)) for x in limits])))
    up, down = (F.col("_p") <= F.col("limit")) & (F.col(v) > F.col("limit")), (F.col("_p") >= F.col("limit")) & (F.col(v) < F.col("limit"))
    return x.where(up | down).drop("_p")


def sudden_changes(df: DataFrame, key: list[str], order: list[str], t: str, v: str, k: float = 3.0, sample: bool = False) -> DataFrame:
    """Rows whose derivative is more than k deviations from the mean one; significance up to 1."""
    x, o = in_chunks(df, key, order, before=2)
    x = with_totals(own(_slopes(x, o, t, v)), key, _m=F.avg("d1"), _s=F.stddev_samp("d1") if sample else F.stddev_pop("d1"))
    x = x.withColumn("_d", F.abs(F.col("d1") - F.col("_m"))).drop("_m")
    return x.where(F.col("_d") > k * F.col("_s")).withColumn("significance", F.least(F.lit(1.0), F.try_divide(F.col("_d"), 2 * k * F.col("_s")))).drop("_d", "_s", "d2")


#: From this width on, sliding extremes come from blocks.
WIDE = 48


def sliding(o: WindowSpec, c: Column, w: int, least: bool = False) -> tuple[Column, Column]:
    """The greatest (or least) of the w values before a row, and of the w after it, over rows with row_idx.

    Narrow frames are looked through. A wide one is the end of one block of w rows and the beginning of the next, so it comes
    from running values within blocks, at a cost that does not depend on w.
    """
    f = F.min if least else F.max
    if w < WIDE:
        return f(c).over(o.rowsBetween(-w, -1)), f(c).over(o.rowsBetween(1, w))
    block = Window.partitionBy("_chunk", F.floor(F.col("row_idx") / w)).orderBy("row_idx")
    end = f(c).over(block.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    begin = f(c).over(block.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = F.least if least else F.greatest
    return both(F.lag(end, w).over(o), F.lag(begin, 1).over(o)), both(F.lead(end, 1).over(o), F.lead(begin, w).over(o))


def extrema(df: DataFrame, key: list[str], order: list[str], v: str, w: int = 10) -> DataFrame:
    """Rows strictly above (peak) or below (valley) all w neighbours on both sides; w rows at both ends never are."""
    x, o = in_chunks(df, key, order, before=w, after=w)
    c = F.col(v)
    (lx, rx), (ln, rn) = sliding(o, c, w), sliding(o, c, w, least=True)
    one = F.lit(1)
    x = x.withColumns({"_lx": lx, "_rx": rx, "_ln": ln, "_rn": rn, "_full": F.lag(one, w).over(o) + F.lead(one, w).over(o)})
    kind = F.when((c > F.col("_lx")) & (c > F.col("_rx")), "peak").when((c < F.col("_ln")) & (c < F.col("_rn")), "valley")
    return own(x.withColumn("kind", kind)).where(F.col("kind").isNotNull() & F.col("_full").isNotNull()).drop("_lx", "_ln", "_rx", "_rn", "_full")


def normalize(df: DataFrame, key: list[str], v: str, method: str) -> DataFrame:
    """v_norm beside v: peak, rms, minmax or zscore; a zero divisor leaves the value (peak, rms) or gives 0."""
    c = F.col(v)
    if method in ("peak", "rms"):
        x = with_totals(df, key, _d=F.max(F.abs(c)) if method == "peak" else F.sqrt(F.avg(c * c)))
        return x.withColumn("v_norm", F.coalesce(F.try_divide(c, F.col("_d")), c)).drop("_d")
    if method == "minmax":
        x = with_totals(df, key, _a=F.min(c), _d=F.max(c) - F.min(c))
    else:
        x = with_totals(df, key, _a=F.avg(c), _d=F.stddev_pop(c))
    return x.withColumn("v_norm", F.coalesce(F.try_divide(c - F.col("_a"), F.col("_d")), F.lit(0.0))).drop("_a", "_d")


def outliers(df: DataFrame, key: list[str], v: str, method: str = "std", cut: float = 3.0, baseline: str | None = None, order: list[str] | None = None, w: int = 50) -> DataFrame:
    """Rows further than cut scales from the baseline, with their score.

    Scales: std, aad and mad (mean and median absolute deviation from the baseline) or iqr. Baselines: mean (std, aad) and
    median (mad, iqr) of the series, or, given an order, rolling (mean of the last w rows) and trend (least squares).
    """
    c = F.col(v)
    base = baseline or ("mean" if method in ("std", "aad") else "median")
    if base == "trend":
        x = trend(df, key, order, v).withColumnRenamed("trend", "_b").drop("row_idx", "slope", "intercept")
    elif base == "rolling":
        x, o = in_chunks(df, key, order, before=w - 1)
        x = own(x.withColumn("_b", F.avg(c).over(o.rowsBetween(-(w - 1), 0)))).select(*df.columns, "_b")
    else:
        x = with_totals(df, key, _b=F.avg(c)) if base == "mean" else _with_quantiles(df, key, c, {"_b": 0.5})
    off = F.abs(c - F.col("_b"))
    if method == "iqr":
        x = _with_quantiles(x, key, c, {"_a": 0.25, "_z": 0.75}).withColumn("_s", F.col("_z") - F.col("_a")).drop("_a", "_z")
    elif method == "mad":
        x = _with_quantiles(x, key, off, {"_s": 0.5})
    else:
        x = with_totals(x, key, _s={"std": F.stddev_pop(c), "aad": F.avg(off)}[method])
    return x.withColumn("score", F.try_divide(off, F.col("_s"))).where(F.col("score") > cut).drop("_b", "_s")


def _with_quantiles(df: DataFrame, key: list[str], c: Column, names: dict[str, float]) -> DataFrame:
    x = beside(df, quantiles(df, key, c, list(names.values()), "_q"), key)
    return x.withColumns({n: F.col("_q")[k] for k, n in enumerate(names)}).drop("_q")
