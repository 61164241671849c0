"""Statistics over series: one row per key, all signals in one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigflow.operators.cells import fits, quantiles
from sigflow.operators.series import beside, in_chunks, own, with_row_index, with_totals


def statistics(v: str) -> list[Column]:
    c = F.col(v)
    return [F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.sum(c).alias("sum"), F.sqrt(F.avg(c * c)).alias("rms"), (F.max(c) - F.min(c)).alias("peak_to_peak"), F.count(F.lit(1)).alias("count"), F.count(c).alias("valid_count")]


def with_median(df: DataFrame, key: list[str], v: str, aggs: list[Column]) -> DataFrame:
    """Aggregates of each series and the exact median: in one pass where df is small, else the median by itself."""
    if fits(df):
        return df.groupBy(*key).agg(*aggs, F.median(v).alias("median"))
    return beside(df.groupBy(*key).agg(*aggs), quantiles(df, key, v, [0.5], "_q"), key).withColumn("median", F.col("_q")[0]).drop("_q")


def stats(df: DataFrame, key: list[str], v: str) -> DataFrame:
    return with_median(df, key, v, statistics(v))


def light_stats(df: DataFrame, key: list[str], v: str) -> DataFrame:
    return with_median(df, key, v, [F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max")])


def threshold_stats(df: DataFrame, key: list[str], order: list[str], t: str, v: str, threshold: float) -> DataFrame:
    """Counts, percentages and times above and not above; a step belongs to its later sample."""
    x, o = in_chunks(df, key, order, before=1)
    x = own(x.withColumn("_dt", F.col(t) - F.lag(t).over(o)))
    above = F.col(v) > threshold
    valid = F.count(v)
    return x.groupBy(*key).agg(
        F.count_if(above).alias("above"), F.count_if(~above).alias("below"), (F.lit(100.0) * F.count_if(above) / valid).alias("above_pct"), (F.lit(100.0) * F.count_if(~above) / valid).alias("below_pct"),
        F.coalesce(F.sum(F.when(above, F.col("_dt"))), F.lit(0.0)).alias("time_above"), F.coalesce(F.sum(F.when(~above, F.col("_dt"))), F.lit(0.0)).alias("time_below"),
    )


def percentile_rank(df: DataFrame, key: list[str], v: str, p: float) -> DataFrame:
    """The value at index floor(p/100 * (n-1)) of the sorted values."""
    x = with_row_index(df.where(F.col(v).isNotNull()), key, [v], "_i", total="_n")
    return x.where(F.col("_i") == F.floor(F.lit(p / 100.0) * (F.col("_n") - 1))).select(*key, F.col(v).alias("value"))


def quartiles(df: DataFrame, key: list[str], v: str) -> DataFrame:
    q = quantiles(df, key, v, [0.25, 0.5, 0.75], "_q")
    return q.select(*key, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q2"), F.col("_q")[2].alias("q3"), (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"))


def histogram(df: DataFrame, key: list[str], v: str, bins: int) -> DataFrame:
    """bin, lower, upper, n for equal bins over [min, max]; the maximum is in the last, zero width all in bin 0."""
    span = df.groupBy(*key).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    grid = span.withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    spread = span.withColumn("_w", (F.col("_hi") - F.col("_lo")) / bins)
    at = F.when(F.col("_w") > 0, F.least(F.floor((F.col(v) - F.col("_lo")) / F.nullif(F.col("_w"), F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    n = df.where(F.col(v).isNotNull()).join(spread, key).groupBy(*key, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(n, [*key, "bin"], "left")
    return out.select(*key, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lower"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def shape(df: DataFrame, key: list[str], v: str) -> DataFrame:
    """Population skewness and excess kurtosis, for more than ten values."""
    many = F.count(v) > 10
    return df.groupBy(*key).agg(F.when(many, F.skewness(v)).alias("skewness"), F.when(many, F.kurtosis(v)).alias("kurtosis"))


def duty_cycle(df: DataFrame, key: list[str], order: list[str], t: str, v: str, threshold: float | None = None) -> DataFrame:
    """Percent of the duration above the threshold (default: the series' mean)."""
    x, o = in_chunks(df if threshold is not None else with_totals(df, key, _level=F.avg(v)), key, order, before=1)
    level = F.col("_level") if threshold is None else F.lit(threshold)
    x = own(x.withColumn("_dt", F.col(t) - F.lag(t).over(o))).withColumn("_on", F.col(v) > level)
    return x.groupBy(*key).agg(F.try_divide(F.lit(100.0) * F.coalesce(F.sum(F.when(F.col("_on"), F.col("_dt"))), F.lit(0.0)), F.max(t) - F.min(t)).alias("duty"), F.avg(F.when(F.col("_on"), 100.0).otherwise(0.0)).alias("duty_samples"))


def sampling(df: DataFrame, key: list[str], t: str) -> DataFrame:
    return df.groupBy(*key).agg(F.try_divide((F.count(t) - 1).cast("double"), F.max(t) - F.min(t)).alias("rate"), (F.max(t) - F.min(t)).alias("duration"))


def preaggregate(df: DataFrame, key: list[str], idx: str, v: str, size: int) -> DataFrame:
    """Mergeable sums per chunk of `size` rows."""
    c = F.col(v)
    return df.groupBy(*key, F.floor(F.col(idx) / size).alias("chunk")).agg(F.min(idx).alias("start_row"), F.count(F.lit(1)).alias("row_count"), F.sum(c).alias("s1"), F.sum(c * c).alias("s2"), F.min(c).alias("vmin"), F.max(c).alias("vmax"), F.count(c).alias("valid"))


def range_stats(pre: DataFrame, df: DataFrame, key: list[str], idx: str, v: str, a: int, b: int, size: int) -> DataFrame:
    """Statistics of rows [a, b) from whole chunks where they fit and from rows at both edges."""
    first, last = -(-a // size), b // size
    inner = pre.where(F.col("chunk").between(first, last - 1)).select(*key, "s1", "s2", "vmin", "vmax", "valid")
    edge = df.where(F.col(idx).between(a, b - 1) & ~F.floor(F.col(idx) / size).between(first, last - 1))
    edge = preaggregate(edge, key, idx, v, size).select(*key, "s1", "s2", "vmin", "vmax", "valid")
    total = inner.unionByName(edge).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("s1", "s2", "valid")], F.min("vmin").alias("min"), F.max("vmax").alias("max"))
    # sums of decimals stay exact however the rows were cut into chunks
    mean, square = (F.try_divide(F.col(c).cast("double"), F.col("valid")) for c in ("s1", "s2"))
    return total.select(*key, "valid", mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"))


def sketches(df: DataFrame, key: list[str], idx: str, v: str, size: int, k: int = 800) -> DataFrame:
    """A KLL sketch of the values of each chunk of `size` rows; its rank error, merged or not, is about 2 / k ** 0.9. Null and
    NaN take no part, chunks without values have no sketch."""
    x = df.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
    return x.groupBy(*key, F.floor(F.col(idx) / size).alias("chunk")).agg(F.kll_sketch_agg_double(F.col(v).cast("double"), F.lit(k)).alias("sketch"))


def range_quantiles(sketched: DataFrame, df: DataFrame, key: list[str], idx: str, v: str, a: int, b: int, size: int, fractions: list[float], k: int = 800) -> DataFrame:
    """key, q: about the quantiles of rows [a, b) of each series, from the sketches of whole chunks and the rows at both edges."""
    first, last = -(-a // size), b // size
    inner = sketched.where(F.col("chunk").between(first, last - 1))
    edge = df.where(F.col(idx).between(a, b - 1) & ~F.floor(F.col(idx) / size).between(first, last - 1))
    both = inner.unionByName(sketches(edge, key, idx, v, size, k))
    merged = both.groupBy(*key).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("s"))
    return merged.select(*key, F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(float(f)) for f in fractions])).alias("q"))


def reduce_blocks(df: DataFrame, key: list[str], idx: str, v: str, size: int = 500) -> DataFrame:
    c = F.col(v)
    return df.groupBy(*key, F.floor(F.col(idx) / size).alias("block")).agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), F.sqrt(F.avg(c * c)).alias("rms"), F.count(c).alias("n"))


def merge_blocks(blocks: DataFrame, key: list[str]) -> DataFrame:
    n = F.sum("n")
    return blocks.groupBy(*key).agg(F.min("min").alias("min"), F.max("max").alias("max"), (F.sum(F.col("avg") * F.col("n")) / n).alias("avg"), F.sqrt(F.sum(F.col("rms") * F.col("rms") * F.col("n")) / n).alias("rms"), n.alias("n"))


def correlate(df: DataFrame, target: str, signals: list[str], top: int | None = None) -> DataFrame:
    """Pearson r of the target with each signal over pairwise valid rows, ranked by |r|; undefined ones are left out."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    pair = lambda c, of: F.when(finite(c) & finite(target), F.col(of))
    one = df.agg(*[F.when((F.count(pair(c, c)) >= 2) & (F.stddev_pop(pair(c, c)) > 0) & (F.stddev_pop(pair(c, target)) > 0), F.corr(pair(c, target), pair(c, c))).alias(c) for c in signals])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("r")) for c in signals])).alias("x")).select("x.*").where("r is not null")
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("r").desc(), "signal")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)
