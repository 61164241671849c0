"""Values of series at given times: linear, hold and nearest lookups as both-sided as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigflow.operators.series import in_cells, with_carry


def value_at(df: DataFrame, probes: DataFrame, key: list[str], t: str, v: str, method: str = "linear", bounds: str = "null") -> DataFrame:
    """key, probe_t, value for each probe (key, probe_t).

    Probes are rows of the series without a value: the last sample before and the first one after come from two
    frames over one order, in chunks with the nearest samples of the chunks around carried in, so no probe is compared
    with every sample and no task sorts a series. Outside the samples: null, or the nearest
    sample with bounds='clamp'. Of samples with one time the greatest value counts.
    """
    samples = df.where(F.col(v).isNotNull()).groupBy(*key, F.col(t).alias("_t")).agg(F.max(v).alias("_v")).withColumn("_p", F.lit(0))
    asks = probes.select(*key, F.col("probe_t").alias("_t")).distinct().withColumn("_v", F.lit(None).cast("double")).withColumn("_p", F.lit(1))
    both = samples.select(*key, "_t", "_v", "_p").unionByName(asks.select(*key, "_t", "_v", "_p"))
    s = F.when(F.col("_p") == 0, F.struct("_t", "_v"))
    x, w = in_cells(both, key, ["_t", "_p"])
    down = w.orderBy(F.col("_t").desc(), F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = with_carry(x, ahead={"_b0": (F.min(s), lambda c: F.last(c, True))}, _a0=(F.max(s), lambda c: F.last(c, True)))
    x = x.withColumn("_a", F.coalesce(F.last(s, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_a0")))
    x = x.withColumn("_b", F.coalesce(F.last(s, True).over(down), F.col("_b0"))).where("_p = 1")
    x = x.withColumn("_b", F.when(F.col("_a._t") == F.col("_t"), F.col("_a")).otherwise(F.col("_b")))  # a sample at the probe's own time is both
    a, b, p = F.col("_a"), F.col("_b"), F.col("_t")
    if method == "hold":
        inner = a["_v"]
    elif method == "nearest":
        inner = F.when(p - a["_t"] <= b["_t"] - p, a["_v"]).otherwise(b["_v"])
    else:
        inner = F.when(b["_t"] == a["_t"], a["_v"]).otherwise(a["_v"] + (b["_v"] - a["_v"]) * F.try_divide(p - a["_t"], b["_t"] - a["_t"]))
    value = F.when(a.isNotNull() & b.isNotNull(), inner)
    if method == "hold":
        value = F.when(a.isNotNull(), inner)
    if bounds == "clamp":
        value = F.coalesce(value, a["_v"], b["_v"])
    return x.select(*key, p.alias("probe_t"), value.alias("value"))


def snap(df: DataFrame, probes: DataFrame, key: list[str], t: str, v: str) -> DataFrame:
    """probe_t, key, at, value: for each probe_t the sample nearest to it over all series.

    Of samples equally near the earlier counts, then the smaller key. Null probes, times and values take no part; a
    repeated probe gives one row, no samples give none.
    """
    names = [f"_k{j}" for j in range(len(key))]
    own_key = F.struct(*[F.col(k).alias(n) for k, n in zip(key, names)])
    at = df.where(F.col(v).isNotNull()).select(F.col(t).cast("double").alias("_t"), own_key.alias("_v"))
    best = at.groupBy("_t").agg(F.min("_v").alias("_v")).withColumn("_p", F.lit(0))
    asks = probes.select(F.col("probe_t").cast("double").alias("_t")).where("_t is not null").distinct().withColumn("_v", F.lit(None).cast(at.schema["_v"].dataType)).withColumn("_p", F.lit(1))
    s = F.when(F.col("_p") == 0, F.struct("_t", "_v"))
    x, w = in_cells(best.where("_t is not null").unionByName(asks), [], ["_t", "_p"])
    down = w.orderBy(F.col("_t").desc(), F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = with_carry(x, ahead={"_b0": (F.min(s), lambda c: F.last(c, True))}, _a0=(F.max(s), lambda c: F.last(c, True)))
    a = F.coalesce(F.last(s, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_a0"))
    b = F.coalesce(F.last(s, True).over(down), F.col("_b0"))
    x = x.withColumn("_a", a).withColumn("_b", b).where("_p = 1")
    nearer = F.when(F.col("_b").isNull() | (F.col("_t") - F.col("_a._t") <= F.col("_b._t") - F.col("_t")), F.col("_a")).otherwise(F.col("_b"))
    x = x.withColumn("_s", nearer).where(F.col("_s").isNotNull()).select(F.col("_t").alias("probe_t"), F.col("_s._t").alias("at"), F.col("_s._v").alias("_v"))
    values = df.where(F.col(v).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col(t).cast("double").alias("_tt")).agg(F.max(v).alias("value"))
    same = F.col("at") == F.col("_tt")
    for n in names:
        same &= F.col(f"_v.{n}").eqNullSafe(F.col(n))
    return x.join(values, same).select("probe_t", *[F.col(n).alias(k) for k, n in zip(key, names)], "at", "value")


def delta_between(df: DataFrame, key: list[str], t: str, v: str, t1: float, t2: float) -> DataFrame:
    """Values at two cursor times, their difference, the time step and its frequency."""
    probes = df.select(*key).distinct().withColumn("probe_t", F.explode(F.array(F.lit(t1), F.lit(t2))))
    x = value_at(df, probes, key, t, v)
    at = lambda c: F.max(F.when(F.col("probe_t") == c, F.col("value")))
    return x.groupBy(*key).agg(at(t1).alias("v1"), at(t2).alias("v2")).withColumn("dv", F.col("v2") - F.col("v1")).withColumn("dt", F.lit(t2 - t1)).withColumn("freq", F.try_divide(F.lit(1.0), F.lit(t2 - t1)))
