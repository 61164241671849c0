"""Cells of a series with about equally many rows, and exact quantiles, both from counts in finer and finer buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.operators.scratch import cut, input_bytes

#: Buckets that a range of values is cut into at a time.
BUCKETS = 1024
#: About the most cells of a table; cells of larger tables get more rows.
MOST = 1 << 15
#: Tables of fewer bytes at their sources are sorted a series to a task, or have their quantiles from one aggregate.
SMALL = 64 << 20
#: What the optimizer takes a source of unknown size for, at least.
UNKNOWN = 1 << 62


def fits(df: DataFrame, small: int | None = None) -> bool:
    """Whether all of df is small enough for one task, by the sizes of its sources; where a source doesn't tell its size, by
    whether df has more than a row for each KB of `small` (SMALL), for which no more rows than that are counted."""
    size, small = input_bytes(df), SMALL if small is None else small
    if size >= UNKNOWN and small < UNKNOWN:
        return small > 0 and df.select(F.lit(1)).limit((small >> 10) + 1).count() <= small >> 10
    return size < small


def _digits(df: DataFrame, c: str) -> list[Column]:
    """Numbers that, compared one after the other, order rows as the column does; none for types that are not ordered so."""
    kind, x = df.schema[c].dataType, F.col(f"`{c}`")
    if isinstance(kind, T.LongType):
        return [F.shiftright(x, 26).cast("double"), x.bitwiseAND(F.lit((1 << 26) - 1)).cast("double")]
    if isinstance(kind, T.DecimalType):
        return [x.cast("double"), (x - F.floor(x)).cast("double")] if kind.precision <= 15 + kind.scale else [x.cast("double")]
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return [x.cast("double")]
    if isinstance(kind, T.TimestampType):
        return [F.unix_micros(x).cast("double")]
    if isinstance(kind, T.TimestampNTZType):
        return [F.unix_date(x.cast("date")) * F.lit(86400e6) + F.hour(x) * F.lit(3600e6) + F.minute(x) * F.lit(60e6) + (F.date_part(F.lit("SECOND"), x) * 1_000_000).cast("double")]
    if isinstance(kind, T.DateType):
        return [F.unix_date(x).cast("double")]
    if isinstance(kind, (T.StringType, T.BinaryType)):
        parts = [F.rpad(F.hex(F.substring(x.cast("binary"), 1 + 6 * k, 6)), 12, "0") for k in range(4)]
        return [F.when(x.isNotNull(), F.conv(p, 16, 10).cast("double")) for p in parts]
    return []


def _finite(d: Column) -> Column:
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def _kind(d: Column, finite: Column) -> Column:
    """0 for null, 1 for -inf, then finite, then the last two for inf and NaN."""
    return F.when(d.isNull(), 0).when(F.isnan(d), BUCKETS + 3).when(d == float("inf"), BUCKETS + 2).when(d == float("-inf"), 1).otherwise(finite).cast("int")


def _bucket(d: Column, lo: Column, hi: Column) -> Column:
    """The bucket of a number between lo and hi; it never falls as the number rises."""
    part = F.try_divide(d / 2 - lo / 2, hi / 2 - lo / 2) * BUCKETS
    return _kind(d, 2 + F.least(F.greatest(F.floor(F.coalesce(part, F.lit(0.0))), F.lit(0)), F.lit(BUCKETS - 1)))


def balanced(df: DataFrame, key: list[str], order: list[str], rows: int) -> DataFrame:
    """df with _chunk (k, the series; n, the cell, rising with the order): cells of a series hold about `rows` rows, never
    more than twice as many but where rows agree in all that orders them.

    The range of each series is cut into buckets that are counted in one grouped pass; those with too many rows are cut
    again between their own least and greatest value, or by the next order column if they hold one value only (a burst),
    until none is left. So far values, bursts and heavy series get the cells that they need. Small buckets next to each
    other make up a cell. Strings count by their first 24 bytes; types without an order like numbers share a cell.
    """
    digits = [d for c in order for d in _digits(df, c)] or [F.lit(0.0)]
    x = df.withColumns({"_k": F.struct(F.lit(0).alias("_0"), *[F.col(f"`{c}`") for c in key]), "_d": F.array(*digits), "_path": F.array().cast("array<int>"), "_j": F.lit(0)})
    now, then = F.get("_d", F.col("_j")), F.get("_d", F.col("_j") + 1)
    kinds, leaves, target = _kind(now, F.lit(2)), [], None
    for depth in range(64):
        ends = [f(_finite(d)).alias(n) for d, names in ((now, ("lo", "hi")), (then, ("lo2", "hi2"))) for f, n in zip((F.min, F.max), names)]
        found = x.where(F.size("_path") == depth).groupBy("_k", "_path", "_j").agg(F.count(F.lit(1)).alias("_n"), F.min(kinds).alias("kind"), F.max(kinds).alias("kind2"), *ends)
        found = cut(found)
        if target is None:
            target = max(rows, (found.agg(F.sum("_n")).first()[0] or 0) // MOST)
        one = F.col("kind") == F.col("kind2")
        one &= F.col("lo").isNull() | (F.col("lo") == F.col("hi"))
        heavy = (F.col("_n") > target) & (~one | (F.col("_j") + 1 < len(digits)))
        leaves.append(found.where(~heavy).select("_k", "_path", "_n"))
        split = found.where(heavy).select(F.col("_k").alias("_hk"), F.col("_path").alias("_hp"), (F.col("_j") + one.cast("int")).alias("_hj"), F.when(one, F.col("lo2")).otherwise(F.col("lo")).alias("_lo"), F.when(one, F.col("hi2")).otherwise(F.col("hi")).alias("_hi"))
        if split.isEmpty():
            break
        x = x.join(split, (F.col("_k") == F.col("_hk")) & (F.col("_path") == F.col("_hp")), "left").withColumn("_j", F.coalesce("_hj", "_j"))
        x = x.withColumn("_path", F.when(F.col("_hj").isNull(), F.col("_path")).otherwise(F.concat("_path", F.array(_bucket(now, F.col("_lo"), F.col("_hi")))))).drop("_hk", "_hp", "_hj", "_lo", "_hi")
    cells = leaves[0]
    for more in leaves[1:]:
        cells = cells.unionByName(more)
    before = F.sum("_n").over(Window.partitionBy("_k").orderBy("_path").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(F.col("_k").alias("_ck"), F.col("_path").alias("_cp"), F.floor(F.coalesce(before, F.lit(0)) / target).alias("_cell"))
    x = x.join(cells, (F.col("_k") == F.col("_ck")) & (F.col("_path") == F.col("_cp")))
    return x.withColumn("_chunk", F.struct(F.col("_k").alias("k"), F.col("_cell").cast("long").alias("n"))).drop("_k", "_d", "_path", "_j", "_ck", "_cp", "_cell")


def quantiles(df: DataFrame, key: list[str], v: Column | str, fractions: list[float], name: str = "q") -> DataFrame:
    """key, name: the exact quantiles of a series' values, between two values in proportion, as one array. Nulls do not
    count, NaN is the greatest; a series without values has a null array.

    Where df is not small no task holds the values of a series: each pass counts the values in buckets and goes on with the
    buckets that hold a wanted rank, all series and ranks at once, until the bucket holds a single value.
    """
    v = (F.col(v) if isinstance(v, str) else v).cast("double")
    if fits(df):
        return df.groupBy(*key).agg(F.percentile(v, F.array(*[F.lit(float(f)) for f in fractions])).alias(name))
    x = df.select(F.struct(F.lit(0).alias("_0"), *key).alias("k"), v.alias("v"))
    spans = cut(x.groupBy("k").agg(F.count("v").alias("n"), F.min(_finite(F.col("v"))).alias("lo"), F.max(_finite(F.col("v"))).alias("hi")))
    wanted = spans.where("n > 0").withColumn("f", F.explode(F.array(*[F.struct(F.lit(k).alias("at"), F.lit(float(f)).alias("f")) for k, f in enumerate(fractions)]))).withColumn("place", (F.col("n") - 1) * F.col("f.f"))
    ranks = wanted.select("k", "lo", "hi", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    open_, done, first = ranks.select("k", "rank", F.struct("lo", "hi").alias("node"), F.lit(0).cast("long").alias("off")), [], True
    while True:
        rows = x.where("v is not null").join(open_.select("k", "node").distinct(), "k")
        if not first:
            rows = rows.where(F.col("v").between(F.col("node.lo"), F.col("node.hi")))
        counts = rows.groupBy("k", "node", _bucket(F.col("v"), F.col("node.lo"), F.col("node.hi")).alias("b")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("a"), F.max("v").alias("z"))
        before = F.sum("m").over(Window.partitionBy("k", "node").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("before", F.coalesce(before, F.lit(0)))
        at = F.col("rank") - F.col("off") - F.col("before")
        step = cut(open_.join(counts, ["k", "node"]).where((at >= 0) & (at < F.col("m"))).select("k", "rank", F.struct(F.col("a").alias("lo"), F.col("z").alias("hi")).alias("node"), (F.col("off") + F.col("before")).alias("off")))
        same = F.col("node.lo") == F.col("node.hi")
        done.append(step.where(same).select("k", "rank", F.col("node.lo").alias("value")))
        open_, first = step.where(~same), False
        if open_.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    low = found.select("k", F.col("rank").alias("r0"), F.col("value").alias("v0"))
    high = found.select("k", F.col("rank").alias("r1"), F.col("value").alias("v1"))
    both = wanted.withColumns({"r0": F.floor("place"), "r1": F.ceil("place")}).join(low, ["k", "r0"]).join(high, ["k", "r1"])
    value = F.when((F.col("r0") == F.col("r1")) | (F.col("v0") == F.col("v1")), F.col("v0")).otherwise((F.col("r1") - F.col("place")) * F.col("v0") + (F.col("place") - F.col("r0")) * F.col("v1"))
    each = both.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.col("f.at").alias("at"), value.alias("value")))).alias("all"))
    every = spans.select("k").join(each, "k", "left")
    return every.select(*[F.col(f"k.{c}").alias(c) for c in key], F.col("all.value").alias(name))
