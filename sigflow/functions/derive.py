"""Signals defined by SQL expressions over signals, and bit decoding."""

from __future__ import annotations

import re
from collections.abc import Callable
from graphlib import CycleError, TopologicalSorter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigflow.operators.series import with_totals

ORDER_BOUND = re.compile(r"\b(cumsum|cumprod|diff|correlate|convolve|gradient|rolling|shift|lag|lead|over)\b", re.I)


def derive(df: DataFrame, exprs: dict[str, str], aggregates: dict[str, str] | None = None, key: list[str] | None = None) -> DataFrame:
    """Add signals by SQL expression; they may use each other in any order, a cycle raises ValueError.

    aggregates are computed per key first (over all rows without one) and can be named in the expressions.
    """
    for name, text in (aggregates or {}).items():
        df = with_totals(df, key or [], **{name: F.expr(text)})
    words = {n: set(re.findall(r"[A-Za-z_]\w*", e)) for n, e in exprs.items()}
    try:
        turn = list(TopologicalSorter({n: words[n] & exprs.keys() for n in exprs}).static_order())
    except CycleError as e:
        raise ValueError(f"signals define each other in a circle: {e.args[1]}") from e
    for name in turn:
        df = df.withColumn(name, F.expr(exprs[name]))
    return df


def row_wise(expr: str) -> str:
    """The expression itself, if it needs no other rows; else ValueError."""
    if found := ORDER_BOUND.search(expr):
        raise ValueError(f"{found[0]} needs the order of rows")
    return expr


def log10(x: str) -> str:
    """The expression of a decimal logarithm that is -Infinity at 0 and NaN below, where Spark's own is null."""
    return f"CASE WHEN {x} > 0 THEN log10({x}) WHEN {x} = 0 THEN double('-Infinity') WHEN {x} < 0 THEN double('NaN') END"


def divide(a: Column, b: Column, zero: float | None = None) -> Column:
    x = F.try_divide(a, b)
    return x if zero is None else F.coalesce(x, F.when(b == 0, F.lit(zero)))


def floor_mod(a: Column, b: Column) -> Column:
    return F.try_subtract(a, b * F.floor(F.try_divide(a, b)))


def smaller(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def greater(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def clip(x: Column, low, high) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def where(c: Column, a: Column, b: Column) -> Column:
    """a where c is not 0 (or true), else b; b for a null c."""
    return F.when(c.cast("double") != 0, a).otherwise(b)


def unix_seconds(c: Column) -> Column:
    """Epoch values as seconds: beyond 1e12 they are milliseconds."""
    return F.when(F.abs(c) > 1e12, c / 1000.0).otherwise(c.cast("double"))


#: Seconds between two marks of a time axis up to which a format serves (fixed values).
LABELS = ((1, "dd/MM/yyyy HH:mm:ss.SSS"), (60, "dd/MM/yyyy HH:mm:ss"), (86_400, "dd/MM HH:mm"), (float("inf"), "dd/MM/yyyy"))


def time_label(c: Column, spacing: float) -> Column:
    """The text of an epoch value on an axis with marks so many seconds apart, in the session's time zone."""
    return F.date_format(F.timestamp_micros(F.round(unix_seconds(c) * 1_000_000).cast("long")), next(f for most, f in LABELS if spacing < most))


def vectorised(df: DataFrame, name: str, fn: Callable[..., pd.Series], cols: list[str], kind: str = "double") -> DataFrame:
    """df with a user's function of whole columns, batch by batch (pandas series in, one out); rows are independent."""
    return df.withColumn(name, F.pandas_udf(fn, kind)(*[F.col(c) for c in cols]))


def active_bits(df: DataFrame, keep: list[str], v: str, definitions: DataFrame | None = None, series: str | None = None) -> DataFrame:
    """A row per set bit (0..63) with its description; 'Undefined Bit n' where none is given."""
    x = df.select(*keep, F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(F.col(v).cast("long"), b) == 1)).alias("bit"))
    other = F.concat(F.lit("Undefined Bit "), F.col("bit").cast("string"))
    if definitions is None:
        return x.withColumn("description", other)
    on = ["bit"] + ([series] if series else [])
    return x.join(definitions, on, "left").withColumn("description", F.coalesce("description", other))
