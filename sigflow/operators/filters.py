"""Conditions, multi-condition filters and named filter sets, which reach the scan; null and NaN pass nothing."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def _not_nan(c: Column) -> Column:
    """NaN is above infinity. As a comparison this reaches the scan, also from within an or, where isnan() would stop it all."""
    return c <= float("inf")


def cond(col: str, op: str, value: float, high: float | None = None, tolerance: float = 1e-10) -> Column:
    """One condition: between, > >= < <= = !=; equality has the tolerance.

    The comparison stands by itself, so that it reaches the scan, and NaN, the greatest value, is ruled out beside it where
    it would pass. Null for a null value, as comparisons are: no row passes where(), count_if() or a segment. `mask` makes
    that false.
    """
    c = F.col(col)
    if op == "between":
        return c.between(value, high)
    if op == "=":
        return c.between(value - tolerance, value + tolerance) & (F.abs(c - value) < tolerance)
    test = F.abs(c - value) >= tolerance if op == "!=" else OPS[op](c, F.lit(value))
    return test & _not_nan(c) if op in (">", ">=", "!=") else test


def mask(condition: Column) -> Column:
    """True or false for every row."""
    return F.coalesce(condition, F.lit(False))


def fold(conditions: list[tuple[str, Column]]) -> Column:
    """Left fold of (and|or, condition); the first connective is ignored; no condition passes every row."""
    if not conditions:
        return F.lit(True)
    return functools.reduce(lambda a, x: (a & x[1]) if x[0] == "and" else (a | x[1]), conditions[1:], conditions[0][1])


def parameter_filter(spec: list[dict], within: str = "all") -> Column:
    """Nested filter: [{parameter, ranges: [{operator, value}]}]; AND between parameters, within one by `within`."""
    parts = []
    for p in spec:
        tests = [cond(p["parameter"], r["operator"], r["value"]) for r in p["ranges"]]
        if tests:
            parts.append(functools.reduce(operator.and_ if within == "all" else operator.or_, tests))
    return functools.reduce(operator.and_, parts, F.lit(True))


def outside(col: str, low: float, high: float) -> Column:
    """Inverse range."""
    c = F.col(col)
    return ((c < low) | (c > high)) & _not_nan(c)


def apply_filters(df: DataFrame, named: dict[str, Column], enabled: list[str] | None = None) -> DataFrame:
    return df.where(functools.reduce(operator.and_, [named[n] for n in (named if enabled is None else enabled)], F.lit(True)))


def filter_counts(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """name, visible, hidden for each filter and for all together ('*'), in one pass."""
    every = dict(named) | {"*": functools.reduce(operator.and_, named.values(), F.lit(True))}
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"_{k}") for k, c in enumerate(every.values())])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{k}").alias("visible"), (F.col("_n") - F.col(f"_{k}")).alias("hidden")) for k, n in enumerate(every)]))
    return one.select(rows.alias("r")).select("r.*")
