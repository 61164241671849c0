"""Data quality profiling: column profiles, type detection, issues and fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigflow.operators.cells import quantiles

# Null tokens, boolean tokens and date patterns with their weights.
NULL_TOKENS = ["", "NULL", "null", "None", "NA", "N/A", "nan", "NaN", "-"]
BOOLEAN_TOKENS = ["true", "false", "1", "0", "yes", "no", "y", "n", "t", "f"]
DATE_PATTERNS = {
    "iso_datetime": (r"^\d{4}-\d{2}-\d{2}[\sT]\d{2}:\d{2}:\d{2}", 0.95),
    "iso_date": (r"^\d{4}-\d{2}-\d{2}$", 0.90),
    "us_datetime": (r"^\d{1,2}/\d{1,2}/\d{4}\s\d{1,2}:\d{2}:\d{2}", 0.85),
    "eu_datetime": (r"^\d{1,2}/\d{1,2}/\d{4}\s\d{1,2}:\d{2}:\d{2}", 0.80),
    "turkish_datetime": (r"^\d{1,2}\.\d{1,2}\.\d{4}\s\d{1,2}:\d{2}:\d{2}", 0.85),
    "timestamp": (r"^\d{10}(\.\d+)?$", 0.90),
    "excel_serial": (r"^\d{5}(\.\d+)?$", 0.70),
}


def number(c: Column) -> Column:
    return c.try_cast("double")


#: Values that a task of uniques() holds at most before they are dealt by value.
HELD = 1_000_000


def uniques(df: DataFrame, cols: list[str]) -> DataFrame:
    """k, uniques: the different values (as text, nulls aside) of the kth column. Rows are dealt over so many tasks that none
    gathers more than HELD values, however few files hold them."""
    x = df.select(*[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(cols)], F.monotonically_increasing_id().alias("_at"))
    tasks = -(-df.count() * len(cols) // HELD)
    if tasks > 1:
        x = x.repartition(tasks, "_at")
    each = x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("s")) for k in range(len(cols))])).alias("x")).select("x.*")
    return each.where("s is not null").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("uniques"))


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per column: total, nulls, null_pct, uniques and the numeric summary; the values that are told apart go by
    value over the tasks, all else is one pass."""
    aggs = []
    for k, c in enumerate(cols):
        s = F.col(c).cast("string")
        n = number(s)
        aggs.append(F.struct(F.lit(k).alias("k"), F.lit(c).alias("column"), F.count(F.lit(1)).alias("total"), F.count_if(s.isNull()).alias("nulls"), (F.lit(100.0) * F.count_if(s.isNull()) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("null_pct"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std")).alias(f"c{k}"))
    x = df.agg(*aggs).select(F.explode(F.array(*[f"c{k}" for k in range(len(cols))])).alias("x")).select("x.*")
    x = x.join(F.broadcast(uniques(df, cols)), "k", "left")  # a row a column
    return x.select("column", "total", "nulls", "null_pct", F.coalesce("uniques", F.lit(0)).alias("uniques"), "min", "max", "mean", "std")


def detect_types(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, the confidences numeric, dated and boolean, the best date format, the type they speak for and its confidence.

    numeric is the share of non-null values that are numbers, times 0.9 from 0.9 down and 0.5 from 0.7 down; dated the best
    share of a date pattern times its weight, or 0.8 if that is below 0.7 and every value parses as a time. Numbers come
    before dates and dates before booleans; mixed columns hold a tenth of numbers or dates at least. Without values: string.
    """
    aggs = []
    for k, c in enumerate(cols):
        s = F.trim(F.col(c).cast("string"))
        n = F.greatest(F.count(s), F.lit(1))
        fits = [F.struct((F.count_if(s.rlike(p)) / n * w).alias("dated"), F.lit(-at).alias("order"), F.lit(name).alias("format")) for at, (name, (p, w)) in enumerate(DATE_PATTERNS.items())]
        parsed = (F.count(s) > 0) & (F.count(F.try_to_timestamp(s)) == F.count(s))
        aggs.append(F.struct(F.lit(c).alias("column"), (F.count(number(s)) / n).alias("share"), F.greatest(*fits).alias("best"), parsed.alias("parsed"), (F.count_if(F.lower(s).isin(BOOLEAN_TOKENS)) / n).alias("boolean")).alias(f"c{k}"))
    x = df.agg(*aggs).select(F.explode(F.array(*[f"c{k}" for k in range(len(cols))])).alias("x")).select("x.*")
    share, loose = F.col("share"), (F.col("best.dated") < 0.7) & F.col("parsed")
    numeric = share * F.when(share > 0.9, 1.0).when(share > 0.7, 0.9).otherwise(0.5)
    x = x.withColumns({"numeric": numeric, "dated": F.when(loose, 0.8).otherwise(F.col("best.dated")), "format": F.when(F.col("best.dated") > 0, F.col("best.format")).when(loose, "auto")})
    kind = F.when(F.col("numeric") > 0.8, "numeric").when(F.col("dated") > 0.7, "datetime").when(F.col("boolean") > 0.8, "boolean").when((share > 0.1) | (F.col("dated") > 0.1), "mixed").otherwise("string")
    sure = F.when(F.col("type").isin("numeric", "datetime", "boolean"), F.greatest(*[F.when(F.col("type") == t, F.col(v)) for t, v in (("numeric", "numeric"), ("datetime", "dated"), ("boolean", "boolean"))])).when(F.col("type") == "mixed", 0.6).otherwise(0.5)
    return x.withColumn("type", kind).withColumn("confidence", sure).select("column", "numeric", "dated", "boolean", "format", "type", "confidence")


def iqr_outliers(df: DataFrame, c: str) -> DataFrame:
    q = quantiles(df, [], c, [0.25, 0.75])
    low, high = F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0]), F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])
    return df.crossJoin(q).agg(F.count_if((F.col(c) < low) | (F.col(c) > high)).alias("outliers"), F.count_if(F.abs(c) == float("inf")).alias("infinite"))


def string_checks(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.count_if(F.col(c) == "").alias("empty"), F.count_if(F.char_length(c) > 1000).alias("long"), F.max(F.char_length(c)).alias("longest"))


def issues(profiled: DataFrame) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("null_pct") > 50, "mostly_null"), F.when((F.col("null_pct") > 20) & (F.col("null_pct") <= 50), "many_nulls"), F.when(F.col("uniques") == 1, "constant"), F.when(F.col("uniques") == 2, "few_values"), F.when((F.col("total") > 100) & (F.col("uniques") / F.col("total") > 0.95), "id_like")))
    return profiled.select("column", F.array_join(flags, ",").alias("issues"))


def value_types(df: DataFrame, c: str) -> DataFrame:
    s = F.trim(F.col(c).cast("string"))
    kind = F.when(s.isNull() | s.isin(NULL_TOKENS), "null").when(number(s).isNotNull(), "numeric").when(s.rlike("|".join(p for p, _ in DATE_PATTERNS.values())), "datetime").otherwise("string")
    return df.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"))


def fix_plan(detected: DataFrame, profiled: DataFrame) -> DataFrame:
    """column, fix, nulls: what to do with each column, from detect_types() and profile().

    fix: numeric, or, for dates, epoch, serial or datetime by their format, where not all values are of the type as they
    stand; split for mixed columns; else null. nulls: the ways to fill that its type allows, where it has nulls.
    """
    dated = F.when(F.col("format") == "timestamp", "epoch").when(F.col("format") == "excel_serial", "serial").otherwise("datetime")
    fix = F.when(F.col("type") == "mixed", "split").when((F.col("type") == "numeric") & (F.col("numeric") < 1), "numeric").when((F.col("type") == "datetime") & (F.col("dated") < 1), dated)
    ways = F.when(F.col("type") == "numeric", "mean,median,interpolate").when(F.col("type") == "datetime", "forward,backward").otherwise("constant,drop")
    x = detected.join(profiled.select("column", "nulls"), "column")
    return x.select("column", fix.alias("fix"), F.when(F.col("nulls") > 0, ways).alias("nulls"))


def plan_of(planned: DataFrame) -> dict[str, str]:
    """The fixes of fix_plan() for auto_fix(): one entry a column."""
    return {r["column"]: r["fix"] for r in planned.where("fix is not null and fix <> 'split'").collect()}


def auto_fix(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Coerce columns to 'numeric', 'datetime' (text), 'epoch' or 'serial' times; what does not parse becomes null."""
    def one(c: Column, kind: str) -> Column:
        return number(c) if kind == "numeric" else instant(c, "text" if kind == "datetime" else kind)

    return df.withColumns({c: one(F.col(f"`{c}`").cast("string"), k) for c, k in plan.items()})


def clean(df: DataFrame, cols: list[str], null: str = "keep", inf: str = "null") -> DataFrame:
    """NaN to null; infinities to null or zero; nulls kept or zero."""
    def one(c: str) -> Column:
        x = F.when(~F.isnan(c), F.col(c))
        x = F.when(F.abs(x) == float("inf"), F.lit(0.0) if inf == "zero" else F.lit(None)).otherwise(x)
        return F.coalesce(x, F.lit(0.0)) if null == "zero" else x

    return df.withColumns({c: one(c) for c in cols})


def null_tokens(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.trim(c).isin(NULL_TOKENS), F.col(c)) for c in cols})


def normalize_time(df: DataFrame, c: str, unit: str = "s", t0: float = 0.0) -> DataFrame:
    """Text to seconds: decimal comma or point; if more than half fails, date and time text; numbers above 1e12 are ms."""
    s = F.trim(F.col(c).cast("string"))
    n = number(F.replace(s, F.lit(","), F.lit(".")))
    failed, total = df.agg(F.count_if(n.isNull() & s.isNotNull()), F.count(s)).first()
    if total and failed > total / 2:
        t = F.unix_micros(F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("dd.MM.yyyy HH:mm:ss")))) / 1e6
    else:
        t = F.when(F.abs(n) > 1e12, n / 1000).otherwise(n) * {"s": 1.0, "ms": 1e-3, "us": 1e-6}[unit]
    return df.withColumn("t", t + t0)


def instant(c: Column, kind: str = "text") -> Column:
    """A time from text, from seconds of the epoch ('epoch') or from days since 1899-12-30 ('serial'); null if it is none."""
    if kind == "text":
        return F.try_to_timestamp(c)
    n = number(c)
    return F.timestamp_seconds(n if kind == "epoch" else (n - 25569) * 86400)


def datetime_checks(df: DataFrame, c: str, now: Column | None = None, kind: str = "text") -> DataFrame:
    """Values that fail to parse, dates before 1900 and more than 365 days ahead of now, and the span in days; kind as in
    instant()."""
    s = F.trim(F.col(c).cast("string"))
    at = instant(s, kind)
    ahead = (F.current_timestamp() if now is None else now) + F.expr("interval 365 days")
    return df.agg(F.count_if(s.isNotNull() & at.isNull()).alias("failed"), F.count_if(F.year(at) < 1900).alias("before_1900"), F.count_if(at > ahead).alias("ahead"), F.datediff(F.max(at), F.min(at)).alias("span_days"))


def type_counts(detected: DataFrame) -> DataFrame:
    """Columns of each type in the result of detect_types()."""
    return detected.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def issue_counts(found: DataFrame) -> DataFrame:
    """Columns that have each issue in the result of issues()."""
    return found.select(F.explode(F.split("issues", ",")).alias("issue")).where("issue <> ''").groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def report(df: DataFrame, plan: dict[str, str]) -> DataFrame:
    """Per column of the plan (see auto_fix()): valid and invalid values and the percentage of values that are valid."""
    fixed = auto_fix(df.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(plan)]), {f"c{k}": kind for k, kind in enumerate(plan.values())})
    n = F.count(F.lit(1))
    rows = [F.struct(F.lit(c).alias("column"), F.count(f"c{k}").alias("valid"), (n - F.count(f"c{k}")).alias("invalid"), F.try_divide(F.lit(100.0) * F.count(f"c{k}"), n).alias("success_pct")) for k, c in enumerate(plan)]
    return fixed.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("x")).select("x.*") if rows else df.sparkSession.createDataFrame([], "column string, valid long, invalid long, success_pct double")
