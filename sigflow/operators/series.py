"""Series layout: key columns, an order, and a row index; row and time ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.operators import cells
from sigflow.operators.scratch import cut

#: Rows of a series that one task of a row window works on, besides those that its frame needs.
CHUNK = 65_536
#: The order to call operators with on what numbered() gives: rows have their row_idx already and are not numbered anew.
NUMBERED = ["row_idx"]


def ordered(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order) if key else Window.partitionBy(F.lit(0)).orderBy(*order)


def in_cells(df: DataFrame, key: list[str], order: list[str], small: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """df with the cell (_chunk) of each row, and a cell's window in the series' order, for `with_carry`.

    A small table (of fewer bytes than `small`, by default cells.SMALL) has one cell a series, which is a plain window; otherwise cells hold about CHUNK / 4 rows, see
    `cells.balanced`, so that no task sorts a series. Null keys are a series; null times come first, NaN last.
    """
    if order is NUMBERED:
        x = df.withColumn("_chunk", F.struct(F.struct(F.lit(0).alias("_0"), *key).alias("k"), F.floor(F.col("row_idx") / max(1, CHUNK // 4)).alias("n")))
    elif cells.fits(df, small):
        x = df.withColumn("_chunk", F.struct(F.struct(F.lit(0).alias("_0"), *key).alias("k"), F.lit(0).alias("n")))
    else:
        x = cells.balanced(df, key, order, max(1, CHUNK // 4))
    return x, Window.partitionBy("_chunk").orderBy(*order)


def one_cell(x: DataFrame) -> bool:
    """Whether in_cells() left each series whole: then its cell number is no count but a constant."""
    return isinstance(x.schema["_chunk"].dataType["n"].dataType, T.IntegerType)


def with_carry(x: DataFrame, ahead: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None, whole: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None, **before: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
    """What the chunks before a row's own (`ahead`: those after it, `whole`: all of its series) amount to: per name an
    aggregate of one chunk and the aggregate that unites those of several, null if there are none. The chunks of a series,
    not its rows, are sorted."""
    if one_cell(x):
        kinds = x.groupBy().agg(*[one.alias(n) for n, (one, _) in {**before, **(ahead or {})}.items()] or [F.lit(0).alias("_")]).schema
        none = {n: F.lit(None).cast(kinds[n].dataType) for n in [*before, *(ahead or {})]}
        return x.withColumns(none | {n: one.over(Window.partitionBy("_chunk")) for n, (one, _) in (whole or {}).items()})
    if not (before or ahead or whole):
        return x
    w = Window.partitionBy("_c.k").orderBy("_c.n")
    frames = [(before, w.rowsBetween(Window.unboundedPreceding, -1)), (ahead or {}, w.orderBy(F.col("_c.n").desc()).rowsBetween(Window.unboundedPreceding, -1)), (whole or {}, Window.partitionBy("_c.k"))]
    sums = x.groupBy(F.col("_chunk").alias("_c")).agg(*[one.alias(n) for parts, _ in frames for n, (one, _) in parts.items()])
    carried = sums.select("_c", *[many(F.col(n)).over(f).alias(n) for parts, f in frames for n, (_, many) in parts.items()])
    return x.join(carried, F.col("_chunk") == F.col("_c")).drop("_c")


def with_row_index(df: DataFrame, key: list[str], order: list[str], name: str = "row_idx", total: str | None = None, passing: Column | None = None, rank: str = "_rank") -> DataFrame:
    """0-based position of each row in its series, by the order columns; total: also the series' row count; passing: also
    the number of passing rows up to and with this one. Rows are numbered within their cell, the rows of the cells before
    are added."""
    rows = (F.count(F.lit(1)), F.sum)
    parts = {"_before": rows} | ({"_seen": (F.count_if(passing), F.sum)} if passing is not None else {})
    x, w = in_cells(df, key, order)
    x = with_carry(x, whole={total: rows} if total else None, **parts)
    x = x.withColumn(name, (F.row_number().over(w) - 1 + F.coalesce("_before", F.lit(0))).cast("long"))
    if passing is not None:
        x = x.withColumn(rank, F.count_if(passing).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_seen", F.lit(0)))
    return x.drop("_chunk", *parts)


def numbered(df: DataFrame, key: list[str], order: list[str], *cols: str) -> DataFrame:
    """key, row_idx and cols of df, to call several operators on with the order NUMBERED. A large table is numbered and
    written once, however many of them read it."""
    if order is NUMBERED:
        return df
    x = with_row_index(df, key, order).select(*dict.fromkeys([*key, "row_idx", *cols]))
    return x if cells.fits(df) else cut(x)


def with_row_index_wide(df: DataFrame, order: list[str], name: str = "row_idx") -> DataFrame:
    """Row index of one giant series without a single-task sort.

    Range partitions sort their own rows; the counts per partition, as many rows as partitions, give the offsets.
    The partitioned rows are written once (shared checkpoint folder), so both reads see the same partitions.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed)
    counts = placed.groupBy(F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    out = placed.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).select(*df.columns, name)


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def slice_rows(df: DataFrame, key: list[str], order: list[str], start: int, count: int) -> DataFrame:
    """Rows start .. start+count-1 of each series."""
    return with_row_index(df, key, order).where(F.col("row_idx").between(start, start + count - 1))


def time_range(df: DataFrame, t: str, a, b) -> DataFrame:
    """Rows with a <= t <= b; reaches the scan as a pushed filter."""
    return df.where(F.col(t).between(a, b))


def chunked_with_halo(df: DataFrame, rows: str, size: int, before: int, after: int, chunk: str = "_chunk") -> DataFrame:
    """Rows dealt into chunks of `size` by their index, each with copies of the neighbouring rows that a frame needs.

    `_own` marks a chunk's own rows; windows partitioned by the chunk then serve one giant series in parallel.
    """
    own = F.floor(F.col(rows) / size)
    last = F.floor((F.col(rows) + before) / size)
    first = F.greatest(F.floor((F.col(rows) - after) / size), F.lit(0))
    return df.withColumn("_home", own).withColumn(chunk, F.explode(F.sequence(first, last))).withColumn("_own", F.col("_home") == F.col(chunk)).drop("_home")


def in_chunks(df: DataFrame, key: list[str], order: list[str], before: int = 0, after: int = 0, total: str | None = None) -> tuple[DataFrame, WindowSpec]:
    """df with row_idx, dealt into chunks, and a chunk's window by row index, good for frames of `before` rows back and
    `after` rows ahead; `own` drops the copied neighbours again."""
    if order is NUMBERED and not total:
        x = df
    else:
        x, w = in_cells(df, key, order)
        if one_cell(x):
            whole = {total: F.count(F.lit(1)).over(Window.partitionBy("_chunk"))} if total else {}
            return x.withColumns({"row_idx": (F.row_number().over(w) - 1).cast("long"), "_own": F.lit(True)} | whole), w
        x = with_row_index(df, key, order, total=total)
    x = chunked_with_halo(x, "row_idx", max(CHUNK, 4 * (before + after)), before, after, "_n_")
    x = x.withColumn("_chunk", F.struct(F.struct(F.lit(0).alias("_0"), *key).alias("k"), F.col("_n_").alias("n"))).drop("_n_")
    return x, Window.partitionBy("_chunk").orderBy("row_idx")


def own(x: DataFrame, keep: bool = False) -> DataFrame:
    """A chunk's own rows; keep: with their chunk, for `with_carry`."""
    return x.where("_own").drop("_own", *([] if keep else ["_chunk"]))


def with_totals(df: DataFrame, key: list[str], **aggs: Column) -> DataFrame:
    """Aggregates of a series beside each of its rows: grouped, then joined, so that no task holds a series."""
    if not key:
        return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in aggs.items()])))  # one row
    return beside(df, df.groupBy(*key).agg(*[c.alias(n) for n, c in aggs.items()]), key)


def beside(df: DataFrame, sums: DataFrame, key: list[str]) -> DataFrame:
    """df with the columns of sums, which has one row a series; null keys are a series too."""
    if not key:
        return df.crossJoin(sums)  # one row
    names = [f"_k{j}" for j in range(len(key))]
    same = F.lit(True)
    for k, n in zip(key, names):
        same &= F.col(k).eqNullSafe(F.col(n))
    return df.join(sums.withColumnsRenamed(dict(zip(key, names))), same).drop(*names)


def summary(df: DataFrame, key: list[str], t: str, v: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.min(v).alias("min_v"), F.max(v).alias("max_v"))


def rate(df: DataFrame, key: list[str], order: list[str], t: str, rows: int = 100) -> DataFrame:
    """1 / median time step over the first rows of each series."""
    x = with_row_index(df, key, order).where(F.col("row_idx") < rows)
    x = x.withColumn("_dt", F.col(t) - F.lag(t).over(ordered(key, ["row_idx"])))
    return x.groupBy(*key).agg((1 / F.median("_dt")).alias("hz"))


def synthetic_time(df: DataFrame, key: list[str], order: list[str], freq: float, t0: float = 0.0) -> DataFrame:
    """A time column t0 + i/freq; a frequency of 0 or less counts as 1000 Hz."""
    hz = freq if freq > 0 else 1000.0
    return with_row_index(df, key, order).withColumn("t", F.lit(t0) + F.col("row_idx") / F.lit(hz))


def align(df: DataFrame, key: str, order: list[str], v: str, a, b) -> DataFrame:
    """row_idx, a, b: the values of two series side by side by row position, up to the shorter one's length."""
    x = with_row_index(df.where(F.col(key).isin(a, b)), [key], order).select("row_idx", key, v)
    pair = x.groupBy("row_idx").agg(F.max(F.when(F.col(key) == a, F.struct(v))).alias("a"), F.max(F.when(F.col(key) == b, F.struct(v))).alias("b"))
    return pair.where("a is not null and b is not null").select("row_idx", F.col(f"a.{v}").alias("a"), F.col(f"b.{v}").alias("b"))
