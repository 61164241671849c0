"""Recordings stored by chunk, with the bounds of each chunk and levels of detail beside them; regions and views that read
only what they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigflow.operators.downsample import build_lod, overlapping
from sigflow.operators.segments import merge_regions
from sigflow.operators.series import with_row_index
from sigflow.operators.stats import preaggregate

LEVELS = (100, 10_000, 100_000)
#: The most folders of a recording. Those of longer series hold more chunks each, so that the time to write, list and open
#: folders does not grow with the rows.
FOLDERS = 256


def store(df: DataFrame, key: list[str], order: list[str], t: str, signals: list[str], path: str, size: int = 10_000, folder: int = 64, levels: tuple[int, ...] = LEVELS) -> None:
    """Write `rows` (with row_idx and chunk, a folder for each `folder` chunks, or more where that would be over FOLDERS
    folders), `chunks` (bounds and sums of every chunk and signal, and the part that is its folder), a table for each level of
    detail, and `spans`, the catalogue: level, rows, buckets and times of each series."""
    longest = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.floor(F.col("chunk") / max(folder, -(-longest // (size * FOLDERS))))
    x = with_row_index(df, key, order).withColumn("chunk", F.floor(F.col("row_idx") / size)).withColumn("part", part)
    x.repartition("part", *key).sortWithinPartitions("part", *key, "row_idx").write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/rows")
    x.limit(0).write.parquet(f"{path}/schema")  # a recording without rows has no folders to tell it
    rows = _rows(df.sparkSession, path)
    for k, s in enumerate(signals):
        chunks = preaggregate(rows, key, "row_idx", s, size).withColumn("signal", F.lit(s)).withColumn("part", part)
        chunks.write.mode("append" if k else "error").parquet(f"{path}/chunks")
    spans = None
    for level, table in build_lod(rows.drop("row_idx", "chunk", "part"), key, order, t, signals, levels).items():
        table.repartitionByRange(*key, "bucket").sortWithinPartitions(*key, "bucket").write.parquet(f"{path}/level={level}")
        of = df.sparkSession.read.schema(table.schema).parquet(f"{path}/level={level}").groupBy(*key).agg(F.lit(level).alias("level"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("buckets"), F.min("time_min").alias("start_t"), F.max("time_max").alias("end_t"))
        spans = of if spans is None else spans.unionByName(of)
    if spans is not None:
        spans.coalesce(1).write.parquet(f"{path}/spans")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema).parquet(f"{path}/rows")


def violation_regions(spark: SparkSession, path: str, limits: DataFrame, key: list[str], v: str, folder: int = 64) -> DataFrame:
    """key, start_row, end_row: half-open regions of rows outside their series' limits (key, lo, hi), from a stored recording.

    Chunks within the limits by their bounds are not read; chunks wholly below or above them are regions by their bounds;
    only the folders of the others are read, picked at run time from the chunks' table. Pieces that touch are one region.
    Null and NaN are outside nothing; series without limits have no regions. `folder` counts only for recordings whose chunks'
    table does not tell the parts.
    """
    chunks = spark.read.parquet(f"{path}/chunks").where(F.col("signal") == v).join(limits, key)
    part = F.col("part") if "part" in chunks.columns else F.floor(F.col("chunk") / folder)
    clear = (F.col("valid") == F.col("row_count")) & ~F.isnan("vmax")
    inside = (F.col("valid") == 0) | ((F.col("vmin") >= F.col("lo")) & (F.col("vmax") <= F.col("hi")))
    outside = clear & ((F.col("vmax") < F.col("lo")) | (F.col("vmin") > F.col("hi")))
    whole = chunks.where(outside).select(*key, "start_row", (F.col("start_row") + F.col("row_count")).alias("end_row"))
    mixed = chunks.where(~inside & ~outside).select(*key, "chunk", part.alias("part"), "lo", "hi")
    rows = _rows(spark, path).select(*key, "part", "chunk", "row_idx", v)
    # the folders to read: no more of them than folders that the driver lists, so they may be broadcast whatever the size
    rows = rows.join(F.broadcast(mixed.select("part").distinct()), "part", "left_semi")
    bad = rows.join(mixed, [*key, "part", "chunk"]).where(((F.col(v) < F.col("lo")) | (F.col(v) > F.col("hi"))) & ~F.isnan(v))
    run = F.col("row_idx") - F.row_number().over(Window.partitionBy(*key, "chunk").orderBy("row_idx"))
    pieces = bad.withColumn("_run", run).groupBy(*key, "chunk", "_run").agg(F.min("row_idx").alias("start_row"), (F.max("row_idx") + 1).alias("end_row"))
    return merge_regions(whole.unionByName(pieces.select(*key, "start_row", "end_row")), key, "start_row", "end_row")


def choose_level(rows: int, levels: list[int], zoom: float, width: int, raw_below: int = 20_000) -> int | None:
    """The level of detail to show `rows` rows with, or None for the rows themselves: for few rows; for views of less than a
    fifth of the time with under twice two points a pixel; and where no level exists. Else level 100 below two million rows,
    10 000 below twenty million, 100 000 beyond, or what exists, the coarser ones first."""
    if rows < raw_below or not levels or zoom > 5 and rows < 4 * width:
        return None
    wanted = 100 if rows < 2_000_000 else 10_000 if rows < 20_000_000 else 100_000
    if wanted in levels:
        return wanted
    coarser = [x for x in sorted(levels) if x > wanted]
    return coarser[0] if coarser else max(levels)


def view(spark: SparkSession, path: str, key: list[str], t: str, signal: str, a, b, width: int = 1920, raw_below: int = 20_000) -> DataFrame:
    """key, t, v, level of the times [a, b]: rows (level 0), or two points a bucket of the level that `choose_level` takes. With
    over 250 rows a pixel both points stand at the bucket's middle time, else at its ends. Rows are counted, and the zoom
    found, on the catalogue and the coarsest level; the stored rows are read for level 0 only, and then their range only.
    """
    spans = spark.read.parquet(f"{path}/spans")
    levels = sorted(r["level"] for r in spans.select("level").distinct().collect())  # one a level
    if levels:
        coarse = spark.read.parquet(f"{path}/level={levels[-1]}")
        rows = overlapping(coarse, a, b).agg(F.sum("rows")).first()[0] or 0
        span = spans.agg(F.max("end_t") - F.min("start_t")).first()[0]
        zoom = float(span) / float(b - a) if span and b > a else 1.0
    else:
        rows, zoom = 0, 1.0
    level = choose_level(rows, levels, zoom, width, raw_below)
    if level is None:
        x = _rows(spark, path).where(F.col(t).between(a, b))
        return x.select(*key, F.col(t).alias("t"), F.col(signal).alias("v"), F.lit(0).alias("level"))
    x = overlapping(spark.read.parquet(f"{path}/level={level}"), a, b)
    at = [(F.col("time_min") + F.col("time_max")) / 2] * 2 if rows > 250 * width else [F.col("time_min"), F.col("time_max")]
    points = F.array(*[F.struct(c.alias("t"), F.col(f"{signal}_{n}").alias("v")) for c, n in zip(at, ("min", "max"))])
    return x.select(*key, F.explode(points).alias("p")).select(*key, "p.t", "p.v", F.lit(level).alias("level"))
