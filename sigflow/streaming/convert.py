"""Conversion of recordings that arrive as CSV files into sorted Parquet, file by file, each row once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.operators.quality import NULL_TOKENS, clean
from sigflow.operators.series import with_row_index

MANIFEST = "file string, batch long, rows long, start_t double, end_t double"


def manifest(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """file, batch, rows, start_t, end_t of the files converted so far; before: by earlier batches."""
    done = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    return done if before is None else done.where(F.col("batch") < before)


def recording(spark: SparkSession, out: str) -> DataFrame:
    """The rows converted so far: those of the batches in the manifest, which is written last."""
    rows = spark.read.parquet(f"{out}/rows").withColumn("batch", F.col("batch").cast("long"))
    return rows.join(manifest(spark, out).select("batch").distinct(), "batch", "left_semi").drop("batch")


def rate(spark: SparkSession, out: str) -> float | None:
    """Samples per second over all files, from the manifest alone; None where time stands still or there are no rows."""
    n, a, b = manifest(spark, out).agg(F.sum("rows"), F.min("start_t"), F.max("end_t")).first()
    return (n - 1) / (b - a) if n and b is not None and b > a else None


def convert(spark: SparkSession, source: str, out: str, schema: T.StructType | str, t: str | None = None, freq: float = 0.0, sep: str = ",", files_per_batch: int = 8, then: Callable[[int], None] | None = None) -> None:
    """Convert the CSV files of a folder that have not been converted yet, and stop.

    Null tokens are null, NaN and infinite numbers too; rows that do not fit the schema go. The time, in seconds, is the
    column t (epoch values beyond 1e12 are milliseconds; rows without one go) or, without one, the row's number over all
    files, in the order of their names within a batch, at freq Hz (0 or less: 1000). Each batch is written to a folder of its
    own and overwrites it, and its manifest after it; the row counter comes from the manifests of earlier batches. So a run
    that is stopped anywhere and started again gives each row once. then(batch) is called after the rows, before the manifest.
    """
    spark.createDataFrame([], MANIFEST).write.mode("ignore").parquet(f"{out}/manifest/batch_=none")
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])

    def value(f: T.StructField) -> Column:
        c = F.trim(F.col(f"`{f.name}`"))
        c = F.when(~c.isin(NULL_TOKENS), c)
        return (c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name)

    def step(rows: DataFrame, batch: int) -> None:
        x = rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at"), *[value(f) for f in schema.fields])
        x = clean(x, [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))])
        if t is None:
            done = manifest(spark, out, batch).agg(F.sum("rows")).first()[0] or 0
            x = with_row_index(x, [], ["_file", "_from", "_at"], "_row").withColumn("t", (F.col("_row") + done) / F.lit(freq if freq > 0 else 1000.0)).drop("_row")
        else:
            c = F.col(f"`{t}`")
            at = F.unix_micros(c) / 1e6 if isinstance(schema[t].dataType, T.TimestampType) else F.when(F.abs(c) > 1e12, c / 1000.0).otherwise(c.cast("double"))
            x = x.withColumn("t", at).where(F.col("t").isNotNull())
        x = x.withColumn("file", F.element_at(F.split("_file", "/"), -1)).drop("_file", "_from", "_at")
        x.repartitionByRange("t").sortWithinPartitions("t").write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/rows/batch={batch}")
        if then is not None:
            then(batch)
        made = spark.read.schema(x.schema).parquet(f"{out}/rows/batch={batch}")
        files = made.groupBy("file").agg(F.lit(batch).cast("long").alias("batch"), F.count(F.lit(1)).alias("rows"), F.min("t").alias("start_t"), F.max("t").alias("end_t"))
        files.coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/batch_={batch}")

    stream = spark.readStream.schema(text).option("header", True).option("sep", sep).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_per_batch).csv(source)
    stream = stream.withColumn("_metadata", F.col("_metadata"))
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
