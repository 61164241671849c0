"""Reading and writing recordings."""

from __future__ import annotations

import csv
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.operators.quality import NULL_TOKENS


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """value, _i: the lines that are not blank, with numbers that grow in file order."""
    plain = spark.read.option("sep", "\u0001").option("quote", "").option("encoding", encoding).schema("value string").csv(path)
    return plain.withColumn("_i", F.monotonically_increasing_id()).where(F.trim("value") != "")


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns as long or double where all values are; one pass over all rows, so no value is lost."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    fits = lambda c, kind: F.count(F.col(f"`{c}`").try_cast(kind))
    counts = df.agg(*[f.alias(f"{k}{j}") for j, c in enumerate(text) for k, f in (("n", F.count(F.col(f"`{c}`"))), ("l", fits(c, "long")), ("d", fits(c, "double")))]).first()
    kinds = {c: "long" if counts[f"l{j}"] == counts[f"n{j}"] else "double" for j, c in enumerate(text) if counts[f"n{j}"] and counts[f"d{j}"] == counts[f"n{j}"]}
    return df.withColumns({c: F.col(f"`{c}`").try_cast(k) for c, k in kinds.items()}) if kinds else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",", header: bool = True, encoding: str = "UTF-8", repair_quotes: bool = False, header_row: int = 0, start_row: int | None = None, infer: bool = False) -> DataFrame:
    """CSV with ragged rows dropped, names trimmed and null tokens read as null; infer gives columns types (infer_types()).

    With a header_row or start_row (line numbers from 0, blank lines left out), or lines wrapped whole in quotes, the
    lines are read as text and parsed by Spark's own CSV function.
    """
    if not repair_quotes and not header_row and start_row is None:
        reader = spark.read.option("sep", sep).option("header", header).option("encoding", encoding).option("mode", "DROPMALFORMED").option("columnPruning", "false")
        df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
        df = df.toDF(*[c.strip().strip('"') for c in df.columns])
    else:
        lines = _lines(spark, path, encoding)
        begin = start_row if start_row is not None else header_row + 1
        first = lines.limit(max(begin, header_row + 4) + 1).select("value", "_i").collect()  # in file order, so no sort
        wrapped = lambda s: len(s) > 1 and s[0] == s[-1] == '"' and s.count('"') == 2
        if repair_quotes and sum(wrapped(r["value"]) for r in first) * 2 > len(first):
            lines = lines.withColumn("value", F.regexp_replace("value", '^"(.*)"$', "$1"))
            first = [{"value": r["value"][1:-1] if wrapped(r["value"]) else r["value"], "_i": r["_i"]} for r in first]
        names = [c.strip() for c in next(csv.reader([first[header_row]["value"]], delimiter=sep))] if len(first) > header_row else ["value"]
        kind = schema if isinstance(schema, str) else ", ".join(f"`{n}` string" for n in names)
        rows = lines.where(F.col("_i") >= first[begin]["_i"]) if begin < len(first) else lines.limit(0)
        parsed = F.from_csv("value", f"{kind}, `_ragged` string", {"sep": sep, "columnNameOfCorruptRecord": "_ragged"})
        df = rows.select(parsed.alias("r")).where("r._ragged is null").select("r.*").drop("_ragged")
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: F.when(~F.trim(F.col(f"`{c}`")).isin(NULL_TOKENS), F.col(f"`{c}`")) for c in text})
    return infer_types(df) if infer else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with TIMESTAMP_NTZ columns as timestamps of the session's zone."""
    df = spark.read.parquet(path)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)})


def ingest(df: DataFrame, out: str, key: list[str], t: str) -> None:
    """Write a recording sorted by series and time, so that time ranges skip row groups."""
    df.repartitionByRange(*key, t).sortWithinPartitions(*key, t).write.mode("overwrite").option("compression", "zstd").parquet(out)


def export_range(df: DataFrame, t: str, a, b, signals: list[str], out: str) -> None:
    df.where(F.col(t).between(a, b)).select(t, *signals).write.mode("overwrite").option("header", True).csv(out)


def limits(df: DataFrame) -> DataFrame:
    """series_id, lo, hi from Parameter, Warning_Min, Warning_Max; blanks are 0."""
    missing = {"Parameter", "Warning_Min", "Warning_Max"} - set(df.columns)
    if missing:
        raise ValueError(f"limits need the columns {sorted(missing)}")
    num = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return df.select(F.col("Parameter").alias("series_id"), num("Warning_Min").alias("lo"), num("Warning_Max").alias("hi"))


def bit_definitions(spark: SparkSession, paths: dict[str, str], sep: str = ",") -> DataFrame:
    """series_id, bit, description from one table of (bit, description) per signal; rows without a bit number are left out."""
    parts = [read_csv(spark, path, sep=sep).select(F.lit(name).alias("series_id"), F.col("bit").try_cast("int").alias("bit"), F.col("description")) for name, path in sorted(paths.items())]
    return reduce(DataFrame.unionByName, parts).where("bit is not null")


def write_derived(df: DataFrame, out: str, blocks: DataFrame) -> None:
    """A derived signal and its reduced blocks beside it, as a new version: both are there for read_derived() once the marker,
    the last thing written, is; what was there before stays until then."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{out}/signal/{version}")
    blocks.write.parquet(f"{out}/blocks/{version}")
    spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at")).write.mode("append").parquet(f"{out}/versions")


def read_derived(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The newest whole version: the signal and its blocks."""
    version = spark.read.parquet(f"{out}/versions").orderBy(F.col("at").desc(), "version").first()["version"]
    return spark.read.parquet(f"{out}/signal/{version}"), spark.read.parquet(f"{out}/blocks/{version}")
