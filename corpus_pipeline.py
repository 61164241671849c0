"""A corpus cleaning pipeline: toxicity, line dedup, near duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents. Stages work on every row that their predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigflow.llm import decontaminate, jaccard, lines, mixing, toxicity
from sigflow.llm.common import shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic (score 0.5 or more) go. Null and empty texts score alike, by the prior; repeated
    rows share their fate; without labels of both kinds, or rows, nothing is toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where(F.col("score") < 0.5).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on ten sources or more are cut; n_chars follows the text; every document stays, repeated rows and
    null texts (n_chars null) included."""
    out = lines.dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that with the least id. Null and empty texts are in no class."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; an empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: a row for each time that a document is emitted, numbered by copy. Null
    sources are one source; documents without words are not emitted."""
    return mixing.sample(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("jaccard_join", drop_near_copies), ("decontaminate", drop_leaks), ("mix", mix_sources)]

#: The trained model has no SQL. tests/llm/test_pipeline.py holds the stages against a brute-force version.
ORACLE_SQL = None


#: Rows that Spark hands to a Python task at a time: whole documents, held by the JVM and by the worker at once, in and out.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    name, rows = BATCH
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        for k, (name_, stage) in enumerate(STAGES):
            path = f"{folder}/{k}-{name_}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(name, before)
    return docs
