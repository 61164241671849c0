"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigflow.llm.common import cut, internal


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(df: DataFrame, group: str | None, order: list[Column], name: str) -> DataFrame:
    """Adds the 1-based rank in the given order (within group, if one is named).

    Range partitions on (group, order) hold a hot group in many tasks; each partition ranks its own rows, and the
    counts of (partition, group), as many as partitions and groups only, give the offsets. The table is written
    once, so ranks and offsets see the same partitions.
    """
    part, local, before, rows, first = (internal(df, x) for x in ("_part", "_local", "_before", "_rows", "_first"))
    opart, ogroup = internal(df, "_opart"), internal(df, "_ogroup")
    keys = ([F.col(group).asc_nulls_last()] if group else []) + order
    sorted_ = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = cut(sorted_.withColumn(part, F.spark_partition_id()).withColumn(local, F.monotonically_increasing_id()))
    by = [F.col(part).alias(opart)] + ([F.col(group).alias(ogroup)] if group else [])
    counts = placed.groupBy(*by).agg(F.count(F.lit(1)).alias(rows), F.min(local).alias(first))
    w = (Window.partitionBy(ogroup) if group else Window.partitionBy(F.lit(0))).orderBy(opart).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum(rows).over(w), F.lit(0)))
    match = F.col(part) == F.col(opart)
    if group:
        match &= F.col(group).eqNullSafe(F.col(ogroup))
    place = F.col(local) - F.col(first) + F.col(before) + 1
    return placed.join(offsets, match).select(*df.columns, place.alias(name))


def targets(sizes: DataFrame, size: str, weight: str, most: float = 3.0) -> DataFrame:
    """Share the total size among sources by weight, none above most times its size; the excess is reshared by weight.

    sizes has a row per source. Each round takes two sums over the sources still open and closes those at their
    limit; it ends when none closes. Only the sums reach the driver.
    """
    total = sizes.agg(F.sum(size)).first()[0] or 0
    cap = F.col(size) * F.lit(most)
    level = None
    while True:
        shut = F.lit(False) if level is None else cap <= F.col(weight) * F.lit(level)
        row = sizes.agg(F.sum(F.when(shut, cap)), F.sum(F.when(~shut, F.col(weight))), F.count(F.when(shut, 1))).first()
        new = (total - (row[0] or 0)) / row[1] if row[1] else None
        if new is None or new == level:
            break
        level = new
    share = cap if level is None else F.least(cap, F.col(weight) * F.lit(float(level)))
    return sizes.withColumn("target", share.cast("double"))


def plan_copies(docs: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 20240601, ties: tuple[str, ...] = ()) -> DataFrame:
    """Systematic sampling of rows that already carry their size: adds source_size, target and copies. See mix().

    Rows are sorted whole, so they should be slim. ties are further columns that order rows of equal size and id.
    """
    docs = docs.drop("source_size", "target", "copies")
    rank, number, of, w = (internal(docs, x) for x in ("_rank", "_number", "_of", "_weight"))
    sizes = docs.groupBy(source).agg(F.sum(size).alias("source_size"))
    sizes = _ranked(sizes, None, [F.col(source).asc_nulls_last()], number)
    turn = ((F.col(number) - 1) % len(weights) + 1).cast("int")
    sizes = cut(sizes.withColumn(w, F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn)))
    plan = targets(sizes, "source_size", w, most).select(F.col(source).alias(of), "source_size", "target")
    ranked = _ranked(docs, source, [F.col(size), F.col(doc_id).asc_nulls_last(), *[F.col(c) for c in ties]], rank)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.lit(offset_of(seed))
    crossed = F.floor(F.col(rank) * each + offset) - F.floor((F.col(rank) - 1) * each + offset)
    return ranked.join(plan, F.col(source).eqNullSafe(F.col(of))).withColumn("copies", crossed.cast("int")).drop(of, rank)


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 20240601) -> DataFrame:
    """Systematic sampling to target weights: all columns of docs plus size, source_size, target and copies.

    Sources in code point order (null last) weigh weights[0], weights[1], ... in turn. Every document of a source
    is expected target / source_size times; documents stand in order of size, so the words taken differ from the
    target by one document's size at most. Prefix sums of the expected copies plus one random offset are cut at
    the integers: a document is emitted once per integer that its span crosses.

    Only ids, sources, sizes and hashes of the texts are ranked; the rows meet their number of copies by a row number
    that is written with them.

    Null text has size 0. Sources without words get target 0 and no copies. Null sources form one source. Documents of
    equal size and id stand in order of their texts' hashes. Repeated rows are separate documents; which of two equal
    rows is emitted makes no difference. An empty table gives an empty table. Columns of the input named size,
    source_size, target or copies are replaced. The same rows and seed give the same copies on every run.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    row, tie, number = (internal(docs, x) for x in ("_row", "_tie", "_number"))
    wide = cut(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(tie, F.xxhash64(text)).withColumn("size", n_words(F.col(text))))
    slim = wide.select(F.col(row).alias(number), *{source: 0, doc_id: 0}, tie, "size")
    plan = plan_copies(slim, "size", source, doc_id, weights, most, seed, (tie,)).select(number, "source_size", "target", "copies")
    return wide.join(plan, F.col(row) == F.col(number)).drop(row, tie, number)


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself: docs with copy (1, 2, ...), a row for each time that mix() emits the document.

    Nulls, ties, repeated rows and empty tables as in mix(). A column of the input named copy is replaced; others pass
    through.
    """
    out = mix(docs.drop("copy"), **options).where(F.col("copies") > 0)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[c for c in docs.columns if c != "copy"], "copy")


def offset_of(seed: int = 20240601) -> float:
    return random.Random(seed).random()
