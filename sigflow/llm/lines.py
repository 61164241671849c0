"""Cross-site boilerplate lines: distinct-site spread from HyperLogLog sketches, exact near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import internal

BLANK = " \t\r"
#: Tasks that the texts of one very common line are dealt to.
SPREAD = 16


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """A 96-bit key of a line, trimmed; null for a blank one."""
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b")))


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 10, log_k: int = 10, margin: float = 0.25) -> DataFrame:
    """Keys (a, b) of the lines that stand on min_sites distinct sites or more.

    Sketches of sites per line merge by aggregation. Estimates that differ from the threshold by more than margin
    decide at once; the lines in between get exact distinct counts. A null site is a site of its own.
    """
    at = F.coalesce(F.concat(F.lit("="), F.col(site)), F.lit("null"))
    each = docs.select(at.alias("site"), F.explode(F.transform(_lines(F.col(text)), _key)).alias("k")).where("k is not null")
    each = each.select("site", "k.a", "k.b")
    # a line that occurs fewer times than the threshold cannot stand on so many sites
    spread = each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", F.lit(log_k)).alias("sketch"))
    spread = spread.where(F.col("n") >= min_sites).select("a", "b", F.hll_sketch_estimate("sketch").alias("sites"))
    sure = spread.where(F.col("sites") > min_sites * (1 + margin)).select("a", "b")
    near = spread.where((F.col("sites") <= min_sites * (1 + margin)) & (F.col("sites") >= min_sites * (1 - margin))).select("a", "b")
    exact = each.join(near, ["a", "b"]).groupBy("a", "b", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("a", "b").agg(F.count("one").alias("sites")).where(F.col("sites") >= min_sites).select("a", "b")
    return sure.union(exact)


def dedup_lines(docs: DataFrame, text: str = "text", site: str = "source", min_sites: int = 10, log_k: int = 10, margin: float = 0.25) -> DataFrame:
    """Every row of docs with the boilerplate lines cut from its text, plus n_lines and n_removed.

    Lines are compared trimmed of blanks, tabs and carriage returns; blank lines stay. Null text stays null with
    n_lines 0. A text of boilerplate only becomes ''. Repeated rows are treated alike. An empty table gives an
    empty table. Columns of the input named n_lines or n_removed are replaced; others pass through.
    """
    docs = docs.drop("n_lines", "n_removed")
    ka, kb, gone = (internal(docs, x) for x in ("_ka", "_kb", "_gone"))
    bad = boilerplate(docs, text, site, min_sites, log_k, margin)
    # null texts match nothing; keys of their own keep them from meeting in one task
    keyed = docs.withColumn(ka, F.when(F.col(text).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(text))).withColumn(kb, F.hash(text))
    # what goes from a text depends on the text alone: exact copies share one row here
    own = keyed.where(F.col(text).isNotNull()).select(ka, kb, F.explode(F.transform(_lines(F.col(text)), _key)).alias("k")).where("k is not null")
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    hit = own.select(ka, kb, "k.a", "k.b", F.pmod(ka, F.lit(SPREAD)).cast("int").alias("salt")).join(bad, ["a", "b", "salt"])
    hit = hit.groupBy(ka, kb).agg(F.collect_set(F.struct("a", "b")).alias(gone))
    out = keyed.join(hit, [ka, kb], "left")
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col(gone), _key(x)), F.lit(False)))
    clean = F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    return out.select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns], n.alias("n_lines"), removed.alias("n_removed"))
