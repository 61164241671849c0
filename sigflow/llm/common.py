"""Helpers that the corpus operators share: shared storage, word hashes, connected components."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_WORD = re.compile(r"\W")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. A local session that names none (tests) gets one; on a cluster
    a folder of one machine would be of no use, so there the setting is required."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"/tmp/sigflow-shared-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: ends the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a table that cut() wrote, once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def internal(df: DataFrame, base: str) -> str:
    """A column name that does not clash with df's own, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


CODES = 0x110000
SLICE = 1 << 19
ODD = np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Per code point: 1 in words (letters, digits, underscore), 2 at the ends of sentences and lines, else 0."""
    kinds = np.fromiter((c == 95 or chr(c).isalnum() for c in range(CODES)), dtype=np.uint8, count=CODES)
    kinds[[ord(c) for c in ".!?"]] = 2
    kinds[ord("\n")] = 3
    return kinds


@lru_cache(1)
def _values() -> np.ndarray:
    return mix64(np.arange(1, CODES + 1, dtype=np.uint64))


@lru_cache(4)
def _powers(base: int, size: int) -> np.ndarray:
    return np.cumprod(np.full(size, base, dtype=np.uint64))


def lowered(text: str) -> str:
    """The text in lower case, code point by code point where that would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Words:
    """The words of some texts: 64-bit hashes in order; bounds, the texts' first words; starts and ends in code points of
    their text; cuts and lines, the numbers of words before each end of a sentence or line, and before each end of a line.

    Words are runs of letters, digits and underscores in lower case. They are hashed a slice of text at a time by prefix
    sums of a polynomial, so a very long text needs little more memory than its own code points.
    """

    def __init__(self, texts: list[str | None]):
        lows = [lowered(t) if t else "" for t in texts]
        joined = "\n".join(lows)
        begin = np.cumsum([0] + [len(t) + 1 for t in lows])
        ids, starts, ends, stops, breaks, at = [], [], [], [], [], 0
        while at < len(joined):
            stop = min(at + SLICE, len(joined))
            if stop < len(joined):
                back = max(joined.rfind(" ", at, stop), joined.rfind("\n", at, stop))
                stop = back + 1 if back > at else (m.end() if (m := NOT_WORD.search(joined, stop)) else len(joined))
            codes = np.frombuffer(joined[at:stop].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            kind = _kinds().take(codes)
            inside = np.zeros(len(codes) + 2, dtype=bool)
            np.equal(kind, 1, out=inside[1:-1])
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            first, after = edges[::2], edges[1::2]
            size = max(SLICE, len(codes))
            sums = np.zeros(len(codes) + 1, dtype=np.uint64)
            np.cumsum(_values().take(codes) * _powers(BASE, size)[: len(codes)], out=sums[1:])
            ids.append(mix64((sums[after] - sums[first]) * _powers(pow(BASE, -1, 1 << 64), size)[first]))
            starts.append(first + at)
            ends.append(after + at)
            stops.append(np.flatnonzero(kind >= 2) + at)
            breaks.append(np.flatnonzero(kind == 3) + at)
            at = stop
        none = [np.empty(0, dtype=np.int64)]
        self.ids = np.concatenate(ids or [np.empty(0, dtype=np.uint64)])
        first = np.concatenate(starts or none)
        self.bounds = np.searchsorted(first, begin)
        self.cuts, self.lines = (np.searchsorted(first, np.concatenate(x or none)) for x in (stops, breaks))
        off = np.repeat(begin[:-1], np.diff(self.bounds))
        self.starts, self.ends = first - off, np.concatenate(ends or none) - off

    def __len__(self) -> int:
        return len(self.bounds) - 1


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order (np.unique hashes whole numbers first, which is slower than a sort)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def in_groups(column: pa.Array | pa.ChunkedArray, most: int = SLICE) -> Iterator[list[str]]:
    """The texts of a column (null as empty) in lists of about `most` code points or one longer text."""
    held, size = [], 0
    for text in column:
        text = text.as_py() or ""
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def shingles_in_order(ids: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of width words, in order; none if there are fewer words."""
    n = max(0, len(ids) - width + 1)
    acc = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        acc += ids[k : k + n] * (_values()[k + 7] | ODD)
    return mix64(acc)


def shingle_hashes(ids: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct hashes of the word shingles of a text; a text shorter than one shingle is one shingle of all its words."""
    return distinct(shingles_in_order(ids, max(1, min(width, len(ids))))) if len(ids) else ids


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v): rows (u, root) with root the least node reached, for every node of an edge.

    Alternating large-star and small-star rounds; each round is grouped minima and joins, written to the shared
    folder, and the number of rounds grows with the logarithm of the longest path. Only two numbers a round reach
    the driver. Should `rounds` not suffice, it raises rather than give unfinished components.
    """
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    now = cut(edges.where(F.col("u") != F.col("v")).select(*pair).distinct())
    seen = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        after = joined.select("u", F.col("m").alias("v")).union(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = cut(after.where(F.col("u") != F.col("v")).distinct())
        state = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_cut(now)
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components not complete after {rounds} rounds")
    pairs = now.select("u", F.col("v").alias("root"))
    return pairs.union(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def row_key(*cols: Column | str) -> list[Column]:
    """A 96-bit content key of a row, for nulls and repeated rows alike: equal rows share it."""
    return [F.xxhash64(*cols), F.hash(*reversed(cols))]


def split_by(df: DataFrame, col: str, keys: DataFrame, key: str, bits: int = 1 << 25) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose col may be among keys, rows whose col surely is not).

    A bitmap of fixed size (4 MB at most, so it is broadcast whatever the input) holds the hashes of the keys. Only
    the first part then needs a join. A crowded bitmap lets more rows through; it loses none. A null col is surely
    not among them.
    """
    wide = 32768
    mark, bucket, map_ = internal(df, "_mark"), internal(df, "_bucket"), internal(df, "_map")
    h = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = keys.where(F.col(key).isNotNull()).select(h(F.col(key)).alias("h")).groupBy((F.col("h") / wide).cast("int").alias(bucket)).agg(F.bitmap_construct_agg((F.col("h") % wide)).alias(map_))
    marked = df.withColumn(mark, h(F.col(col))).withColumn(bucket + "0", (F.col(mark) / wide).cast("int"))
    marked = marked.join(F.broadcast(maps), F.col(bucket) == F.col(bucket + "0"), "left")
    place = F.col(mark) % wide
    byte = F.conv(F.hex(F.substring(F.col(map_), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2.0), place % 8)), F.lit(2)) == 1, F.lit(False)) & F.col(col).isNotNull()
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)
