"""Substring dedup: paragraph MinHash banding, exact Jaccard verification, removals by components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import ODD, Words, components, cut, distinct, in_groups, mix64, shingles_in_order, split_by
from sigflow.llm.jaccard import verify


def bands_for(similarity: float, recall: float, rows: int = 2) -> int:
    """Bands of `rows` minima each until a pair at the similarity shares one with the recall wanted."""
    n = 1
    while 1 - (1 - similarity**rows) ** n < recall:
        n += 1
    return n


LEAST, WHOLE, WIDTH = 20, 50, 5
BITS = 1 << 25


def rolling(least: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """np.minimum or np.maximum of each `width` values in a row."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x, size = least(x[:-step], x[step:]), size + step
    return x


def paragraphs(words: Words, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and word after the last of each paragraph of the texts, in order, and its kinds: 1 passage, 2 line, 3 both.

    A line of `least` words or more is a paragraph. Passages are smaller: each sentence of that length is one; the
    sentences between those, within a long line or within a run of short lines, join from the first on until they have
    `least` words. Paragraphs of one kind never overlap.
    """
    n = words.bounds[-1]
    fine = distinct(np.concatenate([words.cuts, words.bounds]))
    line = distinct(np.concatenate([words.lines, words.bounds]))
    long_line = np.flatnonzero(np.diff(line) >= least)
    long_piece = np.flatnonzero(np.diff(fine) >= least)
    at = distinct(np.concatenate([words.bounds, line[long_line], line[long_line + 1], fine[long_piece], fine[long_piece + 1]]))
    now, end = at[:-1], at[1:]
    lines = line[long_line] * (n + 1) + line[long_line + 1]
    passages = [np.empty(0, dtype=np.int64)]
    while len(now):
        stop = np.append(fine, n + 1)[np.searchsorted(fine, now + least)]
        now, stop, end = (x[stop <= end] for x in (now, stop, end))
        passages.append(now * (n + 1) + stop)
        now = stop
    both = distinct(np.concatenate([lines, *passages]))
    return both // (n + 1), both % (n + 1), np.isin(both, np.concatenate(passages)) + 2 * np.isin(both, lines)


def anchors(words: Words, runs: np.ndarray, least: int = LEAST, whole: int = WHOLE) -> np.ndarray:
    """First words of the windows of `least` words that each run of `whole` words in a text is sure to hold.

    Of the words from which a window fits into such a run the one whose shingle has the least hash starts one. That
    depends on the run alone, so all copies of a run hold the same window, wherever they stand.
    """
    n, room = len(words.ids), whole - least + 1
    last = np.repeat(words.bounds[1:], np.diff(words.bounds)) - whole
    at = np.arange(max(0, n - whole + 1))
    if not len(at):
        return at
    chosen = np.zeros(n + room, dtype=np.uint64)
    chosen[room - 1 : room - 1 + len(at)] = np.where(at <= last[: len(at)], rolling(np.minimum, runs, room)[: len(at)], np.uint64(0))
    return np.flatnonzero(runs == rolling(np.maximum, chosen, room)[: len(runs)])


def minima(shingles: np.ndarray, begin: np.ndarray, stop: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """MinHash of each stretch [begin, stop) of the shingles, sorted by begin."""
    at = np.column_stack([begin, stop]).ravel()
    padded = np.append(shingles, np.uint64(0xFFFFFFFFFFFFFFFF))
    out = np.empty((len(begin), len(factors)), dtype=np.uint64)
    for k, f in enumerate(factors):
        out[:, k] = np.minimum.reduceat(padded * f, at)[::2]
    return out


def _texts(batches: Iterator[pa.RecordBatch], windows: bool) -> Iterator[tuple]:
    """Of some texts at a time: shingles, and per paragraph (and window, if wanted) its row of the batch, key, start and end in
    code points, first and last shingle; and the kind (0: window). A key is a digest of the shingles in order."""
    for batch in batches:
        at = 0
        for texts in in_groups(batch.column("text")):
            words = Words(texts)
            runs = shingles_in_order(words.ids, WIDTH)
            first, after, kind = paragraphs(words)
            if windows and len(runs):
                more = anchors(words, runs)
                n = len(words.ids) + 1
                more = more[~np.isin(more * n + more + LEAST, first * n + after)]
                first, after, kind = np.concatenate([first, more]), np.concatenate([after, more + LEAST]), np.append(kind, np.zeros(len(more), dtype=kind.dtype))
            owner = np.searchsorted(words.bounds, first, side="right") - 1 + at
            at += len(texts)
            if len(first):
                raw, stop = memoryview(runs).cast("B"), after - WIDTH + 1
                keys = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip((first * 8).tolist(), (stop * 8).tolist())]
                yield batch, owner, runs, keys, words.starts[first], words.ends[after - 1], first, stop, kind


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The halves of each key as whole numbers. The first stands for the key where a mix-up only costs time."""
    both = np.frombuffer(b"".join(keys), dtype=">i8").astype(np.int64)
    return both[::2], both[1::2]


def _half(key: str, first: int) -> Column:
    return F.conv(F.hex(F.substring(key, first, 8)), 16, -10).cast("long")


def _whole(k1: str, k2: str) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(k), 16, "0") for k in (k1, k2)]))


def _units(bands: int, rows: int, most: int = 50_000):
    """Place and key of each paragraph and window, and the paragraphs' band labels, by kind; labels that a task has just
    given for a document with a smaller id are not repeated (null)."""
    rng = np.random.default_rng(11)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + ODD
    salts = mix64(np.arange(1, 2 * bands + 1, dtype=np.uint64)).reshape(2, bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        for batch, row, runs, keys, start, end, first, stop, kind in _texts(batches, True):
            who = [batch.column(name).take(pa.array(row)) for name in ("doc_id", "text_hash", "row")]
            ids = who[0].to_pylist()
            places, labels = [], []
            for seen, salt, bit in zip(held, salts, (1, 2)):
                new = []
                for k in np.flatnonzero(kind & bit).tolist():
                    owner = -1 if ids[k] is None else ids[k]
                    if seen.get(keys[k], owner + 1) > owner:
                        if len(seen) >= most:
                            seen.clear()
                        seen[keys[k]] = owner
                        new.append(k)
                places.append(np.array(new, dtype=np.int64))
                m = minima(runs, first[new], stop[new], factors).reshape(len(new), bands, rows)
                h = np.broadcast_to(salt, (len(new), bands)).copy()
                for k in range(rows):
                    h = mix64(h ^ m[:, :, k])
                labels.append(h)
            place = np.concatenate(places)
            has = np.bincount(place, minlength=len(keys))
            at = pa.array(np.concatenate([[0], np.cumsum(has) * bands]).astype(np.int32), mask=np.append(has == 0, False))
            flat = np.concatenate(labels)[np.argsort(place, kind="stable")].ravel()
            cols = [*who, pa.array(start), pa.array(end), *map(pa.array, _halves(keys)), pa.ListArray.from_arrays(at, pa.array(flat.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "row", "start", "end", "k1", "k2", "prefixes"])

    return run


def _sets(wanted, most: int = 50_000):
    """Key and distinct shingles of the paragraphs whose bit is set in the bitmap, once in a while a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.frombuffer(wanted.value, dtype=np.uint8)
        seen: set[bytes] = set()
        for _, _, runs, own, _, _, first, stop, _ in _texts(batches, False):
            keys, sizes, sets = [], [], []
            h = _halves(own)[0] % BITS
            for k in np.flatnonzero(marks[h >> 3] >> (h & 7).astype(np.uint8) & 1).tolist():
                if own[k] not in seen:
                    if len(seen) >= most:
                        seen.clear()
                    seen.add(own[k])
                    s = distinct(runs[first[k] : stop[k]])
                    keys.append(own[k])
                    sizes.append(len(s))
                    sets.append(s.tobytes())
            if keys:
                cols = [pa.array(keys, pa.binary()), pa.array(_halves(keys)[0]), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["set_key", "u", "n", "shingles"])

    return run


def _candidates(nodes: DataFrame) -> DataFrame:
    """u, root, owner: paragraphs that share a label, one group for each label, and a document that has the paragraph. Of
    labels with the same members one stays.

    One exchange by label serves the grouping and the join back; the copies of a paragraph merge within it."""
    node = nodes.select("u", "owner", F.explode("prefixes").alias("node")).repartition("node")
    node = node.groupBy("node", "u").agg(F.min("owner").alias("owner"))
    shared = node.groupBy("node").agg(F.min("u").alias("v"), F.max("u").alias("w"), F.bit_xor("u").alias("x"), F.count(F.lit(1)).alias("k"))
    shared = shared.where("v < w").groupBy("v", "w", "x", "k").agg(F.min("node").alias("node"))
    return cut(node.join(shared, "node").select("u", F.col("node").alias("root"), "owner"))


def find_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, recall: float = 0.99, block: int = 256) -> DataFrame:
    """doc_id, spans, n_removed, text_hash: for each row of docs the stretches that repeat a passage of an earlier one.

    Paragraphs of 20 words or more (lines; and within them long sentences and groups of short ones, see paragraphs())
    collide with others of their kind when one of the bands of two minima is equal, with as many bands as the recall at
    the threshold takes, and colliding ones, within a document and across documents, are verified by exact Jaccard
    similarity. So that no verbatim repeat is
    lost where lines and sentences are cut otherwise, each run of 50 words also holds a window of 20 words that all
    its copies hold (see anchors()); windows repeat only as they are. A component of equal or linked paragraphs keeps
    its first occurrence, by doc_id (null last), text_hash and start; all others are removed, but for those that overlap it.
    Overlapping removals of a row merge into spans of code points; n_removed is their total length. Rows without
    removals are left out.

    Null and short texts have no paragraphs. Rows that share a doc_id, or have none, are documents of their own, told
    apart by text_hash (xxhash64 of the text); of equal rows all but one have their repeats removed, it does not matter
    which. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    owner = F.coalesce("doc_id", F.lit(-1)).alias("owner")
    rows = slim.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    # the numbers of rows hold from here on, as the table is written
    units = cut(rows.mapInArrow(_units(bands_for(threshold, recall), 2), "doc_id long, text_hash long, row long, start long, end long, k1 long, k2 long, prefixes array<long>"))
    group = _candidates(units.where("prefixes is not null").select(F.col("k1").alias("u"), owner, "prefixes"))
    units = units.drop("prefixes")
    h = F.pmod(F.col("u"), F.lit(BITS))
    marked = group.select(h.alias("h")).groupBy((F.col("h") / 32768).cast("int").alias("b")).agg(F.bitmap_construct_agg(F.col("h") % 32768).alias("m"))
    bitmap = bytearray(BITS // 8)  # of fixed size: 4 MB, whatever the input
    for r in marked.collect():
        bitmap[r["b"] * 4096 : (r["b"] + 1) * 4096] = r["m"]
    # only documents that own a candidate are cut up again
    owners, _ = split_by(slim.select("doc_id", "text", owner), "owner", group, "owner")
    shingled = owners.drop("owner").mapInArrow(_sets(spark.sparkContext.broadcast(bytes(bitmap))), "set_key binary, u long, n long, shingles binary")
    # written once: a paragraph's sizes go into each of its groups, its shingles only into the tasks that compare it
    shingled = cut(shingled.dropDuplicates(["set_key"]))
    of = shingled.select("set_key", "u", "n").join(group.drop("owner"), "u").drop("u").withColumn("weight", F.lit(1).cast("long"))
    found = verify(of, shingled.select("set_key", "shingles"), threshold, block)
    linked = components(found.where("v is not null").select("u", "v"))
    linked = cut(linked.select(_half("u", 1).alias("k1"), _half("u", 9).alias("k2"), "root"))
    # only paragraphs that occur more than once or are linked to others move on
    again = units.groupBy("k1").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("k1")
    maybe, _ = split_by(units, "k1", cut(again.union(linked.select("k1")).distinct()), "k1")
    maybe = cut(maybe)
    several = maybe.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times")).join(linked, ["k1", "k2"], "left").where("times > 1 or root is not null")
    # written by itself, so that the join below is free to split a passage that very many documents hold
    several = cut(several.select("k1", "k2", F.coalesce("root", _whole("k1", "k2")).alias("root")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "row", "start", "end")
    occurs = cut(maybe.join(several, ["k1", "k2"]))
    heads = cut(occurs.groupBy("root").agg(F.min(place).alias("head")))
    gone = occurs.select("doc_id", "text_hash", "row", "start", "end", "root").join(heads, "root")
    gone = gone.where((F.col("row") != F.col("head.row")) | (F.col("start") >= F.col("head.end")))
    spans = gone.groupBy("row", "doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    kind = "array<struct<start: bigint, end: bigint>>"

    def join_up(a, x):
        touch = (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= x["start"])
        wider = F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], x["end"]).alias("end"))
        return F.when(touch, F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(a, F.array(x)))

    merged = spans.select("doc_id", "text_hash", F.aggregate("s", F.array().cast(kind), join_up).alias("spans"))
    return merged.select("doc_id", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_removed"), "text_hash")
