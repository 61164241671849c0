"""Context-triggered piecewise hashing: signatures of content-defined chunks, compared by edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.llm.common import _powers, _values, cut, mix64

#: Code points that the rolling hash sees, and that a text is hashed by at a time.
WINDOW, SLICE = 7, 1 << 18
#: The least block size is 2 ** LEAST code points; a signature has at most LONGEST chunks at its block size.
LEAST, LONGEST = 2, 64
#: Letters of chunks (fixed values).
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Letters in a row that two signatures must share to be alike at all.
COMMON = 4
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(1)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE from the first on, and of its inverse from 1 on."""
    return _powers(BASE, size), np.append(np.uint64(1), _powers(INVERSE, size))


def signature(text: str | None) -> str:
    """`block:chunks:chunks` of a text (null as empty): a letter per chunk at the block size and at twice that size.

    A chunk ends where the hash of the last WINDOW code points has enough zero bits (one bit more for each doubling of the
    block size), or at the text's end. The block size is the least with at most LONGEST chunk ends; it depends on the whole
    text. Chunk ends that no block size still possible can use are dropped on the way, so a very long text needs little
    more memory than its own code points. Equal texts have equal signatures.
    """
    text = text or ""
    up, down = _tables(SLICE + WINDOW)
    level, at, done = LEAST, 0, 0
    ends = np.zeros((3, 0), dtype=np.uint64)  # position after the chunk, prefix sum there, zero bits
    while at < len(text):
        low = max(0, at - WINDOW)  # the code points before the slice, for the window
        codes = np.frombuffer(text[low : at + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_values().take(codes) * up[: len(codes)], out=sums[1:])
        k = np.arange(at - low, len(codes))
        back = np.maximum(k + 1 - WINDOW, 0)
        h = mix64((sums[k + 1] - sums[back]) * down[back])
        hit = np.flatnonzero((h & np.uint64((1 << min(level, 64)) - 1)) == 0)
        zeros = h[hit]
        zeros = np.bitwise_count((zeros & (~zeros + np.uint64(1))) - np.uint64(1)).astype(np.uint64)
        scale = pow(BASE, low, 1 << 64)
        total = (sums[k[hit] + 1] - sums[at - low]) * np.uint64(scale) + np.uint64(done)
        ends = np.concatenate([ends, np.stack([(hit + at + 1).astype(np.uint64), total, zeros])], axis=1)
        while (ends[2] >= level).sum() > LONGEST:
            level += 1
        ends = ends[:, ends[2] >= level]
        done = ((int(sums[-1]) - int(sums[at - low])) * scale + done) & MASK
        at += SLICE

    def letters(bits: int) -> str:
        some = ends[:, ends[2] >= bits]
        position, total = [0, *some[0].tolist()], [0, *some[1].tolist()]
        if position[-1] < len(text):
            position, total = [*position, len(text)], [*total, done]
        chunk = [((b - a) * pow(INVERSE, p, 1 << 64)) & MASK for a, b, p in zip(total, total[1:], position)]
        return "".join(LETTERS[x] for x in (mix64(np.array(chunk, dtype=np.uint64)) >> np.uint64(58)).tolist())

    return f"{1 << level}:{letters(level)}:{letters(level + 1)}"


def edit_distance(a: str, b: str) -> int:
    """Least number of inserted, deleted and replaced letters that turn a into b, a column of the table as bits at a time."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rise, fall, distance = full, 0, len(a)
    for c in b:
        eq = places.get(c, 0)
        flat = eq | fall
        across = (((eq & rise) + rise) ^ rise) | eq
        plus, minus = fall | (~(across | rise) & full), rise & across
        distance += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        rise, fall = minus | (~(flat | plus) & full), plus & flat
    return distance


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    n = max(1, min(COMMON, min(len(a), len(b)) // 2))
    if not a or not b or {a[k : k + n] for k in range(len(a) - n + 1)}.isdisjoint(b[k : k + n] for k in range(len(b) - n + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: one less the edit distance of the chunks at a common block size over the longer signature; the greater of the
    two where both block sizes are common. 0 if no block size is, or if they share no COMMON letters in a row (fewer for
    signatures under twice that length). An empty text is like empty texts only."""
    if a == b:
        return 1.0
    (size, a1, a2), (other, b1, b2) = a.split(":"), b.split(":")
    if not a1 or not b1:
        return 0.0
    pairs = {0: [(a1, b1), (a2, b2)], 1: [(a2, b1)], -1: [(a1, b2)]}
    return max((_alike(x, y) for x, y in pairs.get(int(other).bit_length() - int(size).bit_length(), [])), default=0.0)


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with the signature of each whole text. A column of that name is replaced; others pass through. Null texts count
    as empty; repeated rows are treated alike; an empty table gives an empty table."""
    docs = docs.drop(name)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([signature(t.as_py()) for t in texts], pa.string())], [*batch.schema.names, name])

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


CHAIN = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(text: str, sign: str, after: str, sign_after: str, edit: Callable[[str, str], str]) -> tuple:
    edited = edit(text, after)
    sign_edited = sign if edited == text else signature(edited)
    return len(text), hashlib.sha256(edited.encode()).hexdigest(), sign, sign_edited, likeness(sign, sign_edited), likeness(sign, sign_after)


def against_next(docs: DataFrame, edit: Callable[[str, str], str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs.

    The next row is that with the next smaller key (the first follows the last; nulls come last; of equal keys any order
    that depends on the texts only); edit(text, next text) gives the edited text. Ranges of the order are sorted apart
    and streamed, a row waiting for the one after it; only the first and last row of a range are kept with their texts,
    and joined over the borders. Null texts are empty. One row is its own next; an empty table gives an empty table.
    """
    order = [F.col(key).desc_nulls_last(), F.xxhash64(text), F.col(text)]
    # ranges are found from a sample of keys and hashes: no texts reach the driver
    x = docs.select(key, text).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    fields = ["part", "place", "sign", "key", "text", "results"]
    names = [c.split()[0] for c in CHAIN.split(", ")]
    kind = docs.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, target = TaskContext.get().partitionId(), None, None

        def rows(out: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate([pa.int32(), pa.string(), pa.string(), target, pa.string()])]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            parts = [pa.array([r[5][k] if r[5] else None for r in out], t) for k, t in enumerate(kinds)]
            missing = pa.array([r[5] is None for r in out], pa.bool_())
            return pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(parts, names, mask=missing)], fields)

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            target, out = keys.type, []
            for k in range(batch.num_rows):
                now = texts[k].as_py() or ""
                now = (keys[k].as_py(), now, held[2] if held is not None and held[1] == now else signature(now))
                if held is None:
                    out.append((part, "first", now[2], now[0], now[1], None))
                else:
                    out.append((part, "done", None, held[0], None, _compared(held[1], held[2], now[1], now[2], edit)))
                held = now
            yield rows(out)
        if held is not None:
            yield rows([(part, "last", held[2], held[0], held[1], None)])

    found = cut(x.mapInArrow(walk, f"part int, place string, sign string, key {kind}, text string, results struct<{CHAIN.replace(' ', ':').replace(',:', ', ')}>"))
    # ranges hold rows or not; each one's last row meets the first one of the range after it
    ranges = found.where("place = 'first'").select("part")
    follow = ranges.select("part", F.lead("part").over(Window.orderBy("part")).alias("after")).crossJoin(ranges.agg(F.min("part").alias("begin")))
    follow = follow.select("part", F.coalesce("after", "begin").alias("after"))
    last = found.where("place = 'last'").select("part", "key", "text", "sign").join(follow, "part")
    first = found.where("place = 'first'").select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("sign").alias("next_sign"))

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [_compared(r["text"], r["sign"], r["next_text"], r["next_sign"], edit) for r in batch.drop_columns(["key"]).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*some), [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", *names])

    joined = last.join(first, "after").select("key", "text", "sign", "next_text", "next_sign")
    ends = joined.mapInArrow(border, f"key {kind}, {CHAIN}")
    return found.where("place = 'done'").select("key", "results.*").unionByName(ends).withColumnRenamed("key", key)
