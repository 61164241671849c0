"""Periodic runs of words: branching tandem repeats from an enhanced suffix array, rotated and merged into maximal runs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words of texts that are sorted together; a longer text is sorted alone. Results do not depend on it.
TOGETHER = 1 << 18
RESULTS = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def suffix_array(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, place, lcp) of the suffixes: order lists their starts, sorted; place is its inverse; lcp[k] is the number of
    words that suffixes order[k - 1] and order[k] share. The last word must be unique.

    Ranks by the first 1, 2, 4 ... words; only suffixes that still share a rank are sorted again. The ranks of every
    width are kept, so that common lengths come from them width by width instead of word by word.
    """
    n = len(words)
    order = np.argsort(words, kind="stable").astype(np.int32)
    at, sort = np.arange(n, dtype=np.int32), words[order]
    new = np.append(True, sort[1:] != sort[:-1])
    place = np.empty(n, dtype=np.int32)
    place[order] = np.maximum.accumulate(np.where(new, at, 0))
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    ranks, width = [], 1
    while len(open_):
        ranks.append((width, place.copy()))
        mine = order[open_]
        pair = place[mine].astype(np.int64) * n + place[mine + width]
        by = np.argsort(pair, kind="stable")
        mine, pair = mine[by], pair[by]
        order[open_] = mine
        new = np.append(True, pair[1:] != pair[:-1])
        place[mine] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        width *= 2
    lcp = np.zeros(n, dtype=np.int32)
    if ranks:
        first = ranks[0][1]
        k = np.flatnonzero(first[order[1:]] == first[order[:-1]]) + 1
        a, b, same = order[k - 1], order[k], np.zeros(len(k), dtype=np.int32)
        for width, rank in reversed(ranks):
            step = (rank[a] == rank[b]) * np.int32(width)
            same, a, b = same + step, a + step, b + step
        lcp[k] = same
    return order, place, lcp


def _intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, cut, right): each pair of neighbouring parts [left, cut) and [cut, right) of an LCP interval of depth lcp[cut],
    the right one a child, the left one all children before it. No tree is built; a stack of open intervals is enough."""
    cuts = np.flatnonzero(lcp)
    left, right = np.empty(len(cuts), dtype=np.int64), np.empty(len(cuts), dtype=np.int64)
    stack: list[tuple[int, int, int]] = []  # depth, where its interval begins, number of the cut whose right end is open
    before = -1
    for k, (p, d) in enumerate(zip(cuts.tolist(), lcp[cuts].tolist())):
        begin = p - 1
        if before != p - 1:  # neighbours without a common word lie between: all ends here
            for _, _, j in stack:
                right[j] = before + 1
            stack.clear()
        while stack and stack[-1][0] >= d:
            _, begin, j = stack.pop()
            right[j] = p
        left[k] = begin
        stack.append((d, begin, k))
        before = p
    for _, _, j in stack:
        right[j] = before + 1
    return left, cuts, right


def branching_squares(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square whose next word does not go on with the period: suffixes start and start + period
    share just `period` words. Of two parts of an interval the smaller one's suffixes look for their partner, one depth
    before or after, in the other part by its place in the order."""
    order, place, lcp = suffix_array(words)
    left, cut, right = _intervals(lcp)
    lower = cut - left <= right - cut
    begin, size = np.where(lower, left, cut), np.where(lower, cut - left, right - cut)
    lo, hi = np.where(lower, cut, left), np.where(lower, right, cut)
    depth, total = lcp[cut].astype(np.int64), np.cumsum(size)
    starts, periods, done = [], [], 0
    while done < len(cut):
        base = total[done - 1] if done else 0
        stop = max(done + 1, int(np.searchsorted(total, base + (1 << 19), "right")))
        some = slice(done, stop)
        which = np.repeat(np.arange(done, stop), size[some])
        s = order[np.arange(len(which)) - np.repeat(total[some] - size[some] - base, size[some]) + begin[which]].astype(np.int64)
        d = depth[which]
        ahead = place[s + d]
        hit = (ahead >= lo[which]) & (ahead < hi[which])
        back = s - d
        behind = place[np.maximum(back, 0)]
        hit2 = (back >= 0) & (behind >= lo[which]) & (behind < hi[which])
        starts += [s[hit], back[hit2]]
        periods += [d[hit], d[hit2]]
        done = stop
    none = [np.empty(0, dtype=np.int64)]
    return np.concatenate(starts or none), np.concatenate(periods or none)


def _rotations(words: np.ndarray, i: int, d: int) -> int:
    """How often a square of period d at i can be rotated to the left."""
    far, step = i, 32
    while far:
        low = max(0, far - step)
        off = np.flatnonzero(words[low:far] != words[low + d : far + d])
        if len(off):
            return i - (low + int(off[-1]) + 1)
        far, step = low, 2 * step
    return i


def maximal_runs(words: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least `least` words and two periods, by start and period."""
    start, period = branching_squares(words)
    ok = np.ones(len(start), dtype=bool)
    for back in range(1, least - 1):  # short periods must rotate far enough
        need = ok & (least - 2 * period >= back)
        if not need.any():
            break
        ok &= ~need | ((start >= back) & (words[np.maximum(start - back, 0)] == words[np.maximum(start - back, 0) + period]))
    start, period = start[ok], period[ok]
    by_end: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k in np.lexsort((period, start + 2 * period)).tolist():
        i, d = int(start[k]), int(period[k])
        known = by_end[i + 2 * d]
        # a square of a multiple of the period of a run that ends here lies in that run
        if not any(d % q == 0 and s <= i for s, q in known):
            known.append((i - _rotations(words, i, d), d))
    return sorted((s, e - s, q) for e, found in by_end.items() for s, q in found if e - s >= least)


def _in_texts(texts: list[str | None], least: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """(n_words, runs, collapsed) of each text. bytes.split() parts at just the six blanks of ASCII."""
    split = [t.encode().split() if t else [] for t in texts]
    ids: dict[bytes, int] = defaultdict(count().__next__)
    first = np.cumsum([0] + [len(w) + 1 for w in split])
    words = np.empty(int(first[-1]), dtype=np.int64)
    for k, w in enumerate(split):
        words[first[k] : first[k + 1] - 1] = np.fromiter(map(ids.__getitem__, w), dtype=np.int64, count=len(w))
        words[first[k + 1] - 1] = -1 - k  # ends are unique, so nothing is common to two texts across them
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for s, n, q in maximal_runs(words, least):
        k = int(np.searchsorted(first, s, "right")) - 1
        runs[k].append((s - int(first[k]), n, q))
    for w, found in zip(split, runs):
        kept = w
        if found:
            keep = bytearray(b"\1") * len(w)
            for s, n, q in found:
                keep[s + q : s + n] = bytes(n - q)
            kept = [x for x, k in zip(w, keep) if k]
        yield len(w), found, b" ".join(kept).decode()


def find_runs(docs: DataFrame, text: str = "text", least: int = 12) -> DataFrame:
    """docs with n_words, runs (start, length, period of each maximal run of words, by start and period) and collapsed (the
    words joined by single spaces, of each run its first period only).

    Words are stretches without blanks (space, tab, line ends, form feed, vertical tab), compared exactly. A run has
    `least` words and twice its smallest period or more. Rows stay where they are, each text is worked on whole and by
    itself; memory follows the longest text. Null and empty texts have 0 words, no runs and '' collapsed; repeated rows
    are treated alike; an empty table gives an empty table. Columns of the input named like the results are replaced;
    others pass through.
    """
    docs = docs.drop("n_words", "runs", "collapsed")
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(RESULTS).fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, done = batch.column(batch.schema.get_field_index(text)), 0
            while done < batch.num_rows:
                texts, size = [], 0
                while done + len(texts) < batch.num_rows and (not texts or size < 4 * TOGETHER):
                    texts.append(column[done + len(texts)].as_py())
                    size += len(texts[-1] or "")
                n, runs, collapsed = zip(*_in_texts(texts, least))
                found = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], kind)
                part = batch.slice(done, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), found, pa.array(collapsed, pa.string())], [*batch.schema.names, "n_words", "runs", "collapsed"])
                done += len(texts)

    return docs.mapInArrow(work, schema)
