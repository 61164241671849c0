"""Benchmark decontamination: BM25 index of test items, block-max WAND over every passage, overlap verification."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import Words, distinct, in_groups, internal, shingle_hashes

SENTENCE_END = re.compile(r"(?<=[.!?])\s+|\n+")
K1, B = 1.2, 0.75
LEAKS = "array<struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double, start: bigint>>"
LEAK_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("start", pa.int64())]))


def split_item(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an item's question and answer, given as one text: the answer is its last sentence, of a single
    sentence the last third."""
    words = Words(SENTENCE_END.split(text or ""))
    parts = [words.ids[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:]) if b > a]
    if len(parts) > 1:
        return np.concatenate(parts[:-1]), parts[-1]
    k = len(words.ids) - len(words.ids) // 3
    return words.ids[:k], words.ids[k:]


class Terms:
    """Numbers of words by their hashes; len(self) stands for all other words."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[hashes >> np.uint64(44)] = True

    def __len__(self) -> int:
        return len(self.sorted)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), len(self), dtype=np.int64)
        at = np.flatnonzero(self.maybe[ids >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.sorted, ids[at]), len(self) - 1)
        same = self.sorted[place] == ids[at] if len(self) else np.zeros(len(at), dtype=bool)
        out[at[same]] = self.order[place[same]]
        return out


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for count[0] numbers, then those of start[1], and so on."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


class Index:
    """Postings of a bounded set of items, in blocks of item numbers.

    Impacts are BM25 contributions divided by the item's own score against itself, so a score of 1 means that a
    passage has all the words of an item, and one threshold serves all items. Terms are numbered by their bound, the
    largest impact, from the least up: the first terms of a passage are those whose lists matter least.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[int, int], n_docs: int, block: int = 8):
        self.ids, self.question, self.answer, words = [], [], [], []
        for item_id, text in items:
            q, a = split_item(text)
            if len(q) or len(a):
                self.ids.append(item_id)
                self.question.append(shingle_hashes(q))
                self.answer.append(shingle_hashes(a))
                words.append(np.concatenate([q, a]))
        self.longest = max(map(len, words), default=0)
        mean = sum(map(len, words)) / max(1, len(words))
        postings: dict[int, list[tuple[int, float]]] = {}
        for item, x in enumerate(words):
            norm = K1 * (1 - B + B * len(x) / mean)
            own = {w: np.log1p((n_docs - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(x.tolist()).items()}
            total = sum(own.values())
            for w, s in own.items():
                postings.setdefault(w, []).append((item, float(s / total)))
        hashes = sorted(postings, key=lambda w: (max(s for _, s in postings[w]), w))
        self.terms = Terms(np.array(hashes, dtype=np.uint64))
        self.block, self.blocks = block, -(-len(words) // block)
        self.bound = np.array([max(s for _, s in postings[w]) for w in hashes])
        starts, at, most, self.lists = [0], [], [], []
        for w in hashes:
            by: dict[int, list[tuple[int, float]]] = {}
            for item, s in postings[w]:
                by.setdefault(item // block, []).append((item, s))
            self.lists.append(by)
            at += by
            most += [max(s for _, s in x) for x in by.values()]
            starts.append(len(at))
        self.starts, self.at, self.most = np.array(starts), np.array(at, dtype=np.int64), np.array(most)
        self.key = np.repeat(np.arange(len(hashes)), np.diff(self.starts)) * self.blocks + self.at

    def search(self, window: np.ndarray, term: np.ndarray, threshold: float, room: int = 1 << 18) -> Iterator[tuple[int, int, float]]:
        """(window, item, score) of all items that a window's distinct terms score at threshold or above.

        The pairs are sorted by window and term. Lists whose bounds sum to less than half the threshold cannot bring
        an item there alone, so only the other lists of a window are read; their block maxima and the sum of the
        bounds left out rule blocks out. The maxima of the lists left out are looked up for the blocks that stay, and
        what still reaches the threshold is searched by WAND within the block.
        """
        least = threshold - 1e-9
        names, first, size = np.unique(window, return_index=True, return_counts=True)
        total = np.add.reduceat(self.bound[term], first) if len(first) else np.empty(0)
        names, first, size = (x[total >= least] for x in (names, first, size))
        for w in range(0, len(names), max(1, room // max(1, self.blocks))):
            part = slice(w, w + max(1, room // max(1, self.blocks)))
            begin, count = first[part], size[part]
            own = term[_spread(begin, count)]
            of = np.repeat(np.arange(len(count)), count)
            stop = np.cumsum(count)
            so_far = np.cumsum(self.bound[own])
            so_far -= np.repeat(so_far[stop - count] - self.bound[own[stop - count]], count)
            minor = so_far < threshold / 2
            rest = np.bincount(of[minor], weights=self.bound[own[minor]], minlength=len(count))
            n = np.diff(self.starts)[own[~minor]]
            lists = _spread(self.starts[own[~minor]], n)
            sums = np.bincount(np.repeat(of[~minor], n) * self.blocks + self.at[lists], weights=self.most[lists], minlength=len(count) * self.blocks)
            kept = np.flatnonzero((sums >= np.repeat(least - rest, self.blocks)) & (sums > 0))
            k, block = np.divmod(kept, self.blocks)
            few = np.bincount(of[minor], minlength=len(count))
            look = own[_spread((stop - count)[k], few[k])] * self.blocks + np.repeat(block, few[k])
            place = np.minimum(np.searchsorted(self.key, look), len(self.key) - 1)
            more = np.where(self.key[place] == look, self.most[place], 0.0)
            full = sums[kept] + np.bincount(np.repeat(np.arange(len(k)), few[k]), weights=more, minlength=len(k))
            for j in np.flatnonzero(full >= least).tolist():
                b, mine = int(block[j]), own[stop[k[j]] - count[k[j]] : stop[k[j]]]
                for item, score in self._wand([x[b] for t in mine.tolist() if b in (x := self.lists[t])], threshold):
                    yield int(names[part][k[j]]), item, score

    @staticmethod
    def _wand(lists: list[list[tuple[int, float]]], threshold: float) -> Iterator[tuple[int, float]]:
        """WAND over a block: the pivot is the first item at which the bounds of the lists up to it reach the threshold."""
        cursors = [[0, max(s for _, s in p), p] for p in lists]
        while True:
            cursors = sorted((c for c in cursors if c[0] < len(c[2])), key=lambda c: c[2][c[0]][0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[1]
                if bound >= threshold - 1e-9:
                    pivot = c[2][c[0]][0]
                    break
            if pivot is None:
                return
            if cursors[0][2][cursors[0][0]][0] == pivot:
                score = 0.0
                for c in cursors:
                    if c[2][c[0]][0] != pivot:
                        break
                    score += c[2][c[0]][1]
                    c[0] += 1
                if score >= threshold - 1e-9:
                    yield pivot, score
            else:
                for c in cursors:
                    while c[0] < len(c[2]) and c[2][c[0]][0] < pivot:
                        c[0] += 1

    def leaks(self, texts: list[str | None], threshold: float, overlap: float) -> list[list[dict]]:
        """Verified items of each text. Passages are windows of twice the longest item, one every such length: each run of
        words as long as an item lies within one of them."""
        words, step, none = Words(texts), self.longest, len(self.terms)
        best: list[dict[int, dict]] = [{} for _ in range(len(words))]
        if not len(words.ids) or not none:
            return [[] for _ in best]
        n = np.diff(words.bounds)
        windows = np.where(n > 0, -(-np.maximum(1, n - step) // step), 0)
        base = np.cumsum(windows) - windows
        owner = np.repeat(np.arange(len(n)), n)
        chunk = (np.arange(len(words.ids)) - words.bounds[owner]) // step
        term = self.terms(words.ids)
        pairs = [(base[owner] + chunk - back)[ok] * none + term[ok] for back, ok in ((0, (term < none) & (chunk < windows[owner])), (1, (term < none) & (chunk > 0)))]
        window, own = np.divmod(distinct(np.concatenate(pairs)), none)
        runs: dict[int, np.ndarray] = {}
        for w, item, score in self.search(window, own, threshold):
            doc = int(np.searchsorted(base, w, side="right")) - 1
            begin = (w - int(base[doc])) * step
            if w not in runs:
                runs = {w: _runs(words.ids[words.bounds[doc] + begin : min(words.bounds[doc] + begin + 2 * step, words.bounds[doc + 1])])}
            q, a = (_share(x[item], runs[w]) for x in (self.question, self.answer))
            found = best[doc]
            if q >= overlap and a >= overlap and (item not in found or found[item]["score"] < score):
                found[item] = {"item_id": self.ids[item], "score": float(score), "question_overlap": q, "answer_overlap": a, "start": begin}
        return [[found[i] for i in sorted(found)] for found in best]


def _runs(ids: np.ndarray) -> np.ndarray:
    """Hashes of all runs of one to five words of a passage: items' parts shorter than five words are one short run."""
    out = []
    for width in range(1, 6):
        if len(ids) >= width:
            out.append(shingle_hashes(ids, width))
    return np.unique(np.concatenate(out)) if out else ids


def _share(part: np.ndarray, runs: np.ndarray) -> float:
    return 1.0 if not len(part) else float(np.isin(part, runs, assume_unique=True).mean())


def _frequencies(hashes: np.ndarray):
    """Texts that hold each of the words, and (null) the number of texts; partial sums of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = Terms(hashes), 0
        counts = np.zeros(len(hashes), dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            for texts in in_groups(batch.column(0)):
                words = Words(texts)
                term = terms(words.ids)
                pairs = np.repeat(np.arange(len(words)), np.diff(words.bounds)) * (len(terms) + 1) + term
                counts += np.bincount(distinct(pairs[term < len(terms)]) % (len(terms) + 1), minlength=len(terms))
        some = np.flatnonzero(counts)
        words = pa.array([*hashes[some].view(np.int64).tolist(), None], pa.int64())
        yield pa.RecordBatch.from_arrays([words, pa.array([*counts[some].tolist(), n], pa.int64())], names=["word", "n"])

    return run


def _annotate(index, threshold: float, overlap: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            last, at = batch.num_columns - 1, 0
            for texts in in_groups(batch.column(last)):
                found = pa.array(own.leaks(texts, threshold, overlap), LEAK_TYPE)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(at, len(texts)) for k in range(last)], found], names=names)
                at += len(texts)

    return run


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.6, overlap: float = 0.8, shard_words: int = 1_000_000) -> DataFrame:
    """docs with a column leaks: the test items that each text holds, as item_id, score, question_overlap,
    answer_overlap and start (the passage's first word).

    A passage is retrieved when its BM25 score against an item is threshold times that of the item itself or more,
    and verified when the shares of the question's and of the answer's five-word runs that the passage has both
    reach overlap. Word weights come from document counts over all of docs. The items are dealt into shards of
    about shard_words words; each shard's index is built and broadcast by itself, so what a task holds stays
    bounded however many items there are.

    Null and empty texts have no leaks; null or wordless items match nothing; repeated rows and items are treated
    alike each. Empty tables give no leaks. Another column named leaks is replaced; others pass through.
    """
    spark = docs.sparkSession
    docs = docs.drop("leaks")
    items = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    own = internal(docs, "_own")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.withColumn("leaks", F.array().cast(LEAKS))
    before = internal(docs, "_before")
    for k in range(shards):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(shards)) == k).orderBy("item_id", "text").collect()]
        hashes = np.unique(np.concatenate([x for _, t in rows for x in split_item(t)])) if rows else np.empty(0, np.uint64)
        if not len(hashes):
            continue
        counted = docs.select(text).mapInArrow(_frequencies(hashes), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        df = {None if r["word"] is None else r["word"] % (1 << 64): r["n"] for r in counted}
        index = spark.sparkContext.broadcast(Index(rows, df, df.pop(None, 0)))
        kept = out.withColumnRenamed("leaks", before).withColumn(own, F.col(text))
        kept = kept.mapInArrow(_annotate(index, threshold, overlap, [*docs.columns, before, "leaks"]), f"{fields}, `{before}` {LEAKS}, leaks {LEAKS}")
        out = kept.withColumn("leaks", F.concat(before, "leaks")).drop(before)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a test item; nulls, empty texts and empty tables as in find_leaks()."""
    return find_leaks(docs, items, **options).where(F.size("leaks") == 0).select(*docs.columns)
