"""Toxic spans and document scores from a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import NOT_WORD, Words, cut, drop_cut, in_groups, internal, lowered, mix64, shingles_in_order

TOKEN = re.compile(r"\w+|[.!?\n]")
PREFIXES = (4, 5, 6)
BITS = 20
PIECE = 1 << 19
BLOCK = 64


def parts_of(word: str) -> list[str]:
    """What may mark a token as toxic in training: the word itself and its beginnings."""
    return [f"w:{word}"] + [f"p:{word[:k]}" for k in PREFIXES if len(word) > k]


def hash_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


def _parts(word: str) -> tuple[int, int, int, int, int, int]:
    """Hashes of word, beginning and shape; then, for the token itself only, of longer beginnings and the ending (0: none)."""
    shape = f"k{0 if word.isalpha() else 1 if word.isdigit() else 2}{word.isascii():d}{min(len(word), 12) // 3}"
    h, n = xxhash.xxh3_64_intdigest, len(word)
    return h("w" + word), h("p" + word[:4]), h(shape), h("p" + word[:5]) if n > 4 else 0, h("p" + word[:6]) if n > 5 else 0, h("s" + word[-3:]) if n > 3 else 0


def features(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features (rows: words) and which of them exist: the words' own, what they tell the next token and the previous one."""
    raw = np.fromiter((x for w in words for x in _parts(w)), dtype=np.uint64, count=6 * len(words)).reshape(-1, 6)
    return [((mix64(raw[:, :wide] + np.uint64(role)) >> np.uint64(64 - BITS)).astype(np.int64), raw[:, :wide] != 0) for role, wide in ((0, 6), (1, 3), (2, 3))]


def adds(words: list[str], weights: np.ndarray) -> np.ndarray:
    """What each word adds to its own score, to the next token's and to the previous one's; '' is an end and adds nothing."""
    out = np.column_stack([np.where(has, weights[f], 0).sum(axis=1) for f, has in features(words)]).astype(float)
    out[[k for k, w in enumerate(words) if not w]] = 0
    return out


@dataclass
class Model:
    """What training leaves: a weight for each hashed feature, bias and label transitions of the field, the document
    calibration. Of fixed size (4 MB), whatever the input."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, dtype=np.float32))
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calib: np.ndarray = field(default_factory=lambda: np.array([-2.0, 1.0, 0.0]))


class Lexicon(dict):
    """Word -> number; table(): the words' rows of adds(). Number 0 is an end of a sentence or text.

    The lexicon is emptied when it has grown past `most` words, but only where trim() is called, as numbers must hold for
    a group of texts.
    """

    def __init__(self, weights: np.ndarray, most: int = 300_000):
        super().__init__()
        self.weights, self.most = weights, most
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.update(dict.fromkeys(".!?\n", 0))
        self.rows, self.new, self.size = np.zeros((1, 3)), [], 1

    def trim(self) -> None:
        if self.size > self.most:
            self.restart()

    def __missing__(self, word: str) -> int:
        x = self[word] = self.size
        self.new.append(word)
        self.size += 1
        return x

    def table(self) -> np.ndarray:
        if self.new:
            known = self.size - len(self.new)
            if len(self.rows) < self.size:
                self.rows = np.concatenate([self.rows[:known], np.zeros((self.size, 3))])
            self.rows[known : self.size] = adds(self.new, self.weights)
            self.new = []
        return self.rows


class Marker(dict):
    """Word -> 1 if it has a marked feature; bounded."""

    def __init__(self, marks: frozenset[str], most: int = 100_000):
        super().__init__()
        self.marks, self.most = marks, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        x = self[word] = int(any(p in self.marks for p in parts_of(word)))
        return x


def pieces(text: str) -> Iterator[list[str]]:
    """Words and sentence ends, in lower case that keeps every code point's place, a piece of the text at a time."""
    low, at = lowered(text), 0
    while at < len(low):
        stop = at + PIECE
        if stop < len(low):
            stop = m.end() if (m := NOT_WORD.search(low, stop)) else len(low)
        yield TOKEN.findall(low, at, stop)
        at = stop


def tokens(text: str) -> list[str]:
    return [t for piece in pieces(text) for t in piece]


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t]) for all t, with x[-1] = 0; no coefficient is negative.

    The maps of each block are composed as 2x2 matrices, all blocks at once; then only the blocks' first values are
    found one by one. So a chain of any length takes a number of steps that grows with n / BLOCK.
    """
    n = len(a)
    rows = -(-n // BLOCK)
    fill = rows * BLOCK - n
    a, b, c, d = (np.ascontiguousarray(np.append(x, np.full(fill, e)).reshape(rows, BLOCK).T) for x, e in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    pa_, pb, pc, pd_ = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for k in range(BLOCK):
        pa_, pb, pc, pd_ = a[k] * pa_ + b[k] * pc, a[k] * pb + b[k] * pd_, c[k] * pa_ + d[k] * pc, c[k] * pb + d[k] * pd_
        size = pa_ + pb + pc + pd_
        pa_, pb, pc, pd_ = pa_ / size, pb / size, pc / size, pd_ / size
    x, first = 0.0, np.empty(rows)
    for k, (ka, kb, kc, kd) in enumerate(zip(pa_.tolist(), pb.tolist(), pc.tolist(), pd_.tolist())):
        first[k] = x
        x = (ka * x + kb) / (kc * x + kd)
    out, now = np.empty((BLOCK, rows)), first
    for k in range(BLOCK):
        now = out[k] = (a[k] * now + b[k]) / (c[k] * now + d[k])
    return out.T.ravel()[:n]


def forward_backward(emit: np.ndarray, ends: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per token the marginal of the toxic label (0 at ends), and the summed pair marginals (2, 2), of all chains at once.

    `emit` holds the tokens' scores for the toxic label; the chains are the runs between ends, whole, however long. What
    is carried along is the ratio of the two labels' forward (backward) sums.
    """
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    t = np.exp(np.clip(trans, -20, 20))
    w = np.where(ends, 0.0, np.exp(np.clip(emit, -30, 30)))
    inner = ~ends & ~np.append(True, ends[:-1])  # has a token before it in its chain
    r = scan(np.where(inner, w * t[1, 1], 0), np.where(inner, w * t[0, 1], w), np.where(inner, t[1, 0], 0), np.where(inner, t[0, 0], 1))
    more = np.append(inner[1:], False)  # has a token after it
    wn = np.append(w[1:], 0)
    back = scan(*(x[::-1] for x in (np.where(more, t[1, 1] * wn, 0), np.where(more, t[1, 0], 1), np.where(more, t[0, 1] * wn, 0), np.where(more, t[0, 0], 1))))[::-1]
    both = r * back
    i = np.flatnonzero(more)
    m = np.empty((2, 2, len(i)))
    for y in range(2):
        m[y, 0] = (r[i] if y else 1.0) * t[y, 0]
        m[y, 1] = (r[i] if y else 1.0) * t[y, 1] * wn[i] * back[i + 1]
    return both / (1 + both), (m / m.sum(axis=(0, 1))).sum(axis=2)


def emission(at: np.ndarray, rows: np.ndarray, bias: float) -> np.ndarray:
    """Scores of the tokens, from their rows (Lexicon) and their neighbours'."""
    return bias + rows[at, 0] + np.append(0.0, rows[at[:-1], 1]) + np.append(rows[at[1:], 2], 0.0)


def fit_chain(at: np.ndarray, y: np.ndarray, words: list[str], model: Model, rounds: int = 40, l2: float = 0.5) -> None:
    """Penalised maximum likelihood of the chains' labels y: accelerated gradient steps, each weight's scaled by how often
    its feature occurs. at: word of each token, 0 at ends; words[0] stands for the ends."""
    hashed = features(words[1:])
    owner = [np.nonzero(has)[0] + 1 for _, has in hashed]
    flat = [f[has] for f, has in hashed]
    used, place = np.unique(np.concatenate(flat), return_inverse=True)
    place = np.split(place, np.cumsum([len(x) for x in flat])[:-1])
    ends, n = at == 0, (at > 0).sum()

    def spread(x: np.ndarray) -> np.ndarray:
        """Sums over the tokens, per feature."""
        shifted = (x, np.append(x[1:], 0.0), np.append(0.0, x[:-1]))
        per = [np.bincount(at, weights=np.where(ends, 0.0, z), minlength=len(words)) for z in shifted]
        return sum(np.bincount(place[k], weights=per[k][owner[k]], minlength=len(used)) for k in range(3))

    wide = 13  # features of a token and its neighbours, and the bias
    rate = 1 / np.concatenate([0.25 * wide * np.append(spread((~ends).astype(float)), n) + l2, np.full(4, 0.25 * wide * n + l2)])
    pairs = ~ends[1:] & ~ends[:-1]
    seen_t = np.array([[(pairs & (y[:-1] == a) & (y[1:] == b)).sum() for b in range(2)] for a in range(2)], dtype=float)
    theta = np.concatenate([model.weights[used].astype(float), [model.bias], model.trans.ravel()])
    last = theta
    for k in range(rounds):
        now = theta + k / (k + 3) * (theta - last)
        rows = np.column_stack([np.bincount(owner[j], weights=now[:-5][place[j]], minlength=len(words)) for j in range(3)])
        p, expected = forward_backward(np.where(ends, 0.0, emission(at, rows, now[-5])), ends, now[-4:].reshape(2, 2))
        diff = np.where(ends, 0.0, y - p)
        g = np.concatenate([spread(diff), [diff.sum()], (seen_t - expected).ravel()]) - l2 * now * np.append(np.ones(len(used)), np.zeros(5))
        last, theta = theta, now + rate * g
    model.weights[used], model.bias, model.trans = theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * w)
    return w


class Scorer:
    """Scores texts with a model: marginals per token, aggregated per document."""

    def __init__(self, model: Model):
        self.model, self.words = model, Lexicon(model.weights)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), dtype=np.int32, count=len(words))

    def evidence(self, texts: list[str], least: float = 0.5) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
        """Largest marginal and expected toxic tokens of each text, and its token marginals where one reaches `least`."""
        most, total, spots = [np.zeros(0)], [np.zeros(0)], []
        for group in in_groups(pa.array(texts, pa.string())):
            self.words.trim()
            numbers = [np.concatenate([np.zeros(0, np.int32), *(self.numbers(piece) for piece in pieces(t))]) for t in group]
            at = np.concatenate([np.append(x, np.int32(0)) for x in numbers])  # each text is closed by an end
            begin = np.cumsum([0] + [len(x) + 1 for x in numbers])
            p = forward_backward(emission(at, self.words.table(), self.model.bias), at == 0, self.model.trans)[0]
            most.append(np.maximum.reduceat(p, begin[:-1]))
            total.append(np.add.reduceat(p, begin[:-1]))
            spots += [p[a : b - 1] if x >= least else None for a, b, x in zip(begin, begin[1:], most[-1])]
        return np.concatenate(most), np.concatenate(total), spots

    def score(self, most: np.ndarray, total: np.ndarray) -> np.ndarray:
        z = self.model.calib[0] + doc_features(most, total) @ self.model.calib[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def spans(self, text: str, p: np.ndarray | None, least: float = 0.5) -> list[tuple[int, int]]:
        """Offsets (code points) of the runs of offending tokens."""
        if p is None or not (p >= least).any():
            return []
        out: list[tuple[int, int]] = []
        for k, m in enumerate(TOKEN.finditer(lowered(text))):
            if k < len(p) and p[k] >= least:
                if out and out[-1][2] == k - 1:
                    out[-1] = (out[-1][0], m.end(), k)
                else:
                    out.append((m.start(), m.end(), k))
        return [(a, b) for a, b, _ in out]


def doc_features(most: np.ndarray, total: np.ndarray) -> np.ndarray:
    p = np.clip(most, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(p / (1 - p)), np.log1p(total)])


def held_out(doc_id: Column) -> Column:
    """Rows that no training sees: crc32 of the id as text, divisible by 5 (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 5 == 0, F.lit(True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that have a feature, partial sums."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def table() -> pa.RecordBatch:
        rows = [(f, y, n) for y, c in counts.items() for f, n in c.items()]
        for c in counts.values():
            c.clear()
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["feature", "toxic", "n"])

    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[y].update({p for w in set(tokens(text or "")) for p in parts_of(w)})
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield table()
    yield table()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text, label and the least hash of the text's runs of three words: nearly equal texts mostly share it."""
    for batch in batches:
        least = []
        for group in in_groups(batch.column(0)):
            words = Words(group)
            for a, b in zip(words.bounds, words.bounds[1:]):
                runs = shingles_in_order(words.ids[a:b], max(1, min(3, b - a)))
                least.append(int(runs.min() >> np.uint64(1)) if len(runs) else -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.int64())], names=["text", "y", "least"])


def _contexts(candidates: frozenset[str]):
    """(feature, label, neighbours) of the candidates' occurrences: copies and near copies repeat a context, other texts do not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = Marker(candidates)
        for batch in batches:
            out = set()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                toks = tokens(text or "")
                for k, t in enumerate(toks):
                    if mark[t]:
                        near = hash_of(f"{toks[k - 1] if k else ''} {toks[k + 1] if k + 1 < len(toks) else ''}")
                        out.update((p, y, near) for p in parts_of(t) if p in candidates)
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["feature", "toxic", "near"])

    return run


def _chains(marks: frozenset[str], plain: int, stretch: int):
    """Labelled chains of the sample, of a longer one the stretch around its first marked token: every chain with a marked
    token, one in `plain` (by its words) of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = Marker(marks)
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for end, run_ in groupby(tokens(text or ""), ".!?\n".__contains__):
                    if not end:
                        chain = list(run_)
                        flags = [mark[t] for t in chain]
                        hit = flags.index(1) if 1 in flags else 0
                        a = max(0, min(hit - stretch // 2, len(chain) - stretch))
                        chain, flags = " ".join(chain[a : a + stretch]), flags[a : a + stretch]
                        draw = hash_of(chain)
                        if any(flags) or draw % plain == 0:
                            out.append((chain, bytes(f * y for f in flags), y, mix_draw(draw)))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["words", "labels", "toxic", "draw"])

    return run


def mix_draw(x: int) -> int:
    """Another hash of a chain's, so that the order of drawing does not follow the choice of one in `plain`."""
    return hash_of(str(x))


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            most, total, _ = scorer.evidence([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(most), pa.array(total), batch.column(1)], names=["most", "total", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", sample: int = 5000, chains: int = 10000, stretch: int = 256, least: int = 8, least_share: float = 0.01, ratio: float = 15.0, plain: int = 21) -> Model:
    """Fit on the labelled rows that are not held out: at most `sample` texts of either label (those of least hash,
    copies and most near copies once) and at most `chains` token chains of at most `stretch` tokens, of which those without a marked
    token are one in `plain` of all. The bounds keep the driver's share fixed at any size; they hold for the sample
    only: every text is scored whole, its chains uncut.

    First token labels come from the documents': a word, or a beginning of words, that at least `least` and least_share of the
    toxic texts have, ratio times as often as clean ones do, in at least as many different contexts, is marked; marked
    tokens of toxic texts are toxic, all others are not. The field learns a weight for each hashed feature: a token's
    word, beginnings, ending and shape, and the words, beginnings and shapes beside it. Then tokens of toxic texts that
    the field itself holds toxic get that label too, and it is fitted on. The calibration is fitted on the sampled
    documents, weighted back to the share of either label among all training rows. With no label of one kind every
    text gets the same low score.
    """
    known = labels.where(F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(toxic).cast("int").alias("y")).where(~held_out(F.col("id")))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model()
    # the sample is drawn among the labels, so no text of another row moves; it has 2 * sample rows at most
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(drawn[0].union(drawn[1])), "id")
    signed = rows.select("text", "y").mapInArrow(_signed, "text string, y int, least long")
    picked = cut(signed.groupBy("least", "y").agg(F.min("text").alias("text")).select("text", "y"))
    got = {r["y"]: r["count"] for r in picked.groupBy("y").count().collect()}
    if not got.get(0) or not got.get(1):
        drop_cut(picked)
        return Model()
    counts = picked.mapInArrow(_count, "feature string, toxic int, n long").groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    rare = lambda t, c: (F.col(t) >= max(least, least_share * got[1])) & ((F.col(t) + 0.5) / (got[1] + 1) >= ratio * (F.col(c) + 0.5) / (got[0] + 1))
    # each is in one toxic text of a hundred or more, so their number does not grow with the input
    first = counts.where(rare("t", "c")).select("feature").collect()
    near = picked.mapInArrow(_contexts(frozenset(r["feature"] for r in first)), "feature string, toxic int, near long").distinct()
    near = near.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    marks = frozenset(r["feature"] for r in near.where(rare("t", "c")).collect())
    model = Model()
    rows = picked.select("text", "y").mapInArrow(_chains(marks, plain, stretch), "words string, labels binary, toxic int, draw long").orderBy("draw", "words", "labels").limit(chains).collect()
    if rows:
        words = {"": 0}
        at = np.array([words.setdefault(w, len(words)) for r in rows for w in [*r["words"].split(" "), ""]], dtype=np.int64)
        y = np.frombuffer(b"".join(r["labels"] + b"\0" for r in rows), dtype=np.int8).astype(float)
        guilty = np.repeat([r["toxic"] for r in rows], [len(r["labels"]) + 1 for r in rows]) == 1
        model.bias = float(np.log((y.sum() + 1) / (len(y) + 1)))
        fit_chain(at, y, list(words), model)
        p = forward_backward(emission(at, adds(list(words), model.weights), model.bias), at == 0, model.trans)[0]
        fit_chain(at, np.maximum(y, guilty & (p >= 0.5)), list(words), model, rounds=20)
    seen = picked.mapInArrow(_evidence(model), "most double, total double, toxic int").toPandas()
    drop_cut(picked)
    y = seen["toxic"].to_numpy().astype(float)
    weight = np.where(y == 1, n[1] / got[1], n[0] / got[0])
    model.calib = fit_logistic(doc_features(seen["most"].to_numpy(), seen["total"].to_numpy()), y, weight)
    return model


def _score(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            last, at = batch.num_columns - 1, 0
            for texts in in_groups(batch.column(last)):
                most, total, spots = scorer.evidence(texts)
                spans = [[{"start": a, "end": b} for a, b in scorer.spans(t, p)] for t, p in zip(texts, spots)]
                cols = [batch.column(k).slice(at, len(texts)) for k in range(last)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(scorer.score(most, total)), pa.array(total), pa.array(spans, kind)], names=names)
                at += len(texts)

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs (all columns) with score (0 to 1), toxic_tokens (expected number) and toxic_spans (offsets in code points).

    Only the text counts. Whole texts are read. Null and empty texts get the score of a text without evidence.
    Repeated rows score alike; an empty table gives an empty table. Columns of the input with those names are
    replaced.
    """
    docs = docs.drop("score", "toxic_tokens", "toxic_spans")
    own = internal(docs, "_text")
    names = [*docs.columns, "score", "toxic_tokens", "toxic_spans"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.withColumn(own, F.col(text)).mapInArrow(_score(model, names), f"{schema}, score double, toxic_tokens double, toxic_spans array<struct<start: bigint, end: bigint>>")
