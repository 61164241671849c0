"""Spelling variants: words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer and itself."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.common import cut

#: Different words that a task counts before it hands them on.
HELD = 200_000
#: Words whose acceptor one task builds at once.
BLOCK = 20_000


def count_words(docs: DataFrame, letters: str, least: int, change: Callable[[object, str], str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the maximal runs of `letters` (a character class) in whole texts with A-Z in lower case, of `least` code
    points or more, counted over all rows. change(key, run) may replace the runs of a row before that.

    Each task adds up its words first; Spark adds up the tasks' sums. Null and empty texts hold no words.
    """
    runs = re.compile(f"[{letters}]{{{least},}}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                t = t.as_py()
                if not t:
                    continue
                own = Counter(runs.findall(t.encode().lower().decode()))  # bytes.lower() turns A-Z only
                if change is None:
                    held.update(own)
                else:
                    k = k.as_py()
                    for run, n in own.items():
                        if len(word := change(k, run)) >= least:
                            held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    return docs.select(key, text).mapInArrow(work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def acceptor(words: list[str]) -> tuple[list[tuple[bool, dict[str, int]]], int]:
    """The minimised acceptor of sorted, distinct words: its states (final, next state by letter) and the initial one.

    States are closed from the last letter of a word to the first, and equal ones are one state.
    """
    states: list[tuple[bool, dict[str, int]]] = []
    known: dict[tuple, int] = {}
    path, before = [[False, {}]], ""

    def close(node: list) -> int:
        state = known.setdefault((node[0], tuple(node[1].items())), len(states))
        if state == len(states):
            states.append((node[0], node[1]))
        return state

    def close_beyond(k: int) -> None:
        while len(path) > k + 1:
            node = path.pop()
            path[-1][1][before[len(path) - 1]] = close(node)

    for w in words:
        k = next((k for k, (x, y) in enumerate(zip(w, before)) if x != y), min(len(w), len(before)))
        close_beyond(k)
        path += [[False, {}] for _ in w[k:]]
        path[-1][0], before = True, w
    close_beyond(0)
    return states, close(path[0])


def _common(states: list, p: int, q: int, but: str | None) -> list[str]:
    """Words that both states accept and that do not begin with the letter `but`."""
    out, open_ = [], [(p, q, "", but)]
    while open_:
        p, q, read, but = open_.pop()
        (end, a), (end2, b) = states[p], states[q]
        if end and end2:
            out.append(read)
        open_ += [(a[c], b[c], read + c, None) for c in (a if len(a) < len(b) else b) if c != but and c in a and c in b]
    return out


def one_edit_pairs(words: list[str], depth: int) -> Iterator[tuple[str, str]]:
    """Pairs (u, v), u not longer, that the composition of the words' acceptor, a transducer that inserts or replaces one
    letter, and the acceptor again accepts, where the edit comes before `depth` letters are read.

    Until the edit both acceptors are in one state; the edit is made where the words part, so each pair comes once.
    """
    states, initial = acceptor(words)
    seen: dict[tuple, list[str]] = {}

    def rest(p: int, q: int, but: str | None = None) -> list[str]:
        if (p, q, but) not in seen:
            seen[p, q, but] = _common(states, p, q, but)
        return seen[p, q, but]

    open_ = [(initial, "")]
    while open_:
        p, read = open_.pop()
        after = sorted(states[p][1].items())
        for k, (b, y) in enumerate(after):
            for r in rest(p, y, b):
                yield read + r, read + b + r
            for a, x in after[:k]:
                for r in rest(x, y):
                    yield read + a + r, read + b + r
        if len(read) + 1 < depth:
            open_ += [(y, read + b) for b, y in after]


def _blocks(words: DataFrame, block: int) -> DataFrame:
    """Each word with the blocks it is in: m, lo, hi and the key, the first lo and last m - hi letters.

    A block is an initial state of the composition: words of m or m + 1 letters that share them, to be edited at a place from
    lo to hi - 1. Places are halved, so that either half of the letters is shared; a block with more than `block` words is
    halved again, down to a single place, where all that differs is one letter.
    """
    w, n = F.col("word"), F.char_length("word")
    x = words.withColumn("m", F.explode(F.array(n, n - 1)))
    half = F.floor(F.col("m") / 2).cast("int")
    x = x.withColumn("w", F.explode(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi")))))
    x = x.select(*words.columns, "m", "w.lo", "w.hi").where("lo < hi")
    done = []
    while True:
        tail = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
        x = x.withColumn("key", F.concat(F.substring(w, F.lit(1), F.col("lo")), F.lit(" "), F.substring(w, n - tail + 1, tail)))
        names = ["m", "lo", "hi", "key"]
        heavy = cut(x.where("hi - lo > 1").groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select(*names))
        done.append(x)
        if heavy.isEmpty():
            break
        done[-1] = x.join(heavy, names, "left_anti").select(x.columns)
        x = x.join(heavy, names, "left_semi").select(*words.columns, "m", "lo", "hi")
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        x = x.withColumn("w", F.explode(F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi")))).select(*words.columns, "m", "w.lo", "w.hi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n, other, other_n: each ordered pair of words (word, n; words distinct and not empty) that differ by exactly one
    inserted, deleted or replaced code point. Blocks are dealt by key, sorted and streamed, so a task holds one block."""
    x = _blocks(words.select("word", "n"), block)
    x = x.repartition("m", "lo", "hi", "key").sortWithinPartitions("m", "lo", "hi", "key")

    def pairs(at: tuple[int, int, int], some: dict[str, int]) -> Iterator[tuple[str, int, str, int]]:
        m, lo, hi = at
        tail = max(m - hi, 0)
        one = next(iter(some))
        head, end = one[:lo], one[len(one) - tail :]
        for u, v in one_edit_pairs(sorted(w[lo : len(w) - tail] for w in some), hi - lo):
            if len(u) + lo + tail == m:
                u, v = head + u + end, head + v + end
                yield u, some[u], v, some[v]
                yield v, some[v], u, some[u]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["word", "n", "other", "other_n"])

        now, some, rows = None, {}, []
        for batch in batches:
            for word, n, *at in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "m", "lo", "hi", "key"))):
                if at != now:
                    if len(some) > 1:
                        rows += pairs(tuple(now[:3]), some)
                    if len(rows) >= 20_000:
                        yield out(rows)
                        rows = []
                    now, some = at, {}
                some[word] = n
        if len(some) > 1:
            rows += pairs(tuple(now[:3]), some)
        if rows:
            yield out(rows)

    return x.mapInArrow(work, "word string, n bigint, other string, other_n bigint")


def spelling_variants(words: DataFrame, factor: int = 5, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of words (word, n; words distinct).

    form: the near word (one edit away) of largest n, ties to the smallest, if that n is `factor` times the word's or more;
    root: where forms lead to. n grows with each form, so forms never lead round, and the number of rounds follows from
    the largest n: each doubles the way. Only words with a form take part in them. A word has no more near words than
    places times letters, so none gathers a large part of the rows. A null word is near to none; an empty table gives an
    empty table.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, else forms could lead round")
    words = cut(words)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = cut(near_words(words.where("word <> ''"), block).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b")).select("word", "n_near", F.when(-F.col("b.less") >= factor * F.col("n"), F.col("b.other")).alias("form"), (-F.col("b.less")).alias("form_n")))
    links = cut(near.where("form is not null").select("word", F.col("form").alias("root")))
    most, steps, ways = words.agg(F.max("n")).first()[0] or 1, 1, links
    while factor**steps <= most:  # so many forms in a row would need a larger n
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ways = cut(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        steps *= 2
    out = words.join(near, "word", "left").join(ways, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form").isNotNull(), F.col("form_n")).alias("form_n"))
