"""Fingerprints, periodic runs and spelling variants against brute force: nulls, empties, ties, repeats, clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sigflow.llm import fingerprints, queries, repeats, variants


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def some_texts(rng, n=60):
    texts = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=rng.randint(1, 200))) for _ in range(n)]
    return [*texts, None, "", "", "a", "ab \n\tc", "é一 \U0001f600 x", texts[3], texts[3], "z " * 4000, "no blanks" * 900]


# --- fingerprints


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 13))) for _ in range(2))
        assert fingerprints.edit_distance(a, b) == levenshtein(a, b)
    a, b = "ab" * 100, "ba" * 100
    assert fingerprints.edit_distance(a, b) == 2


def test_signature_does_not_depend_on_slices(monkeypatch):
    texts = ["".join(random.Random(2).choices("abcdefgh é\n", k=6000)), "x" * 5000, "ab" * 900, "short", "", "\U0001f600" * 700]
    want = [fingerprints.signature(t) for t in texts]
    for size in (7, 64, 1000):
        monkeypatch.setattr(fingerprints, "SLICE", size)
        assert [fingerprints.signature(t) for t in texts] == want
    assert fingerprints.signature(None) == fingerprints.signature("") and all(len(s.split(":")[1]) <= fingerprints.LONGEST + 1 for s in want)


def straight_signature(t):
    """The definition, a code point at a time: hashes of windows end chunks, each block size tried from the least."""
    powers = [pow(fingerprints.BASE, k + 1, 1 << 64) for k in range(len(t) + 1)]
    value = lambda c: int(fingerprints._values()[ord(c)])
    whole = lambda s: sum(value(c) * powers[k] for k, c in enumerate(s)) & fingerprints.MASK
    mixed = lambda x: int(fingerprints.mix64(np.array([x], dtype=np.uint64))[0])
    hashes = [mixed(whole(t[max(0, k - 6) : k + 1])) for k in range(len(t))]
    ends = lambda bits: [k + 1 for k, h in enumerate(hashes) if h % (1 << bits) == 0]
    bits = 2
    while len(ends(bits)) > 64:
        bits += 1

    def letters(bits):
        e = [0, *ends(bits)]
        e = e if e[-1] == len(t) else [*e, len(t)]
        return "".join(fingerprints.LETTERS[mixed(whole(t[a:b])) >> 58] for a, b in zip(e, e[1:]))

    return f"{1 << bits}:{letters(bits)}:{letters(bits + 1)}"


def test_signature_by_definition():
    for t in ["".join(random.Random(k).choices("abcdef é", k=40 * k)) for k in range(12)] + ["a", "aaaaaaaaaaaaaaaaaaaa"]:
        assert fingerprints.signature(t) == straight_signature(t)


def test_likeness():
    rng = random.Random(3)
    t = "".join(rng.choices("abcdefghij ", k=4000))
    u = "".join(rng.choices("abcdefghij ", k=4000))
    f = fingerprints.signature
    assert fingerprints.likeness(f(t), f(t)) == 1 and fingerprints.likeness(f(t), f(u)) < 0.1
    assert fingerprints.likeness(f(t), f(t[:2000] + "?" + t[2000:])) > 0.9 and 0.5 < fingerprints.likeness(f(t), f(t[:2700] + u[:1300])) < 0.8
    assert fingerprints.likeness(f(t), f("")) == 0 and fingerprints.likeness(f(None), f("")) == 1


@pytest.mark.parametrize("parts", [1, 5])
def test_against_next(spark, parts):
    rng = random.Random(4)
    rows = [(7 * k % 101, t, "x") for k, t in enumerate(some_texts(rng))] + [(None, "nobody's", "x"), (5, "tie", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(parts)
    got = fingerprints.against_next(df, queries.with_third_of).collect()
    assert len(got) == len(rows)
    ordered = sorted({r[0] for r in rows if r[0] is not None}, reverse=True)
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(t or "")
    f = fingerprints.signature
    for r in got:
        if len(texts[r["doc_id"]]) > 1:
            continue
        t = texts[r["doc_id"]][0]
        after = ordered[(ordered.index(r["doc_id"]) + 1)] if r["doc_id"] is not None and r["doc_id"] != ordered[-1] else None if r["doc_id"] is not None else ordered[0]
        wants = set()
        for u in texts[after]:
            edited = t[: len(t) - len(t) // 3] + u[: len(t) // 3]
            wants.add((len(t), hashlib.sha256(edited.encode()).hexdigest(), f(t), f(edited), fingerprints.likeness(f(t), f(edited)), fingerprints.likeness(f(t), f(u))))
        assert tuple(r)[1:] in wants
    assert fingerprints.against_next(df.limit(0), queries.with_third_of).count() == 0
    (one,) = fingerprints.against_next(df.where("text = 'tie'"), queries.with_third_of).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"tit").hexdigest()
    plain = fingerprints.fingerprint(df).collect()
    assert len(plain) == len(rows) and all(r["fingerprint"] == f(r["text"]) for r in plain)


# --- periodic runs


def straight_runs(w, least):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found.setdefault((s, i - s + q), q)
    return sorted((s, n, q) for (s, n), q in found.items())


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_random_words(least):
    rng = random.Random(least)
    for _ in range(700):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 9)
            for i in range(a, n):
                w[i] = w[a + (i - a) % p]
        assert repeats.maximal_runs(np.array([*w, -1]), least) == straight_runs(w, least)


def test_suffix_array():
    rng = np.random.default_rng(6)
    for k in (1, 2, 5):
        w = np.append(rng.integers(0, k, 200), -1)
        order, place, lcp = repeats.suffix_array(w)
        suffixes = sorted(range(len(w)), key=lambda i: w[i:].tolist())
        assert order.tolist() == suffixes and (place[order] == np.arange(len(w))).all()
        for x in range(1, len(w)):
            a, b = w[order[x - 1] :], w[order[x] :]
            n = min(len(a), len(b))
            off = np.flatnonzero(a[:n] != b[:n])
            assert lcp[x] == (off[0] if len(off) else n)


def test_find_runs(spark, monkeypatch):
    rng = random.Random(7)
    texts = [*some_texts(rng), "a b c " * 5 + "end", "x " + "one two three four five six " * 2, "a\x85a " * 20, "\xa0".join("b" * 30), "q " * 11]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)] * 2, "doc_id long, text string, runs int").repartition(3)
    monkeypatch.setattr(repeats, "TOGETHER", 500)
    got = repeats.find_runs(df).collect()
    assert got[0].__fields__ == ["doc_id", "text", "n_words", "runs", "collapsed"] and len(got) == 2 * len(texts)
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        runs = straight_runs(w, 12) if len(w) < 1000 else [(0, len(w), 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        assert (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == (len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone))
    assert repeats.find_runs(df.limit(0)).count() == 0


def test_long_period():
    w = np.append(np.tile(np.arange(3000), 40)[: 3000 * 40 - 17], -1)
    assert repeats.maximal_runs(w) == [(0, 3000 * 40 - 17, 3000)]
    assert repeats.maximal_runs(np.append(np.zeros(100_000, dtype=np.int64), -1)) == [(0, 100_000, 1)]


def test_op12_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, t) for k, t in enumerate(some_texts(rng, 150))] + [(None, "null id"), (33, "again again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op12_repeats(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            w = [w[x] if x < a else w[a + (x - a) % (1 + (n - a) // (3 + g % 8))] for x in range(n)]
        runs = straight_runs(w, 12) if n < 1000 else [(0, n, 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, " ".join(x for k, x in enumerate(w) if k not in gone))]
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha))
    assert got == sorted(want, key=str) and sum(r[1] for r in got) > 5


# --- spelling variants


def straight_variants(counts, factor=5):
    near = {w: [v for v in counts if levenshtein(v, w) == 1] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= factor * counts[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), counts[w], len(near[w]), counts[form[w]] if w in form else None) for w in counts), key=str)


def test_pairs_of_one_edit():
    rng = random.Random(9)
    for _ in range(300):
        words = sorted({"".join(rng.choices("ab", k=rng.randint(0, 5))) for _ in range(rng.randint(0, 25))})
        depth = rng.randint(1, 7)
        got = list(variants.one_edit_pairs(words, depth))
        parted = lambda u, v: next((k for k, (x, y) in enumerate(zip(u, v)) if x != y), min(len(u), len(v)))
        want = {frozenset((u, v)) for u in words for v in words if levenshtein(u, v) == 1 and parted(u, v) < depth}
        assert len(got) == len(want) and set(map(frozenset, got)) == want and all(len(u) <= len(v) for u, v in got)


def test_acceptor_is_minimal():
    states, initial = variants.acceptor(sorted(["tap", "taps", "top", "tops"]))
    assert len(states) == 5 and states[initial][1].keys() == {"t"}
    assert variants.acceptor([]) == ([(False, {})], 0) and variants.acceptor([""])[0] == [(True, {})]


@pytest.mark.parametrize("block", [2, 7, 20_000])
def test_spelling_variants(spark, block):
    rng = random.Random(10)
    counts = {"".join(rng.choices("abc", k=rng.randint(1, 7))): rng.choice([5, 6, 7, 25, 40, 130, 700, 9000]) for _ in range(250)}
    counts |= {"aaaaaaaaaaaa" + c: 5**k for k, c in enumerate("bcdefg")} | {"été": 5, "ete": 5, "x": 5, "h" * 300: 5, "h" * 301: 25}
    df = spark.createDataFrame([*counts.items(), (None, 3)], "word string, n long").repartition(4)
    got = sorted((tuple(r) for r in variants.spelling_variants(df, block=block).collect() if r["word"] is not None), key=str)
    assert got == straight_variants(counts)
    assert variants.spelling_variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        variants.spelling_variants(df, factor=1)


def test_op13_query(spark, tmp_path):
    rng = random.Random(11)
    pool = ["".join(rng.choices("abcde", k=rng.randint(4, 8))) for _ in range(50)] + ["Études", "études", "naïvely"]
    pool += [w[:2] + "x" + w[2:] for w in pool[:20]]
    rows = [(k, rng.choice([" ", "-", "9"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in rng.choices(pool, k=90))) for k in range(60)]
    rows += [(None, "Seventh seventh"), (2, None), (3, ""), (4, "longer" * 3000 + " short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            counts[queries.spoiled(i, run)] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = sorted(map(tuple, queries.op13_variants(spark, str(tmp_path)).collect()), key=str)
    assert got == straight_variants(counts) and len(got) > 30
