"""Small brute-force checks of the corpus operators: nulls, empties, ties, repeats, clashing names."""

from __future__ import annotations

import collections
import functools
import hashlib
import html
import pathlib
import random
import time
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigflow.llm import decontaminate, extract, jaccard, language, lines, mixing, passages, topk, toxicity, warc
from sigflow.llm.common import Words

WORDS = [f"w{k}" for k in range(400)]
DOCS = "doc_id long, text string, source string, n long, size string"


def words(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def make(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(k, words(rng, rng.randint(3, 120)), f"s{k % 4}", k, "x") for k in range(60)]
    base = words(rng, 100).split()
    for k in range(60, 75):
        copy = list(base)
        copy[k % 100] = "changed"
        rows.append((k, " ".join(copy), "s0", k, "x"))
    rows += [(80 + k, rows[3][1], "s1", k, "x") for k in range(5)]
    return rows + [(90, None, None, 0, "x"), (91, "", "s1", 0, "x"), (92, "one two", "s2", 0, "x"), (92, "one two", "s2", 0, "x")]


def test_jaccard_against_all_pairs(spark, corpus):
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(make(spark, corpus), block=4).collect())
    sets = []
    for r in corpus:
        w = re.findall(r"\w+", (r[1] or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        return x if root[x] == x else find(root[x])

    links = collections.Counter()
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == sorted((corpus[k][0], corpus[find(k)][0], links[k]) for k in range(len(sets)))
    assert jaccard.near_duplicates(make(spark, [])).count() == 0
    kept = jaccard.keep_one(make(spark, corpus))
    assert kept.columns == ["doc_id", "text", "source", "n", "size"]
    assert kept.count() == len({find(k) for k in range(len(sets))})


def test_keep_one_tells_rows_apart_by_id_and_text(spark):
    rng = random.Random(9)
    t, u = words(rng, 40), words(rng, 40)
    rows = [(5, u), (5, t), (3, t), (3, t), (None, t), (7, None), (7, ""), (7, ""), (8, u + " end")]
    out = jaccard.keep_one(make(spark, [(a, b, "s", 0, "x") for a, b in rows])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted([(5, u), (3, t), (7, None), (7, ""), (7, "")], key=str)
    # no id at all: one of the copies stays
    out = jaccard.keep_one(make(spark, [(None, t, "s", 0, "x")] * 3)).collect()
    assert [(r["doc_id"], r["text"]) for r in out] == [(None, t)]


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_forest_recall_against_all_pairs(spark, threshold):
    rng = random.Random(12)
    rows = []
    for k in range(150):
        base = words(rng, 90).split()
        for copy in range(2):
            mine = list(base)
            for j in rng.sample(range(90), copy * rng.randint(0, 4)):
                mine[j] = "other"
            rows.append((2 * k + copy, " ".join(mine), "s", 0, "x"))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (r[1].split() for r in rows)]
    want = {k for k in range(0, 300, 2) if len(sets[k] & sets[k + 1]) >= threshold * len(sets[k] | sets[k + 1])}
    got = {r["class_id"] for r in jaccard.near_duplicates(make(spark, rows), threshold=threshold).where("n_links > 0").collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and 30 < len(want) < 150


def test_jaccard_keeps_no_shingles_of_texts_without_candidates(spark):
    rng = random.Random(21)
    rows = [(k, words(rng, 2000), "s", k, "x") for k in range(200)]
    rows.append((200, rows[7][1].replace("w1 ", "W1, "), "s", 200, "x"))
    where = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in where.rglob("*.parquet"))
    before = held()
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(make(spark, rows)).collect()}
    assert got == {(k, k, int(k == 7)) for k in range(200)} | {(200, 7, 1)}
    assert held() - before < sum(len(r[1]) for r in rows) / 5


def test_prefixes_shorten_until_the_recall():
    assert jaccard.prefix_length([], 0.8, 24, 0.999, 0.99) == 6
    assert jaccard.prefix_length([0.97] * 50, 0.8, 24, 0.999, 0.99) == 7
    assert jaccard.prefix_length([0.81] * 50, 0.8, 24, 0.999, 0.99) == 6
    assert jaccard.prefix_length([0.97] * 50, 0.8, 24, 0.999, 0.0) == 8


def test_lines(spark):
    rows = [(k, f"own {k}\nsame line \n\nlast", f"s{k}" if k else None, 0, "x") for k in range(4)] + [(9, None, "s1", 0, "x"), (8, "", "s1", 0, "x")]
    out = {r["doc_id"]: r for r in lines.dedup_lines(make(spark, rows), min_sites=4).collect()}
    assert out[1]["text"] == "own 1\n" and out[1]["n_removed"] == 2 and out[1]["n_lines"] == 4
    assert out[9]["text"] is None and out[8]["text"] == "" and out[8]["n_removed"] == 0
    assert lines.dedup_lines(make(spark, rows), min_sites=5).where("n_removed > 0").count() == 0
    assert lines.dedup_lines(make(spark, [])).count() == 0


def test_mix(spark, corpus):
    out = mixing.mix(make(spark, corpus)).collect()
    assert sum(r["size"] for r in out) == pytest.approx(sum({r["source"]: r["target"] for r in out}.values()))
    taken = collections.Counter()
    for r in out:
        assert r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for r in out:
        assert abs(taken[r["source"]] - r["target"]) <= 121
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(make(spark, corpus).repartition(7)).collect()))
    assert mixing.mix(make(spark, [])).count() == 0
    assert out[0].asDict().keys() == {*make(spark, []).columns, "source_size", "target", "copies"}
    rows = collections.Counter(r["doc_id"] for r in mixing.sample(make(spark, corpus)).collect())
    assert rows == collections.Counter({k: n for k, n in collections.Counter(r["doc_id"] for r in out for _ in range(r["copies"])).items() if n})


def test_mix_orders_rows_of_one_id_by_their_texts(spark):
    rows = [(None, words(random.Random(k), 10), "s", k, "x") for k in range(40)] + [(1, words(random.Random(k), 10), "t", k, "x") for k in range(40)]
    out = [sorted((r["text"], r["copies"]) for r in mixing.mix(make(spark, x).repartition(n)).collect()) for n, x in ((1, rows), (6, rows[::-1]))]
    assert out[0] == out[1]


def test_leaks(spark):
    rng = random.Random(1)
    items = [(k, words(rng, 20) + ". " + words(rng, 12) + ".") for k in range(30)] + [(40, None), (41, "")]
    rows = [(k, words(rng, 200), "s", 0, "x") for k in range(40)]
    rows += [(100 + k, words(rng, 150) + " " + items[k][1].upper() + words(rng, 30), "s", 0, "x") for k in range(30)]
    rows += [(200, items[2][1].split(". ")[0], "s", 0, "x"), (201, None, "s", 0, "x"), (202, "", "s", 0, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard in (1_000_000, 300):
        out = decontaminate.find_leaks(make(spark, rows), bench, shard_words=shard)
        assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in out.where("size(leaks) > 0").collect()} == {100 + k: [k] for k in range(30)}
    assert decontaminate.decontaminate(make(spark, rows), bench).count() == 43
    assert decontaminate.find_leaks(make(spark, rows), bench.limit(0)).where("size(leaks) > 0").count() == 0


def test_wand_finds_what_full_scoring_finds():
    rng = random.Random(2)
    items = [(k, words(rng, 15)) for k in range(50)]
    hashes = Words(WORDS).ids.tolist()
    index = decontaminate.Index(items, {w: rng.randint(1, 90) for w in hashes}, 100, block=4)
    windows = [np.unique(rng.choices(range(len(index.terms)), k=60)) for _ in range(50)]
    for room in (1 << 21, 40):
        found = collections.defaultdict(dict)
        for w, item, score in index.search(np.repeat(np.arange(50), [len(t) for t in windows]), np.concatenate(windows), 0.25, room):
            found[w][item] = score
        for w, terms in enumerate(windows):
            full = collections.Counter()
            for t in terms:
                for p in index.lists[t].values():
                    for item, s in p:
                        full[item] += s
            assert found[w] == pytest.approx({k: s for k, s in full.items() if s >= 0.25})


def test_topk(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(700, 8)) * 0.2
    v[300:500] = v[300]
    rows = [(k, [float(x) for x in p], 1) for k, p in enumerate(v)] + [(1000, None, 1), (1100, [None] * 8, 1), (1200, [float("nan")] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(df, df.where("vec_id % 100 = 0"), centers=6, block=150, group=3).collect()}
    ints = np.floor(1024 * v.astype(np.float32).astype(np.float64)).astype(np.int64)
    for q in range(0, 700, 100):
        s = ints @ ints[q]
        best = sorted((k for k in range(700) if k != q), key=lambda k: (-s[k], k))[:10]
        assert [got[q, r + 1] for r in range(10)] == [(k, s[k]) for k in best]
    assert len(got) == 70 and topk.search(df.limit(0), df).count() == 0


def test_topk_of_query_rows_that_share_an_id(spark):
    rng = np.random.default_rng(14)
    v = np.round(rng.normal(size=(120, 4)), 3)
    ids = [k // 2 if k < 20 else k for k in range(120)]  # ten ids of two vectors each
    rows = [(i, [float(x) for x in p]) for i, p in zip(ids, v)]
    df = spark.createDataFrame([*rows, rows[0], rows[3]], "vec_id long, embedding array<double>")
    ints = np.floor(1024 * v).astype(np.int64)
    want = set()
    for q in range(20):
        copy = int(ints[q].tolist() > ints[q ^ 1].tolist())
        every = [(-int(ints[k] @ ints[q]), ids[k]) for k in [*range(120), 0, 3] if ids[k] != ids[q]]
        want |= {(ids[q], copy, r + 1, i, -s) for r, (s, i) in enumerate(sorted(every)[:10])}
    for parts in (1, 5):
        out = topk.search(df.repartition(parts), df.where("vec_id < 10").repartition(parts), centers=4, block=30, group=3).collect()
        assert {(r["query_id"], r["copy"], r["rank"], r["vec_id"], r["score"]) for r in out} == want and len(out) == len(want)


def test_warc(spark):
    pages = [(1, "http://a/1", "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 500, 1), (2, None, None, 1), (0, "x\r\ny", "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 500, 1), (3, "u", "", 1), (None, "u", "z", 1), (5, "u", "q" * 3_000_000, 1), (5, "u", "q" * 3_000_000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, data int")
    chunks = warc.read_chunks(warc.write_warc(df), chunk=1000)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 1000
    rows = warc.records(chunks).collect()
    assert len(rows) == 7
    by = {r["page_id"]: r for r in rows}
    assert by[1]["record_type"] == "revisit" and by[1]["refers_to"] == 0 and by[3]["refers_to"] == 2 and by[5]["record_type"] == "response"
    for p in pages:
        data = (p[2] or "").encode()
        assert (by[p[0]]["payload_bytes"], by[p[0]]["payload_digest"]) == (len(data), warc.base32_sha1(hashlib.sha1(data).digest()))
    whole = chunks.where("page_id = 0").orderBy("chunk_no").collect()
    assert b"".join(r["data"] for r in whole) == pages[2][2].encode()
    assert warc.records(warc.read_chunks(warc.write_warc(df.limit(0)))).count() == 0


def test_toxicity(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        w = words(rng, rng.randint(5, 60)).split()
        if k % 3 == 0:
            w.insert(rng.randint(0, len(w)), "vile" + rng.choice(["", "ness", "ly"]))
        rows.append((k, " ".join(w) + ". " + words(rng, 20), "s", 0, "x"))
        labels.append((k, 1, int(k % 3 == 0)))
    rows += [(1000, None, "s", 0, "x"), (1001, "", "s", 0, "x")]
    model = toxicity.train(make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.score(make(spark, rows), model).collect()}
    assert np.mean([(out[k]["score"] >= 0.5) == (k % 3 == 0) for k in range(600)]) > 0.98
    assert out[1000]["score"] == out[1001]["score"] < 0.5
    text, span = rows[3][1], out[3]["toxic_spans"][0]
    assert text[span["start"] : span["end"]].startswith("vile")
    assert toxicity.score(make(spark, []), model).count() == 0
    assert toxicity.train(make(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).weights.any() == False  # noqa: E712


def test_spans_keep_their_places_where_case_changes_lengths(spark):
    text = "İstanbul güzel vile end"
    model = toxicity.Model()
    model.weights[toxicity.features(["vile"])[0][0][0, 0]] = 20
    row = toxicity.score(make(spark, [(1, text, "s", 0, "x")]), model).first()
    assert [text[x["start"] : x["end"]] for x in row["toxic_spans"]] == ["vile"]


def test_leave_one_out_fusion_by_hand(spark):
    """Posteriors of ten pages, computed straight from the definition."""
    rng = random.Random(41)
    model = language.TextModel(["aa", "bb"], {})
    rows = [(k, rng.choice([None, "aa", "bb"]), rng.choice(["com", "bb"]), f"h{k % 3}", f"d{k % 2}", [rng.uniform(-3, 0), rng.uniform(-3, 0)]) for k in range(10)]
    df = spark.createDataFrame(rows, "page_id long, declared string, suffix string, host string, domain string, text_ll array<double>")
    got = {r["page_id"]: (r["lang"], r["posterior"]) for r in language.fuse(df, model).collect()}
    verdict = [int(r[5][1] > r[5][0]) for r in rows]
    base = [(verdict.count(k) + 1) / 12 for k in (0, 1)]
    for r in rows:
        n = lambda col: [sum(verdict[q[0]] == k for q in rows if q[0] != r[0] and q[col] == r[col]) for k in (0, 1)]  # noqa: E731,B023
        domain = [(x + 5 * p) / (sum(n(4)) + 5) for x, p in zip(n(4), base)]
        host = [(x + 5 * p) / (sum(n(3)) + 5) for x, p in zip(n(3), domain)]
        log = [a + np.log(p) for a, p in zip(r[5], host)]
        for col in (1, 2):
            if r[col] is not None:
                log = [a + np.log((x + 5 * p) / p) for a, x, p in zip(log, n(col), base)]
        want = 1 / (1 + np.exp(-abs(log[0] - log[1])))
        assert got[r[0]] == (("aa", "bb")[int(log[1] > log[0])], pytest.approx(want))


def test_language_lets_any_column_pass(spark):
    model = language.TextModel(["aa"], {})
    df = spark.createDataFrame([(1, "http://x.y/", "<p>a", 7, 8, 9)], "page_id long, url string, html string, verdict int, text_ll int, n_host int")
    row = language.identify_pages(df, model).first()
    assert (row["verdict"], row["text_ll"], row["n_host"], row["host"], row["lang"]) == (7, 8, 9, "x.y", "aa")
    assert language.identify_pages(df.limit(0), model).count() == 0


def test_damaged_archives_raise():
    import io
    import zlib

    out = io.BytesIO()
    assert warc.write_record(out, 1, "u", memoryview(b"x" * 1000), "D", None, "d") == len(out.getvalue())
    data = out.getvalue()
    (head, body), = ((h, b"".join(b)) for h, b in warc.read_records(io.BytesIO(data), len(data), 64))
    assert body == b"x" * 1000 and head["x-page-id"] == "1"
    for bad in (data[:-30], data[: len(data) // 2]):
        with pytest.raises((ValueError, zlib.error)):
            for _, body in warc.read_records(io.BytesIO(bad), len(bad)):
                b"".join(body)


def test_chain_marginals_by_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=14), rng.normal(size=(2, 2))
    ends = np.isin(np.arange(14), [0, 6, 7, 9])
    p, pairs = toxicity.forward_backward(emit, ends, trans)
    want, want_pairs = np.zeros(14), np.zeros((2, 2))
    for own in (range(1, 6), range(8, 9), range(10, 14)):
        mass, pair, total = np.zeros(14), np.zeros((2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=len(own)):
            s = np.exp(sum(emit[t] * v for t, v in zip(own, y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += s
            mass[list(own)] += s * np.array(y)
            for a, b in zip(y, y[1:]):
                pair[a, b] += s
        want, want_pairs = want + mass / total, want_pairs + pair / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)
    assert toxicity.forward_backward(np.zeros(0), np.zeros(0, bool), trans)[0].size == 0


def test_long_chains_are_whole():
    """One chain of 5000 tokens, step by step; a strong first token is felt at the far end where labels hardly change."""
    rng = np.random.default_rng(2)
    emit, trans = np.append(9.0, rng.normal(0, 1e-3, 4999)), np.array([[9.0, 0.0], [0.0, 9.0]])
    a = np.zeros((5000, 2))
    a[0] = 0, emit[0]
    for t in range(1, 5000):
        a[t] = np.logaddexp(a[t - 1, 0] + trans[0], a[t - 1, 1] + trans[1]) + [0, emit[t]]
    p = toxicity.forward_backward(emit, np.zeros(5000, bool), trans)[0]
    assert p[-1] == pytest.approx(1 / (1 + np.exp(a[-1, 0] - a[-1, 1])), abs=1e-9)
    assert toxicity.forward_backward(np.append(0.0, emit[1:]), np.zeros(5000, bool), trans)[0][-1] != pytest.approx(p[-1], abs=1e-3)


def test_scores_of_texts_by_hand(spark):
    """Scores from features, chains and calibration, token by token; one text is longer than a piece."""
    rng = random.Random(6)
    model = toxicity.Model(bias=-2.0, trans=np.array([[0.3, -0.2], [0.1, 0.4]]), calib=np.array([-1.0, 0.7, 0.2]))
    model.weights[:] = np.random.default_rng(3).normal(0, 0.4, len(model.weights))

    def role(word, r):
        f, has = toxicity.features([word])[r]
        return sum(float(model.weights[x]) for x in f[has])

    texts = ["w1 w2. W3!", "", "w9", words(rng, 200) + ".\n" + words(rng, 90), "." , (words(rng, 300) + ". ") * 600]
    got = {r["doc_id"]: r for r in toxicity.score(make(spark, [(k, t, "s", 0, "x") for k, t in enumerate(texts)]), model).collect()}
    role = functools.lru_cache(None)(role)
    for k, text in enumerate(texts):
        most, total = 0.0, 0.0
        for chain in re.split(r"[.!?\n]", text.lower()):
            toks = re.findall(r"\w+", chain)
            e = [model.bias + role(t, 0) + (role(toks[j - 1], 1) if j else 0) + (role(toks[j + 1], 2) if j + 1 < len(toks) else 0) for j, t in enumerate(toks)]
            f, g = np.zeros((len(e), 2)), np.zeros((len(e), 2))
            for j in range(len(e)):
                f[j] = (np.logaddexp(f[j - 1, 0] + model.trans[0], f[j - 1, 1] + model.trans[1]) if j else 0) + np.array([0, e[j]])
            for j in range(len(e) - 2, -1, -1):
                n = g[j + 1] + [0, e[j + 1]]
                g[j] = np.logaddexp(n[0] + model.trans[:, 0], n[1] + model.trans[:, 1])
            if e:
                p = 1 / (1 + np.exp((f + g)[:, 0] - (f + g)[:, 1]))
                most, total = max(most, p.max()), total + p.sum()
        z = model.calib[0] + toxicity.doc_features(np.array([most]), np.array([total]))[0] @ model.calib[1:]
        assert got[k]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6), k
        assert got[k]["toxic_tokens"] == pytest.approx(total, rel=1e-6)


def test_the_field_knows_more_than_the_marked_words(spark):
    """A rare toxic word, too rare to be marked, ends as the marked ones do: the field finds it by that."""
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(900):
        w = words(rng, rng.randint(8, 40)).split()
        if k % 3 == 0:
            stem = rng.choice(["grob", "fies", "vile"]) if k % 30 else f"q{k}zu"
            w.insert(rng.randint(0, len(w)), stem + "wicht")
        rows.append((k, " ".join(w), "s", 0, "x"))
        labels.append((k, 1, int(k % 3 == 0)))
    model = toxicity.train(make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    new = [(2000, "w1 w2 w3 neuerwicht w7 w8", "s", 0, "x"), (2001, "w1 w2 w3 w7 w8", "s", 0, "x")]
    out = {r["doc_id"]: r for r in toxicity.score(make(spark, new), model).collect()}
    assert out[2000]["score"] > 10 * out[2001]["score"]
    assert out[2000]["toxic_tokens"] > 5 * out[2001]["toxic_tokens"]


def test_passages(spark):
    rng = random.Random(3)
    sentence = lambda: words(rng, rng.randint(8, 14)) + "."
    passage = " ".join(sentence() for _ in range(6))
    rows = [(k, " ".join(sentence() for _ in range(8)), "s", 0, "x") for k in range(30)]
    for k in (5, 12, 20):
        a = rows[k][1].split()
        rows[k] = (k, " ".join(a[:17]) + " " + passage + " " + " ".join(a[17:]), "s", 0, "x")
    rows += [(40, None, "s", 0, "x"), (41, "", "s", 0, "x"), (None, "short", "s", 0, "x")]
    out = {r["doc_id"]: r for r in passages.find_repeats(make(spark, rows)).collect()}
    assert set(out) == {12, 20}
    for k in (12, 20):
        gone = "".join(rows[k][1][x["start"] : x["end"]] for x in out[k]["spans"])
        assert len(gone) > 0.5 * len(passage)
    assert passages.find_repeats(make(spark, [])).count() == 0


def test_extract(spark):
    page = '<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><ul><li>Home</ul></nav><div class="ad">buy</div>{}<footer>&copy; x</footer></body></html>'
    rows = [(k, f"http://h/{k}", page.format(f"<article><h1>T{k} &amp; co</h1><p><b>one\n two<br><p>three &eacute;</article>"), "c") for k in range(3)]
    rows += [(10 + k, f"http://g/{k}", f"<body><div>Same words here</div><div>Text {k}</div></body>", "c") for k in range(4)] + [(20, None, None, "c"), (21, None, "plain &lt;b", "c")]
    out = {r["page_id"]: r for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert out[1]["text"] == "T1 & co\n\none two\n\nthree é" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[12]["text"] == "Text 2" and out[20]["text"] == "" and out[21]["text"] == html.unescape("plain &lt;b")


def test_language(spark):
    rng = random.Random(6)
    vocab = {"aa": ["akka", "pakka", "lakka", "makka"], "bb": ["troll", "grolle", "stroll", "drolle"]}
    docs = [(k, " ".join(rng.choices(vocab[x], k=20)), x) for k in range(40) for x in [("aa", "bb")[k % 2]]]
    model = language.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    pages = [(k, f"http://h{k % 2}.x.com/{k}", f'<html lang="{x}"><p>{" ".join(rng.choices(vocab[x], k=9))}', "q") for k in range(20) for x in [("aa", "bb")[k % 2]]]
    pages += [(30, "http://h1.x.com/z", None, "q"), (31, None, "", "q")]
    out = {r["page_id"]: r for r in language.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string, lang string"), model).collect()}
    assert all(out[k]["lang"] == ("aa", "bb")[k % 2] for k in range(20)) and out[30]["lang"] == "bb" and 0 < out[31]["posterior"] <= 1


def test_passages_tell_rows_with_one_doc_id_apart(spark):
    """Copies with the same doc_id or none go but for one; other texts of that doc_id keep their own spans."""
    rng = random.Random(77)
    a, b, c = (words(rng, 40) for _ in range(3))
    rows = [(1, a), (1, a), (1, a + "\n" + b), (2, b), (2, c), (None, c), (None, c), (None, None), (None, "")]
    got = collections.Counter()
    for r in passages.find_repeats(make(spark, [(k, t, "s", 0, "x") for k, t in rows])).collect():
        got[r["doc_id"], r["text_hash"], r["n_removed"], tuple((s["start"], s["end"]) for s in r["spans"])] += 1
    key = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in {t for _, t in rows if t}], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    left = collections.Counter()
    for k, t in rows:
        if t:
            left[k, key[t]] += 1
    # of each line, by (doc_id, text_hash), the first occurrence stays
    want = collections.Counter()
    seen = set()
    for k, t in sorted(((k, t) for k, t in rows if t), key=lambda r: (r[0] is None, r[0] or 0, key[r[1]])):
        spans, at = [], 0
        for line in t.split("\n"):
            if line in seen:
                spans.append((at, at + len(line)))
            seen.add(line)
            at += len(line) + 1
        if spans:
            want[k, key[t], sum(y - x for x, y in spans), tuple(spans)] += 1
    assert got == want and all(n <= left[k[:2]] for k, n in got.items())


def test_passages_do_not_depend_on_the_partitioning(spark):
    rng = random.Random(13)
    sentence = lambda: words(rng, rng.randint(8, 14)) + "."
    texts = [" ".join(sentence() for _ in range(12)) for _ in range(12)]
    near = [t.replace(" " + t.split()[40] + " ", " changed ", 1) for t in texts[:6]]
    rows = [(k, t, "s", 0, "x") for k, t in enumerate(texts + near)] + [(None, texts[2], "s", 0, "x"), (-1, texts[3], "s", 0, "x"), (-1, texts[3], "s", 0, "x")]
    # labels of a paragraph are given again only for a smaller id, so both orders of ids count
    key = lambda r: (r["doc_id"] is None, r["doc_id"], str(r["spans"]))
    found = [sorted(passages.find_repeats(make(spark, x).repartition(n, "doc_id")).collect(), key=key) for n, x in ((1, rows), (5, rows[::-1]))]
    assert found[0] == found[1]
    # of the two equal rows of document -1 one stays
    assert {r["doc_id"] for r in found[0]} == {-1, None, 3, *range(12, 18)} and sum(r["doc_id"] == -1 for r in found[0]) == 1


def test_each_run_of_50_words_holds_a_paragraph(spark):
    rng = random.Random(17)
    short = lambda n: " ".join(w + rng.choice(["!", ".", ",!!"]) for w in words(rng, n).split())
    # one-word pieces, decimals, sentences of 45 words, one word over and over
    runs = [short(50), " ".join(f"{rng.randint(0, 99)}.{rng.randint(0, 99)}" for _ in range(25)), f"{words(rng, 5)}. {words(rng, 45)}", f"{words(rng, 22)}. {words(rng, 28)}", " ".join(["so"] * 50)]
    rows = []
    for k, run in enumerate(runs):
        rows.append((k, f"{words(rng, 9)}. {words(rng, 33)} {run} {words(rng, 60)}", "s", 0, "x"))
        rows.append((20 + k, f"{short(31)} {run} {words(rng, 3)}. {short(70)}", "s", 0, "x"))
    out = {r["doc_id"]: r for r in passages.find_repeats(make(spark, rows)).collect()}
    assert set(out) == {4, *(20 + k for k in range(len(runs)))}  # 4 says one word over and over
    # near copies of a text of one-word pieces
    text = short(120).split()
    near = [(k, " ".join(text[:60] + ["other."] * k + text[60 + k :]), "s", 0, "x") for k in range(2)]
    assert [r["doc_id"] for r in passages.find_repeats(make(spark, near)).collect()] == [1]


def test_template_alone_decides(spark):
    """No article, no telling class names: what stands in the same place of all pages goes, the rest stays."""
    rng = random.Random(31)
    rows, want = [], {}
    for k in range(6):
        menu = "".join(f"<li>{x}" for x in ("Home", "News", "About"))
        body = [words(rng, rng.randint(5, 20)) for _ in range(rng.randint(1, 4))]
        extra = "<div>We use biscuits</div>" if k % 3 else ""
        rows.append((k, f"http://h/{k}", f"<body><div><ul>{menu}</ul></div>{extra}<div>{''.join(f'<p>{x}</p>' for x in body)}</div><div>All rights</div></body>"))
        want[k] = "\n\n".join(body)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in extract.extract(df).collect()} == want
    # one page of the same host alone has no template
    assert "Home" in extract.extract(df.where("page_id = 1")).first()["text"]
    assert extract.extract(df.limit(0)).count() == 0


def test_template_classes_by_brute_force(spark):
    rng = random.Random(33)
    pages = []
    for k in range(8):
        parts = ["<body>"] + [f"<div class=c{j}>{'fixed ' + str(j) if rng.random() < 0.8 else words(rng, 3)}</div>" for j in range(5)] + ["<p>row</p>" * (k % 3)]
        pages.append("".join(parts))
    df = spark.createDataFrame([("h", p) for p in pages + pages[:3]], "host string, html string")
    got = {frozenset(c) for r in extract.templates(df).collect() for c in r["template"]}
    vectors, size = collections.defaultdict(dict), {}
    for k, p in enumerate(dict.fromkeys(pages)):
        for path, _, _, text in extract.blocks(p):
            t = extract.token(path, text)
            vectors[t][k] = vectors[t].get(k, 0) + 1
            size[t] = max(1, len((text or '').split()))
    classes = collections.defaultdict(set)
    for t, v in vectors.items():
        if len(v) >= 3 and len(v) >= 0.5 * len(set(pages)):
            classes[tuple(sorted(v.items()))].add(t)
    assert got == {frozenset(c) for c in classes.values() if sum(size[t] for t in c) > 1}


def test_slots_nest():
    # class 1 2 3 frames the page; class 7 8 nests twice in its second gap; class 4 5 is out of order
    slot, fixed = extract.slots([1, 9, 2, 7, 10, 8, 7, 11, 8, 3, 5, 4], [[1, 2, 3], [7, 8], [5, 4], [6, 12]])
    assert fixed == {0, 2, 3, 5, 6, 8, 9, 10, 11} and slot[1] not in (slot[4], slot[7], 0) and slot[4] != slot[7]
    assert extract.slots([1, 2, 2, 1], [[1, 2]])[1] == set()


def test_near_copies_within_one_document_go(spark):
    rng = random.Random(21)
    sentence = words(rng, 38).split()
    text = f"{words(rng, 30)}. {' '.join(sentence)}. {words(rng, 30)}. {' '.join(sentence[:-1])} other. {words(rng, 9)}."
    out = passages.find_repeats(make(spark, [(1, text, "s", 0, "x"), (2, words(rng, 60), "s", 0, "x")])).collect()
    assert [r["doc_id"] for r in out] == [1]
    first = text.index(" ".join(sentence))
    assert all(x["start"] >= first + len(" ".join(sentence)) for x in out[0]["spans"])


def test_passages_against_all_pairs_of_paragraphs(spark):
    """Removed are all paragraphs equal or similar (0.8) to an earlier one, and nothing else."""
    rng = random.Random(23)
    lines_ = [words(rng, rng.randint(60, 90)) for _ in range(40)]
    for k in range(0, 40, 2):  # a near copy: one to three words changed in a row, or two apart
        w = lines_[k].split()
        at = rng.randint(0, len(w) - 20)
        for j in rng.choice([(0,), (0, 1, 2), (0, 9, 18)]):
            w[at + j] = "changed"
        lines_.append(" ".join(w))
    rng.shuffle(lines_)
    rows = [(k, "\n".join(lines_[5 * k : 5 * k + 5]), "s", 0, "x") for k in range(12)]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (x.split() for x in lines_)]
    twin = {b for b in range(60) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = {r["doc_id"]: r["spans"] for r in passages.find_repeats(make(spark, rows)).collect()}
    gone = set()
    for b in range(60):
        text = rows[b // 5][1]
        at = len("\n".join(lines_[b - b % 5 : b])) + (b % 5 > 0)
        if any(x["start"] <= at and x["end"] >= at + len(lines_[b]) for x in found.get(b // 5, [])):
            gone.add(b)
    assert gone == twin and 5 <= len(twin) < 20


def test_copies_of_a_page_are_one_page_of_evidence(spark):
    page = "<body><div>Menu of h</div><div>{}</div></body>"
    rows = [(k, f"http://h/{k}", page.format("One story"), "c") for k in range(4)] + [(10 + k, f"http://h/{10 + k}", page.format(f"Story {k}"), "c") for k in range(3)]
    out = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert out == {**{k: "One story" for k in range(4)}, **{10 + k: f"Story {k}" for k in range(3)}}


def test_words_of_class_names_only_choose_between_slots():
    text = lambda page: extract.main_text(page, None)
    assert text('<article><h1>T</h1><section class="login-howto">How to log in</section></article>') == "T\n\nHow to log in"
    assert text('<div class="search-results">Only content</div>') == "Only content"
    assert text('<div class="ad-slot">Alone</div>') == "Alone"
    assert text('<div class="post"><p>Words</div><div class="ad-slot">buy</div><div id="login-box">name</div>') == "Words"
    assert text('<article><p>Story<section class="comments"><p>me too</section></article>') == "Story"
    assert text('<form><input><main><p>Within</main><p>name</form>') == "Within"
    # with an empty template a page is one slot
    assert extract.main_text('<div class="post">Words</div><div class="ad-slot">buy</div>', []) == "Words\n\nbuy"


def test_very_deep_and_broken_pages_take_linear_work():
    begin = time.process_time()
    assert extract.main_text("<div>" * 64_000 + "deep", None) == "deep"
    assert len(extract.main_text("<b>" * 20_000 + "<p>x" * 20_000, None).split()) == 20_000
    for tail in ("<a " * 100_000, '<p title="' * 100_000):
        assert extract.main_text(f"<p>Words</p>{tail}", None).startswith("Words")
    assert time.process_time() - begin < 20


def test_extract_against_building_the_page(spark):
    """Pages of three hosts put together from known parts: the text is the parts that differ and are no furniture."""
    rng = random.Random(41)
    rows, want = [], {}
    for k in range(30):
        host, kind = f"h{k % 3}", k % 3
        body = [words(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 5))]
        ad, said = words(rng, 9), [words(rng, 12) for _ in range(rng.randint(0, 3))]
        paragraphs = "".join(f"<p>{x}</p>" for x in body)
        said = '<section class="comments">' + "".join(f"<p>{x}" for x in said) + "</section>"
        if kind == 0:
            page = f"<body><nav>{ad}</nav><article>{paragraphs}{said}</article><div class=ad>{ad}</div></body>"
        elif kind == 1:
            page = f"<body><div><ul><li>Home<li>News</ul></div><div class=main-story>{paragraphs}</div>{said}<div>All rights reserved</div></body>"
        else:
            page = f"<body><table><tr><td>Home<td>About us<tr><td>{paragraphs}</table><div role=complementary>{ad}</div></body>"
        rows.append((k, f"http://{host}/{k}", page))
        want[k] = "\n\n".join(body)
    got = {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_passages_of_several_groups_are_compared_in_each(spark):
    """A paragraph that shares labels with several others, which share none, meets each of them; other columns are ignored."""
    rng = random.Random(29)
    w = words(rng, 60).split()
    rows = [(1, " ".join(w)), (2, " ".join(["other", *w[1:]])), (3, " ".join([*w[:-1], "other"])), (4, words(rng, 60))]
    docs = make(spark, [(k, t, "s", 0, "x") for k, t in rows])
    out = {r["doc_id"]: r["n_removed"] for r in passages.find_repeats(docs, block=1).collect()}
    assert out == {k: len(rows[k - 1][1]) for k in (2, 3)}
