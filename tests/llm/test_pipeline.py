"""The pipeline's stages, each on what the one before left, against straight computations."""

from __future__ import annotations

import collections
import random
import re


import corpus_pipeline
from sigflow.llm import mixing

WORDS = [f"w{k}" for k in range(500)]


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choices(WORDS, k=n))
    items = [(k, words(20) + ". " + words(12) + ".") for k in range(3)]
    rows = [[k, words(rng.randint(40, 90)), "en", f"s{k // 3 % 12}"] for k in range(240)]
    toxic = set(range(0, 240, 3))
    for k in toxic:
        rows[k][1] += " vile" + rng.choice(["", "ness", "ly"]) + " " + words(5)
    for k in range(1, 240, 3):
        rows[k][1] += "\nSubscribe to our news"  # on 12 sources
    copies = {2: 5, 8: 11, 14: 17}
    for a, b in copies.items():
        w = rows[a][1].split()
        rows[b][1] = " ".join([*w[:-1], "other"])
    leaks = {20: 0, 23: 1}
    for k, item in leaks.items():
        rows[k][1] = words(50) + " " + items[item][1] + " " + words(50)
    rows += [[300, None, "en", "s0"], [301, "", "en", None], list(rows[1])]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = [tuple(r) for r in rows if r[0] not in toxic]
    plain = lambda df: sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()), key=str)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if name == "line_dedup":
            want = [(a, t and t.replace("\nSubscribe to our news", ""), b, c) for a, t, b, c in want]
        elif name == "jaccard_join":
            want = [r for r in dict.fromkeys(want) if r[0] not in copies.values()]
        elif name == "decontaminate":
            want = [r for r in want if r[0] not in leaks]
        if name != "mix":
            assert plain(docs) == sorted(want, key=str), name
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = docs.collect()
    size = {r[0]: len(re.findall(r"\S+", r[1] or "")) for r in want}
    total, taken = collections.Counter(), collections.Counter()
    for a, _, _, source in want:
        total[source] += size[a]
    for r in got:
        taken[r["source"]] += size[r["doc_id"]]
    open_, target, left = set(total), {}, sum(total.values())
    weight = {x: (1, 2, 3)[k % 3] for k, x in enumerate(sorted(total, key=lambda x: (x is None, x or "")))}
    while open_:
        level = left / sum(weight[x] for x in open_)
        shut = {x for x in open_ if weight[x] * level >= 3 * total[x]}
        if not shut:
            target |= {x: weight[x] * level for x in open_}
            break
        for x in shut:
            target[x] = 3 * total[x]
            left -= target[x]
        open_ -= shut
    assert all(abs(taken[x] - target[x]) <= max(size.values()) for x in total)
    times = collections.Counter(r["doc_id"] for r in got)
    assert all(n <= 3 for n in times.values()) and sorted(r["copy"] for r in got if r["doc_id"] == 2) == list(range(1, times[2] + 1))
    assert mixing.mix(docs.limit(0)).count() == 0
