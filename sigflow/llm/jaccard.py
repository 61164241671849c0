"""N-gram Jaccard join: MinHash LSH forest for candidates, exact verification, one class per document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigflow.llm.common import Words, components, cut, in_groups, internal, mix64, shingle_hashes, split_by

FEATURES = "set_key binary, u long, n long, labels array<struct<hi: bigint, lo: bigint>>"
LABEL = pa.struct([("hi", pa.int64()), ("lo", pa.int64())])
#: Minima in a label: the first half, hashed, is a trie's top node; the others, 16 bits of each, are the path below it.
TOP, LONGEST = 4, 8


def forest_recall(similarity: float, trees: int, depth: int) -> float:
    """Chance that two sets of this similarity share a prefix of this depth in one of the trees at least."""
    return 1 - (1 - similarity**depth) ** trees


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(out, (shingles[k : k + 4096, None] * factors).min(axis=0), out=out)
    return out


def labels_of(minima: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) per tree: hi stands for the tree and its label's first minima, lo sorts labels by the ones after."""
    hi, lo = salt.copy(), np.zeros(len(salt), dtype=np.uint64)
    for k in range(TOP):
        hi = mix64(hi ^ minima[:, k])
    for k in range(TOP, LONGEST):
        lo = (lo << np.uint64(16)) | (mix64(minima[:, k]) >> np.uint64(48))
    return hi.view(np.int64), lo.view(np.int64)


def _features(trees: int, width: int, most: int = 50_000):
    """Set key, size and labels of each text. Copies of a set that a task has just seen have no labels."""
    rng = np.random.default_rng(7)
    factors = rng.integers(1, 1 << 63, trees * LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = mix64(np.arange(1, trees + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            names = batch.schema.names[:-1] + ["set_key", "u", "n", "labels"]
            at = 0
            for texts in in_groups(batch.column(batch.num_columns - 1)):
                keys, sizes, has, his, los = [], [], [], [], []
                words = Words(texts)
                for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                    s = shingle_hashes(words.ids[a:b], width)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sizes.append(len(s))
                    has.append(len(s) > 0 and keys[-1] not in seen)
                    if not has[-1]:
                        continue
                    if len(seen) >= most:
                        seen.clear()
                    seen.add(keys[-1])
                    hi, lo = labels_of(signature(s, factors).reshape(trees, LONGEST), salt)
                    his.append(hi)
                    los.append(lo)
                offsets = pa.array(np.concatenate([[0], np.cumsum(has) * trees]).astype(np.int32), mask=np.append(~np.array(has), False))
                none = [np.empty(0, dtype=np.int64)]
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(his or none)), pa.array(np.concatenate(los or none))], fields=list(LABEL))
                cols = [batch.column(k).slice(at, len(texts)) for k in range(batch.num_columns - 1)]
                at += len(texts)
                u = np.frombuffer(b"".join(keys), dtype=np.int64)[::2]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(keys, pa.binary()), pa.array(u), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], names=names)

    return run


def _shingles(width: int, most: int = 50_000):
    """Set key and shingles of each text; what a task has just seen is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for texts in in_groups(batch.column(0)):
                keys, sets = [], []
                words = Words(texts)
                for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                    raw = shingle_hashes(words.ids[a:b], width).tobytes()
                    key = xxhash.xxh3_128_digest(raw)
                    if raw and key not in seen:
                        if len(seen) >= most:
                            seen.clear()
                        seen.add(key)
                        keys.append(key)
                        sets.append(raw)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["set_key", "shingles"])

    return run


def _links(groups: list, threshold: float) -> tuple[list, list]:
    """Verified links of one group of sets. groups: (key, n, weight, block, shingles), all of one task.

    Returns per set the documents it links to, and the edges of a spanning forest only; pairs are counted in
    blocks of a matrix product and never listed. Two blocks: only pairs across count; one block: all pairs.
    """
    m = len(groups)
    sets = [np.frombuffer(g[4], dtype=np.uint64) for g in groups]
    n = np.array([g[1] for g in groups], dtype=np.float64)
    weight = np.array([g[2] for g in groups], dtype=np.float64)
    block = np.array([g[3] for g in groups])
    if m == 2:
        common = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))]] * 2, dtype=np.float64)
        common[1] = common[0][::-1]
    else:
        flat = np.concatenate(sets)
        row = np.repeat(np.arange(m), [len(s) for s in sets])
        _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count > 1
        place = np.cumsum(shared) - 1
        row, col = row[shared[col]], place[col[shared[col]]]
        common, wide = np.zeros((m, m)), 4096
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        cuts = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + wide, wide))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                dense = np.zeros((m, wide), dtype=np.float32)
                dense[row[a:b], col[a:b] % wide] = 1
                common += dense @ dense.T
    linked = common >= threshold * (n[:, None] + n[None, :] - common) - 1e-9
    if len(np.unique(block)) > 1:
        linked &= block[:, None] != block[None, :]
    np.fill_diagonal(linked, False)
    degree = linked @ weight
    root, forest = np.arange(m), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left = linked.copy()
    for i in range(m):  # a breadth-first walk: every set is reached once
        if root[i] != i:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            for k in np.flatnonzero(left[j]):
                if find(k) != find(i):
                    root[find(k)] = find(i)
                    forest.append((j, int(k)))
                    stack.append(int(k))
            left[:, j] = False
    return degree.tolist(), forest


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        out: list[tuple] = []

        def flush() -> None:
            if len(held) > 1:
                degree, forest = _links(held, threshold)
                out.extend((held[k][0], None, int(d)) for k, d in enumerate(degree) if d)
                out.extend((held[a][0], held[b][0], 0) for a, b in forest)
            held.clear()

        def table() -> pa.RecordBatch:
            cols = list(zip(*out)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], names=["u", "v", "links"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for task, set_key, n, weight, block, shingles in zip(*cols):
                if task != key:
                    flush()
                    key = task
                held.append((set_key, n, weight, block, shingles))
            if len(out) > 5000:
                yield table()
                out.clear()
        flush()
        yield table()

    return run


def prefix_length(seen: list[float], threshold: float, trees: int, recall: float, at_threshold: float) -> int:
    """Shorten the prefixes matched, a level at a time, until the recall is reached.

    The recall is that of pairs with the similarities `seen`, each weighted by 1 over its chance to share a top node, and one
    more at the threshold; besides, a pair at the threshold must be found with chance at_threshold at any rate. With none
    seen it is the recall of a pair at the threshold, which every pair above exceeds.
    """
    weights = np.array([1.0, *[1 / forest_recall(s, trees, TOP) for s in seen]])
    for depth in range(LONGEST, TOP, -1):
        chances = np.array([forest_recall(s, trees, depth) for s in (threshold, *seen)])
        if chances[0] >= at_threshold and (weights @ chances) / weights.sum() >= recall:
            return depth
    return TOP


def candidate_groups(sets: DataFrame, depth: int) -> DataFrame:
    """u, root: components over shared trie nodes of this depth, each node tied to its least member.

    sets: u, labels, repeats allowed. Labels are dealt and sorted by node, once.
    """
    nodes = sets.select("u", F.explode("labels").alias("label")).select("u", "label.hi", F.shiftrightunsigned("label.lo", 16 * (LONGEST - depth)).alias("path") if depth > TOP else F.lit(0).cast("long").alias("path"))
    least = F.min("u").over(Window.partitionBy("hi", "path"))
    return cut(components(nodes.select("u", least.alias("v")).where("u != v")))


def verify(of: DataFrame, shingles: DataFrame, threshold: float, block: int) -> DataFrame:
    """Exact links within candidate groups: of has root, set_key, n and weight, a row per set; shingles has set_key and
    shingles, and joins the sets when they are dealt already.

    Rows (u, null, links) count the documents that a set links to; rows (u, v, 0) are edges of spanning forests.
    """
    spark = of.sparkSession
    of = cut(of.withColumn("bin", F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")))
    bins = of.groupBy("root", "bin").agg(F.count(F.lit(1)).alias("k"))
    total = bins.groupBy("root").agg(F.sum("k").alias("all"), F.map_from_entries(F.collect_list(F.struct("bin", F.ceil(F.col("k") / block).cast("int")))).alias("parts"))
    placed = of.join(total, "root").where("all > 1")
    parts = lambda b: F.coalesce(F.try_element_at("parts", b), F.lit(0))
    own = F.pmod(F.xxhash64("set_key"), parts(F.col("bin"))).cast("int")
    large = placed.where(F.col("all") > block).withColumn("part", own)

    def others(shift: int):
        """The blocks of a neighbouring bin (sizes in bins further off cannot reach the threshold)."""
        b = F.col("bin") + shift
        return F.transform(F.when(parts(b) > 0, F.sequence(F.lit(0), parts(b) - 1)).otherwise(F.array().cast("array<int>")), lambda p: F.struct(b.alias("b"), p.alias("p")))

    me = F.struct(F.col("bin").alias("b"), F.col("part").alias("p"))
    mates = F.concat(others(-1), others(0), others(1))
    large = large.withColumn("mate", F.explode(mates)).withColumn("me", me)
    task = F.xxhash64("root", F.least("me", "mate"), F.greatest("me", "mate"))
    large = large.select(task.alias("task"), "set_key", "n", "weight", F.xxhash64("me").alias("block"))
    small = placed.where(F.col("all") <= block).select(F.xxhash64("root").alias("task"), "set_key", "n", "weight", F.lit(0).cast("long").alias("block"))
    work = small.union(large).join(shingles, "set_key").select("task", "set_key", "n", "weight", "block", "shingles")
    work = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task")
    return cut(work.mapInArrow(_verify(threshold), "u binary, v binary, links long"))


def _classes(slim: DataFrame, threshold: float, width: int, trees: int, recall: float, at_threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(slim without text, with set_key and n; linked sets with root and links): slim has doc_id, ka (the text's hash), its own
    columns, and text last."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    feats = cut(slim.mapInArrow(_features(trees, width), f"{fields}, {FEATURES}"))
    full = feats.where("n > 0")
    depth = prefix_length([], threshold, trees, recall, at_threshold)
    group = candidate_groups(full.where("labels is not null").select("u", "labels"), depth)
    sets = cut(full.groupBy("set_key").agg(F.count(F.lit(1)).alias("weight"), F.first("u").alias("u"), F.first("n").alias("n"), F.min("ka").alias("ka")))
    # shingles are made again for one text of each candidate set; the others' are never kept
    of = cut(sets.join(group, "u").drop("u"))
    maybe, _ = split_by(slim.select("ka", "text"), "ka", of, "ka")
    shingles = maybe.select("text").mapInArrow(_shingles(width), "set_key binary, shingles binary").dropDuplicates(["set_key"])
    sets = sets.select("set_key", "weight")
    found = verify(of.drop("ka"), shingles, threshold, block)
    classes = components(found.where("v is not null").select("u", "v")).select(F.col("u").alias("set_key"), "root")
    degree = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "set_key")
    known = sets.join(classes, "set_key", "left").join(degree, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    known = known.select("set_key", "root", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links")).where("links > 0")
    return feats.drop("u", "labels"), cut(known)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, width: int = 5, trees: int = 24, recall: float = 0.999, at_threshold: float = 0.99, block: int = 256) -> DataFrame:
    """One row per document: its doc_id, class_id (least doc_id of its class) and n_links.

    Documents link when the Jaccard similarity of their sets of width-word shingles (lower case, runs of letters,
    digits and underscores) reaches threshold; classes are the components of the links, and n_links counts the
    other documents that one links to, copies included.

    Each set of shingles gets a label of eight minima in each of `trees` prefix tries. Sets that share a node are
    candidates. Nodes as deep as the labels come first; the prefixes are shortened level by level until a pair at the
    threshold, the hardest one to find, is found with a chance of `recall` and at_threshold (see prefix_length()). That
    depends on the parameters alone, so each pair has this chance at least, whatever the other pairs are like.
    Equal sets are one node with a weight. Sets that share nodes form candidate groups; groups above `block` sets are
    dealt into blocks by size, and block pairs that can reach the threshold are verified apart, so a group of any
    size is compared in full in tasks of bounded size.

    A text shorter than a shingle is one shingle. Empty and null texts have no shingle: no links, own class.
    A null doc_id takes part and has null as its own class if no member of its class has an id. Repeated rows are
    documents of their own that link to one another. An empty table gives an empty table; other columns are left
    alone.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("ka"), F.col(text).alias("text"))
    feats, known = _classes(slim, threshold, width, trees, recall, at_threshold, block)
    least = feats.groupBy("set_key").agg(F.min("doc_id").alias("least_id")).join(known, "set_key")
    named = cut(known.join(least.groupBy("root").agg(F.min("least_id").alias("class_id")), "root").select("set_key", "class_id", "links"))
    out = feats.select("doc_id", "set_key").join(named, "set_key", "left")
    linked = F.col("links").isNotNull()
    return out.select("doc_id", F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8, width: int = 5, trees: int = 24, recall: float = 0.999, at_threshold: float = 0.99, block: int = 256) -> DataFrame:
    """docs with one row of each class of near_duplicates() kept: that with the least doc_id (null last), of rows with
    the same id the one whose text has the least hash.

    Rows are told apart by id and text, so a text without near copies stays whatever else has its id. Empty and null
    texts are in no class and stay. Of repeated rows in a class one stays; an empty table gives an empty table;
    other columns pass through.
    """
    ids, ka, kb = (internal(docs, x) for x in ("_id", "_ka", "_kb"))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("ka"), F.hash(text).alias("kb"), F.col(text).alias("text"))
    feats, known = _classes(slim, threshold, width, trees, recall, at_threshold, block)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ka", "kb")
    rows = feats.groupBy("doc_id", "ka", "kb", "set_key").agg(F.count(F.lit(1)).alias("times")).join(known.select("set_key", "root"), "set_key")
    rows = cut(rows.withColumn("row", row))
    first = rows.groupBy("root").agg(F.min("row").alias("first"))
    rows = rows.join(first, "root").withColumn("stays", F.col("row") == F.col("first")).where("not stays or times > 1")
    rows = cut(rows.select(F.col("doc_id").alias(ids), F.col("ka").alias(ka), F.col("kb").alias(kb), "stays"))
    keyed = docs.withColumn(ka, F.xxhash64(text)).withColumn(kb, F.hash(text))
    maybe, alone = split_by(keyed, ka, rows, ka)
    stays = internal(keyed, "stays")
    rows = rows.select(ids, F.col(ka).alias("k1"), F.col(kb).alias("k2"), F.col("stays").alias(stays))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(ids)) & (F.col(ka) == F.col("k1")) & (F.col(kb) == F.col("k2"))
    judged = maybe.join(rows, same, "left")
    several = judged.where(F.col(stays)).dropDuplicates([doc_id, ka, kb])
    return judged.where(F.col(stays).isNull()).select(*docs.columns).union(several.select(*docs.columns)).union(alone.select(*docs.columns))
