"""Exact top-k search by inner product: dual-tree search over cover trees of queries and data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigflow.llm.common import cut

LEAF, FAN = 64, 8


class CoverTree:
    """Nested centres with covering radii. The children of a node are centres picked farthest first, the node's own
    among them, so they stand as far apart as their covering radius; each point belongs to its nearest centre."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.center, self.radius, self.kids, self.rows = [], [], [], []
        if len(points):
            self.root = self._node(np.arange(len(points)), 0)

    def _node(self, rows: np.ndarray, center: int) -> int:
        p = self.points
        dist = np.sqrt(((p[rows] - p[center]) ** 2).sum(axis=1))
        me = len(self.center)
        self.center.append(center)
        self.radius.append(float(dist.max()) * (1 + 1e-9))
        self.kids.append([])
        self.rows.append(rows)
        if len(rows) > LEAF and dist.max() > 0:
            near, best, picked = np.zeros(len(rows), dtype=np.int64), dist.copy(), [center]
            while len(picked) < FAN and best.max() > 0:
                far = int(rows[best.argmax()])
                d = np.sqrt(((p[rows] - p[far]) ** 2).sum(axis=1))
                near[d < best] = len(picked)
                best = np.minimum(best, d)
                picked.append(far)
            self.kids[me] = [self._node(rows[near == k], c) for k, c in enumerate(picked) if (near == k).any()]
        return me


def dual_search(queries: np.ndarray, query_ids: np.ndarray, worst: np.ndarray, data: CoverTree, data_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(place in queries, vec_id, score) of each query's k best in data, none below `worst`, the query's kth score so far.

    A pair of nodes is left out when even the largest product of points within their radii stays below the least
    kth score of the query node's members.
    """
    tree, x = CoverTree(queries), data.points
    best = np.full((len(queries), k), -np.inf)
    kth = worst.astype(np.float64).copy()
    qn, xn = np.sqrt((queries**2).sum(axis=1)), np.sqrt((x**2).sum(axis=1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def most(a: int, b: int) -> float:
        q, d, r, s = tree.center[a], data.center[b], tree.radius[a], data.radius[b]
        v = float(queries[q] @ x[d]) + qn[q] * s + xn[d] * r + r * s
        return v + 1e-6 * abs(v) + 1e-6

    stack = [(most(tree.root, data.root), tree.root, data.root)]
    while stack:
        bound, a, b = stack.pop()
        rows = tree.rows[a]
        if bound < kth[rows].min():
            continue
        if not tree.kids[a] and not data.kids[b]:
            for c in range(0, len(data.rows[b]), 4096):
                cols = data.rows[b][c : c + 4096]
                score = queries[rows] @ x[cols].T
                score[query_ids[rows][:, None] == data_ids[cols][None, :]] = -np.inf
                i, j = np.nonzero((score >= kth[rows][:, None]) & np.isfinite(score))
                if len(i):
                    found.append((rows[i], data_ids[cols[j]], score[i, j]))
                    both = np.concatenate([best[rows], score], axis=1)
                    best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                    kth[rows] = np.maximum(kth[rows], best[rows].min(axis=1))
            continue
        if data.kids[b] and (not tree.kids[a] or data.radius[b] >= tree.radius[a]):
            pairs = [(a, c) for c in data.kids[b]]
        else:
            pairs = [(c, b) for c in tree.kids[a]]
        stack += sorted((most(*p), *p) for p in pairs)
    if not found:
        return []
    q, v, s = (np.concatenate(c) for c in zip(*found))
    keep = s >= kth[q]
    q, v, s = q[keep], v[keep], s[keep]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    top = rank < k
    return list(zip(q[top].tolist(), v[top].tolist(), s[top].astype(np.int64).tolist()))


def matrix(vectors: list[list[int]], wide: int) -> np.ndarray:
    """Rows of equal length, shorter vectors filled with zeros."""
    out = np.zeros((len(vectors), wide))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _assign(centers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = matrix(batch.column(1).to_pylist(), centers.shape[1])
            d2 = (p**2).sum(axis=1)[:, None] - 2 * p @ centers.T + (centers**2).sum(axis=1)
            node = d2.argmin(axis=1)
            dist = np.sqrt(((p - centers[node]) ** 2).sum(axis=1)) if len(p) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int32()), pa.array(dist, pa.float64())], names=["vec_id", "v", "node", "dist"])

    return run


def _search(k: int, wide: int):
    """Rows come sorted by block, its data first: the data's tree is built once, queries stream against it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, tree, tree_ids = None, [], [], None, None
        pending: list[tuple[int, list[int], float, int]] = []
        out: list[tuple[int, int, int, int]] = []

        def ask() -> None:
            nonlocal tree, tree_ids
            if pending and ids:
                if tree is None:
                    tree, tree_ids = CoverTree(matrix(vectors, wide)), np.array(ids, dtype=np.int64)
                qs = matrix([p[1] for p in pending], wide)
                hits = dual_search(qs, np.array([p[0] for p in pending], dtype=np.int64), np.array([p[2] for p in pending]), tree, tree_ids, k)
                out.extend((pending[q][0], pending[q][3], v, s) for q, v, s in hits)
            pending.clear()

        for batch in batches:
            for block, asks, vec_id, v, worst, copy in zip(*(c.to_pylist() for c in batch.columns)):
                if block != key:
                    ask()
                    key, ids, vectors, tree = block, [], [], None
                if asks:
                    pending.append((vec_id, v, worst, copy))
                    if len(pending) >= 2048:
                        ask()
                else:
                    ids.append(vec_id)
                    vectors.append(v)
            if len(out) > 20_000:
                yield _found(out)
                out.clear()
        ask()
        yield _found(out)

    return run


def _found(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "copy", "vec_id", "score"])


FOUND = "query_id long, copy long, vec_id long, score long"


def search(vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024, centers: int = 64, sample: int = 2048, block: int = 8192, group: int = 512) -> DataFrame:
    """Each query's k best vectors: query_id, rank, vec_id, score, copy; exact, ties to the smaller vec_id.

    Components become floor(scale * x); the score is the integer inner product. The top of the cover tree is up to
    `centers` centres, picked farthest first from at most `sample` vectors of least hash; all rows are assigned and
    searched. A node's rows are dealt into blocks of about `block` rows, each with a cover tree of its own. Queries
    of a node form groups of about `group`. A first round against one block of the own node gives every query a kth
    score; a group then meets only the nodes that its bound (product of centres and both radii) leaves open, and
    the trees prune within.

    Vectors that are null or hold null, NaN or infinite components take no part. A query never finds rows of its own
    vec_id. Rows without vec_id take no part. Shorter vectors count as filled with zeros. Repeated rows are
    separate candidates; a repeated query asks once, and different vectors of one vec_id ask each for itself, numbered
    from 0 in copy by their components. Fewer than k candidates: all of them. Empty tables: no rows.
    Products must stay below 2^53 (components below 2^23 at 64 dimensions). Other columns are ignored.
    """
    spark = vectors.sparkSession

    def prepared(df: DataFrame) -> DataFrame:
        x = F.col(vector)
        fit = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) != float("inf")))
        return df.where(x.isNotNull() & fit & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))

    data = prepared(vectors)
    wide = data.agg(F.max(F.size("v"))).first()[0] or 0
    if not wide:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, copy long")
    seeds = matrix([r["v"] for r in data.orderBy(F.xxhash64("v"), "vec_id").limit(sample).collect()], wide)
    picked, best = [0], np.sqrt(((seeds - seeds[0]) ** 2).sum(axis=1))
    while len(picked) < centers and best.max() > 0:
        picked.append(int(best.argmax()))
        best = np.minimum(best, np.sqrt(((seeds - seeds[picked[-1]]) ** 2).sum(axis=1)))
    middle = seeds[picked]
    kinds = "vec_id long, v array<bigint>, node int, dist double"
    data = cut(data.mapInArrow(_assign(middle), kinds))
    asked = prepared(queries).dropDuplicates(["vec_id", "v"]).mapInArrow(_assign(middle), kinds)
    asked = cut(asked.withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")).cast("long") - 1))
    nodes = {r["node"]: r for r in data.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).collect()}
    in_node = {r["node"]: r["n"] for r in asked.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = F.create_map(*[F.lit(x) for n, r in nodes.items() for x in (n, -(-r["n"] // block))])
    groups = F.create_map(*[F.lit(x) for n, c in in_node.items() for x in (n, -(-c // group))]) if in_node else F.create_map(F.lit(-1), F.lit(1))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), n)
    data = data.select(F.struct("node", deal(parts[F.col("node")]).cast("int").alias("part")).alias("block"), "vec_id", "v")
    asked = asked.withColumn("grp", deal(groups[F.col("node")]).cast("int"))

    def met(asks: DataFrame) -> DataFrame:
        both = data.select("block", F.lit(False).alias("asks"), "vec_id", "v", F.lit(0.0).alias("worst"), F.lit(0).cast("long").alias("copy"))
        both = both.union(asks.select("block", F.lit(True), "vec_id", "v", "worst", "copy"))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return both.repartition(n, "block").sortWithinPartitions("block", "asks", "vec_id").mapInArrow(_search(k, wide), FOUND)

    home = asked.where(parts[F.col("node")].isNotNull()).withColumn("block", F.struct("node", F.pmod(F.xxhash64("vec_id"), parts[F.col("node")]).cast("int").alias("part"))).withColumn("worst", F.lit(float("-inf")))
    first = met(home).groupBy("query_id", "copy").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") >= k)
    asked = cut(asked.join(first.select(F.col("query_id").alias("vec_id"), "copy", F.col("low").cast("double").alias("worst")), ["vec_id", "copy"], "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf")))))
    norms = np.sqrt((middle**2).sum(axis=1))
    spread = asked.groupBy("node", "grp").agg(F.min("worst").alias("least"), F.max("dist").alias("reach"))
    # the open nodes of a group: centres' products and radii against the group's worst kth score
    open_ = None
    products = middle @ middle.T
    table = [(int(a), int(b), float(products[a, b] + norms[a] * nodes[b]["radius"]), float(norms[b] + nodes[b]["radius"]), -(-nodes[b]["n"] // block)) for a in in_node for b in nodes]
    bounds = spark.createDataFrame(table, "node int, other int, fixed double, slope double, parts int")
    open_ = spread.join(F.broadcast(bounds), "node").where((F.col("fixed") + F.col("slope") * F.col("reach")) * (1 + 1e-9) + 1 >= F.col("least"))
    open_ = open_.select("node", "grp", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.col("other").alias("node"), p.cast("int").alias("part")))).alias("block"))
    found = met(asked.join(open_, ["node", "grp"]).select("block", "vec_id", "v", "worst", "copy"))
    w = Window.partitionBy("query_id", "copy").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "copy")
