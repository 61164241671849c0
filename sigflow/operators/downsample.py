"""Downsampling, critical points and level-of-detail tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigflow.operators import cells, series
from sigflow.operators.rolling import extrema, limit_crossings, sudden_changes
from sigflow.operators.scratch import cut
from sigflow.operators.series import NUMBERED, numbered, with_row_index, with_totals


def _held(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What to do with a step's rows that several later ones read: rows of a large table are written, so that each step is
    done once."""
    return (lambda x: x) if cells.fits(df, cells.SMALL >> 4) else cut


def uniform(df: DataFrame, key: list[str], order: list[str], max_points: int, last: bool = False) -> DataFrame:
    """Every nth row, n = rows // max_points."""
    x = with_row_index(df, key, order, total="_n")
    step = F.greatest(F.floor(F.col("_n") / max_points), F.lit(1))
    keep = F.col("row_idx") % step == 0
    if last:
        keep |= F.col("row_idx") == F.col("_n") - 1
    return x.where(keep).drop("_n")


def _bucketed(df: DataFrame, key: list[str], order: list[str], buckets: int) -> DataFrame:
    x = with_row_index(df, key, order, total="_n")
    size = F.greatest(F.ceil(F.col("_n") / buckets), F.lit(1))
    return x.withColumn("bucket", F.floor(F.col("row_idx") / size)).drop("_n")


def minmax(df: DataFrame, key: list[str], order: list[str], t: str, v: str, buckets: int, low: float | None = None, high: float | None = None, first: bool = False) -> DataFrame:
    """Least and greatest value of each bucket in time order, one row where they meet; optionally the bucket's first
    row and its first row outside the limits. Ties go to the earlier row."""
    x = _bucketed(df, key, order, buckets)
    row = F.struct(F.col(v).alias("k"), F.col("row_idx"), F.col(t).alias("t"), F.col(v).alias("v"))
    neg = F.struct((-F.col(v)).alias("k"), F.col("row_idx"), F.col(t).alias("t"), F.col(v).alias("v"))
    seq = F.struct(F.col("row_idx").cast("double").alias("k"), F.col("row_idx"), F.col(t).alias("t"), F.col(v).alias("v"))
    picks = [F.min(row), F.min(neg)]
    if first:
        picks.append(F.min(seq))
    if low is not None or high is not None:
        bad = (F.col(v) < (low if low is not None else float("-inf"))) | (F.col(v) > (high if high is not None else float("inf")))
        picks.append(F.min(F.when(bad, seq)))
    g = x.groupBy(*key, "bucket").agg(*[p.alias(f"_p{k}") for k, p in enumerate(picks)])
    rows = F.array_distinct(F.transform(F.array_compact(F.array(*[f"_p{k}" for k in range(len(picks))])), lambda s: F.struct(s["row_idx"].alias("row_idx"), s["t"].alias("t"), s["v"].alias("v"))))
    return g.select(*key, "bucket", F.explode(F.array_sort(rows)).alias("s")).select(*key, "bucket", "s.row_idx", "s.t", "s.v")


def hull_rows(t: np.ndarray, v: np.ndarray, bucket: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Positions that hold the corners of each bucket's convex hull (buckets and t ascending), in order.

    Of rows with one time the first, the least and the greatest count, the earliest each, and of the bucket the first row
    and the first with NaN. Rows on or within the line of two others, so and so many places before and after, are left
    out, all at once, until a round leaves out hardly any; the rows kept beyond the corners change no pick.
    """
    bad = np.isnan(t) | np.isnan(v)
    keep = np.zeros(len(t), dtype=bool)
    for rows in (np.arange(len(t)), np.flatnonzero(bad)):
        keep[rows[np.unique(bucket[rows], return_index=True)[1]]] = True
    fine = np.flatnonzero(~bad)
    if not len(fine):
        return np.flatnonzero(keep)
    same = (bucket[fine][1:] == bucket[fine][:-1]) & (t[fine][1:] == t[fine][:-1])
    moment = np.concatenate([[0], np.cumsum(~same)])
    begins = np.flatnonzero(np.concatenate([[True], ~same]))
    edge = np.zeros(len(begins), dtype=bool)  # first and last time of a bucket
    of = bucket[fine][begins]
    edge[0] = edge[-1] = True
    edge[1:] |= of[1:] != of[:-1]
    edge[:-1] |= of[1:] != of[:-1]
    keep[fine[begins[edge]]] = True
    for sign in (1.0, -1.0):
        order = np.lexsort((np.arange(len(fine)), sign * v[fine], moment))  # least first: the lower chain, then the upper
        chain = fine[order[np.concatenate([[True], np.diff(moment[order]) > 0])]]
        keep[chain[edge]] = True
        for _ in range(rounds):
            before, reach = len(chain), 1
            while 2 * reach < len(chain):
                x, y, z = chain[: -2 * reach], chain[reach:-reach], chain[2 * reach :]
                with np.errstate(invalid="ignore", over="ignore"):
                    out = sign * ((t[y] - t[x]) * (v[z] - v[x]) - (v[y] - v[x]) * (t[z] - t[x])) <= 0
                chain = np.delete(chain, np.flatnonzero(out & (bucket[x] == bucket[z])) + reach)
                reach *= 2
            if len(chain) >= 0.999 * before:
                break
        keep[chain] = True
    return np.flatnonzero(keep)


def lttb_pick(bucket: np.ndarray, t: np.ndarray, v: np.ndarray, mean_t: np.ndarray, mean_v: np.ndarray, entry: tuple[float, float] | None = None) -> np.ndarray:
    """Largest-triangle pass: one position per bucket (numbered from 0), given the buckets' rows and means.

    entry is the point picked before, none at the start of a series; the means may go on beyond the rows by one bucket,
    else the series ends."""
    starts = np.searchsorted(bucket, np.arange(bucket[-1] + 1))
    stops = np.append(starts[1:], len(bucket))
    at, av = entry or (t[0], v[0])
    out = []
    for k, (a, b) in enumerate(zip(starts, stops)):
        if (k == 0 and entry is None) or k + 1 == len(mean_t):
            pick = a
        else:
            ct, cv = mean_t[k + 1], mean_v[k + 1]
            area = np.abs((at - ct) * (v[a:b] - av) - (at - t[a:b]) * (cv - av))
            pick = a + int(area.argmax())
        out.append(pick)
        at, av = t[pick], v[pick]
    return np.array(out)


def lttb_exits(bucket: np.ndarray, t: np.ndarray, v: np.ndarray, mean_t: np.ndarray, mean_v: np.ndarray, entry_t: np.ndarray, entry_v: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The last bucket's pick for each point that may have been picked before the first bucket. Walks that meet go on as one."""
    starts = np.searchsorted(bucket, np.arange(bucket[-1] + 1))
    stops = np.append(starts[1:], len(bucket))
    walk, at, av = np.arange(len(entry_t)), entry_t, entry_v
    for k, (a, b) in enumerate(zip(starts, stops)):
        if k + 1 == len(mean_t):
            picks = np.full(len(at), a)
        else:
            ct, cv = mean_t[k + 1], mean_v[k + 1]
            step = max(1, most // (b - a))
            picks = np.concatenate([a + np.abs((x - ct)[:, None] * (v[a:b] - y[:, None]) - (x[:, None] - t[a:b]) * (cv - y)[:, None]).argmax(axis=1) for x, y in ((at[c : c + step], av[c : c + step]) for c in range(0, len(at), step))])
        picks, to = np.unique(picks, return_inverse=True)
        walk, at, av = to[walk], t[picks], v[picks]
    return picks[walk]


def lttb(df: DataFrame, key: list[str], order: list[str], t: str, v: str, points: int, together: int = 4096) -> DataFrame:
    """Largest-triangle-three-buckets to `points` rows a series; shorter series pass whole.

    The triangle's area is linear in the candidate up to its sign, so only the hull of a bucket can win: buckets
    are reduced to their hulls in parallel, CHUNK rows of a series at a time. Ties of areas go to the earlier row (areas
    that differ by rounding alone are ties). Up to `together` points, the pass over a series' hulls is one task. For more,
    ranges of about sqrt(points) buckets work at once: each makes a map from every point that its predecessor may
    end with to the point it ends with itself, these few maps are composed along the series, and each range
    then picks from its known start.

    Null values are left out, and row_idx counts the others (with the order NUMBERED it is the rows' own); rows with NaN (time
    or value) win their bucket, the first of them, as comparisons would have it.
    """
    x, at = df.where(F.col(v).isNotNull()), F.col("row_idx")
    if order is not NUMBERED:
        x = with_row_index(x, key, order, total="_n")
    elif df.where(F.col(v).isNull()).isEmpty():
        x = with_totals(x, key, _n=F.count(F.lit(1)))
    else:
        x, at = with_row_index(x, key, order, "_i", total="_n"), F.col("_i")
    width = (F.col("_n") - 2) / F.lit(float(points - 2))
    inner = F.least(F.floor((at - 1) / width) + 1, F.lit(points - 2))
    bucket = F.when(at == 0, 0).when(at == F.col("_n") - 1, points - 1).otherwise(inner)
    x = x.withColumn("_b", F.when(F.col("_n") <= points, at).otherwise(bucket).cast("long")).select(*key, "row_idx", F.col(t).cast("double").alias("t"), F.col(v).cast("double").alias("v"), "_b")
    x = x.withColumn("_q", F.floor(F.col("row_idx") / series.CHUNK))
    kinds = "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in key)

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        t, v, b = (pdf[c].to_numpy() for c in ("t", "v", "_b"))
        starts = np.unique(b, return_index=True)[1]
        at = hull_rows(t, v, b)
        of = np.searchsorted(starts, at, side="right") - 1
        sums = {"_st": np.add.reduceat(t, starts), "_sv": np.add.reduceat(v, starts), "_rows": np.diff(np.append(starts, len(pdf)))}
        return pdf.iloc[at].assign(**{n: x[of] for n, x in sums.items()})

    hulls = x.groupBy(*key, "_q").applyInPandas(reduce, f"{kinds}row_idx long, t double, v double, _b long, _q long, _st double, _sv double, _rows long")
    size = int(np.ceil(np.sqrt(points))) if points > together else points + 1
    fields = ["row_idx", "t", "v"]

    def parted(pdf: pd.DataFrame) -> tuple:
        """A range's rows in order, its bucket numbers, the means (and the next bucket's), and the rows of the bucket before."""
        pdf = pdf.sort_values("row_idx")
        first = int(pdf["_g"].iloc[0]) * size
        before = pdf[pdf["_b"] < first]
        parts = pdf[pdf["_b"] >= first].drop_duplicates(["_b", "_q"])
        each = np.unique(parts["_b"].to_numpy(), return_index=True)[1]
        st, sv, n = (np.add.reduceat(parts[c].to_numpy(), each) if len(each) else np.zeros(0) for c in ("_st", "_sv", "_rows"))
        own = pdf[(pdf["_b"] >= first) & (pdf["_b"] < first + size)]
        return own, (own["_b"] - first).to_numpy(), st / n, sv / n, before

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        own, b, mt, mv, before = parted(pdf)
        if not len(own):
            return own[[*key, *fields]]
        start = before[before["row_idx"] == pdf["_start"].iloc[0]]
        entry = (start["t"].iloc[0], start["v"].iloc[0]) if len(start) else None
        return own.iloc[lttb_pick(b, own["t"].to_numpy(), own["v"].to_numpy(), mt, mv, entry)][[*key, *fields]]

    if points <= together:
        return hulls.withColumns({"_g": F.lit(0), "_start": F.lit(-1)}).groupBy(*key).applyInPandas(walk, f"{kinds}row_idx long, t double, v double")

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        own, b, mt, mv, before = parted(pdf)
        t, v, at = own["t"].to_numpy(), own["v"].to_numpy(), own["row_idx"].to_numpy()
        if not len(own):
            at, come = at[:0], at[:0]
        elif len(before):
            few = before.iloc[hull_rows(before["t"].to_numpy(), before["v"].to_numpy(), before["_b"].to_numpy())]
            come, at = few["row_idx"].to_numpy(), at[lttb_exits(b, t, v, mt, mv, few["t"].to_numpy(), few["v"].to_numpy())]
        else:
            come, at = np.array([-1]), at[lttb_pick(b, t, v, mt, mv)[-1:]]
        return pdf.iloc[np.zeros(len(come), dtype=int)][[*key, "_g"]].assign(_come=come, _go=at)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_g")
        maps: dict[int, dict[int, int]] = {}
        for g, come, go in zip(pdf["_g"], pdf["_come"], pdf["_go"]):
            maps.setdefault(g, {})[come] = go
        now, starts = -1, []
        for m in maps.values():
            starts.append(now)
            now = m[now]
        return pdf.drop_duplicates("_g")[[*key, "_g"]].assign(_start=starts)

    place = F.floor(F.col("_b") / size)
    also = [F.when(F.col("_b") % size == size - 1, place + 1), F.when((F.col("_b") % size == 0) & (place > 0), place - 1)]
    ranges = cut(hulls).withColumn("_g", F.explode(F.array_compact(F.array(place, *also))))
    maps = ranges.groupBy(*key, "_g").applyInPandas(ends, f"{kinds}_g long, _come long, _go long")
    starts = maps.groupBy(*key).applyInPandas(chain, f"{kinds}_g long, _start long")
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_g").alias("_at"), "_start")
    begun = ranges.join(starts, (F.col("_g") == F.col("_at")) & _null_safe(key))
    return begun.groupBy(*key, "_g").applyInPandas(walk, f"{kinds}row_idx long, t double, v double")


def _null_safe(key: list[str]) -> Column:
    """Equal keys, nulls included, beside a table whose key columns are named _k0, _k1, ..."""
    out = F.lit(True)
    for i, k in enumerate(key):
        out &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out


def _blocks(rows: DataFrame, key: list[str], fan: int, most: int, held: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """A pyramid over (row_idx, v): level 0 holds the rows of each block of `fan`, level k + 1 the bounds of level k's blocks."""
    names = [f"_k{i}" for i in range(len(key))]
    parts = rows.select(*[F.col(k).alias(n) for k, n in zip(key, names)], F.col("row_idx").alias("_p"), F.col("v").alias("_hi"), F.col("v").alias("_lo"))
    out: list[DataFrame] = []
    while True:
        inner = F.array_sort(F.collect_list(F.struct("_p", "_hi", "_lo")))
        out.append(held(parts.groupBy(*names, F.floor(F.col("_p") / fan).alias("_node")).agg(inner.alias("_parts"), F.max("_hi").alias("_max"), F.min("_lo").alias("_min"))))
        most = -(-most // fan)
        if most <= 1:
            return out
        parts = out[-1].select(*names, F.col("_node").alias("_p"), F.col("_max").alias("_hi"), F.col("_min").alias("_lo"))


def _look(asked: DataFrame, key: list[str], level: DataFrame, node: Column, near: Column) -> DataFrame:
    """Walk the parts of a block outwards from an extremum: _hit is the first one beyond its value (0: none), _low takes in
    the parts passed."""
    x = asked.withColumn("_at", node).join(level, (F.col("_at") == F.col("_node")) & _null_safe(key)).withColumn("_near", near)
    peak = F.col("_sign") > 0
    beyond = F.transform("_near", lambda e: F.when(peak, e["_hi"]).otherwise(-e["_lo"]) > F.col("_h"))
    x = x.withColumn("_hit", F.array_position(beyond, F.lit(True)))
    passed = F.when(F.col("_hit") > 0, F.slice("_near", F.lit(1), (F.col("_hit") - 1).cast("int"))).otherwise(F.col("_near"))
    lows = F.transform(passed, lambda e: F.when(peak, e["_lo"]).otherwise(-e["_hi"]))
    x = x.withColumn("_low", F.least("_low", F.array_min(lows))).withColumn("_n", F.size("_parts"))
    return x.select(*asked.columns, "_hit", "_n")


def with_prominence(df: DataFrame, key: list[str], order: list[str], v: str, w: int = 10, least_sigma: float | None = None, variant: str = "B", fan: int = 256) -> DataFrame:
    """Extrema with their prominence, those below least_sigma deviations (0.3 for B, 0.5 for A) left out.

    A side of a peak reaches to the first higher sample (of a valley: lower) or the end of the series. Variant B is the
    lesser of the two sides' depths, variant A the depth to the lowest point of both. Null and NaN values are no extrema
    and stop nothing; null keys are a series. Empty tables give no rows.

    No task holds a series: each extremum looks through its own block of `fan` rows, then through the bounds of the blocks
    around it, level by level, and goes down again into the one block that stops it.
    """
    value = F.col(v).cast("double")
    value = F.when(~F.isnan(value), value)
    held, df, order = _held(df), numbered(df, key, order, v), NUMBERED
    rows = df.select(*key, "row_idx", value.alias("v"))
    most = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    levels = _blocks(rows, key, fan, most, held)

    found = extrema(df, key, order, v, w).select(*key, "row_idx", value.alias("v"), "kind").where(F.col("v").isNotNull())
    found = held(found).withColumn("_sign", F.when(F.col("kind") == "peak", 1.0).otherwise(-1.0)).withColumn("_h", F.col("_sign") * F.col("v"))
    open_ = found.withColumn("_low", F.col("_h")).withColumn("_pos", F.col("row_idx")).withColumn("_side", F.explode(F.array(F.lit(-1), F.lit(1))))
    left = F.col("_side") < 0

    stopped: list[DataFrame] = []
    for level in levels:
        off = (F.col("_pos") % fan).cast("int")
        near = F.when(left, F.reverse(F.slice("_parts", F.lit(1), off))).otherwise(F.slice("_parts", off + 2, F.lit(fan)))
        x = held(_look(open_, key, level, F.floor(F.col("_pos") / fan), near))
        stopped.append(x.where("_hit > 0").withColumn("_pos", F.col("_pos") + F.col("_side") * F.col("_hit")).drop("_hit", "_n"))
        open_ = x.where("_hit = 0").withColumn("_pos", F.floor(F.col("_pos") / fan)).drop("_hit", "_n")
    inside = stopped[-1]
    for k in range(len(levels) - 1, 0, -1):
        x = _look(inside, key, levels[k - 1], F.col("_pos"), F.when(left, F.reverse("_parts")).otherwise(F.col("_parts")))
        at = F.col("_pos") * fan + F.when(left, F.col("_n") - F.col("_hit")).otherwise(F.col("_hit") - 1)
        inside = stopped[k - 1].unionByName(held(x.withColumn("_pos", at).drop("_hit", "_n")))
    ends = inside.unionByName(open_)

    low = F.max("_low") if variant == "B" else F.min("_low")
    both = ends.groupBy(*key, "row_idx", "kind").agg(F.max("v").alias("v"), (F.max("_h") - low).alias("prominence"))
    least = (0.3 if variant == "B" else 0.5) if least_sigma is None else least_sigma
    sigma = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg((least * F.stddev_pop("v")).alias("_least"))
    both = both.join(sigma, _null_safe(key)).where(F.col("prominence") >= F.col("_least"))
    share = F.col("prominence") / F.greatest(3 * F.col("_least"), F.lit(1e-300))
    return both.select(*key, "row_idx", "v", "kind", "prominence", F.least(F.lit(1.0), share).alias("significance"))


def _fold(idx: np.ndarray, sig: np.ndarray, distance: int, last: tuple[int, float] | None, like: list | None = None) -> tuple[list, bool]:
    """The state after each point, (index, significance, own position or -1 if it came in), and whether the point that came in
    gave way. like: the states of another start, taken over from where both agree."""
    states, replaced = [], False
    now = None if last is None else (*last, -1)
    for k, (i, s) in enumerate(zip(idx.tolist(), sig.tolist())):
        if now is None or i - now[0] > distance:
            now = (i, s, k)
        elif s > now[1]:
            replaced |= now[2] < 0
            now = (i, s, k)
        states.append(now)
        if like is not None and like[k] == now:
            return states + like[k + 1 :], replaced
    return states, replaced


def proximity_dedup(points: DataFrame, key: list[str], distance: int = 5) -> DataFrame:
    """Walk by index: within `distance` of the last kept point the more significant stays, the later only if strictly so.

    A walk over chunks of indices, not over points: each chunk first notes, for every point within `distance` before it that
    may come in as the last kept one, which point goes out and whether the one that came in gives way. These few notes are
    composed along a series; then each chunk keeps its points, knowing what comes in and whether its last one gives way.
    Points of one index go by falling significance, then kind. Null keys are a series; no points give none.
    """
    order, names, size = ["row_idx", "significance", "kind"], points.columns, max(series.CHUNK, 2 * distance + 1)
    x = series.chunked_with_halo(points, "row_idx", size, distance, 0, "_c")
    kinds = "".join(f"`{k}` {dict(points.dtypes)[k]}, " for k in key)

    def split(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        pdf = pdf.sort_values(order, ascending=[True, False, True], kind="stable")
        return pdf[~pdf["_own"]], pdf[pdf["_own"]]

    def note(pdf: pd.DataFrame) -> pd.DataFrame:
        halo, mine = split(pdf)
        if mine.empty:
            return pd.DataFrame(columns=[*key, "_c", "in_idx", "in_sig", "out_idx", "out_sig", "gives"])
        idx, sig = mine["row_idx"].to_numpy(), mine["significance"].to_numpy()
        plain, _ = _fold(idx, sig, distance, None)
        rows = [(None, None, *plain[-1][:2], False)]
        for came in set(zip(halo["row_idx"].tolist(), halo["significance"].tolist())):
            states, gives = _fold(idx, sig, distance, came, plain)
            rows.append((*came, *states[-1][:2], gives))
        out = pd.DataFrame(rows, columns=["in_idx", "in_sig", "out_idx", "out_sig", "gives"])
        return out.assign(**{k: [mine[k].iloc[0]] * len(out) for k in [*key, "_c"]})[[*key, "_c", *out.columns]]

    notes = x.groupBy(*key, "_c").applyInPandas(note, f"{kinds}_c long, in_idx long, in_sig double, out_idx long, out_sig double, gives boolean")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, now = [], None
        for c, of in pdf.sort_values("_c").groupby("_c"):
            known = {(None if pd.isna(r.in_idx) else (int(r.in_idx), r.in_sig)): r for r in of.itertuples()}
            came = now if now in known else None  # what is further off than the distance has no say
            if came is not None and known[came].gives:
                rows[-1][-1] = True
            rows.append([c, *(came or (None, None)), False])
            now = (int(known[came].out_idx), known[came].out_sig)
        out = pd.DataFrame(rows, columns=["_c", "_idx", "_sig", "_gives"])
        return out.assign(**{k: [pdf[k].iloc[0]] * len(out) for k in key})[[*key, "_c", "_idx", "_sig", "_gives"]]

    comes = notes.groupBy(*key).applyInPandas(compose, f"{kinds}_c long, _idx long, _sig double, _gives boolean")
    comes = comes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_c").alias("_cc"), "_idx", "_sig", "_gives")
    known = x.where("_own").join(comes, (F.col("_c") == F.col("_cc")) & _null_safe(key))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        _, mine = split(pdf)
        came = None if pd.isna(mine["_idx"].iloc[0]) else (int(mine["_idx"].iloc[0]), mine["_sig"].iloc[0])
        states, _ = _fold(mine["row_idx"].to_numpy(), mine["significance"].to_numpy(), distance, came)
        # the last state of each stretch stays: the next one is another point that did not take its place
        kept, idx = [], mine["row_idx"].to_numpy()
        for k, now in enumerate(states):
            if now[2] < 0 or k + 1 < len(states) and (states[k + 1][2] == now[2] or idx[states[k + 1][2]] - now[0] <= distance):
                continue
            if k + 1 < len(states) or not mine["_gives"].iloc[0]:
                kept.append(now[2])
        return mine.iloc[kept][names]

    return known.groupBy(*key, "_c").applyInPandas(keep, points.schema)


def top_significant(points: DataFrame, key: list[str], least: float = 0.0, most: int | None = None) -> DataFrame:
    """Points of significance `least` or more, the `most` best of each series, ties to the smaller index."""
    out = points.where(F.col("significance") >= least)
    if most is None:
        return out
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("significance").desc(), "row_idx"))
    return out.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def critical_points(df: DataFrame, key: list[str], order: list[str], t: str, v: str, w: int = 10, k: float = 3.0, limits: list[float] | None = None, least: float = 0.0, most: int | None = None) -> DataFrame:
    """Extrema, sudden changes and limit crossings: deduplicated, filtered by significance, the `most` best kept."""
    held, df, order = _held(df), numbered(df, key, order, t, v), NUMBERED
    parts = [with_prominence(df, key, order, v, w).select(*key, "row_idx", "v", "kind", "significance")]
    parts.append(sudden_changes(df, key, order, t, v, k).select(*key, "row_idx", F.col(v).cast("double").alias("v"), F.lit("change").alias("kind"), "significance"))
    if limits:
        parts.append(limit_crossings(df, key, order, v, limits).select(*key, "row_idx", F.col(v).cast("double").alias("v"), F.lit("limit").alias("kind"), F.lit(1.0).alias("significance")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return top_significant(proximity_dedup(held(out), key), key, least, most)


def lttb_critical(df: DataFrame, key: list[str], order: list[str], t: str, v: str, points: int, critical: int = 500, limits: list[float] | None = None) -> DataFrame:
    """LTTB rows and critical points together, each row once."""
    df, order = numbered(df, key, order, t, v), NUMBERED
    best = critical_points(df, key, order, t, v, limits=limits, most=min(critical, points // 2))
    rows = lttb(df, key, order, t, v, max(3, points - min(critical, points // 2))).select(*key, "row_idx")
    picked = rows.unionByName(best.select(*key, "row_idx")).distinct()
    return df.join(picked, [*key, "row_idx"], "left_semi").select(*key, "row_idx", F.col(t).alias("t"), F.col(v).alias("v"))


def auto(df: DataFrame, key: list[str], order: list[str], t: str, v: str, width: int = 1920, limits: list[float] | None = None, critical: int = 500) -> DataFrame:
    """Reduce to twice the screen's width: whole where there are no more rows, by LTTB and critical points if limits are
    given, else by LTTB."""
    points = 2 * width
    if df.count() <= points:
        return with_row_index(df, key, order).select(*key, "row_idx", F.col(t).alias("t"), F.col(v).alias("v"))
    if limits:
        return lttb_critical(df, key, order, t, v, points, critical, limits)
    return lttb(df, key, order, t, v, points).select(*key, "row_idx", F.col(t).alias("t"), F.col(v).alias("v"))


def spikes(df: DataFrame, key: list[str], order: list[str], v: str, low: float | None = None, high: float | None = None, k: float = 3.0) -> DataFrame:
    """Rows outside given bounds, by default mean plus and minus k sample deviations."""
    x = df if order is NUMBERED else with_row_index(df, key, order)
    if low is None or high is None:
        x = with_totals(x, key, _m=F.avg(v), _s=F.stddev_samp(v))
    least = F.lit(low) if low is not None else F.col("_m") - k * F.col("_s")
    most = F.lit(high) if high is not None else F.col("_m") + k * F.col("_s")
    return x.where((F.col(v) < least) | (F.col(v) > most)).drop("_m", "_s")


def smart(df: DataFrame, key: list[str], order: list[str], t: str, v: str, points: int, low: float | None = None, high: float | None = None, near: int = 3) -> DataFrame:
    """Spikes, extrema and changes, filled with LTTB rows (70 % of the target) that are not within `near` rows of them or
    of an LTTB row taken before."""
    held, df, order = _held(df), numbered(df, key, order, t, v), NUMBERED
    s = spikes(df, key, order, v, low, high).select(*key, "row_idx", F.lit("spike").alias("kind"))
    c = critical_points(df, key, order, t, v).select(*key, "row_idx", "kind")
    best = held(s.unionByName(c).groupBy(*key, "row_idx").agg(F.max("kind").alias("kind")))
    fill = lttb(df, key, order, t, v, max(100, int(points * 0.7))).select(*key, "row_idx")
    around = best.withColumn("row_idx", F.explode(F.sequence(F.col("row_idx") - near, F.col("row_idx") + near))).select(*key, "row_idx").distinct()
    fill = held(fill.join(around, [*key, "row_idx"], "left_anti")).withColumn("kind", F.lit("lttb"))
    fill = proximity_dedup(fill.withColumn("significance", F.lit(0.0)), key, near).drop("significance")
    return df.join(best.unionByName(fill), [*key, "row_idx"]).select(*key, "row_idx", F.col(t).alias("t"), F.col(v).alias("v"), "kind")


def quick(df: DataFrame, key: list[str], order: list[str], t: str, v: str, points: int, threshold: float) -> DataFrame:
    """smart() with spikes beyond plus and minus the threshold."""
    return smart(df, key, order, t, v, points, -threshold, threshold)


def smart_stats(picked: DataFrame, df: DataFrame, key: list[str]) -> DataFrame:
    """Per series of smart()'s result: its rows by kind, rows before and after, and how many times fewer they are."""
    kinds = ("spike", "peak", "valley", "change", "lttb")
    own = picked.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.count(F.lit(1)).alias("picked"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    both = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).join(own, _null_safe(key))
    return both.select(*key, "rows", "picked", *kinds, (F.col("rows") / F.col("picked")).alias("ratio"))


def build_lod(df: DataFrame, key: list[str], order: list[str], t: str, signals: list[str], sizes: tuple[int, ...] = (100, 10_000, 100_000)) -> dict[int, DataFrame]:
    """Per size the least and greatest time and values of each bucket; coarser levels come from the finer one."""
    x = with_row_index(df, key, order)
    out: dict[int, DataFrame] = {}
    for k, size in enumerate(sizes):
        if k == 0:
            aggs = [F.min(t).alias("time_min"), F.max(t).alias("time_max"), F.count(F.lit(1)).alias("rows")]
            aggs += [f(s).alias(f"{s}_{n}") for s in signals for n, f in (("min", F.min), ("max", F.max))]
            out[size] = x.groupBy(*key, F.floor(F.col("row_idx") / size).alias("bucket")).agg(*aggs)
        else:
            fine = out[sizes[k - 1]]
            aggs = [F.min("time_min").alias("time_min"), F.max("time_max").alias("time_max"), F.sum("rows").alias("rows")]
            aggs += [f(f"{s}_{n}").alias(f"{s}_{n}") for s in signals for n, f in (("min", F.min), ("max", F.max))]
            out[size] = fine.groupBy(*key, F.floor(F.col("bucket") / (size // sizes[k - 1])).alias("bucket")).agg(*aggs)
    return out


def overlapping(lod: DataFrame, a, b) -> DataFrame:
    """Buckets whose time overlaps [a, b]."""
    return lod.where((F.col("time_max") >= a) & (F.col("time_min") <= b))


def envelope(lod: DataFrame, key: list[str], signal: str, a, b) -> DataFrame:
    """Two points per bucket that overlaps [a, b]: (time_min, min) and (time_max, max)."""
    x = overlapping(lod, a, b)
    pair = F.array(F.struct(F.col("time_min").alias("t"), F.col(f"{signal}_min").alias("v")), F.struct(F.col("time_max").alias("t"), F.col(f"{signal}_max").alias("v")))
    return x.select(*key, "bucket", F.explode(pair).alias("p")).select(*key, "bucket", "p.t", "p.v")


def view(lods: dict[int, DataFrame], df: DataFrame, key: list[str], t: str, signal: str, a, b) -> DataFrame:
    """Raw rows of [a, b] below 20 000, else the envelope of the level for their number, counted on the coarsest table."""
    coarse = lods[max(lods)]
    rows = overlapping(coarse, a, b).agg(F.sum("rows")).first()[0] or 0
    level = next((s for most, s in ((2_000_000, 100), (20_000_000, 10_000)) if rows < most and s in lods), max(lods))
    if rows < 20_000:
        return df.where(F.col(t).between(a, b)).select(*key, F.col(t).alias("t"), F.col(signal).alias("v"))
    return envelope(lods[level], key, signal, a, b).select(*key, "t", "v")


def apply_series(df: DataFrame, key: list[str], order: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, **before: tuple[Column, Callable[[Column], Column]]) -> DataFrame:
    """A user's function of series, called once for each cell of a series' order (see `series.in_cells`) with the cell's rows
    in order, so that no task holds a series. What it needs of the cells before stands beside the rows, a column for each
    of `before` as in `series.with_carry`: null in a series' first cell."""
    x, _ = series.in_cells(df, key, order, cells.SMALL >> 4)
    x = series.with_carry(x, **before).withColumn("_cell", F.col("_chunk.n")).drop("_chunk")
    return x.groupBy(*key, "_cell").applyInPandas(lambda pdf: fn(pdf.drop(columns="_cell").sort_values(order, na_position="first", kind="stable")), schema)
