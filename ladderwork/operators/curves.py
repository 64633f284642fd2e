"""Career curves and their clusters.

Curves are built by windows and array functions; assignment, distances and
bands too.  Centres are fitted by Lloyd's algorithm as Spark jobs: every
iteration assigns all curves and sums them by place, so only sums leave a task
and only centres reach the driver.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.functions import selection
from ladderwork.functions.windows import centred_mean
from ladderwork.sources.warehouse import written

POINTS = 41


def career_curves(log: DataFrame, least: int = 42, each_side: int = 10) -> DataFrame:
    """player_id and curve: rating smoothed over 21 games, at 41 places, standardised.

    Players with fewer than `least` games or without spread have no curve.
    """
    smooth = centred_mean(F.col("rating_after"), ["player_id"], ["game_date", "game_id"], each_side)
    w = Window.partitionBy("player_id")
    rows = log.select("player_id", "game_date", "game_id", smooth.alias("v"))
    rows = rows.select(
        "player_id", "v", F.lead("v").over(w.orderBy("game_date", "game_id")).alias("following"),
        (F.row_number().over(w.orderBy("game_date", "game_id")) - 1).alias("low"), F.count("*").over(w).alias("n"),
    ).where(F.col("n") >= least)
    spine = rows.groupBy("player_id").agg(F.max("n").alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1))))
    spine = spine.withColumn("x", F.col("i") * (F.col("n") - 1) / float(POINTS - 1)).withColumn("low", F.floor("x").cast("int"))
    y = F.col("v") + (F.coalesce("following", "v") - F.col("v")) * (F.col("x") - F.floor("x"))
    points = spine.select("player_id", "i", "x", "low").join(rows.drop("n"), ["player_id", "low"]).select("player_id", "i", y.alias("y"))
    curve = points.groupBy("player_id").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"), F.array_sort(F.collect_list(F.struct("i", "y"))).alias("c"))
    return curve.where("sd >= 1e-9").select("player_id", F.transform("c", lambda p: (p["y"] - F.col("m")) / F.col("sd")).alias("curve"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def assigned(curves: DataFrame, centres: list[list[float]]) -> DataFrame:
    """cluster (nearest centre, the first on ties) and distance; centres are a bounded literal."""
    options = F.array(*[F.struct(squared_distance(F.col("curve"), _vector(c)).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)])
    best = F.array_min(options)
    return curves.withColumn("cluster", best["k"]).withColumn("distance", F.sqrt(best["d"]))


def _cluster_sums(curves: DataFrame, centres: dict[int, np.ndarray]) -> list:
    """For each start and cluster the curves nearest to its centre: their number, distances, farthest and sums by place.

    Every task assigns its curves to all starts' centres and returns sums, so
    nothing but starts x clusters x places numbers leaves it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for batch in batches:
            if batch.empty:
                continue
            x, ids = np.stack(batch["curve"].to_list()), batch["player_id"].to_numpy()
            squares = (x * x).sum(axis=1)
            for s, c in centres.items():
                d = np.maximum(squares[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1), 0.0)
                near = d.argmin(axis=1)
                least = d[np.arange(len(x)), near]
                for k in np.unique(near):
                    mine = near == k
                    order = np.lexsort((ids[mine], least[mine]))[-1]
                    far = (float(least[mine][order]), int(ids[mine][order]))
                    n, total, far_before, sums = held.get((s, int(k)), (0, 0.0, far, 0.0))
                    held[s, int(k)] = (n + int(mine.sum()), total + float(least[mine].sum()), max(far, far_before), sums + x[mine].sum(axis=0))
        rows = [(s, k, n, d, *far, sums.tolist()) for (s, k), (n, d, far, sums) in held.items()]
        yield pd.DataFrame(rows, columns=["start", "cluster", "n", "d", "far_d", "far_id", "sums"])

    parts = curves.select("player_id", "curve").mapInPandas(run, "start int, cluster int, n long, d double, far_d double, far_id long, sums array<double>")
    return parts.groupBy("start", "cluster").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"), F.max(F.struct("far_d", "far_id")).alias("far"), F.array(*[F.sum(F.col("sums")[i]) for i in range(POINTS)]).alias("sums")
    ).collect()  # starts x clusters rows


def kmeans(curves: DataFrame, k: int, seed: int = 42, starts: int = 40, iterations: int = 150) -> list[list[float]]:
    """Centres of least inertia over several starts, in order of their peaks."""
    return kmeans_each(curves, [k], seed, starts, iterations)[k]


def kmeans_each(curves: DataFrame, ks: Sequence[int], seed: int = 42, starts: int = 40, iterations: int = 150) -> dict[int, list[list[float]]]:
    """kmeans() for several numbers of centres.

    All starts of all k move in one job an iteration and only sums are
    exchanged.  A start rests once its inertia stands; an empty cluster starts
    again from the curve that is farthest from its centre.
    """
    curves = written(curves.select("player_id", "curve"), "curves")
    ids = [r.player_id for r in curves.select("player_id").orderBy(F.xxhash64("player_id", F.lit(seed))).limit(max(ks) * starts).collect()]
    rows = {r.player_id: r.curve for r in curves.where(F.col("player_id").isin(ids)).collect()}
    centres = {}
    for i, k in enumerate(ks):
        rng, some = random.Random(seed), ids[: k * starts]
        centres |= {i * starts + s: np.array([rows[x] for x in rng.sample(some, min(k, len(some)))]) for s in range(starts)}
    inertia, moving = dict.fromkeys(centres, float("inf")), set(centres)
    for _ in range(iterations):
        found: dict[int, list] = {}
        for r in _cluster_sums(curves, {s: centres[s] for s in moving}):
            found.setdefault(r.start, []).append(r)
        for s in list(moving):
            mine = found.get(s, [])
            new = centres[s].copy()
            for r in mine:
                new[r.cluster] = np.array(r.sums) / r.n
            empty = set(range(len(new))) - {r.cluster for r in mine}
            if empty:
                far = max(tuple(r.far) for r in mine)[1]
                new[list(empty)] = curves.where(F.col("player_id") == far).first().curve
            total = sum(r.d for r in mine)
            if not empty and abs(inertia[s] - total) < 1e-9 * max(1.0, total):  # sums of many curves differ by their order
                moving.discard(s)
            centres[s], inertia[s] = new, total
        if not moving:
            break
    out = {}
    for i, k in enumerate(ks):
        best = min(range(i * starts, (i + 1) * starts), key=lambda s: (inertia[s], s))
        out[k] = sorted(centres[best].tolist(), key=lambda c: max(range(len(c)), key=c.__getitem__))  # by the place of the peak
    return out


#: Squared distances under this are taken from differences; products of large numbers would leave noise in them.
NEAR = 1e-6


def _block_sums(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """For each curve of a block the sums and numbers of distances to another block's clusters."""
    out = []
    if not mine.empty and not others.empty:
        y, kinds, ids = np.stack(others["curve"].to_list()), others["cluster"].to_numpy(), others["player_id"].to_numpy()
        clusters = np.unique(kinds)
        member, squares = (kinds[:, None] == clusters).astype(float), (y * y).sum(axis=1)
        for k in range(0, len(mine), 256):
            part = mine.iloc[k : k + 256]
            x, who = np.stack(part["curve"].to_list()), part["player_id"].to_numpy()
            d = (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + squares
            near_x, near_y = np.nonzero(d < NEAR)
            for j in range(0, len(near_x), 50_000):
                a, b = near_x[j : j + 50_000], near_y[j : j + 50_000]
                d[a, b] = ((x[a] - y[b]) ** 2).sum(axis=1)
            other = who[:, None] != ids[None]
            d = np.where(other, np.sqrt(d), 0.0)
            sums, counts = d @ member, other.astype(float) @ member
            own = part["cluster"].to_numpy()
            for i, c in zip(*np.nonzero(counts), strict=True):
                out.append((int(who[i]), int(own[i]), int(clusters[c]), float(sums[i, c]), int(counts[i, c])))
    return pd.DataFrame(out, columns=["player_id", "cluster", "c", "s", "n"])


def silhouettes(labelled: DataFrame, block: int = 2048) -> DataFrame:
    """Exact Euclidean silhouette of every curve against all others.

    Curves are dealt into blocks of bounded size; two blocks meet in a task
    and only sums by cluster leave it.  A cluster of one has inner distance 0.
    """
    labelled = written(labelled.select("player_id", "cluster", "curve"), "labelled")
    blocks = max(1, -(-labelled.count() // block))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    own = F.pmod(F.xxhash64("player_id"), F.lit(blocks).cast("long"))
    left = labelled.withColumn("a", own).withColumn("b", every)
    right = labelled.withColumn("b", own).withColumn("a", every)
    right = right.toDF(*right.columns)
    flat = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(_block_sums, "player_id long, cluster int, c int, s double, n long")
    sums = flat.groupBy("player_id", "cluster", "c").agg((F.sum("s") / F.sum("n")).alias("mean"))
    out = sums.groupBy("player_id", "cluster").agg(
        F.coalesce(F.max(F.when(F.col("c") == F.col("cluster"), F.col("mean"))), F.lit(0.0)).alias("a"),
        F.min(F.when(F.col("c") != F.col("cluster"), F.col("mean"))).alias("b"),
    )
    return out.withColumn("silhouette", (F.col("b") - F.col("a")) / F.greatest("a", "b"))


def bands(labelled: DataFrame) -> DataFrame:
    """Quartiles of the curves of each cluster at each place."""
    rows = labelled.select("cluster", F.posexplode("curve").alias("place", "v"))
    out = selection.described(rows, ["cluster", "place"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return out.select("cluster", "place", "n", "q25", "q50", "q75")
