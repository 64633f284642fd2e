"""Leagues: players who are linked by games, directly or through others.

Nothing that happens in one league touches another, so leagues can be folded
side by side.  Each partition reduces its games to a forest of its players;
what is left (a row for each player and partition at most) is contracted by
alternating large and small stars until every player hangs on the least one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.sources.warehouse import written

#: Rows whose links a task adds to its forest at once.
FOREST_ROWS = 200_000


def _linked(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """root, the least node that each node hangs on, once u and v are linked; all are places of nodes in order."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = (x[apart] for x in (u, v, a, b))
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """u, the least player v that the partition links u with, and the rows of u in it."""
    known, root, rows = (np.empty(0, dtype=np.int64) for _ in range(3))
    pending, size = [], 0

    def taken() -> None:
        nonlocal known, root, rows
        u, v = (np.concatenate(x) for x in zip(*pending, strict=True))
        every = np.union1d(known, np.concatenate([u, v]))
        if len(every) > len(known):
            at = np.searchsorted(every, known)
            old_root, old_rows = root, rows
            root, rows = np.arange(len(every)), np.zeros(len(every), dtype=np.int64)
            root[at], rows[at] = at[old_root], old_rows
            known = every
        u, v = np.searchsorted(known, u), np.searchsorted(known, v)
        rows += np.bincount(u, minlength=len(known))
        root = _linked(root, u, v)

    for batch in batches:
        pending.append([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("player_id", "hub")])
        size += batch.num_rows
        if size >= FOREST_ROWS:
            taken()
            pending, size = [], 0
    if size:
        taken()
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (known, known[root], rows)], names=["u", "v", "n"])


def stars(edges: DataFrame) -> DataFrame:
    """u and v, the least node that u is linked with, for every u that is not the least one itself.

    edges: u and v, whole numbers, in any order and with repeats.
    """
    u, v = F.col("u"), F.col("v")
    edges = written(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(u != v).distinct(), "stars")
    while True:
        shape = edges.groupBy("u").count()
        if not shape.where("count > 1").limit(1).count() and not edges.join(edges.select(v.alias("u")), "u", "left_semi").limit(1).count():
            return edges
        near = Window.partitionBy("u")
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        large = both.withColumn("m", F.least(F.min("v").over(near), u)).where(v > u).select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        small = large.withColumn("m", F.min("v").over(near)).select(F.explode(F.array(F.struct(u, F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.*").where(u != v).distinct(), "stars")


def with_hub(rows: DataFrame) -> DataFrame:
    """rows with hub, the least player of the game."""
    return rows.withColumn("hub", F.min("player_id").over(Window.partitionBy("game_id")))


def leagues(rows: DataFrame) -> DataFrame:
    """player_id, league (its least player) and n, the player's rows; rows: game_id and player_id, whole numbers, and hub if they have it."""
    rows = rows if "hub" in rows.columns else with_hub(rows.select("game_id", "player_id"))
    parts = rows.select("player_id", "hub").mapInArrow(_forest, "u long, v long, n long")
    parts = written(parts, "forest")
    players = parts.groupBy("u").agg(F.sum("n").alias("n"))
    out = players.join(stars(parts), "u", "left")
    return written(out.select(F.col("u").alias("player_id"), F.coalesce("v", "u").alias("league"), "n"), "leagues")
