"""Grids of thresholds and paths on one axis against plain loops."""

import random

from pyspark.sql import functions as F

from ladderwork.operators import grids, paths


def test_corners(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 9), rng.choice([None, 1.0, 5.0, 9.5]), float(i)) for i in range(400)] + [("never", -5, 1.0, 1.0)]
    axes = {"x": (1, 4, 8), "y": (0.5, 5, 9)}
    out = grids.corners(spark.createDataFrame(rows, "k string, x int, y double, w double"), ["k"], axes, {"n": F.lit(1).cast("long"), "w": F.col("w")})
    got = {(r.k, r.x, float(r.y)): (r.n, r.w) for r in out.collect()}
    want = {}
    for k in ("a", "b", None):
        for x in axes["x"]:
            for y in axes["y"]:
                mine = [r for r in rows if r[0] == k and r[1] >= x and r[2] is not None and r[2] >= y]
                want[k, x, float(y)] = (len(mine), sum(r[3] for r in mine))
    got = {c: v for c, v in got.items() if c[0] != "never"}
    assert {c: v[0] for c, v in got.items()} == {c: v[0] for c, v in want.items()}
    assert all(abs(got[c][1] - want[c][1]) < 1e-9 for c in want)


def test_corners_of_null_keys_and_of_nothing(spark):
    df = spark.createDataFrame([(None, 3, 1.0), ("a", 3, 1.0)], "k string, x int, w double")
    got = {r.k: r.n for r in grids.corners(df, ["k"], {"x": (1,)}, {"n": F.lit(1).cast("long")}).collect()}
    assert got == {None: 1, "a": 1}
    assert grids.corners(df.limit(0), ["k"], {"x": (1, 2)}, {"n": F.lit(1).cast("long")}).count() == 0
    assert [r.n for r in grids.corners(df, [], {"x": (1, 9)}, {"n": F.lit(1).cast("long")}).orderBy("x").collect()] == [2, 0]


def test_resampled_and_compared(spark):
    points = [(1, 0.1, 10.0, 1), (1, 1.0, 20.0, 2), (1, 1.0, 30.0, 3), (1, 2.2, 6.0, 4), (2, 0.5, 0.0, 1), (2, 2.0, 30.0, 2), (3, 7.3, 1.0, 1), (4, 7.5, 2.0, 1)]
    path = paths.resampled(spark.createDataFrame(points, "player_id long, x double, value double, at int"), 0.5)
    got = {(r.player_id, r.slot): round(r.value, 9) for r in path.collect()}
    assert got == {(1, 1): round(10 + 20 * 0.4 / 0.9, 9), (1, 2): 30.0, (1, 3): 20.0, (1, 4): 10.0, (2, 1): 0.0, (2, 2): 10.0, (2, 3): 20.0, (2, 4): 30.0, (4, 15): 2.0}
    r = paths.compared(path).collect()
    assert len(r) == 1 and (r[0].a, r[0].b, r[0].slots, r[0].turns) == (1, 2, 4, 2) and r[0].widest == 20.0 and r[0].share_ahead == 0.5
