"""Numbers, running sums and ranks against plain loops; the statistics built on them."""

import random

import numpy as np
import pytest

from ladderwork.functions import ranks, stats
from ladderwork.plans.holdout import summary
from ladderwork.plans.sampling import metrics, sampled, sampled_pairs


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randint(0, 40), float(rng.randint(0, 9)), i) for i in range(3000)]
    rows += [("same", 5, 1.0, 7)] * 500
    return rows, spark.createDataFrame(rows, "k string, v int, w double, id int").repartition(5)


def test_numbered(table):
    rows, df = table
    found = ranks.numbered(df, ["k"], ["v", "id"], "nth").collect()
    by = {}
    for r in found:
        by.setdefault(r.k, []).append((r.nth, r.v, r.id))
    assert len(found) == len(rows)
    for k, mine in by.items():
        mine.sort()
        assert [n for n, *_ in mine] == list(range(1, len(mine) + 1))
        assert [x[1:] for x in mine] == sorted((r[1], r[3]) for r in rows if r[0] == k)


def test_running_sums(table):
    rows, df = table
    found = {(r.k, r.id): r.upto for r in ranks.running_sums(df.where("id <> 7 or k <> 'same'"), ["k"], ["v", "id"], {"upto": "w"}).collect()}
    for k in ("hot", "b", None):
        total = 0.0
        for _, i, w in sorted((r[1], r[3], r[2]) for r in rows if r[0] == k):
            total += w
            assert found[k, i] == total


def test_average_ranks_and_spearman(table, spark):
    rows, df = table
    got = {(r.k, r.v): r.rank for r in ranks.average_ranks(df, ["k"], "v", "rank").collect()}
    for k in ("hot", "b", None, "same"):
        vs = [r[1] for r in rows if r[0] == k]
        for v in set(vs):
            below, ties = sum(x < v for x in vs), vs.count(v)
            assert got[k, v] == below + (ties + 1) / 2
    pairs = spark.createDataFrame([(float(i), float(i * i)) for i in range(50)], "a double, b double")
    assert abs(stats.spearman(pairs, [], "a", "b").first().rho - 1) < 1e-12


def test_summary_of_perfect_predictions(spark):
    rows = [(2022, 1, 0.6), (2022, 2, -0.1), (2022, 3, -0.5), (2023, 1, 0.4), (2023, 2, 0.0), (2023, 4, -0.4)]
    r = summary(spark.createDataFrame([(b, p, t, t) for b, p, t in rows], "boundary long, player_id long, pred double, target double"), 100).first()
    assert abs(r.mse) < 1e-12 and abs(r.r - 1) < 1e-12 and abs(r.rho - 1) < 1e-12 and r.improvement == r.baseline_mse
    assert (r.n, r.n_players, r.n_boundaries, r.n_positive_r, r.p_sign_exact) == (6, 4, 2, 2, pytest.approx(0.25))
    assert r.boot_player_r_mean == pytest.approx(1) and r.boot_season_gain_lo > 0 and r.boot_player_gain_p == 0


def test_bootstrap_of_a_correlation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y = 0.6 * x + rng.normal(size=400)
    df = spark.createDataFrame([(i // 2, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "c long, x double, y double")
    draws = stats.bootstrap_moments(stats.moments(df, "c", "x", "y"), 500).toPandas()
    assert len(draws) == 500 and abs(draws.r.mean() - np.corrcoef(x, y)[0, 1]) < 0.02 and 0.02 < draws.r.std() < 0.06


LOG = "game_id long, game_date date, season long, track string, player_id long, team_id long, rating_after double, perf double"


def log_of(spark, rows):
    import datetime

    return spark.createDataFrame([(100 + g, datetime.date(2000, 11, g), 2000, "regular", p, t, r, z) for g, p, t, r, z in rows], LOG)


def test_mid_season_target_is_of_the_same_season(spark):
    rows = [x for g in range(1, 4) for x in ((g, 1, 10, 1600.0, 0.5), (g, 2, 20, 1500.0, -0.5))]
    out = metrics(sampled_pairs(log_of(spark, rows), (2,), 200.0, 10, 1), "point").first()
    assert out.mse == pytest.approx(0.0625) and out.r == pytest.approx(1) and (out.n, out.boundaries) == (2, 1)


def test_windows_begin_after_each_players_own_boundary(spark):
    """A player without later games has no target; a traded player's boundary is the last game either team counts."""
    rows = []
    for g in range(1, 5):
        rows += [(g, 1, 10, 1500.0 + g, g * 0.1), (g, 2, 20, 1500.0, -g * 0.1)]
        rows += [(g, 3, 10, 1400.0, 1.0)] if g <= 2 else []
        rows += [(g, 4, 10 if g == 1 else 20, 1300.0 + g, float(g))]
    out = {(r.point, r.player_id): r for r in sampled(log_of(spark, rows), (2, 3, 9), 10, 2).collect()}
    assert out[2, 1].target == pytest.approx(0.35) and out[2, 2].target == pytest.approx(-0.35) and out[2, 3].target is None
    assert (out[2, 1].rating, out[3, 1].rating, out[9, 1].rating) == (1502.0, 1503.0, 1504.0)
    assert out[2, 4].rating == 1302.0 and out[2, 4].target == pytest.approx(3.5)
    assert out[9, 1].games == 0 and out[9, 1].target is None and out[3, 1].games == 1


def test_a_shorter_season_counts_whole(spark):
    out = {r.player_id: r.rating for r in sampled(log_of(spark, [(1, 1, 10, 1600.0, 0.0), (1, 2, 20, 1400.0, 0.0)]), (41,)).collect()}
    assert out == {1: 1600.0, 2: 1400.0}


def test_ranks_of_values_that_differ_from_run_to_run(spark):
    """Values that a second run of the plan computes otherwise must not be lost in the join on them."""
    from pyspark.sql import functions as F

    from ladderwork.functions import ranks, stats

    shaky = F.udf(lambda i: i + __import__("random").random() / 2, "double").asNondeterministic()
    df = spark.range(200).select("id", shaky("id").alias("v"), (F.col("id") * 2.0).alias("w"))
    assert sorted((r.id, r.k) for r in ranks.average_ranks(df, [], "v", "k").collect()) == [(i, i + 1.0) for i in range(200)]
    assert sorted((r.id, r.k) for r in ranks.dense_ranks(df, [], "v", "k", descending=False).collect()) == [(i, i + 1) for i in range(200)]
    row = stats.spearman(df, [], "v", "w").first()
    assert row.n == 200 and abs(row.rho - 1) < 1e-12
