import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ladderwork.functions import scalar, stats, windows
from ladderwork.schema import PerformanceParams, RatingParams
from ladderwork.sources.readers import parameter_grid


def one(spark, column, **values):
    row = [tuple(values.values())]
    return spark.createDataFrame(row, list(values)).select(column.alias("x")).first().x if values else spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "minutes"), [("35:56", 35 + 56 / 60), ("12", 12.0), ("", None), ("-3", None), ("DNP", None), ("7:", None), ("0:30", 0.5)]
)
def test_parse_minutes(spark, text, minutes):
    got = one(spark, scalar.parse_minutes(F.col("t")), t=text)
    assert got == minutes if minutes is None else got == pytest.approx(minutes)


@pytest.mark.parametrize(
    ("day", "season"), [("1996-10-21", 1996), ("1997-06-01", 1996), ("2020-07-30", 2019), ("2020-10-02", 2020), ("2021-07-20", 2021)]
)
def test_season_start(spark, day, season):
    assert one(spark, scalar.season_start(F.to_date(F.col("d"))), d=day) == season


def test_season_label(spark):
    assert one(spark, scalar.season_label(F.col("s")), s=1999) == "1999-00"
    assert one(spark, scalar.season_label(F.col("s")), s=2004) == "2004-05"


def test_win_probability_one_sided(spark):
    assert one(spark, scalar.win_probability(F.lit(0.0))) == 0.5
    assert one(spark, scalar.win_probability(F.lit(400.0))) == pytest.approx(10 / 11)


def test_step_size(spark):
    assert one(spark, scalar.k_effective(20.0, F.lit(0), 3.0, 10.0)) == pytest.approx(60.0)
    assert one(spark, scalar.k_effective(20.0, F.lit(5), 3.0, 0.0)) == pytest.approx(20.0)


@pytest.mark.parametrize("z", [-3.0, -1.0, 0.0, 0.5, 1.96, 4.0])
def test_norm_cdf(spark, z):
    assert one(spark, scalar.norm_cdf(F.lit(z))) == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=1e-7)


def test_binomial_tail(spark):
    want = sum(math.comb(10, k) for k in range(7, 11)) / 2**10
    assert one(spark, scalar.binomial_tail(F.lit(7).cast("long"), F.lit(10).cast("long"))) == pytest.approx(want)


def test_cut_edges(spark):
    left = scalar.cut(F.lit(10), [0, 10, 20], ["a", "b"])
    right = scalar.cut(F.lit(10), [0, 10, 20], ["a", "b"], right=True)
    assert (one(spark, left), one(spark, right)) == ("b", "a")
    assert one(spark, scalar.cut(F.lit(25), [0, 10, 20], ["a", "b"])) is None


def test_all_star_cutoffs(spark):
    for season, day in ((1997, "1998-02-01"), (1998, "1999-02-14"), (2020, "2021-03-01")):
        assert one(spark, scalar.all_star_cutoff(F.col("s")), s=season) == dt.date.fromisoformat(day)


def test_average_rank_and_spearman(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 30.0), (4, None)], "id int, v double")
    ranks = {r.id: r.k for r in df.where("v is not null").select("id", windows.average_rank(F.col("v")).alias("k")).collect()}
    assert ranks == {1: 1.5, 2: 1.5, 3: 3.0}
    pairs = spark.createDataFrame([(1.0, 3.0), (2.0, 4.0), (5.0, 9.0), (7.0, 11.0)], "x double, y double")
    assert stats.spearman(pairs, [], "x", "y").first().rho == pytest.approx(1.0)


def test_weighted_quantiles_and_mean(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (10.0, 8.0)], "v double, w double")
    row = stats.weighted_quantiles(df, [], "v", "w", {"q10": 0.1, "q50": 0.5}).first()
    assert (row.q10, row.q50) == (1.0, 10.0)
    flat = spark.createDataFrame([(1.0, 0.0), (3.0, 0.0)], "v double, w double")
    assert flat.agg(stats.weighted_mean(F.col("v"), F.col("w"))).first()[0] == 2.0


def test_error_metrics_golden(spark):
    pairs = spark.createDataFrame([(0.25, 0.5), (-0.25, -0.5)], "pred double, target double")
    row = stats.error_metrics(pairs, [], "pred", "target").first()
    assert (row.mse, row.pred_sd, row.target_sd, row.discrimination) == pytest.approx((0.0625, 0.25, 0.5, 0.5))


def test_islands_and_running_max(spark):
    df = spark.createDataFrame([(i, i // 3, float(v)) for i, v in enumerate([1, 3, 2, 5, 4, 9, 1])], "i int, day int, v double")
    got = {r.i: r.max_before for r in windows.running_max_before(df, "v", "day", ["i"]).collect()}
    assert got == {0: None, 1: 1.0, 2: 3.0, 3: 3.0, 4: 5.0, 5: 5.0, 6: 9.0}


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        RatingParams(surprise_scale=0)
    with pytest.raises(ValueError):
        PerformanceParams(alpha=1.5)
    with pytest.raises(ValueError):
        RatingParams(anchor="moon")


def test_grid_forms():
    assert [p.k for p in parameter_grid('{"k": [20.0, 45.0], "theta": [0.5]}')] == [20.0, 45.0]
    assert parameter_grid('[{"variant": "a", "k": 30.0}]')[0].variant == "a"


def test_entries_exits_of_absent_players(spark):
    from ladderwork.plans.evaluation import entries_exits

    rows = [("all", g, f"{s}-11-01", s, p, r) for g, (s, p, r) in enumerate([(1, 1, 10.0), (1, 2, 20.0), (2, 1, 30.0), (3, 1, 40.0), (3, 2, 50.0)])]
    log = spark.createDataFrame(rows, "variant string, game_id long, game_date string, season long, player_id long, rating_after double")
    got = {r.season: (r.players, r.entries, r.exits, r.exit_median) for r in entries_exits(log).collect()}
    assert got == {1: (2, 2, 1, 20.0), 2: (1, 0, 0, None), 3: (2, 0, 2, 45.0)}


def test_whole_table_queries_use_every_row(spark, sf):
    from ladderwork.operators import leaderboard
    from ladderwork.plans.registry import QUERIES
    from ladderwork.plans.timeline import events

    want = events(spark, sf).select("season", "player_id").distinct().count()
    assert QUERIES["entry_exit_all"](spark, sf).agg({"players": "sum"}).first()[0] == want
    got = QUERIES["frame_sampling_season"](spark, sf)
    days = spark.read.parquet(f"{sf}/events.parquet").selectExpr("min(to_date(ts)) AS a", "max(to_date(ts)) AS b").first()
    assert {days.a, days.b} <= {r.day for r in got.collect()}
    sparse = spark.createDataFrame([(1, d) for d in (1, 3, 8, 20, 22)], "season int, d int").selectExpr("season", "date_add(date'2000-01-01', d) AS day")
    assert sorted(r.day.day - 1 for r in leaderboard.greedy_frames(sparse, ["season"], 7).collect()) == [1, 8, 20, 22]


def test_whole_scores(spark):
    """Sums of scores of game 123432 of sf0.1 in three orders; the score is 189."""
    for total in (188.99999999999997, 189.0, 189.00000000000003):
        assert one(spark, scalar.whole_score(F.lit(total))) == 189
    assert one(spark, scalar.whole_score(F.lit(188.99999))) == 188


def test_entry_exit_all_has_every_season(spark, sf):
    from ladderwork.plans.registry import QUERIES

    seasons = {r.season: r.asDict() for r in QUERIES["entry_exit"](spark, sf).collect()}
    rows = QUERIES["entry_exit_all"](spark, sf).collect()
    assert {r.season for r in rows} == set(seasons) and len(rows) == len(seasons)
    for r in rows:
        assert all(r[c] == v for c, v in seasons[r.season].items()) and r.all_players == sum(s["players"] for s in seasons.values())
