"""The fold against a plain Python one, and its invariants."""

import datetime as dt
import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ladderwork.operators import fold, leagues, quality
from ladderwork.operators.performance import with_performance
from ladderwork.schema import RatingParams

SCHEMA = (
    "game_id long, game_date timestamp_ntz, season long, track string, player_id long, team_id string, home boolean, share double, s_team double, perf double"
)


def games(n=40, seed=1):
    rng, out = random.Random(seed), []
    for g in range(n):
        day = dt.datetime(1995, 10, 1) + dt.timedelta(days=g // 2 * 9)
        season = day.year if day.month >= 7 else day.year - 1
        players = rng.sample(range(30), 8)
        won = rng.random() < 0.5
        for i, p in enumerate(players):
            home = i < 4
            out.append((g, day, season, "playoffs" if g % 5 == 0 else "regular", p, "F" if home else "O", home, 0.25, float(won == home), rng.uniform(-2, 2)))
    return out


def brute(rows, p, state=None, reverse=False):
    by_game = {}
    for r in rows:
        by_game.setdefault((r[1], r[0]), []).append(r)
    ratings, played = {}, {}
    for k, (r, n) in (state or {}).items():
        ratings[k], played[k] = r, n
    seen = set()
    for key in sorted(by_game, reverse=reverse):
        game = sorted(by_game[key], key=lambda r: r[4])
        for r in game:
            ratings.setdefault(r[4], p.init_value)
            played.setdefault(r[4], 0)
            seen.add(r[4])
        before = {r[4]: ratings[r[4]] for r in game}
        team = {t: sum(before[r[4]] * r[7] for r in game if r[5] == t) / sum(r[7] for r in game if r[5] == t) for t in "FO"}
        anchor = {"game": sum(before.values()) / len(before), "fixed": p.fixed_anchor, "league": sum(ratings[x] for x in seen) / len(seen)}.get(p.anchor)
        raw = {}
        for r in game:
            other = "O" if r[5] == "F" else "F"
            e = 1 / (1 + 10 ** (-(team[r[5]] - team[other] + p.home_advantage * r[6]) / 400))
            used = r[9] - ((before[r[4]] - anchor) / p.surprise_scale if p.anchor else 0)
            k = p.k * (1 + (p.rookie_boost - 1) * math.exp(-played[r[4]] / p.rookie_tau)) * (p.playoff_multiplier if r[3] == "playoffs" else 1)
            raw[r[4]] = k * r[7] * (used + p.theta * (r[8] - e))
        mean = sum(raw.values()) / len(raw)
        for x, d in raw.items():
            ratings[x] += d - mean
            played[x] += 1
    return {x: (ratings[x], played[x]) for x in seen}


@pytest.mark.parametrize(
    "change", [{}, {"anchor": "fixed"}, {"anchor": "league"}, {"anchor": None}, {"theta": 0.6, "home_advantage": 65.0}, {"playoff_multiplier": 0.5}]
)
@pytest.mark.parametrize("reverse", [False, True])
def test_fold_is_the_plain_fold(spark, change, reverse):
    rows, p = games(), replace(RatingParams(), **change)
    updates = fold.rating_updates(spark.createDataFrame(rows, SCHEMA), [p], reverse=reverse).collect()
    got = {}
    for u in sorted(updates, key=lambda u: (u.game_date, u.game_id), reverse=reverse):
        got[u.player_id] = (u.rating_after, u.games_before + 1)
    want = brute(rows, p, reverse=reverse)
    assert got.keys() == want.keys()
    for x in want:
        assert got[x][0] == pytest.approx(want[x][0], abs=1e-9) and got[x][1] == want[x][1]


def test_resume_equals_full_run(spark):
    rows, p = games(), RatingParams()
    df = spark.createDataFrame(rows, SCHEMA)
    full = {r.player_id: r.rating for r in fold.checkpoint(fold.rating_updates(df, [p])).collect()}
    early = fold.checkpoint(fold.rating_updates(df.where("game_id < 20"), [p])).drop("variant")
    late = fold.rating_updates(df.where("game_id >= 20"), [p], early)
    for r in fold.checkpoint(late).collect():
        assert r.rating == pytest.approx(full[r.player_id], abs=1e-9)


def test_log_invariants_and_variants(spark):
    df = spark.createDataFrame(games(), SCHEMA)
    updates = fold.rating_updates(df, [RatingParams(), RatingParams(variant="b", k=10.0)]).cache()
    assert updates.select("variant").distinct().count() == 2
    assert [r.failures for r in quality.log_checks(updates).collect()] == [0] * 5
    with pytest.raises(ValueError):
        fold.rating_updates(df, [RatingParams(), RatingParams()])


def test_full_log_is_the_plain_fold_of_all_seasons(spark, sf):
    from ladderwork.plans.performance import performed
    from ladderwork.plans.registry import QUERIES

    rows = [tuple(r) for r in performed(spark, sf).select(*[c.split()[0] for c in SCHEMA.split(", ")]).collect()]
    by_game, state, want = {}, {}, {}
    for r in rows:
        by_game.setdefault((r[1], r[0]), []).append(r)
    for key in sorted(by_game):
        before = {r[4]: state.get(r[4], (RatingParams().init_value, 0)) for r in by_game[key]}
        after = brute(by_game[key], RatingParams(), before)
        for player, (rating, games) in before.items():
            want[key[1], player] = (games, rating, after[player][0])
        state |= after
    got = {(r.game_id, r.player_id): (r.games_before, r.rating_before, r.rating_after) for r in QUERIES["rating_full_log"](spark, sf).collect()}
    assert len({r[2] for r in rows}) > 1 and len(want) == len(rows) and got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=2e-4)


def test_team_fold_is_zero_sum(spark):
    rng, ratings, rows = random.Random(2), {}, []
    for g in range(30):
        h, a = rng.sample("abcde", 2)
        won = float(rng.random() < 0.6)
        rows.append((g, dt.datetime(2000, 1, 1) + dt.timedelta(days=g // 3), h, a, won))
        x, y = ratings.get(h, 1500.0), ratings.get(a, 1500.0)
        step = 20 * (won - 1 / (1 + 10 ** (-(x - y + 65) / 400)))
        ratings[h], ratings[a] = x + step, y - step
    df = spark.createDataFrame(rows, "game_id long, game_date timestamp_ntz, home_team string, away_team string, home_won double")
    out = fold.team_updates(df, home_advantage=65.0).orderBy("game_date", "game_id").collect()
    got = {r.team: r.rating_after for r in out}
    assert got == pytest.approx(ratings)


def test_performance_of_a_hand_made_game(spark):
    schema = "game_id long, player_id long, team_id string, season long, minutes double, points double, assists double, rebounds double, steals double, blocks double, fouls double, shots_tried double, shots_made double, plus_minus double"
    rows = [(1, 1, "F", 1990, 30.0, 20.0, None, 5.0, 1.0, 0.0, 2.0, 15.0, 8.0, None), (1, 2, "O", 1990, 30.0, 10.0, 4.0, 5.0, 1.0, 0.0, 2.0, 10.0, 5.0, None)]
    out = {r.player_id: r for r in with_performance(spark.createDataFrame(rows, schema)).collect()}
    assert out[1].game_score == pytest.approx(20 + 0.4 * 8 - 0.7 * 15 + 2.5 + 1 - 0.8)
    assert out[1].perf == pytest.approx(out[1].z_score) and out[1].on_court is None
    assert out[1].perf + out[2].perf == pytest.approx(0.0)


def test_results_on_the_log_equal_pandas(spark, sf):
    """Metrics, snapshots, lifts and as-of states of the fold's log, recomputed row by row."""
    import numpy as np
    import pandas as pd

    from ladderwork.plans import fold_results
    from ladderwork.plans.registry import QUERIES

    log = fold_results.log_of(spark, sf, [fold_results.BASE, *fold_results.VARIANTS]).toPandas()
    base = log[log.variant == "base"].sort_values(["game_date", "game_id"])
    last = base.groupby(["season", "player_id"]).rating_after.last()
    first = base.groupby(["season", "player_id"]).perf.apply(lambda x: x.head(10).mean() if len(x) >= 5 else np.nan).dropna()
    got = {r.boundary: r for r in QUERIES["rating_cv_metrics"](spark, sf).collect()}
    for season in {s for s, _ in last.index}:
        rows = [(last[season, p], first[season + 1, p]) for s, p in last.index if s == season and (season + 1, p) in first.index]
        if not rows:
            assert season not in got
            continue
        x, y = (np.array(v) for v in zip(*rows))
        assert got[season].n == len(rows) and got[season].mse == pytest.approx(np.mean(((x - x.mean()) / 200 - y) ** 2), abs=1e-5)
    day = pd.to_datetime(base.game_date).dt.normalize()
    then = base[day <= "1997-03-15"].groupby("player_id").rating_after.last()
    assert {r.player_id: r.rating for r in QUERIES["rating_as_of"](spark, sf).collect()} == pytest.approx(then.to_dict(), abs=1e-3)
    peaks = log.groupby(["player_id", "variant"]).rating_after.max()
    for r in QUERIES["rating_pk_lift"](spark, sf).collect():
        assert (r.pk0, r.pk2) == pytest.approx((peaks[r.player_id, "pk0"], peaks[r.player_id, "pk2"]), abs=1e-3)
    seen = base[day <= pd.to_datetime((base.season + 1).astype(str) + "-02-01")].groupby(["season", "player_id"]).rating_after.last()
    for r in QUERIES["rating_feb1_top"](spark, sf).collect():
        assert r.rating == pytest.approx(seen[r.season, r.player_id], abs=1e-3)
        assert r.place == 1 + (seen[r.season].round(6) > round(seen[r.season, r.player_id], 6)).sum()


def test_only_rookies_are_boosted(spark):
    df = spark.createDataFrame(games(), SCHEMA)
    steps = lambda p: {(r.game_id, r.player_id): r.k_eff for r in fold.rating_updates(df, [p]).select("game_id", "player_id", "k_eff").collect()}
    everybody, few, none = steps(RatingParams()), steps(RatingParams(rookie_ids=(1, 2))), steps(RatingParams(rookie_ids=()))
    assert all(few[key] == (everybody[key] if key[1] in (1, 2) else none[key]) for key in few)
    assert set(none.values()) == {RatingParams().k} and few != none != everybody


def test_draft_mode_needs_a_rating_for_everybody(spark):
    df, p = spark.createDataFrame(games(), SCHEMA), RatingParams(init_mode="draft")
    with pytest.raises(ValueError):
        fold.rating_updates(df, [p])
    with pytest.raises(ValueError):
        RatingParams(init_mode="other")
    rated = df.selectExpr("*", "1500.0D + player_id AS start_rating")
    assert fold.rating_updates(rated, [p]).count() == df.count()
    with pytest.raises(Exception, match="no draft rating for player 3"):
        fold.rating_updates(rated.selectExpr("* except (start_rating)", "nullif(start_rating, 1503.0D) AS start_rating"), [p]).collect()


def test_a_game_without_shares_is_an_error(spark):
    from ladderwork.operators.performance import checked

    df = spark.createDataFrame(games(), SCHEMA)
    assert checked(df).selectExpr("sum(share)").first()[0] == pytest.approx(df.selectExpr("sum(share)").first()[0])
    with pytest.raises(Exception, match="positive share"):
        checked(df.selectExpr("* except (share)", "CASE WHEN game_id = 3 THEN 0.0D ELSE share END AS share")).selectExpr("sum(share)").collect()


@pytest.mark.parametrize("change", [{}, {"anchor": "league"}, {"theta": 0.6}])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("limit", [1000, 60])
def test_leagues_fold_side_by_side_and_in_rounds(spark, change, reverse, limit):
    """Two leagues; with a limit of 60 rows each is folded in several rounds of days."""
    rows, p = games() + [(g + 1000, d, s, t, 100 + x, *rest) for g, d, s, t, x, *rest in games(30, seed=5)], replace(RatingParams(), **change)
    df = spark.createDataFrame(rows, SCHEMA)
    got = fold.checkpoint(fold.rating_updates(df, [p], limit=limit)) if not reverse else None
    if reverse:
        log = fold.rating_updates(df, [p], reverse=True, limit=limit).collect()
        last = {}
        for u in sorted(log, key=lambda u: (u.game_date, u.game_id), reverse=True):
            last[u.player_id] = (u.rating_after, u.games_before + 1)
    else:
        last = {r.player_id: (r.rating, r.games_played) for r in got.collect()}
    want = brute(rows, p, reverse=reverse)
    assert last.keys() == want.keys()
    for x in want:
        assert last[x] == pytest.approx(want[x], abs=1e-9)


def test_a_league_is_a_task_of_its_own(spark):
    """One sequence for each league, not one for all rows."""
    rows = games() + [(g + 1000, d, s, t, 100 + x, *rest) for g, d, s, t, x, *rest in games(30, seed=5)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r.player_id: r.league for r in leagues.leagues(df).collect()}
    assert set(found.values()) == {min(x for x in found if x < 100), min(x for x in found if x >= 100)}
    assert leagues.leagues(df).agg({"n": "sum"}).first()[0] == len(rows)
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long").repartition(4)
    assert {r.u: r.v for r in leagues.stars(chain).collect()} == {i: 0 for i in range(1, 201)} | {501: 500}


def test_league_anchor_with_start_ratings(spark):
    rows, p = games(), RatingParams(anchor="league")
    state = {x: (1300.0 + 10 * x, 0) for x in range(30)}
    rated = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1300.0D + 10 * player_id AS start_rating")
    want = brute(rows, p, state)
    got = {r.player_id: r.rating for r in fold.checkpoint(fold.rating_updates(rated, [p])).collect()}
    assert got == pytest.approx({x: r for x, (r, _) in want.items()}, abs=1e-9)


def test_team_fold_in_rounds(spark):
    rng = random.Random(3)
    rows = [(g, dt.datetime(2000, 1, 1) + dt.timedelta(days=g // 3), *rng.sample("abcde", 2), float(rng.random() < 0.6)) for g in range(60)]
    df = spark.createDataFrame(rows, "game_id long, game_date timestamp_ntz, home_team string, away_team string, home_won double")
    key = lambda r: (r.game_id, r.team)
    one, many = (sorted(fold.team_updates(df, home_advantage=65.0, limit=n).collect(), key=key) for n in (1000, 10))
    assert one == many and len(one) == 120


def test_rows_are_computed_once_for_leagues_and_fold(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = games()

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.createDataFrame(rows, SCHEMA).mapInPandas(counted, SCHEMA)
    assert fold.rating_updates(df, [RatingParams()]).count() == len(rows)
    assert seen.value == len(rows)


def test_checkpoint_needs_no_sort_of_the_log(spark):
    from ladderwork.sources.warehouse import written

    log = written(fold.rating_updates(spark.createDataFrame(games(), SCHEMA), [RatingParams()]), "log")
    plan = fold.checkpoint(log)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan


def test_games_cut_by_batches_are_whole(spark):
    rows, p = games(), replace(RatingParams(), theta=0.6, home_advantage=65.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.player_id: (r.rating, r.games_played) for r in fold.checkpoint(fold.rating_updates(spark.createDataFrame(rows, SCHEMA), [p])).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got.keys() == (want := brute(rows, p)).keys()
    for x in want:
        assert got[x] == pytest.approx(want[x], abs=1e-9)


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Leagues are dealt over as many tasks as their rows ask for, not over a fixed number."""
    rows = [(g + 100 * i, d, s, t, 100 * i + x, *rest) for i in range(12) for g, d, s, t, x, *rest in games(12, seed=i)]
    monkeypatch.setattr(fold, "TASK_ROWS", 20, raising=False)
    log = fold.rating_updates(spark.createDataFrame(rows, SCHEMA), [RatingParams(), RatingParams(variant="theta", theta=0.6)])
    parts = log.selectExpr("variant", "player_id div 100 AS league", "spark_partition_id() AS part").distinct().collect()
    assert len({(r.variant, r.league) for r in parts}) == len(parts) == 24
    assert len({r.part for r in parts}) > 12 and all(len({r.variant for r in parts if r.part == x}) == 1 for x in {r.part for r in parts})
    got = {r.player_id: r.rating for r in fold.checkpoint(log).where("variant = 'base'").collect()}
    assert got == pytest.approx({x: r for x, (r, _) in brute(rows, RatingParams()).items()}, abs=1e-9)


@pytest.mark.parametrize("limit", [1000, 60])
def test_only_wanted_columns_are_made(spark, limit):
    df, p = spark.createDataFrame(games(), SCHEMA), replace(RatingParams(), anchor="fixed")
    whole = fold.rating_updates(df, [p], limit=limit)
    for columns in (fold.STATE, ["game_id", "player_id", "season", "perf_used", "delta"], ["player_id", "game_id", "e_team"]):
        some = fold.rating_updates(df, [p], limit=limit, columns=columns)
        assert sorted(some.columns) == sorted(columns)
        assert sorted(map(tuple, some.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))


def test_forests_of_many_batches_are_whole(spark, monkeypatch):
    monkeypatch.setattr(leagues, "FOREST_ROWS", 7, raising=False)
    rng, links = random.Random(4), []
    import pyarrow as pa

    batches = []
    for _ in range(60):
        pairs = [(c * 1000 + rng.randrange(80), c * 1000 + rng.randrange(80)) for c in (rng.randrange(5) for _ in range(5))]
        links += pairs
        batches.append(pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], names=["player_id", "hub"]))
    least = {x: x for pair in links for x in pair}
    while True:
        now = dict(least)
        for u, v in links:
            now[u] = now[v] = min(now[u], now[v])
        if now == least:
            break
        least = now
    (out,) = leagues._forest(iter(batches))
    got = {r["u"]: (r["v"], r["n"]) for r in out.to_pylist()}
    assert {u: v for u, (v, _) in got.items()} == least
    assert {u: n for u, (_, n) in got.items()} == {x: sum(u == x for u, _ in links) for x in least}
    assert list(leagues._forest(iter([])))[0].num_rows == 0


def test_lines_move_once(spark, sf):
    """The sums of lines, the join with games and the windows use one exchange of the lines."""
    from ladderwork.plans.performance import performed

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = performed(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2  # lines and games


def test_checks_need_one_pass_for_chains(spark):
    from ladderwork.sources.warehouse import written

    log = written(fold.rating_updates(spark.createDataFrame(games(), SCHEMA), [RatingParams()]), "log")
    plan = quality.log_checks(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2
    bad = log.withColumn("games_before", F.expr("if(game_id = 3, games_before + 1, games_before)")).withColumn("rating_after", F.expr("if(game_id = 5, null, rating_after)"))
    got = {r.check_name: r.failures for r in quality.log_checks(bad).collect()}
    assert list(got) == ["zero_sum", "chain", "games_in_steps", "no_nulls", "range"]
    assert got["games_in_steps"] > 0 and got["no_nulls"] == 8 and got["zero_sum"] == got["chain"] == got["range"] == 0


def test_lines_of_a_task_are_bounded(spark, sf, monkeypatch):
    from ladderwork.sources import arena

    few = arena.clean(spark, sf).select("game_id", "player_id", "team_score")
    monkeypatch.setattr(arena, "TASK_LINES", 300, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = arena.clean(spark, sf).select("game_id", "player_id", "team_score")
        assert many.select(F.spark_partition_id().alias("p")).distinct().count() > 4
        assert many._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        shown = lambda df: sorted((r.game_id, r.player_id, round(r.team_score, 6)) for r in df.collect())
        assert shown(many) == shown(few)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("reverse, limit", [(False, 150), (True, 1000)])
def test_a_checkpoint_takes_few_rows_of_the_log(spark, reverse, limit):
    """For states a batch hands back one row a player, whatever its rows."""
    df, grid = spark.createDataFrame(games(), SCHEMA), [RatingParams(), RatingParams(variant="theta", theta=0.6)]
    whole = fold.rating_updates(df, grid, reverse=reverse, limit=limit, columns=fold.STATE)
    some = fold.rating_updates(df, grid, reverse=reverse, limit=limit, columns=fold.STATE, last=True)
    assert 30 <= some.count() < 0.7 * whole.count()
    assert sorted(map(tuple, fold.checkpoint(some).collect())) == sorted(map(tuple, fold.checkpoint(whole).collect()))


def test_scores_of_a_game_need_one_window(spark):
    stats = ["points", "assists", "rebounds", "steals", "blocks", "fouls", "shots_tried", "shots_made", "plus_minus", "minutes"]
    rows = spark.createDataFrame([(g, "F", 1995, *[float(g * i % 7) for i in range(10)]) for g in range(9)], "game_id long, team_id string, season long, " + ", ".join(f"{c} double" for c in stats))
    out = with_performance(rows)
    assert "seen_" not in out.columns
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_three_passes_count_games_once(spark, monkeypatch):
    """The passes equal plain folds, and games are numbered once for all three."""
    calls, number = [], fold.with_games_before
    monkeypatch.setattr(fold, "with_games_before", lambda *a, **kw: calls.append(1) or number(*a, **kw))
    rows, p = games(), RatingParams()
    got = {r.player_id: (r.rating, r.games_played) for r in fold.checkpoint(fold.three_pass(spark.createDataFrame(rows, SCHEMA), p, fold.STATE, last=True)).collect()}
    ends = brute(rows, p, brute(rows, p), reverse=True)
    first = {r[4] for r in rows if r[2] == min(x[2] for x in rows)}
    want = brute(rows, p, {x: (r, 0) for x, (r, _) in ends.items() if x in first})
    assert got.keys() == want.keys() and len(calls) == 1
    for x in want:
        assert got[x] == pytest.approx(want[x], abs=1e-9)


@pytest.mark.parametrize("limit, size, anchor", [(1000, 10_000, "game"), (300, 11, "game"), (300, 10_000, "league"), (1000, 11, None), (1000, 11, "fixed")])
def test_a_grid_is_its_sets_folds(spark, limit, size, anchor):
    """Rows go by once for all sets, in rounds and in small batches too; a row a player and season is left."""
    every = games(100)
    df, sets = spark.createDataFrame(every, SCHEMA), [RatingParams(variant=f"{k}/{s}", k=k, surprise_scale=s, playoff_multiplier=0.5, anchor=anchor) for k in (20.0, 45.0) for s in (285.0, 400.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {(r.season, r.player_id): (r.games_played, r.ratings) for r in fold.grid_updates(df, sets, limit=limit).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {(r[2], r[4]) for r in every} and len({s for s, _ in got}) > 1
    for i, p in enumerate(sets):
        for season in {s for s, _ in got}:
            want = brute([r for r in every if r[2] <= season], p)
            for (s, player), (n, found) in got.items():
                if s == season:
                    assert (found[i], n) == pytest.approx(want[player], abs=1e-9)


def test_sets_of_a_grid_differ_in_k_and_scale(spark):
    df = spark.createDataFrame(games(4), SCHEMA)
    for other in ({"theta": 0.6}, {"rookie_tau": 30.0}, {"init_value": 1500.0}):
        with pytest.raises(ValueError, match="k and scale"):
            fold.grid_updates(df, [RatingParams(), RatingParams(variant="other", **other)])


def test_the_grid_has_every_pair_of_k_and_scale_and_what_it_foretells(spark, sf):
    from ladderwork.plans.registry import QUERIES

    rows = QUERIES["rating_grid"](spark, sf).collect()
    assert {(r.k, r.scale) for r in rows} == {(k, s) for k in (8.0, 10.0, 15.0, 20.0) for s in (300.0, 350.0, 400.0, 500.0)} | {(20.0, 285.0), (45.0, 285.0)}
    assert all(r.pairs > 0 and r.boundaries > 1 and r.mse > 0 and r.discrimination > 0 for r in rows)


@pytest.mark.parametrize("change, held", [({}, 10**6), ({"theta": 0.6, "home_advantage": 65.0, "playoff_multiplier": 0.5}, 10**6), ({"anchor": None, "rookie_ids": (3, 4)}, 10**6), ({}, 100)])
def test_three_passes_in_a_task_are_three_folds(spark, monkeypatch, change, held):
    """Held rows, in several leagues and chunks, or handed from fold to fold: the same states."""
    every = [(g + 1000 * i, d, s, t, 100 * i + x, *rest) for i in range(3) for g, d, s, t, x, *rest in games(100, seed=i)]
    every = [r for r in every if r[4] < 100 or r[2] > 1995]  # two leagues open later
    p, df = replace(RatingParams(), **change), spark.createDataFrame(every, SCHEMA)
    want = {r.player_id: (r.rating, r.games_played) for r in fold.checkpoint(fold.three_pass(df, p)).collect()}
    monkeypatch.setattr(fold, "PASS_ROWS", 50)
    monkeypatch.setattr(fold, "HELD_ROWS", held)
    got = {r.player_id: (r.rating, r.games_played) for r in fold.three_pass_states(df, p).collect()}
    assert got.keys() == want.keys()
    for x in want:
        assert got[x] == pytest.approx(want[x], abs=1e-9)


def test_three_passes_deal_rows_once(spark):
    df = spark.createDataFrame(games(), SCHEMA)
    plan = fold.three_pass_states(df, RatingParams())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Window" not in plan
