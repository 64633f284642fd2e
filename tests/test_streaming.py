import pytest

from ladderwork.operators import fold
from ladderwork.schema import RatingParams
from ladderwork.streaming import sessions
from tests.test_fold import SCHEMA, games


def test_session_counts_over_a_file_stream(spark, sf, tmp_path):
    source = str(tmp_path / "in")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(source)
    stream = sessions.session_counts(spark.readStream.schema(events.schema).parquet(source))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("session_counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("session_counts").selectExpr("sum(events)").first()[0] == events.count()


def test_followed_games_give_the_full_fold(spark, tmp_path):
    rows, p = games(), RatingParams()
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r.player_id: r.rating for r in fold.checkpoint(fold.rating_updates(df, [p])).collect()}
    source, state, log, check = (str(tmp_path / x) for x in ("in", "state", "log", "check"))
    for part, condition in enumerate(("game_id < 20", "game_id >= 20")):
        df.where(condition).coalesce(1).write.mode("append").parquet(source)
        q = sessions.follow(spark.readStream.schema(df.schema).parquet(source), p, state, log, check)
        q.awaitTermination(120)
        got = {r.player_id: r.rating for r in spark.read.parquet(f"{state}/batch={part}").collect()}
    assert got == pytest.approx(whole)


GAMES = "game_id long, player_id long, season long, game_date date, minutes double, points double, s_team double, arrived timestamp"


def test_late_and_repeated_games_leave_the_batch_result(spark, tmp_path):
    import datetime
    import random

    from ladderwork.plans.reconciliation import season_totals
    from ladderwork.streaming import totals

    rng, day = random.Random(5), datetime.datetime(2001, 1, 1)
    rows = [(g, p, 1990 + g // 20, (day + datetime.timedelta(g)).date(), float(rng.randint(1, 40)), float(rng.randint(0, 30)), float(g % 2)) for g in range(80) for p in range(4)]
    files = [
        [r for r in rows if r[0] < 30], [r for r in rows if 40 <= r[0] < 60],  # a gap: games 30 to 39 come late
        [r for r in rows if 50 <= r[0] < 70],  # games 50 to 59 again
        [r for r in rows if 30 <= r[0] < 40][::-1],  # late, out of order
        [r for r in rows if r[0] < 5 or r[0] >= 70] * 2,  # repeats of long ago, beside new ones, each twice
    ]
    source, log, table, check = (str(tmp_path / x) for x in ("in", "log", "totals", "check"))
    for n, part in enumerate(files):
        arrived = day + datetime.timedelta(days=10 * n)
        spark.createDataFrame([(*r, arrived) for r in part], GAMES).coalesce(1).write.mode("append").parquet(source)
        totals.follow_games(spark.readStream.schema(GAMES).parquet(source), log, table, check).awaitTermination(120)
    want = sorted(map(tuple, season_totals(spark.createDataFrame([(*r, day) for r in rows], GAMES)).collect()))
    kept = totals.totals(spark, table)
    assert sorted(map(tuple, kept.select("season", "player_id", "games", "minutes", "points", "wins", "last_day").collect())) == want
    opened = {}
    for r in totals.touched(spark, table).collect():
        opened.setdefault(r.batch, set()).add(r.season)
    first, last = min(opened), max(opened)
    assert opened[first] == {1990, 1991} and opened[last] >= {1993}
    assert sum(1991 in seasons for seasons in opened.values()) == 2  # at first, and when its late games came
    assert spark.read.parquet(log).count() == len(rows)
    # a batch that runs again leaves the same
    totals.merge_batch(spark, spark.createDataFrame([(*r, day) for r in files[-1]], GAMES), log, table, last)
    assert sorted(map(tuple, totals.totals(spark, table).select("season", "player_id", "games", "minutes", "points", "wins", "last_day").collect())) == want
