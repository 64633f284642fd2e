"""Boards against a plain replay of the days: pruning loses nobody, ties, late entries, seasons."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ladderwork.operators import leaderboard

DAY = datetime.date(1999, 12, 20)


def events():
    rng, out = random.Random(2), []
    for n in range(900):
        day = rng.choice([d for d in range(90) if not 40 <= d < 55])
        out.append((day // 45, DAY + datetime.timedelta(day), n, rng.randint(0, 60), float(rng.randint(0, 40))))
    return out


def brute(rows, k, by_season):
    out = []
    for season, day in sorted({(r[0], r[1]) for r in rows}):
        state = {}
        for r in sorted((x for x in rows if x[1] <= day and (not by_season or x[0] == season)), key=lambda x: (x[1], x[2])):
            state[r[3]] = r[4]
        best = sorted(state.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(day, place, p, v) for place, (p, v) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("width", [1, 7, 32, 1000])
@pytest.mark.parametrize("by_season", [False, True])
def test_board(spark, width, by_season):
    rows = events()
    log = spark.createDataFrame(rows, "season long, day date, n long, player_id long, rating double").withColumn("at", F.struct("day", "n"))
    found = leaderboard.daily_board(log, 4, width, ["season"] if by_season else None).collect()
    assert sorted((r.board_day, r.place, r.player_id, r.rating) for r in found) == brute(rows, 4, by_season)


def test_few_parts_are_laid_out(spark):
    """Players far under the board are gone before days are."""
    rows = [(0, DAY, p, p, float(p)) for p in range(500)] + [(0, DAY + datetime.timedelta(d), 1000 + d, 499, 499.0) for d in range(1, 64)]
    log = spark.createDataFrame(rows, "season long, day date, n long, player_id long, rating double").withColumn("at", F.struct("day", "n"))
    days = log.select(F.unix_date("day").alias("day")).distinct()
    kept = leaderboard.contenders(leaderboard.spans(log, [], []), days, 10, 16, [])
    assert {r.player_id for r in kept.collect()} == set(range(490, 500))


def test_roster_spans_do_not_grow_with_games_sat_out(spark):
    """A member who plays the first and last of 100 home games has a span for each rating, not a row a game."""
    import datetime as dt

    from ladderwork.plans import teams

    day = lambda i: dt.datetime(1995, 10, 1) + dt.timedelta(days=i // 2)  # noqa: E731  two games a day
    plays = [(1, i) for i in (0, 99)] + [(2, i) for i in range(100)]
    rows = [(1995, p, day(i), i, 1500.0 + p * 10 + i, True, 7) for p, i in plays] + [(1995, 1, day(41), 1041, 1600.0, False, 8), (1994, 1, dt.datetime(1995, 3, 1), 1000, 1450.0, False, 8)]
    log = spark.createDataFrame(rows, "season long, player_id long, game_date timestamp_ntz, game_id long, rating_after double, home boolean, venue_id long")
    home = log.where("home").selectExpr("season", "venue_id AS club", "game_date", "game_id", "player_id")
    games = home.where("player_id = 2").selectExpr("season", "club", "game_date", "game_id", "game_id + 1 AS j")
    got = sorted((r.from_j, r.to_j, r.rating) for r in teams.roster_spans(log, home, games).where("player_id = 1").collect())
    assert got == [(1, 1, 1450.0), (2, 42, 1510.0), (43, 100, 1600.0)]


def plays():
    """Games of 25 players in two seasons: season, day, game_id, player_id, home, venue_id, rating_after."""
    rng, out, rating = random.Random(5), [], {}
    for n in range(400):
        season = 1994 + n // 200
        day = datetime.datetime(season, 7, 3) + datetime.timedelta(days=(n % 200) // 2 * 3)
        for i, p in enumerate(rng.sample(range(25), 6)):
            rating[p] = rating.get(p, 1500.0) + rng.randint(-3, 3)  # ties are frequent
            out.append((season, day, n, p, i < 3, n % 3 + 25 * (n % 2), rating[p]))
    return out


@pytest.mark.parametrize("size", [7, 10_000])
def test_rosters_against_a_replay(spark, monkeypatch, size):
    """Rows that go by in batches, and a bound that few members reach, lose nobody; an event goes by once and once a block, not once a club."""
    from ladderwork.plans import teams

    monkeypatch.setattr(teams, "NEAR", 5)
    monkeypatch.setattr(teams, "BLOCKS", 4)
    log = spark.createDataFrame(plays(), "season long, game_date timestamp_ntz, game_id long, player_id long, home boolean, venue_id long, rating_after double")
    rows = teams.roster_rows(log).sort("season", "block", F.asc_nulls_first("game_date"), "game_id", "player_id").drop("game_date").toArrow()
    assert rows.num_rows <= len(plays()) + 25 * 2 * 3
    got, before = {}, {}
    for r in (r for b in teams._fields(iter(rows.to_batches(max_chunksize=size))) for r in b.to_pylist()):
        at = (r["season"], r["club"])
        before.setdefault(at, {})[r["block"]] = r["number"]
        got[r["game_id"]] = (*at, r["roster"], round(r["mean_rating"], 6), *[round(r[f"best{n}"], 6) for n in teams.SIZES])
    assert sum(x for v in before.values() for x in v.values()) == 400

    want, last, games = {}, {}, {}
    for season, _, n, p, home, venue, _ in plays():
        if home:
            games.setdefault((season, venue % 25, p), []).append(n)
    for n in range(400):
        here = [r for r in plays() if r[2] == n]
        season, club = here[0][0], here[0][5] % 25
        roster = [p for (s, c, p), played in games.items() if (s, c) == (season, club) and played[0] <= n <= played[-1]]
        best = [x for x, _ in sorted(((last.get(p, 1500.0), p) for p in roster), key=lambda x: (-x[0], x[1]))]
        want[n] = (season, club, len(best), round(sum(best) / len(best), 6), *[round(sum(best[:k]) / len(best[:k]), 6) for k in teams.SIZES])
        last |= {r[3]: r[6] for r in here}
    assert got == want
