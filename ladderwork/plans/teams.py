"""Team strength: cores by minutes and by rating, seasons, peak cores, rosters, and the stages against each other.

Home rows name a club (a venue); a club's season is its home games.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.functions import ranks
from ladderwork.plans.registry import query
from ladderwork.plans.timeline import EVENTS_SQL, events
from ladderwork.sources import arena
from ladderwork.sources.warehouse import maybe_broadcast, written

#: Sizes of a core.
SIZES = (2, 3, 5)
#: Games that a player needs for a season's core, and a club for each stage's rank.
CORE_GAMES, REGULAR_GAMES, PLAYOFF_GAMES = 3, 10, 3


def base(log: DataFrame) -> DataFrame:
    """Home rows with the rating before the game and two competing numbers in it: by minutes and by rating."""
    rows = log.where("home").withColumn("club", F.col("venue_id") % 25).withColumn("rating", F.col("rating_after") - F.col("perf"))
    game = Window.partitionBy("game_id")
    by_share = F.row_number().over(game.orderBy(F.round("share", 9).desc(), F.round("rating", 6).desc(), "player_id"))
    by_rating = F.row_number().over(game.orderBy(F.round("rating", 6).desc(), F.round("share", 9).desc(), "player_id"))
    return rows.withColumn("rn", by_share).withColumn("rn_rating", by_rating)


def game_strengths(rows: DataFrame) -> DataFrame:
    """Per game of a club: strength, and for each core size the part of the minutes, its weighted and its best ratings' mean."""
    share, rating = F.col("share"), F.col("rating")
    cores = []
    for n in SIZES:
        inside = F.when(F.col("rn") <= n, share)
        cores += [
            (F.sum(rating * inside) / F.nullif(F.sum(inside), F.lit(0.0))).alias(f"top{n}"), F.sum(inside).alias(f"top{n}_share"),
            F.avg(F.when(F.col("rn_rating") <= n, rating)).alias(f"instant{n}"),
        ]
    return rows.groupBy("game_id", "game_date", "season", "track", "club").agg(F.sum(rating * share).alias("strength"), *cores)


BASE_SQL = f"""{EVENTS_SQL},
base AS (
  SELECT e.game_id, e.game_date, e.season, e.track, c.venue_id % 25 AS club, e.player_id, e.rating_after - e.perf AS rating, c.share
  FROM ev e JOIN clean c USING (game_id, player_id) WHERE c.home),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY round(share, 9) DESC, round(rating, 6) DESC, player_id) AS rn, row_number() OVER (PARTITION BY game_id ORDER BY round(rating, 6) DESC, round(share, 9) DESC, player_id) AS rn_rating FROM base),
tg AS (SELECT game_id, game_date, season, track, club, sum(rating * share) AS strength, {", ".join(
    f"sum(rating * share) FILTER (rn <= {n}) / nullif(sum(share) FILTER (rn <= {n}), 0) AS top{n}, sum(share) FILTER (rn <= {n}) AS top{n}_share, avg(rating) FILTER (rn_rating <= {n}) AS instant{n}" for n in SIZES
)} FROM ranked GROUP BY ALL)"""

_CORES = [f"{kind}{n}{rest}" for n in SIZES for kind, rest in (("top", ""), ("top", "_share"), ("instant", ""))]


def team_games(spark, sf) -> DataFrame:
    return game_strengths(base(events(spark, sf, "share", "home", "venue_id")))


@query(f"WITH {BASE_SQL} SELECT game_id, season, club, round(strength, 4) AS strength, {', '.join(f'round({c}, 4) AS {c}' for c in _CORES)} FROM tg")
def team_game_cores(spark, sf):
    """Strength of a club in each game: all minutes, the two, three and five with most minutes, and the best."""
    return team_games(spark, sf).select("game_id", "season", "club", *[F.round(c, 4).alias(c) for c in ("strength", *_CORES)])


@query(f"""
WITH {BASE_SQL}
SELECT season, club, count(*) AS games, count(*) FILTER (track = 'regular') AS regular_games, count(*) FILTER (track = 'playoffs') AS playoff_games, round(avg(strength), 4) AS mean_strength, round(max(strength), 4) AS peak_strength,
  {', '.join(f'round(avg({c}), 4) AS {c}' for c in _CORES)} FROM tg GROUP BY season, club
""")
def team_season_strength(spark, sf):
    """A club's season: means of the games' strengths and cores."""
    at = lambda c: F.round(c, 4)
    return team_games(spark, sf).groupBy("season", "club").agg(
        F.count("*").alias("games"), F.count_if(F.col("track") == "regular").alias("regular_games"), F.count_if(F.col("track") == "playoffs").alias("playoff_games"),
        at(F.avg("strength")).alias("mean_strength"), at(F.max("strength")).alias("peak_strength"), *[at(F.avg(c)).alias(c) for c in _CORES],
    )


@query(f"""
WITH {BASE_SQL},
ps AS (SELECT season, club, player_id, count(*) AS games, avg(rating) AS mean, sum(share) AS shares FROM base GROUP BY ALL HAVING count(*) >= {CORE_GAMES}),
k AS (SELECT *, row_number() OVER (PARTITION BY season, club ORDER BY round(mean, 6) DESC, games DESC, round(shares, 6) DESC, player_id) AS k FROM ps),
s AS (SELECT unnest({list(SIZES)}) AS size)
SELECT CAST(size AS BIGINT) AS size, season, club, round(avg(mean), 4) AS core_rating, string_agg(CAST(player_id AS VARCHAR), ' / ' ORDER BY k) AS players, string_agg(CAST(games AS VARCHAR), ' / ' ORDER BY k) AS player_games FROM k, s WHERE k <= size GROUP BY ALL
""")
def season_average_cores(spark, sf):
    """The players with the highest mean ratings of a club's season, two, three and five of them."""
    rows = base(events(spark, sf, "share", "home", "venue_id")).groupBy("season", "club", "player_id").agg(F.count("*").alias("games"), F.avg("rating").alias("mean"), F.sum("share").alias("shares"))
    order = Window.partitionBy("season", "club").orderBy(F.round("mean", 6).desc(), F.desc("games"), F.round("shares", 6).desc(), "player_id")
    core = rows.where(F.col("games") >= CORE_GAMES).withColumn("k", F.row_number().over(order)).where(F.col("k") <= max(SIZES))
    core = core.groupBy("season", "club").agg(F.sort_array(F.collect_list(F.struct("k", "player_id", "games", "mean"))).alias("five"))
    core = core.withColumn("size", F.explode(F.array(*map(F.lit, SIZES)))).withColumn("five", F.slice("five", F.lit(1), F.col("size")))
    text = lambda field: F.array_join(F.transform("five", lambda x: x[field].cast("string")), " / ")
    mean = F.aggregate("five", F.lit(0.0), lambda s, x: s + x["mean"]) / F.size("five")
    return core.select(F.col("size").cast("long").alias("size"), "season", "club", F.round(mean, 4).alias("core_rating"), text("player_id").alias("players"), text("games").alias("player_games"))


@query(f"""
WITH {BASE_SQL},
long AS (SELECT *, unnest({list(SIZES)}) AS size, unnest([{', '.join(f'instant{n}' for n in SIZES)}]) AS instant FROM tg),
k AS (SELECT *, row_number() OVER (PARTITION BY size, season, club ORDER BY round(instant, 6) DESC, game_date, game_id) AS k, count(*) OVER (PARTITION BY size, season, club) AS games, avg(strength) OVER (PARTITION BY size, season, club) AS mean FROM long),
line AS (SELECT game_id, string_agg(CAST(player_id AS VARCHAR), ' / ' ORDER BY rn_rating) FILTER (rn_rating <= 2) AS l2, string_agg(CAST(player_id AS VARCHAR), ' / ' ORDER BY rn_rating) FILTER (rn_rating <= 3) AS l3, string_agg(CAST(player_id AS VARCHAR), ' / ' ORDER BY rn_rating) FILTER (rn_rating <= 5) AS l5 FROM ranked GROUP BY game_id)
SELECT CAST(size AS BIGINT) AS size, season, club, game_id AS peak_game, CAST(game_date AS DATE) AS peak_date, round(instant, 4) AS peak_rating, games, round(mean, 4) AS mean_strength, CASE size WHEN 2 THEN l2 WHEN 3 THEN l3 ELSE l5 END AS players FROM k JOIN line USING (game_id) WHERE k = 1
""")
def peak_cores(spark, sf):
    """The game in which a club's best two, three and five were rated highest, who they were, beside the season's mean."""
    rows = written(base(events(spark, sf, "share", "home", "venue_id")), "team-base")
    games = written(game_strengths(rows), "team-games")
    key = lambda n: F.struct(F.round(f"instant{n}", 6), -F.unix_micros(F.col("game_date").cast("timestamp")), -F.col("game_id"))
    best = games.groupBy("season", "club").agg(
        F.count("*").alias("games"), F.avg("strength").alias("mean"), *[F.max_by(F.struct("game_id", "game_date", F.col(f"instant{n}").alias("rating")), key(n)).alias(f"b{n}") for n in SIZES]
    )
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.col(f"b{n}").alias("b")) for n in SIZES]))
    best = best.select("season", "club", "games", "mean", each.alias("x")).select("season", "club", "games", "mean", "x.size", "x.b.*")
    line = rows.where(F.col("rn_rating") <= max(SIZES)).join(maybe_broadcast(best.select("game_id").distinct()), "game_id")
    line = line.groupBy("game_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn_rating", "player_id"))), lambda x: x["player_id"].cast("string")).alias("line"))
    return best.join(line, "game_id").select(
        F.col("size").cast("long").alias("size"), "season", "club", F.col("game_id").alias("peak_game"), F.to_date("game_date").alias("peak_date"), F.round("rating", 4).alias("peak_rating"),
        "games", F.round("mean", 4).alias("mean_strength"), F.array_join(F.slice("line", F.lit(1), F.col("size")), " / ").alias("players"),
    )


@query(f"""
WITH {BASE_SQL},
s AS (SELECT season, club, track, count(*) AS games, round(avg(strength), 6) AS strength FROM tg GROUP BY ALL),
r AS (SELECT *, dense_rank() OVER (ORDER BY strength DESC) AS place FROM s WHERE track = 'regular' AND games >= {REGULAR_GAMES}),
p AS (SELECT *, dense_rank() OVER (ORDER BY strength DESC) AS place FROM s WHERE track = 'playoffs' AND games >= {PLAYOFF_GAMES})
SELECT season, club, r.games AS regular_games, p.games AS playoff_games, r.strength AS regular_strength, p.strength AS playoff_strength, r.place AS regular_place, p.place AS playoff_place, r.place - p.place AS place_gap FROM r JOIN p USING (season, club)
""")
def regular_playoff_gap(spark, sf):
    """Places of clubs' seasons among all of them, by strength in the regular season and in the playoffs."""
    rows = team_games(spark, sf).groupBy("season", "club", "track").agg(F.count("*").alias("games"), F.round(F.avg("strength"), 6).alias("strength"))
    enough = F.when(F.col("track") == "regular", F.col("games") >= REGULAR_GAMES).when(F.col("track") == "playoffs", F.col("games") >= PLAYOFF_GAMES)
    rows = ranks.dense_ranks(written(rows.where(enough), "stages"), ["track"], "strength", "place")
    side = lambda t, name: rows.where(F.col("track") == t).select("season", "club", F.col("games").alias(f"{name}_games"), F.col("strength").alias(f"{name}_strength"), F.col("place").alias(f"{name}_place"))
    return side("regular", "regular").join(side("playoffs", "playoff"), ["season", "club"]).withColumn("place_gap", F.col("regular_place") - F.col("playoff_place"))


#: Blocks of days into which a season is cut; a task takes whole blocks.
BLOCKS = 16
#: Ratings are added up as whole numbers of this part, so that sums of changes are exact.
PART = 1e12
#: A club is a bit of a mask; clubs are remainders by 25, those of negative numbers too.
_BIT = 24
#: Members of a club who are kept in sight of its best; four times as many before the rest go.
NEAR = 64
_BEST = [f"best{n}" for n in SIZES]
_FIELD_SCHEMA = f"season long, block int, club long, number long, game_id long, roster long, mean_rating double, {', '.join(f'{c} double' for c in _BEST)}"


def roster_spans(log: DataFrame, home: DataFrame, games: DataFrame) -> DataFrame:
    """season, club, player_id, rating and the club's game numbers from_j to to_j through which it is the player's last one before the game.

    A membership reaches from a player's first home game to the last.  An
    event of its season starts to hold with the club's first game after it,
    looked up by day; so there are as many rows as events and clubs of their
    players, however many games the members sit out.
    """
    game = F.struct("game_date", "game_id")
    before = F.lag("rating_after").over(Window.partitionBy("player_id").orderBy("game_date", "game_id"))
    rows = written(log.select("season", "player_id", "game_date", "game_id", "rating_after", F.coalesce(before, F.lit(1500.0)).alias("before")), "roster-log")
    here = home.join(games.select("game_id", "j"), "game_id").join(rows.select("game_id", "player_id", "before"), ["game_id", "player_id"])
    members = here.groupBy("season", "club", "player_id").agg(F.min("j").alias("first_j"), F.max("j").alias("last_j"), F.min_by("before", "j").alias("before"))
    members = written(members, "members")
    days = rows.select("season", F.to_date("game_date").alias("day")).distinct().crossJoin(F.broadcast(games.select("club").distinct()))  # days x clubs
    own = games.groupBy("season", "club", F.to_date("game_date").alias("day")).agg(F.sort_array(F.collect_list(game)).alias("at"), F.count("*").alias("n"))
    held = F.coalesce(F.sum("n").over(Window.partitionBy("season", "club").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a day
    days = days.join(own, ["season", "club", "day"], "left").withColumn("held", held)
    changes = rows.withColumn("day", F.to_date("game_date")).join(members.drop("before"), ["season", "player_id"]).join(days, ["season", "club", "day"])
    j = F.col("held") + F.coalesce(F.size(F.filter("at", lambda g: g <= game)), F.lit(0)) + 1
    changes = changes.withColumn("j", F.when(F.col("at").isNull(), F.col("held") + 1).otherwise(j)).where("j > first_j and j <= last_j")
    changes = changes.groupBy("season", "club", "player_id", "last_j", "j").agg(F.max_by("rating_after", game).alias("rating"))
    both = changes.unionByName(members.select("season", "club", "player_id", "last_j", F.col("first_j").alias("j"), F.col("before").alias("rating")))
    until = F.lead("j").over(Window.partitionBy("season", "club", "player_id").orderBy("j")) - 1
    return both.select("season", "club", "player_id", "rating", F.col("j").alias("from_j"), F.coalesce(until, "last_j").alias("to_j"))


def roster_rows(log: DataFrame) -> DataFrame:
    """A row for each event, and one for each block of days that a member enters with the rating of its last event.

    A membership reaches from a player's first home game of a season to the
    last; members: the clubs, as bits, that the player is in after the game.
    club, enters: of a home game, and whether it is the player's first one;
    rating, place: after the game, before, place_before: before it.
    """
    order = ["game_date", "game_id"]
    career, season = (Window.partitionBy(*keys).orderBy(*order) for keys in (["player_id"], ["player_id", "season"]))
    own = Window.partitionBy("player_id", "season", "club").orderBy(*order)
    rows = log.select("season", *order, "player_id", F.col("rating_after").alias("rating"), F.when(F.col("home"), F.col("venue_id") % 25).alias("club"))
    rows = rows.where("season is not null and player_id is not null").withColumn("place", -F.round("rating", 6))
    rows = rows.withColumn("before", F.coalesce(F.lag("rating").over(career), F.lit(1500.0))).withColumn("place_before", F.coalesce(F.lag("place").over(career), F.lit(-1500.0)))
    day = F.datediff("game_date", F.make_date(F.col("season").cast("int"), F.lit(7), F.lit(1)))
    rows = rows.withColumn("block", F.greatest(F.lit(0), F.least(F.lit(BLOCKS - 1), F.floor(day * BLOCKS / 366).cast("int"))))
    at_home = F.col("club").isNotNull()
    rows = rows.withColumn("enters", at_home & F.lag("game_id").over(own).isNull()).withColumn("leaves", at_home & F.lead("game_id").over(own).isNull())
    bit = F.when(at_home, F.expr(f"shiftleft(1L, int(club + {_BIT}))")).otherwise(0)
    members = F.sum(F.when(F.col("enters"), bit).otherwise(0) - F.when(F.col("leaves"), bit).otherwise(0)).over(season)
    rows = rows.withColumn("members", members).withColumn("until", F.lead("block").over(season))
    until = F.when(F.col("members") != 0, F.coalesce("until", "block")).otherwise(F.col("block"))
    rows = rows.withColumn("at", F.explode(F.sequence("block", until)))
    event = F.col("at") == F.col("block")
    return rows.select(
        "season", F.col("at").alias("block"), F.when(event, F.col("game_date")).alias("game_date"), "game_id", event.alias("event"), "player_id",
        F.when(event & at_home, F.col("club")).otherwise(_BIT + 1).alias("club"), "enters", "before", "place_before", "rating", "place", "members",
    )


class _Club:
    """A club's members: how many, the sum of their ratings, and its best.

    near holds every member whose key (place, player) is under bound.
    """

    __slots__ = ("bit", "bound", "least", "means", "n", "near", "number", "stale", "top", "total")

    def __init__(self, bit: int) -> None:
        self.bit, self.n, self.number, self.total, self.near, self.bound = bit, 0, 0, 0, {}, (np.inf, 0)
        self.top, self.least, self.means, self.stale = (), (np.inf, 0), (), True

    def seen(self, player: int, key: tuple[float, int]) -> None:
        if key < self.bound:
            self.near[player] = key
            if len(self.near) > 4 * NEAR:
                self.keep(self.near.values())
        else:
            self.near.pop(player, None)
        if key < self.least or player in self.top:
            self.stale = True

    def gone(self, player: int, part: int) -> None:
        self.n -= 1
        self.total -= part
        self.near.pop(player, None)
        if player in self.top:
            self.stale = True

    def keep(self, keys: Iterable[tuple[float, int]]) -> None:
        first = heapq.nsmallest(NEAR + 1, keys)
        self.bound = first.pop() if len(first) > NEAR else (np.inf, 0)
        self.near = {key[1]: key for key in first}

    def best(self, held: dict[int, tuple]) -> tuple[float, ...]:
        """Means of the ratings of the best, who are looked up again only after an event that touched them."""
        if self.stale:
            most = max(SIZES)
            if len(self.near) < min(most, self.n):
                self.keep([h[0] for h in held.values() if h[3] & self.bit])
            best = heapq.nsmallest(most, self.near.values())
            self.top, self.least, self.stale = {p for _, p in best}, best[-1] if len(best) == most else (np.inf, 0), False
            ratings = [held[p][1] for _, p in best]
            self.means = tuple(sum(ratings[:n]) / min(n, len(ratings)) for n in SIZES)
        return self.means


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The roster at each game of a club; number counts its games in the block.

    A block's rows go by in order, first those of the members that enter it.
    Inside a game players enter, the club is asked, then ratings change and
    players leave.  Only the block's members are held.
    """
    names = ("game_id", "event", "player_id", "club", "enters", "before", "place_before", "rating", "place", "members")
    at, game, host, waiting = None, None, None, []
    held: dict[int, tuple] = {}  # player: key, rating, its parts, clubs
    clubs: dict[int, _Club] = {}

    def enter(player: int, key: tuple[float, int], rating: float, part: int, bits: int) -> None:
        held[player] = (key, rating, part, (held[player][3] if player in held else 0) | bits)
        while bits:
            low = bits & -bits
            bits ^= low
            club = clubs.get(low) or clubs.setdefault(low, _Club(low))
            club.n += 1
            club.total += part
            club.seen(player, key)

    def played() -> Iterator[tuple]:
        if host is not None:
            club = clubs[1 << (host + _BIT)]
            club.number += 1
            yield (*at, host, club.number, game, club.n, float(club.total) / PART / club.n, *club.best(held))
        for player, rating, place, part, bits in waiting:
            old = held.get(player)
            if old is None:
                continue
            key, change, gone = (place, player), part - old[2], old[3] & ~bits
            if bits:
                held[player] = (key, rating, part, bits)
            else:
                del held[player]
            while bits:
                low = bits & -bits
                bits ^= low
                club = clubs[low]
                club.total += change
                if key < club.bound or player in club.near:
                    club.seen(player, key)
            while gone:
                low = gone & -gone
                gone ^= low
                clubs[low].gone(player, old[2])
        waiting.clear()

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind.type) for x, kind in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    fields = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in _FIELD_SCHEMA.split(", "))])
    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("season", "block", *names)}
        parts = [(rows[c] * PART).astype(np.int64).tolist() for c in ("before", "rating")]
        blocks = zip(rows["season"].tolist(), rows["block"].tolist(), strict=True)
        out = []
        for block, before_part, part, g, event, player, club, enters, before, place_before, rating, place, bits in zip(blocks, *parts, *[rows[c].tolist() for c in names], strict=True):
            if game is not None and (g != game or block != at):
                out += played()
                game, host = None, None
            if block != at:
                at = block
                held.clear()
                clubs.clear()
            if not event:
                enter(player, (place, player), rating, part, bits)
                continue
            game = g
            if club <= _BIT:
                host = club
                if enters:
                    enter(player, (place_before, player), before, before_part, 1 << (club + _BIT))
            waiting.append((player, rating, place, part, bits))
        if out:
            yield made(out)
    if game is not None and (out := [*played()]):
        yield made(out)


@query(f"""
WITH {BASE_SQL},
g AS (SELECT *, row_number() OVER (PARTITION BY season, club ORDER BY game_date, game_id) AS j FROM (SELECT DISTINCT season, club, game_date, game_id FROM base)),
m AS (SELECT b.season, b.club, b.player_id, min(j) AS a, max(j) AS z FROM base b JOIN g USING (game_id) GROUP BY ALL),
asked AS (SELECT g.season, g.club, g.game_id, g.game_date, g.j, m.player_id FROM m JOIN g ON g.season = m.season AND g.club = m.club AND g.j BETWEEN m.a AND m.z),
seen AS (SELECT a.season, a.club, a.game_id, a.j, a.player_id, coalesce(arg_max(e.rating_after, struct_pack(d := e.game_date, g := e.game_id)), 1500) AS rating
  FROM asked a LEFT JOIN ev e ON e.player_id = a.player_id AND (e.game_date, e.game_id) < (a.game_date, a.game_id) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY round(rating, 6) DESC, player_id) AS k FROM seen)
SELECT season, club, j AS game_no, game_id, count(*) AS roster, round(avg(rating), 4) AS mean_rating, round(avg(rating) FILTER (k <= 2), 4) AS best2, round(avg(rating) FILTER (k <= 3), 4) AS best3, round(avg(rating) FILTER (k <= 5), 4) AS best5 FROM k GROUP BY ALL
""")
def roster_strength(spark, sf):
    """What a club could field at each game: the whole roster's ratings as of it, best two, three and five.

    An event goes to one task, whatever clubs its player is in: a task takes
    blocks of days of a season with all clubs.
    """
    rows = roster_rows(events(spark, sf, "home", "venue_id"))
    seasons = arena.games(spark, sf).agg(F.min("season"), F.max("season") - F.min("season") + 1).first()
    lines = arena.read(spark, sf, "lineitem").count()
    tasks = min((seasons[1] or 1) * BLOCKS, max(lines // arena.TASK_LINES + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    task = F.pmod((F.col("season") - F.lit(seasons[0] or 0)) * BLOCKS + F.col("block"), F.lit(tasks)).cast("int")
    dealt = rows.withColumn("task", task).repartitionById(tasks, "task")
    dealt = dealt.sortWithinPartitions("season", "block", F.asc_nulls_first("game_date"), "game_id", "player_id").drop("task", "game_date")
    fields = written(dealt.mapInArrow(_fields, _FIELD_SCHEMA), "roster-fields")

    held = fields.groupBy("season", "club", "block").agg(F.max("number").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("season", "club").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a block
    out = fields.join(F.broadcast(held.select("season", "club", "block", earlier.alias("earlier"))), ["season", "club", "block"])  # a row a season, club and block
    number = (F.col("earlier") + F.col("number")).alias("game_no")
    return out.select("season", "club", number, "game_id", "roster", *[F.round(c, 4).alias(c) for c in ("mean_rating", *_BEST)])
