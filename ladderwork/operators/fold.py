"""The ordered, zero-sum rating fold.

Ratings depend on all earlier games of the players' league (players who are
linked by games, operators.leagues), so a league of one variant is one
sequence.  All that needs no rating (performance, shares, steps, the mean of
the start ratings) is computed before by DataFrame operations; the fold streams
the sorted rows of a task's leagues in Arrow batches and holds only their
players' ratings.  Variants and leagues run side by side.  A league of more
rows than a task should read is folded in rounds of days, all leagues' rounds
side by side, and the players' ratings are handed from round to round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladderwork.functions.ranks import running_sums
from ladderwork.operators.leagues import leagues, with_hub
from ladderwork.operators.performance import step_size, with_games_before
from ladderwork.schema import UPDATE_SCHEMA, RatingParams
from ladderwork.sources.warehouse import maybe_broadcast, new_path, written

_TYPES = dict(c.split() for c in UPDATE_SCHEMA.split(", "))
_COLUMNS = list(_TYPES)
_INPUT = ["variant", "game_id", "game_date", "season", "track", "player_id", "team_id", "home", "share", "s_team", "perf", "k_eff", "games_before", "start_rating"]
#: Columns of the log that states are taken from.
STATE = ["variant", "player_id", "games_before", "rating_after"]
_GRID_SCHEMA = "season long, player_id long, games_before long, rating_after array<double>"
#: Rows of a league (games, for teams) that a task folds in one round.
ROUND_ROWS = 4_000_000
#: Rows of a league up to which a task holds them for several passes.
HELD_ROWS = 2_000_000
#: Rows that a held pass turns into plain numbers at once.
PASS_ROWS = 50_000
#: Rows of a task on average; a league stays whole.
TASK_ROWS = 250_000


def _sides(rows: dict[str, np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Whether a row's team is the game's second one; shares and, if asked for, home bonus of both teams of each game."""
    games = np.diff(np.append(starts, len(rows["team_id"])))
    second = rows["team_id"] != np.repeat(rows["team_id"][starts], games)
    sides = (~second, second)
    shares = np.stack([np.add.reduceat(np.where(x, rows["share"], 0.0), starts) for x in sides])
    if (shares == 0).any():
        raise ZeroDivisionError("a game has a team without a share")
    home = np.stack([np.logical_or.reduceat(x & rows["home"].astype(bool), starts) for x in sides]) if "home" in rows else None
    return second, shares, home


def _games(rows: dict[str, np.ndarray], starts: np.ndarray, ratings: dict[int, float], p: RatingParams, columns: set[str]) -> dict[str, np.ndarray]:
    """Games of one variant in order: ratings are changed in place; the columns that the log needs are returned.

    Only what depends on ratings is in the loop, and games have a handful of
    rows, so plain numbers are faster there than arrays.
    """
    ends = [*starts[1:].tolist(), len(rows["perf"])]
    second, shares, home = _sides(rows, starts)
    step = rows["k_eff"] * rows["share"]
    scale, fixed = (1.0, 0.0) if p.anchor is None else (p.surprise_scale, p.fixed_anchor)
    players, begin, perf, seen, steps = (x.tolist() for x in (rows["player_id"], rows["start_rating"], rows["perf"], rows["seen_mean"], step))
    known = (step * rows["perf"]).tolist()  # the raw changes if nothing pulls
    if p.theta:
        shared, other, won, weights, bonus = (x.tolist() for x in (rows["share"], second, rows["s_team"], shares.T, (p.home_advantage * home).T))
    before_out, after_out, raw_out, anchors, offsets = [], [], [], [], []
    get = ratings.get
    for g, (a, b) in enumerate(zip(starts.tolist(), ends, strict=True)):
        ids = players[a:b]
        before = [*map(get, ids)]
        if None in before:
            before = [ratings.setdefault(x, r) for x, r in zip(ids, begin[a:b], strict=True)]
        n = b - a
        anchor = sum(before) / n if p.anchor == "game" else seen[a] if p.anchor == "league" else fixed
        if p.theta:
            sums = [0.0, 0.0]
            for r, s, t in zip(before, shared[a:b], other[a:b], strict=True):
                sums[t] += r * s
            gap = sums[0] / weights[g][0] - sums[1] / weights[g][1]
            e = [1 / (1 + 10 ** (-(x + h) / 400)) for x, h in zip((gap, -gap), bonus[g], strict=True)]
            used = perf[a:b] if p.anchor is None else [f - (r - anchor) / scale for f, r in zip(perf[a:b], before, strict=True)]
            raw = [k * (u + p.theta * (w - e[t])) for k, u, w, t in zip(steps[a:b], used, won[a:b], other[a:b], strict=True)]
        elif p.anchor is None:
            raw = known[a:b]
        else:
            raw = [k * (f - (r - anchor) / scale) for k, f, r in zip(steps[a:b], perf[a:b], before, strict=True)]
        offset = sum(raw) / n
        after = [r + (d - offset) for r, d in zip(before, raw, strict=True)]
        ratings.update(zip(ids, after, strict=True))
        before_out += before
        after_out += after
        raw_out += raw
        anchors.append(anchor)
        offsets.append(offset)
    out = {"rating_after": np.array(after_out)}
    if columns <= out.keys():
        return out
    size = np.diff(np.append(starts, len(players)))
    before, raw, offset = np.array(before_out), np.array(raw_out), np.repeat(np.array(offsets), size)
    out |= {"rating_before": before, "delta_raw": raw, "zero_mean_offset": offset, "delta": raw - offset}
    out["perf_used"] = rows["perf"] if p.anchor is None else rows["perf"] - (before - np.repeat(np.array(anchors), size)) / scale
    if "e_team" in columns:
        held = before * rows["share"]
        mean = [np.add.reduceat(np.where(x, held, 0.0), starts) / w for x, w in zip((~second, second), shares, strict=True)]
        e = [1 / (1 + 10.0 ** (-(x + p.home_advantage * h) / 400)) for x, h in zip((mean[0] - mean[1], mean[1] - mean[0]), home, strict=True)]
        out["e_team"] = np.where(second, np.repeat(e[1], size), np.repeat(e[0], size))
    return out


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Where the batch's games begin."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for name in ("game_id", "number"):
        codes = batch.column(name).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole_games(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole games, and where these begin."""
    kept = None
    for batch in batches:
        if kept is not None:
            batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        starts = _starts(batch)
        kept, whole = batch.slice(starts[-1]), batch.slice(0, starts[-1])  # the last game may go on in the next batch
        if whole.num_rows:
            yield whole, starts[:-1]
    if kept is not None:
        yield kept, np.zeros(1, dtype=np.int64)


def _fold(params: list[RatingParams], columns: list[str], last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The log's columns; what the fold does not change passes as Arrow columns.

    No player is in two leagues, so a task's leagues need no order among each other.
    last: only the last row of each of a batch's players.
    """
    ratings = [{} for _ in params]
    made = {"e_team", "perf_used", "rating_before", "delta_raw", "zero_mean_offset", "delta", "rating_after"} & {*columns}

    def run(batch: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        read = ("player_id", "home", "share", "s_team", "perf", "k_eff", "start_rating", "seen_mean")
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in read if c in batch.schema.names}
        rows.setdefault("seen_mean", rows["start_rating"])
        rows["team_id"] = batch.column("team_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        numbers = batch.column("number").to_numpy()[starts]
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist()]
        parts, names, ends = [], [], []
        for i, j in zip(cuts, [*cuts[1:], len(starts)], strict=True):
            a, b, number = starts[i], starts[j] if j < len(starts) else batch.num_rows, numbers[i]
            parts.append(_games({c: x[a:b] for c, x in rows.items()}, starts[i:j] - a, ratings[number], params[number], made))
            names.append(pa.repeat(params[number].variant, b - a))
            ends.append(b - 1 - np.unique(rows["player_id"][a:b][::-1], return_index=True)[1] if last else None)
        arrays = {c: pa.array(np.concatenate([x[c] for x in parts]), from_pandas=True) for c in made} | {"variant": pa.concat_arrays(names)}
        out = pa.RecordBatch.from_arrays([arrays[c] if c in arrays else batch.column(c) for c in columns], names=columns)
        return out.take(pa.array(np.concatenate(ends))) if last else out

    for batch, starts in _whole_games(batches):
        yield run(batch, starts)


def _fold_grid(params: list[RatingParams], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each player and season: the ratings in every set after the player's last game of it.

    The sets differ in k and scale only, so that games go by once: a row of
    the table holds a player's ratings, a column those of a set.
    """
    p, width = params[0], len(params)
    ks, scales = (np.array([getattr(x, c) for x in params]) for c in ("k", "surprise_scale"))
    places: dict[int, int] = {}
    table, last = np.empty((0, width)), {c: np.empty(0, dtype=np.int64) for c in ("season", "player_id", "games_before")}

    def made(columns: dict[str, np.ndarray], at: np.ndarray | slice, ratings: np.ndarray) -> pa.RecordBatch:
        values = np.ascontiguousarray(ratings[at]).ravel()
        lists = pa.ListArray.from_arrays(np.arange(0, len(values) + 1, width, dtype=np.int32), values)
        return pa.RecordBatch.from_arrays([*[pa.array(columns[c][at]) for c in last], lists], names=[*last, "rating_after"])

    for batch, starts in _whole_games(batches):
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*last, "perf", "share", "k_eff")}
        begin = batch.column("start_rating")
        begin = begin.flatten().to_numpy().reshape(-1, width) if pa.types.is_list(begin.type) else np.repeat(begin.to_numpy()[:, None], width, axis=1)
        seen = batch.column("seen_mean").to_numpy() if "seen_mean" in batch.schema.names else begin[:, 0]
        players, first, code = np.unique(rows["player_id"], return_index=True, return_inverse=True)
        known = len(places)
        place = np.array([places.setdefault(x, len(places)) for x in players.tolist()])
        if len(places) > len(table):
            more = 2 * len(places) - len(table)
            table = np.concatenate([table, np.empty((more, width))])
            last = {c: np.concatenate([x, np.zeros(more, dtype=np.int64)]) for c, x in last.items()}
        new = place >= known
        table[place[new]] = begin[first[new]]
        over = place[~new & (last["season"][place] != rows["season"][first])]
        if len(over):
            yield made(last, over, table)

        at, out = place[code], np.empty((batch.num_rows, width))
        step, perf = (rows["k_eff"] * rows["share"])[:, None] * ks, rows["perf"][:, None]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            here, n = at[a:b], b - a
            before = table[here]
            if p.anchor is None:
                raw = step[a:b] * perf[a:b]
            else:
                anchor = np.add.reduce(before) / n if p.anchor == "game" else seen[a] if p.anchor == "league" else p.fixed_anchor
                raw = step[a:b] * (perf[a:b] - (before - anchor) / scales)
            table[here] = out[a:b] = before + (raw - np.add.reduce(raw) / n)

        tail = batch.num_rows - 1 - np.unique(rows["player_id"][::-1], return_index=True)[1]
        ends = np.flatnonzero(~pd.DataFrame({c: rows[c] for c in ("season", "player_id")}).duplicated(keep="last"))
        over = np.setdiff1d(ends, tail)
        if len(over):
            yield made(rows, over, out)
        for c, x in last.items():
            x[place] = rows[c][tail]
    for a in range(0, len(places), 10_000):
        yield made(last, slice(a, min(a + 10_000, len(places))), table)


def _with_rounds(rows: DataFrame, limit: int, reverse: bool = False) -> tuple[DataFrame, int]:
    """rows (league, game_date), written by round: days of a league, in order, of about limit rows; and how many rounds there are."""
    day = F.to_date("game_date")
    days = rows.groupBy("league", day.alias("day")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("league").orderBy(F.desc("day") if reverse else F.asc("day"))) - F.col("n")  # a row a day
    days = written(days.select("league", "day", F.floor(before / limit).cast("int").alias("round")), "rounds")
    path = new_path(rows.sparkSession, "fold-rows")
    dealt = rows.withColumn("day", day).join(maybe_broadcast(days), ["league", "day"]).drop("day")
    dealt.write.partitionBy("round").parquet(path)
    return rows.sparkSession.read.schema(dealt.schema).parquet(path), days.agg(F.max("round")).first()[0] + 1


def _seen_mean(every: DataFrame, reverse: bool) -> DataFrame:
    """every with seen_mean: the mean start rating of the variant's players who play now or have played.

    A game moves its players' ratings by amounts that sum to 0, so this is the
    mean of their present ratings, too.
    """
    game = ["game_date", "game_id"]
    first = (F.max_by if reverse else F.min_by)(F.struct(*game, "start_rating"), F.struct(*game))
    first = every.groupBy("variant", "player_id").agg(first.alias("f")).select("variant", "f.*", F.lit(1).alias("players"))
    marks = first.unionByName(every.select("variant", *game, F.lit(0.0).alias("start_rating"), F.lit(0).alias("players")).distinct())
    marks = marks.groupBy("variant", *game).agg(F.sum("start_rating").alias("starts"), F.sum("players").alias("players"))
    sums = running_sums(marks, ["variant"], [F.desc(c) if reverse else F.asc(c) for c in game], {"all_starts": "starts", "all_players": "players"})
    means = sums.select("variant", *game, (F.col("all_starts") / F.col("all_players")).alias("seen_mean"))
    return every.join(means, ["variant", *game])


def _needed(params: list[RatingParams], columns: list[str]) -> list[str]:
    """The columns of rows that a fold reads for these columns of the log."""
    need = {"game_id", "game_date", "player_id", "team_id", "share", "perf", *columns}
    if any(p.theta for p in params) or "e_team" in columns:
        need |= {"home", "s_team"}
    return [c for c in _INPUT if c in need and c not in ("variant", "k_eff", "games_before", "start_rating")]


def with_leagues(rows: DataFrame, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows, written once with the columns needed of them, and their players' leagues."""
    held = [c for c in rows.columns if c in (*needed, "track", "start_rating")]
    rows = written(with_hub(rows.select(*held)), "fold-input")
    return rows, leagues(rows)


def _tasks(rows: DataFrame, n: int | None) -> int:
    """As many tasks as n rows ask for, each of one variant in the fold: a task's rows do not grow with the table."""
    return max((n or 0) // TASK_ROWS + 1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def counted(rows: DataFrame, players: DataFrame) -> DataFrame:
    """rows with games_before, their players' leagues and n, written once for folds in either direction."""
    tasks = _tasks(rows, players.agg(F.sum("n")).first()[0])
    return written(with_games_before(rows.drop("hub").repartition(tasks, "player_id")).join(maybe_broadcast(players), "player_id"), "counted")


def rating_updates(
    rows: DataFrame, params: list[RatingParams], state: DataFrame | None = None, reverse: bool = False, limit: int = ROUND_ROWS,
    players: DataFrame | None = None, columns: list[str] | None = None, last: bool = False, grid: bool = False,
) -> DataFrame:
    """The event log of every variant.

    rows: one per game and player with perf (operators.performance); games
    must have two teams.  state: player_id, rating, games_played to resume
    from.  reverse: games from last to first, players inside a game as ever.
    limit: rows of a league that are folded in one task.
    players: the leagues of rows that with_leagues or counted has written.
    columns: those of the log that are wanted (all); others are neither moved nor computed.
    last: only some rows of the log, each player's last one among them, for a checkpoint.
    grid: only some rows of the log, each player's last one of a season among them, with the ratings
    in all sets of params, which differ in k and scale only; see grid_updates.
    """
    if len({p.variant for p in params}) != len(params):
        raise ValueError("variants need different names")
    sets = [replace(params[0], variant="grid", k=1.0)] if grid else params  # a step is in proportion to k
    if grid and (params[0].theta or any(replace(p, variant="grid", k=1.0, surprise_scale=sets[0].surprise_scale) != sets[0] for p in params)):
        raise ValueError("the sets of a grid differ in k and scale only, and have no theta")
    given_start = "start_rating" in rows.columns
    if not given_start and state is None and any(p.init_mode == "draft" for p in params):
        raise ValueError("init mode draft needs a start_rating")
    wanted = [c for c in _COLUMNS if columns is None or c in columns]
    kept = [c for c in _COLUMNS if c in wanted or c in STATE]
    needed = _needed(params, kept)
    if players is None:
        rows, players = with_leagues(rows, needed)
    sizes = players.groupBy("league").agg(F.sum("n").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    tasks = _tasks(rows, sizes["all"])
    seed, start = F.lit(0), None
    if given_start:
        start = F.col("start_rating")
    if state is not None:
        given = state.select("player_id", F.col("rating").alias("given_rating"), F.col("games_played").alias("given_games"))
        rows = rows.join(given, "player_id", "left")
        seed = F.coalesce("given_games", F.lit(0))
        start = F.col("given_rating") if start is None else F.coalesce("given_rating", start)
    known = "league" in rows.columns
    if known:
        rows = rows.withColumn("games_before", (F.col("n") - 1 - F.col("games_before") if reverse else F.col("games_before")) + seed)
    else:
        rows = with_games_before(rows.repartition(tasks, "player_id"), seed, reverse)

    def variant(p: RatingParams) -> list[Column]:
        default = F.lit(p.init_value)
        if p.init_mode == "draft":
            default = F.raise_error(F.concat(F.lit("no draft rating for player "), F.col("player_id").cast("string"))).cast("double")
        first = default if start is None else F.coalesce(start, default)
        return [F.lit(p.variant).alias("variant"), first.alias("start_rating"), step_size(p).alias("k_eff")]

    shared = [*needed, "games_before", *(["league"] if known else [])]
    if len(sets) == 1:
        every = rows.select(*variant(sets[0]), *shared)
    else:
        every = rows.select(*shared, F.explode(F.array(*[F.struct(*variant(p)) for p in sets])).alias("v")).select("v.*", *shared)
    if any(p.anchor == "league" for p in sets):
        every = every.withColumn("seen_mean", F.col("start_rating")) if start is None else _seen_mean(every, reverse)  # all may start alike
    if not known:
        every = every.join(maybe_broadcast(players.select("player_id", "league")), "player_id")
    order = [F.desc(c) if reverse else F.asc(c) for c in ("game_date", "game_id")]
    number = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(sets) for x in (p.variant, i)]), F.col("variant"))
    task = (number * tasks + F.pmod(F.xxhash64("league"), F.lit(tasks))).cast("int").alias("task")

    def fold(part: DataFrame) -> DataFrame:
        # A task has one variant, which goes as its number; what only the order needs does not go to Python.
        read = [c for c in part.columns if c not in ("variant", "league", "round", "n")]
        dealt = part.select(*[F.col(c) if c == "start_rating" else F.col(c).cast(_TYPES.get(c, "double")) for c in read], number.alias("number"), task)
        dealt = dealt.repartitionById(tasks * len(sets), "task").sortWithinPartitions(*order, "player_id")
        if grid:
            found = dealt.drop("task", "game_date", "team_id").mapInArrow(lambda batches: _fold_grid(params, batches), _GRID_SCHEMA)
            return found.select(F.lit("grid").alias("variant"), "*")
        dealt = dealt.drop("task", *[c for c in ("game_date",) if c not in kept])
        return dealt.mapInArrow(lambda batches: _fold(params, kept, last, batches), ", ".join(f"{c} {_TYPES[c]}" for c in kept))

    if (sizes["most"] or 0) <= limit:
        return fold(every).select(*wanted)
    every, rounds = _with_rounds(every, limit * len(sets), reverse)
    logs, ratings = None, None
    for r in range(rounds):
        part = every.where(F.col("round") == r)
        if ratings is not None:
            begin = F.array_repeat("start_rating", len(params)) if grid else F.col("start_rating")
            part = part.join(maybe_broadcast(ratings), ["variant", "player_id"], "left").withColumn("start_rating", F.coalesce(F.col("rating"), begin)).drop("rating")
        log = written(fold(part), "round-log")
        logs = log if logs is None else logs.unionByName(log)
        now = log.groupBy("variant", "player_id").agg(F.max_by("rating_after", "games_before").alias("rating"))
        if ratings is not None:
            now = now.unionByName(ratings.join(now, ["variant", "player_id"], "left_anti"))
        ratings = written(now, "round-ratings")
    return logs.select(*wanted)


def grid_updates(rows: DataFrame, params: list[RatingParams], players: DataFrame | None = None, limit: int = ROUND_ROWS) -> DataFrame:
    """season, player_id, games played and ratings (an array in the order of params) after the player's last game of the season.

    The sets differ in k and scale only; rows are dealt and read once for all of them.
    """
    log = rating_updates(rows, params, players=players, limit=limit, columns=["season", *STATE], grid=True)
    return log.groupBy("season", "player_id").agg((F.max("games_before") + 1).alias("games_played"), F.max_by("rating_after", "games_before").alias("ratings"))


def checkpoint(updates: DataFrame, upto: int | None = None) -> DataFrame:
    """Player state after the last game (of seasons up to `upto`), from the log alone.

    Games played count the fold's order, whichever way it goes; a number, unlike
    a struct, is aggregated by hash, without a sort of the log.
    """
    rows = updates if upto is None else updates.where(F.col("season") <= upto)
    return rows.groupBy("variant", "player_id").agg(F.max_by("rating_after", "games_before").alias("rating"), (F.max("games_before") + 1).alias("games_played"))


def three_pass(rows: DataFrame, p: RatingParams, columns: list[str] | None = None, last: bool = False) -> DataFrame:
    """Forward, backward, forward: first-season players start where the backward pass ends."""
    rows, players = with_leagues(rows, _needed([p], ["season", *(_COLUMNS if columns is None else columns)]))
    rows = counted(rows, players)
    forward = written(checkpoint(rating_updates(rows, [p], players=players, columns=STATE, last=True)), "forward")
    backward = rating_updates(rows, [p], forward.select("player_id", "rating", "games_played"), reverse=True, players=players, columns=STATE, last=True)
    ends = checkpoint(backward).select("player_id", "rating")
    opening = rows.select(F.min("season").alias("season"))
    first = rows.join(F.broadcast(opening), "season").select("player_id").distinct()
    state = written(ends.join(first, "player_id").select("player_id", "rating", F.lit(0).cast("long").alias("games_played")), "backward")
    return rating_updates(rows, [p], state, players=players, columns=columns, last=last)


def _three_passes(p: RatingParams, opening: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """player_id, rating and games_played after three passes over a task's rows, which are held as arrays; size: rows that are plain numbers at once."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    batch = table.to_batches()[0]
    rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("player_id", "season", "home", "share", "s_team", "perf", "start_rating", "playoffs") if c in batch.schema.names}
    rows["team_id"] = batch.column("team_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    rows["seen_mean"] = rows["start_rating"]  # for the league's anchor only, which needs another way
    starts = _starts(batch)
    del held, table, batch

    players, code, n = np.unique(rows["player_id"], return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")  # each player's rows from the first to the last
    before = np.empty(len(code), dtype=np.int64)
    before[order] = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)

    def steps(games: np.ndarray) -> np.ndarray:
        k = p.k * (1.0 + (p.rookie_boost - 1.0) * np.exp(-games / p.rookie_tau)) if p.rookie_tau > 0 else np.full(len(games), p.k)
        k = k if p.rookie_ids is None else np.where(np.isin(rows["player_id"], p.rookie_ids), k, p.k)
        return np.where(rows["playoffs"], k * p.playoff_multiplier, k)

    def run(ratings: dict[int, float], rows: dict[str, np.ndarray], starts: np.ndarray) -> None:
        cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(rows["perf"]), size)), len(starts)))
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = starts[i], starts[j] if j < len(starts) else len(rows["perf"])
            _games({c: x[a:b] for c, x in rows.items()}, starts[i:j] - a, ratings, p, {"rating_after"})

    ratings: dict[int, float] = {}
    forward = rows | {"k_eff": steps(before)}
    run(ratings, forward, starts)
    sizes = np.diff(np.append(starts, len(code)))[::-1]
    turned = np.cumsum(sizes) - sizes  # where games begin if the last one is the first; players inside a game stay
    at = np.arange(len(code)) + np.repeat(starts[::-1] - turned, sizes)
    backward = {c: x[at] for c, x in (rows | {"k_eff": steps(2 * n[code] - 1 - before)}).items()}
    run(ratings, backward, turned)
    ratings = {x: ratings[x] for x in np.unique(rows["player_id"][rows["season"] == opening]).tolist()}
    run(ratings, forward, starts)
    yield pa.RecordBatch.from_arrays([pa.array(players), pa.array([ratings[x] for x in players.tolist()], type=pa.float64()), pa.array(n)], names=["player_id", "rating", "games_played"])


def three_pass_states(rows: DataFrame, p: RatingParams) -> DataFrame:
    """player_id, rating and games_played after three_pass.

    A league's passes need nothing of other leagues but the opening season, so
    a task makes all three over its leagues: rows are dealt, sorted and read
    once.  Tables with a league of over HELD_ROWS rows, and the anchor that
    needs all players' ratings, go by three_pass.
    """
    read, players = with_leagues(rows, _needed([p], ["season", *STATE]))
    sizes = players.groupBy("league").agg(F.sum("n").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if p.anchor == "league" or p.init_mode == "draft" or (sizes["most"] or 0) > HELD_ROWS:
        return checkpoint(three_pass(rows, p, STATE, last=True)).drop("variant")
    size = PASS_ROWS
    opening, tasks = read.agg(F.min("season")).first()[0], _tasks(read, sizes["all"])
    start = F.coalesce("start_rating", F.lit(p.init_value)) if "start_rating" in read.columns else F.lit(p.init_value)
    every = read.join(maybe_broadcast(players.select("player_id", "league").hint("shuffle_hash")), "player_id")
    wanted = [c for c in _needed([p], ["season", "player_id"]) if c != "game_date"]
    task = F.pmod(F.xxhash64("league"), F.lit(tasks)).cast("int").alias("task")
    every = every.select(*[F.col(c).cast(_TYPES[c]) for c in wanted], "game_date", start.cast("double").alias("start_rating"), (F.col("track") == "playoffs").alias("playoffs"), F.lit(0).alias("number"), task)
    dealt = every.repartitionById(tasks, "task").sortWithinPartitions("game_date", "game_id", "player_id").drop("task", "game_date")
    return dealt.mapInArrow(lambda batches: _three_passes(p, opening, size, batches), "player_id long, rating double, games_played long")


_TEAM_SCHEMA = "game_id long, game_date timestamp_ntz, team string, rating_before double, expected double, rating_after double"


def team_updates(games: DataFrame, k: float = 20.0, home_advantage: float = 0.0, start: float = 1500.0, limit: int = ROUND_ROWS) -> DataFrame:
    """Team ratings, zero-sum, symmetric home bonus.

    games: game_id, game_date, home_team, away_team, home_won (1.0 or 0.0).
    All teams may be linked, so games go through a task in order, in rounds of
    days of about `limit` games; ratings are handed from round to round.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ratings: dict[str, float] = {}
        for batch in batches:
            before, expected, after = [], [], []
            columns = [batch[c].tolist() for c in ("home_team", "away_team", "home_won", "home_start", "away_start")]
            for home, away, won, home_start, away_start in zip(*columns, strict=True):
                h, a = ratings.get(home, home_start), ratings.get(away, away_start)
                e = 1 / (1 + 10 ** (-(h - a + home_advantage) / 400))
                step = k * (won - e)
                ratings[home], ratings[away] = h + step, a - step
                before += (h, a)
                expected += (e, 1 - e)
                after += (h + step, a - step)
            if len(batch):
                teams = batch[["home_team", "away_team"]].to_numpy().ravel()
                ids, dates = batch["game_id"].repeat(2).to_numpy(), batch["game_date"].repeat(2).to_numpy()
                yield pd.DataFrame(dict(game_id=ids, game_date=dates, team=teams, rating_before=before, expected=expected, rating_after=after))

    one = games.select("game_id", "game_date", "home_team", "away_team", "home_won", F.lit(0).alias("league"))
    one, rounds = _with_rounds(written(one, "team-games"), limit)
    logs, ratings = None, None
    for r in range(rounds):
        part = one.where(F.col("round") == r)
        for side in ("home", "away"):
            if ratings is None:
                part = part.withColumn(f"{side}_start", F.lit(start))
            else:
                given = ratings.select(F.col("team").alias(f"{side}_team"), F.col("rating").alias(f"{side}_start"))
                part = part.join(maybe_broadcast(given), f"{side}_team", "left").withColumn(f"{side}_start", F.coalesce(f"{side}_start", F.lit(start)))
        log = part.repartition(1, "league").sortWithinPartitions("game_date", "game_id").mapInPandas(run, _TEAM_SCHEMA)
        if rounds == 1:
            return log
        log = written(log, "team-log")
        logs = log if logs is None else logs.unionByName(log)
        now = log.groupBy("team").agg(F.max_by("rating_after", F.struct("game_date", "game_id")).alias("rating"))
        ratings = written(now if ratings is None else now.unionByName(ratings.join(now, "team", "left_anti")), "team-ratings")
    return logs


def parameter_table(spark: SparkSession, params: list[RatingParams]) -> DataFrame:
    return spark.createDataFrame([asdict(p) for p in params])
