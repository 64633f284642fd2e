"""SQLite as a source, and bulk loads with replacement."""

import math
import sqlite3

from ladderwork.sources import sqlite, warehouse


def made(path):
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE games (game_id INTEGER PRIMARY KEY, team TEXT, points REAL, note BLOB)")
    db.executemany("INSERT INTO games VALUES (?, ?, ?, ?)", [(i * 3, f"t{i % 4}", None if i % 7 == 0 else i / 2, b"x" if i % 2 else None) for i in range(1, 101)])
    db.execute("INSERT INTO games VALUES (999, 5, 'not a number', 'text')")
    db.execute('CREATE TABLE "odd name" (a INTEGER)')
    db.commit()
    db.close()


def test_table_in_ranges(spark, tmp_path):
    path = str(tmp_path / "x.db")
    made(path)
    df = sqlite.read_table(spark, path, "games", 5)
    assert dict(df.dtypes) == {"game_id": "bigint", "team": "string", "points": "double", "note": "binary"}
    rows = {r.game_id: r for r in df.collect()}
    assert len(rows) == 101 and rows[6].points == 1.0 and rows[21].points is None and bytes(rows[3].note) == b"x"
    assert (rows[999].team, rows[999].points, rows[999].note) == ("5", None, None)
    assert df.rdd.getNumPartitions() == 5
    assert sqlite.read_table(spark, path, "odd name").count() == 0


def test_query_with_bound_values(spark, tmp_path):
    path = str(tmp_path / "x.db")
    made(path)
    query = "SELECT team, count(*) AS n FROM games WHERE team IN (:a, :b) GROUP BY team"
    got = {r.team: r.n for r in sqlite.read_query(spark, path, query, {"a": "t1", "b": "t2' OR 1=1"}, "team string, n long").collect()}
    assert got == {"t1": 25}
    assert [c for c, _ in sqlite.read_query(spark, path, "SELECT team, 1 AS one FROM games").dtypes] == ["team", "one"]


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = "player_id long, season long, rating double, team string"
    first = spark.createDataFrame([(1, 1, 10.0, "a"), (1, 2, math.nan, "a"), (None, 1, 3.0, None), (2, 1, 1.0, "b"), (2, 1, 5.0, "a")], schema)
    warehouse.upsert(spark, first, ["player_id", "season"], path, 0)
    for _ in range(2):  # a version that runs again is the same
        warehouse.upsert(spark, spark.createDataFrame([(1, 1, 11.0, "c"), (3, 1, 7.0, "d"), (None, 1, 4.0, "z")], schema), ["player_id", "season"], path, 1)
    got = {(r.player_id, r.season): (r.rating, r.team) for r in spark.read.parquet(f"{path}/version=1").collect()}
    assert got == {(1, 1): (11.0, "c"), (1, 2): (None, "a"), (2, 1): (5.0, "a"), (3, 1): (7.0, "d"), (None, 1): (4.0, "z")}
