"""Readers, writers and the warehouse by round trip."""

import json

import pytest
from pyspark.sql import functions as F

from ladderwork.functions import scalar
from ladderwork.operators import curves
from ladderwork.plans import folds
from ladderwork.plans.curves import all_curves
from ladderwork.schema import CHECKPOINT_SCHEMA
from ladderwork.sources import readers, sinks, warehouse


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("compressed", [False, True])
def test_csv_round_trip(spark, tmp_path, compressed):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None), (3, 'q"x', -2.0)], "id long, name string, v double")
    path = str(tmp_path / "x")
    sinks.write_csv(df, path, compressed=compressed)
    assert rows_of(readers.read_csv(spark, path, df.schema)) == rows_of(df)
    sinks.write_csv(df, path, compressed=compressed, append=True)
    back = readers.read_csv(spark, path, df.schema, ["id"])
    assert back.columns == ["id"] and sorted(r.id for r in back.collect()) == [1, 1, 2, 2, 3, 3]


def test_unreadable_fields_become_null_and_missing_columns_are_added(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,v\n1,2.5\n2,what\nthree,4\n")
    back = readers.read_csv(spark, str(tmp_path / "x.csv"), "id long, v double").collect()
    assert [(r.id, r.v) for r in back] == [(1, 2.5), (2, None), (None, 4.0)]
    out = readers.with_schema(spark.createDataFrame([(7, 1.0)], "player_id int, extra double"), CHECKPOINT_SCHEMA)
    assert out.columns == ["player_id", "rating", "games_played"] and tuple(out.first()) == (7, None, None)


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_checkpoint_round_trip(spark, tmp_path, kind):
    state = spark.createDataFrame([(101, 1505.0, 2), (201, 1499.0, 1), (301, 1490.0, 3)], CHECKPOINT_SCHEMA)
    path = str(tmp_path / f"state.{kind}")
    state.toPandas().to_csv(path, index=False) if kind == "csv" else state.write.parquet(path)
    assert rows_of(readers.read_checkpoint(spark, path)) == rows_of(state)


def test_event_log_is_partitioned_and_reads_back(spark, sf, tmp_path):
    log = folds.season_log(spark, sf)
    path = str(tmp_path / "log")
    sinks.write_events(log, path)
    back = spark.read.parquet(path)
    assert back.count() == log.count()
    plan = back.where("season = 2001 and variant = 'base'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan or "(season#" in plan
    one, other = (sinks.content_hash(x.select("game_id", "player_id", F.round("rating_after", 9).alias("r"))).first() for x in (log, back))
    assert one == other


def test_hashes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    assert sinks.content_hash(a).first() == sinks.content_hash(a.orderBy(F.desc("id"))).first()
    assert sinks.content_hash(a).first() != sinks.content_hash(a.where("id = 1")).first()
    one, two = sinks.params_hash(a), sinks.params_hash(a.select("v", "id"))
    assert sorted(r.params_hash for r in one.collect()) == sorted(r.params_hash for r in two.collect())


def test_frames_as_json(spark, tmp_path):
    rows = spark.createDataFrame([("d", 2, 7), ("d", 1, 9), ("e", 1, 7)], "day string, place long, player long")
    sinks.write_frames(rows, str(tmp_path / "f"), "day", "place", ["player"])
    found = {r.day: json.loads(r.frame) for r in spark.read.json(str(tmp_path / "f")).collect()}
    assert found == {"d": {"top": [{"place": 1, "player": 9}, {"place": 2, "player": 7}]}, "e": {"top": [{"place": 1, "player": 7}]}}


def test_parameter_grid():
    grid = readers.parameter_grid('{"k": [20.0, 45.0], "theta": [0.0, 0.6]}')
    assert [(p.k, p.theta) for p in grid] == [(20.0, 0.0), (20.0, 0.6), (45.0, 0.0), (45.0, 0.6)] and len({p.variant for p in grid}) == 4
    assert readers.parameter_grid('[{"variant": "a", "k": 10}]')[0].variant == "a"
    with pytest.raises(ValueError):
        readers.parameter_grid('[{"surprise_scale": 0}]')


def test_many_to_one_join_is_validated(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k long, v string")
    right = spark.createDataFrame([(1, "x"), (2, None)], "k long, w string")
    got = {(r.v, r.w) for r in warehouse.many_to_one(left, right, ["k"]).collect()}
    assert got == {("a", "x"), ("b", "x"), ("c", None), ("d", None)}
    with pytest.raises(Exception, match="repeats"):
        warehouse.many_to_one(left, right.unionAll(right), ["k"]).collect()


def test_bound_values_are_not_text(spark):
    rows = spark.createDataFrame([(1, "a' OR '1'='1"), (2, "b")], "k long, v string")
    assert [r.k for r in warehouse.bound(spark, "SELECT k FROM {rows} WHERE v = :v", {"v": "a' OR '1'='1"}, rows=rows).collect()] == [1]


def test_named_values_and_results(spark):
    cells = spark.createDataFrame([("A B (2100.5)",), ("A (x)",), (None,), ("(1) (2)",)], "c string")
    name, value = scalar.named_value(F.col("c"))
    assert [tuple(r) for r in cells.select(name, value).collect()] == [("A B", 2100.5), (None, None), (None, None), ("(1)", 2.0)]
    games = spark.createDataFrame([(True, 101, 99), (True, 90, 99), (False, 90, 99), (False, 101, 99)], "home boolean, h long, g long")
    text = scalar.result_text(F.col("home"), F.col("h"), F.col("g"))
    assert [r[0] for r in games.select(text).collect()] == ["W 101-99", "L 90-99", "W 90-99", "L 99-101"]


def test_kmeans_inertia_and_order(spark, sf):
    """More rounds never raise the inertia; centres come in order of their peak."""
    rows = all_curves(spark, sf).cache()

    def inertia(centres):
        return curves.assigned(rows, centres).agg(F.sum(F.col("distance") ** 2)).first()[0]

    found = [curves.kmeans(rows, 3, starts=1, iterations=n) for n in (1, 3, 8)]
    sums = [inertia(c) for c in found]
    assert sums == sorted(sums, reverse=True)
    peaks = [max(range(len(c)), key=c.__getitem__) for c in found[-1]]
    assert peaks == sorted(peaks)
    rows.unpersist()


def test_block_sums_of_equal_and_near_curves():
    """Distances by products must not leave noise between equal curves; equal to differences elsewhere."""
    import numpy as np
    import pandas as pd

    from ladderwork.operators import curves

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 41))
    x[100:200] = x[:100]
    x[200:250] = x[:50] + 1e-9
    frame = pd.DataFrame({"player_id": range(300), "cluster": [i % 3 for i in range(300)], "curve": list(x)})
    got = {(r.player_id, r.c): (r.s, r.n) for r in curves._block_sums(frame, frame).itertuples()}
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    for i in range(300):
        for c in range(3):
            mine = [j for j in range(300) if j % 3 == c and j != i]
            assert got[i, c][1] == len(mine) and abs(got[i, c][0] - d[i, mine].sum()) < 1e-9
    pair = frame[frame.player_id.isin([0, 100])].assign(cluster=0)
    assert set(curves._block_sums(pair, pair).s) == {0.0}


def test_several_k_in_one_fit_are_the_single_fits(spark):
    import numpy as np

    from ladderwork.operators import curves

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=41).cumsum().tolist()) for i in range(60)], "player_id long, curve array<double>")
    many = curves.kmeans_each(df, (2, 3), starts=3)
    for k in (2, 3):
        assert np.allclose(many[k], curves.kmeans(df, k, starts=3), atol=1e-9)
