"""Every query of the rating engine against its SQL twin; the rest must have rows."""

import pytest

from ladderwork.plans import registry
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        assert_same(df, registry.ORACLES[name], sf)
    else:
        assert df.count() > 0


def test_entry_imports_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())


def test_a_season_of_the_event_log(spark, sf):
    from ladderwork.plans import folds

    assert_same(folds._shown(folds.season_log(spark, sf)), folds.SEASON_LOG_SQL, sf)


def test_entries_and_exits_with_absent_players(spark):
    import datetime

    from ladderwork.plans.evaluation import entries_exits

    seasons = {1: [1990, 1991, 1993], 2: [1990], 3: [1991, 1992, 1993]}
    rows = [("all", s * 10 + p, datetime.datetime(s, 11, 1), s, p, 1500.0 + p) for p, at in seasons.items() for s in at]
    log = spark.createDataFrame(rows, "variant string, game_id long, game_date timestamp, season long, player_id long, rating_after double")
    out = {r.season: (r.players, r.entries, r.exits, r.exit_median) for r in entries_exits(log).collect()}
    assert out == {1990: (2, 2, 1, 1502.0), 1991: (2, 1, 1, 1501.0), 1992: (1, 0, 0, None), 1993: (2, 0, 2, 1502.0)}
