"""Places at a time of one's own against a plain count: ties, gaps, one hot group, several ranges."""

import datetime
import random

import pytest

from ladderwork.operators.dominance import DominanceParams, places

DAY = datetime.date(2000, 1, 1)
SCHEMA = "grp long, who long, rating double, t date, until date, asked boolean"


def states():
    rng, out = random.Random(8), []
    for grp, players in ((1, 160), (2, 5), (3, 1), (None, 4)):
        for who in range(players):
            times = sorted(rng.sample(range(60), rng.randint(1, 9)))
            for k, t in enumerate(times):
                until = times[k + 1] if k + 1 < len(times) else (None if rng.random() < 0.7 else t + rng.randint(1, 20))
                out.append((grp, who, float(rng.randint(0, 30)), t, until, rng.random() < 0.3))
    return out


def brute(rows):
    out = []
    for g, who, r, t, _, asked in rows:
        if asked and g is not None:
            held = [(x[2], x[1]) for x in rows if x[0] == g and x[3] <= t and (x[4] is None or x[4] > t)]
            out.append((g, who, t, len(held), 1 + sum(a > r or (a == r and b < who) for a, b in held)))
    return sorted(out)


@pytest.mark.parametrize("p", [DominanceParams(), DominanceParams(range_points=40, rows=3)])
def test_places(spark, p):
    rows = states()
    day = lambda t: None if t is None else DAY + datetime.timedelta(t)
    df = spark.createDataFrame([(g, w, r, day(t), day(u), a) for g, w, r, t, u, a in rows], SCHEMA).repartition(3)
    got = sorted((r.grp, r.who, (r.t - DAY).days, r.active, r.place) for r in places(df, p).collect())
    assert got == brute(rows) and len(got) > 200


def test_places_of_nothing(spark):
    assert places(spark.createDataFrame([], SCHEMA)).count() == 0
    unasked = spark.createDataFrame([(1, 1, 1.0, DAY, None, False)], SCHEMA)
    assert places(unasked).count() == 0


def test_tasks_do_not_grow_with_the_ranges(spark):
    """Many ranges are cut inside a few tasks, whose files would otherwise be one a range."""
    df = spark.createDataFrame([(1, w, float(w % 97), DAY, None, w % 50 == 0) for w in range(2000)], SCHEMA)
    found = places(df, DominanceParams(range_points=8))
    jobs = [f for f in found.inputFiles() if "ranged-points" in f]
    assert 0 < len(set(jobs)) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.place for r in found.collect()) == sorted(1 + sum((x % 97, -x) > (w % 97, -w) for x in range(2000)) for w in range(0, 2000, 50))
