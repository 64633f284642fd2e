"""Exact quantiles against NumPy: one range or many rounds, ties, nulls, hot groups, weights."""

import math

import numpy as np
import pytest

from ladderwork.functions.selection import SelectionParams, described, quantiles, weighted_quantiles

POINTS = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.731, "f": 0.9, "g": 1.0}


def rows():
    rng = np.random.default_rng(4)
    out = [("hot", float(x), 0, float(rng.integers(0, 5))) for x in rng.normal(size=3000)]
    out += [("ties", float(x), 0, 1.0) for x in rng.integers(0, 4, 900)]
    out += [("one", 7.0, 0, 2.0)] * 700  # a single value
    out += [("wide", float(s * 10.0**e), 0, 1.0) for e in range(-300, 300, 2) for s in (-1, 1)]
    out += [(None, float(x), 0, 1.0) for x in range(50)] + [("two", 1.0, 0, 1.0), ("two", 2.0, 0, 1.0), ("single", -0.0, 0, 3.0)]
    return out + [("two", None, 0, 1.0), ("empty", None, 0, 1.0), ("weightless", 4.0, 0, 0.0), ("weightless", 5.0, 0, None)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "k string, v double, lo int, w double").repartition(4)


def groups():
    out = {}
    for k, v, _, w in rows():
        if v is not None:
            out.setdefault(k, []).append((v, w))
    return out


@pytest.mark.parametrize("p", [SelectionParams(), SelectionParams(small=40, splits=4), SelectionParams(small=1, splits=16)])
def test_quantiles(table, p):
    got = {r.k: r for r in quantiles(table, ["k"], "v", POINTS, p).collect()}
    want = groups()
    assert set(got) == set(want)
    for k, vs in want.items():
        for n, q in POINTS.items():
            assert math.isclose(got[k][n], float(np.quantile([v for v, _ in vs], q)), rel_tol=1e-9, abs_tol=1e-12), (k, n)


@pytest.mark.parametrize("p", [SelectionParams(), SelectionParams(small=40, splits=4)])
def test_weighted_quantiles(table, p):
    got = {r.k: r for r in weighted_quantiles(table, ["k"], "v", "w", POINTS, p).collect()}
    for k, vs in groups().items():
        vs = sorted((v, w) for v, w in vs if w)
        assert (k in got) == bool(vs)
        for n, q in POINTS.items():
            total = running = 0.0
            for _, w in vs:
                total += w
            for v, w in vs:
                running += w
                if running >= q * total:
                    assert got[k][n] == v, (k, n)
                    break


def test_without_keys_and_of_nothing(spark, table):
    whole = quantiles(table, [], "v", {"m": 0.5}, SelectionParams(small=100, splits=8)).first()
    assert math.isclose(whole.m, float(np.median([v for vs in groups().values() for v, _ in vs])), rel_tol=1e-12)
    assert quantiles(table.limit(0), ["k"], "v", {"m": 0.5}).count() == 0 and quantiles(table.limit(0), [], "v", {"m": 0.5}).count() == 0


def test_described(table):
    row = described(table.where("k = 'hot'"), ["k"], "v", {"q": 0.25}, SelectionParams(small=100, splits=8)).first()
    v = np.array([v for v, _ in groups()["hot"]])
    assert row.n == 3000 and np.allclose([row.mean, row.sd, row.least, row.q, row.greatest], [v.mean(), v.std(ddof=1), v.min(), np.quantile(v, 0.25), v.max()])
