"""op11 against brute force: recall, no false link, hot groups in blocks, nulls, ties, repeated rows, empty tables."""

import numpy as np
import pytest

from ladderwork.llm import embeddings
from ladderwork.llm.embeddings import EmbeddingParams
from tests.compare import assert_same

SCHEMA = "vec_id long, embedding array<float>, label int, class string, list string, n string"


def clusters(seed, groups, size, spread, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        out += [centre + rng.normal(size=dim) * spread / np.sqrt(dim) for _ in range(size)]
    return out


def table():
    """Random vectors, groups around the threshold (their cosines spread over 0.9 to 0.97), one tight hot group, odd rows."""
    vectors = clusters(1, 900, 1, 0) + clusters(2, 60, 5, 0.26) + clusters(3, 1, 400, 0.1)
    rows = [(i, [float(np.float32(x)) for x in v], i % 3) for i, v in enumerate(vectors)]
    rows += [(5000 + i, r[1], r[2]) for i, r in enumerate(rows[:40])]  # equal vectors
    rows += [(5000, rows[1][1], 1), (6000, [2 * x for x in rows[3][1]], 0), (6001, rows[3][1], None), (None, rows[3][1], 0), (None, [1.0] * 64, 7)]
    rows += [(6002, None, 1), (6003, [], 1), (6004, [0.0] * 64, 1), (6005, [None] + [1.0] * 63, 1), (6006, [float("nan")] + [1.0] * 63, 1)]
    rows += [(6007, [float("inf")] + [1.0] * 63, 1), (6008, [1.0, 2.0], 1), (6009, [2.0, 4.0], 1), (6010, [1e38] * 64, 1), (6011, [1e-38] * 64, 1), (6012, [0.0, -0.0, 1.0], 1)]
    return rows


def brute(rows, cosine):
    n, usable = len(rows), []
    for k, (_, v, label) in enumerate(rows):
        if v and label is not None and None not in v and np.isfinite(v).all() and np.any(v):
            usable.append(k)
    links, root = {k: set() for k in range(n)}, list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    by = {}
    for k in usable:
        by.setdefault((rows[k][2], len(rows[k][1])), []).append(k)
    for ks in by.values():
        v = np.array([rows[k][1] for k in ks])
        v /= np.abs(v).max(axis=1, keepdims=True)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        for i, j in zip(*np.nonzero(np.triu(v @ v.T >= cosine, 1))):
            links[ks[i]].add(ks[j])
            links[ks[j]].add(ks[i])
            root[find(ks[i])] = find(ks[j])
    least = {}
    for k in range(n):
        if rows[k][0] is not None:
            least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    return sorted((str(rows[k][0]), len(links[k]), str(least.get(find(k))), rows[k][0] == least.get(find(k))) for k in range(n))


def shown(df):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


@pytest.mark.parametrize("p", [EmbeddingParams(list_rows=20, members=64, visitors=100), EmbeddingParams(), EmbeddingParams(list_rows=10**9)])
def test_links_against_brute_force(spark, p):
    rows = table()
    got = shown(embeddings.near_duplicates(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3), p))
    want = brute(rows, p.cosine)
    assert [(r[0]) for r in got] == [(r[0]) for r in want]
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert there > 10_000 and 0.99 * there <= found <= there
    if p.list_rows > len(rows):  # one list: nothing can be missed
        assert got == want
    assert sum(a[2:] != b[2:] for a, b in zip(got, want)) <= 0.01 * len(rows)


def test_recall_of_pairs_at_the_threshold(spark):
    """Each vector has one partner at cosine 0.93 to 0.94 and nothing else: the hardest case for the probes."""
    rng, p = np.random.default_rng(9), EmbeddingParams(list_rows=32)
    rows = []
    for i in range(1500):
        x, y = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = rng.uniform(0.9301, 0.94)
        rows += [(2 * i, (3 * x).tolist(), 1), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), 1)]
    out = embeddings.near_duplicates(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA), p)
    linked = out.where("n_links = 1").count()
    assert 0.97 * 3000 <= linked <= 3000 and out.where("n_links > 1").count() == 0


def test_few_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embeddings.near_duplicates(none).count() == 0
    bad = spark.createDataFrame([(1, None, 1, "", "", ""), (None, [1.0], None, "", "", "")], SCHEMA)
    assert shown(embeddings.near_duplicates(bad)) == [("1", 0, "1", True), ("None", 0, "None", True)]
    one = spark.createDataFrame([(1, [1.0, 0.0], 1, "", "", "")], SCHEMA)
    assert shown(embeddings.near_duplicates(one)) == [("1", 0, "1", True)]


def test_asymmetric_distances_bound_the_true_ones():
    """A distance less the error of the code is never above the true distance."""
    x = embeddings.units(np.array(clusters(4, 500, 2, 0.3)))
    index = embeddings.Index(x, 25, EmbeddingParams())
    own, visits = index.lists(x)
    codes, missed = index.codes(x, own)
    for number in np.unique(own):
        mine = np.flatnonzero(own == number)
        true = embeddings.distances(x[:200], x[mine])
        assert (index.asymmetric(x[:200], number, codes[mine]) - missed[mine][None] <= true + 1e-4).all()
    assert all(o in v for o, v in zip(own, visits))


def test_sql(spark, sf):
    assert_same(embeddings.near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet")), embeddings.ORACLE_SQL, sf)
