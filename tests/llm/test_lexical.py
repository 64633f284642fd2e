"""op12 against a plain ranking: nulls, ties, repeated rows and ids, several blocks, small buckets, empty tables."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pandas as pd
import pytest

from ladderwork.llm import lexical
from ladderwork.llm.lexical import SearchParams
from tests.compare import assert_same

DOCS = "doc_id long, text string, item_id string, score string, length string"
ITEMS = "item_id long, text string, doc_id string, term string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def tables():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)] + ["É", "ß", "ÜBER", "x y", "Q9", "_a", "b-c"]
    heavy = [1 / (k + 1) for k in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, heavy, k=rng.randint(1, 60)))) for i in range(400)]
    docs += [(900, "w1 w2 w3")] * 70 + [(901, "w1 w2 w3"), (901, "w50 W51"), (None, "w1 w2 w3"), (None, None), (902, ""), (903, " .,- \x7f")]
    docs += [(904, "w7 " * 50_000 + "w119")]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(30)]
    items += [(3, "w100 w101"), (40, None), (41, ""), (42, "nowhere"), (43, "w1 w1 W1 w2"), (None, "w5 w6"), (43, "w2")]
    return docs, items


def brute(docs, items, top):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted, out = {}, []
    for k, t in items:
        wanted.setdefault(k, set()).update(terms(t))
    for k, ts in wanted.items():
        found = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if score > 0:
                found.append((-score, -(2**63) if i is None else i, i))
        out += [(str(k), rank, str(i), -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("p", [SearchParams(), SearchParams(top=7, block_pairs=60, bucket=16, first=8), SearchParams(top=1, bucket=5)])
def test_search_equals_brute_force(spark, p):
    docs, items = tables()
    found = lexical.search(spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], DOCS).repartition(5), spark.createDataFrame([(i, t, "a", "b") for i, t in items], ITEMS), p)
    assert sorted((str(r.item_id), r["rank"], str(r.doc_id), r.score) for r in found.collect()) == brute(docs, items, p.top)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a", "", "", "")], DOCS), spark.createDataFrame([(1, "a", "", "")], ITEMS)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_bounds_lose_no_row_and_prune(spark):
    """Rows that a bucket drops are below the bound, and most rows are dropped."""
    rng, size = np.random.default_rng(2), 60
    rows = []
    for i in range(500):
        held = rng.choice(size, rng.integers(1, 20), replace=False).astype(np.int32)
        impacts = rng.integers(1, 1_000_000, len(held))
        rows.append((i, float(np.sqrt((impacts.astype(float) ** 2).sum())), held.tobytes(), impacts.astype(np.int64).tobytes()))
    bucket = lexical.Bucket(pd.DataFrame(rows, columns=["id", "length", "terms", "impacts"]))
    dropped = 0
    for seed in range(20):
        rng = np.random.default_rng(seed)
        item = lexical.Item(rng.choice(size, 8, replace=False), rng.integers(0, 9000, 8))
        scores, scratch = bucket.scores(np.arange(500), item, np.zeros(size, dtype=np.int64)), np.zeros(size, dtype=np.int64)
        bound = int(np.sort(scores)[-10])
        kept = bucket.survivors(item, bound)
        assert set(np.flatnonzero(scores >= max(bound, 1))) <= set(kept)
        assert (bucket.scores(kept, item, scratch) == scores[kept]).all() and not scratch.any()
        dropped += 500 - len(kept)
    assert dropped > 20 * 250


def test_search_in_sql(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    assert_same(lexical.search(docs, items), lexical.ORACLE_SQL, sf)
