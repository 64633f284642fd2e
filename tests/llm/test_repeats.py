"""op8 against brute force: nulls, repeated rows, one core in many surroundings, both ways to resolve a group."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from ladderwork.llm import repeats
from ladderwork.llm.repeats import RepeatParams

SCHEMA = "doc_id long, text string, row string, core string, place string"


def noise(n, seed, letters="abcdefghij klmnop"):
    return "".join(random.Random(seed).choices(letters, k=n))


def tables():
    passage, short, license_ = noise(900, 1), noise(380, 2), noise(405, 3)
    rows = [(1, passage), (1, passage), (None, noise(50, 4) + passage), (None, None), (7, ""), (8, "a" * 1500), (9, "ab" * 450), (9, "é" * 300)]
    rows += [(20 + i, noise(30 + i, 50 + i) + short + noise(40, 90 + i)) for i in range(40)]  # a common passage that is too short
    rows += [(100 + i, noise(60 + i, 200 + i) + license_ + noise(300, 300 + i)) for i in range(40)]
    rows += [(200 + i, noise(200, 400 + i) + passage[i * 7 : i * 7 + 430] + noise(100, 500 + i)) for i in range(25)]
    rows += [(300, noise(2000, 6) + passage + noise(10, 7) + passage)]
    return rows


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(i), len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == -1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot_core, merged", [(2000, 8000), (2000, 5), (1, 50), (20, 50)])
def test_repeats_equal_brute_force(spark, hot_core, merged):
    rows = tables()
    p = RepeatParams(hot_core=hot_core, merged_entries=merged, run_entries=70, range_entries=90)
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(5)
    out = repeats.without_repeats(docs, p).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute(rows, p.length)


def test_repeats_of_short_strings(spark):
    rows = [(i, noise(random.Random(i).randint(0, 60), i, "ab")) for i in range(60)]
    p = RepeatParams(length=12, core=6, run_entries=40, range_entries=30, merged_entries=20, hot_core=10)
    out = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute(rows, 12)
