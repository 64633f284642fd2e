"""op9: whole-text Baum-Welch against plain loops, the same scores however rows are dealt out, contract columns."""

import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from ladderwork.llm import hidden_markov
from ladderwork.llm.hidden_markov import HiddenMarkovParams, Model


def unit(x):
    return x / x.sum(axis=-1, keepdims=True)


def plain_expected(classes, at, m):
    """Forward and backward values token by token."""
    s = len(m.start)
    first, move, out = np.zeros(s), np.zeros((s, s)), np.zeros(m.emit.shape)
    for a, b in zip(at[:-1], at[1:]):
        c = classes[a:b]
        alpha, scale = [], []
        for t, x in enumerate(c):
            v = (m.start if not t else alpha[-1] @ m.move) * m.emit[:, x]
            scale.append(v.sum())
            alpha.append(v / v.sum())
        beta = np.ones(s)
        for t in range(len(c) - 1, -1, -1):
            out[:, c[t]] += alpha[t] * beta
            if t:
                right = m.emit[:, c[t]] * beta / scale[t]
                move += np.outer(alpha[t - 1], right) * m.move
                beta = m.move @ right
            else:
                first += alpha[0] * beta
    return first, move, out


@pytest.mark.parametrize("stretch", [1, 3, 7, 1000])
def test_expected_counts_of_whole_texts(stretch):
    rng = np.random.default_rng(1)
    m = Model(np.zeros(0, np.uint64), unit(rng.random(3)), unit(rng.random((3, 3)) ** 4), unit(rng.random((3, 6)) ** 3), np.zeros(5), 0.0)
    at = np.cumsum([0, 1, 40, 7, 3, 8, 21, 1])
    classes = rng.integers(0, 6, at[-1])
    for got, want in zip(hidden_markov._expected(classes, at, m, HiddenMarkovParams(states=3, stretch=stretch)), plain_expected(classes, at, m)):
        assert np.allclose(got, want, rtol=1e-9)


def corpus():
    rng = random.Random(4)
    topics = [[f"{t}{i}" for i in range(30)] for t in ("sun", "sea", "law")]
    rows = []
    for i in range(120):
        words = topics[i % 3]
        rows.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([20, 60, 700])))))
    return rows + [(None, "sun1 sun2"), (None, None), (500, ""), (7, rows[7][1]), (501, rows[8][1]), (502, "zzz qqq")]


def scored(spark, rows, parts, **more):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, block long, word long")
    return hidden_markov.scores(docs.repartition(parts), HiddenMarkovParams(own_classes=64, ending_classes=16, **more)).collect()


def key(r):
    return str(r.doc_id), r.n_tokens, round(r.base_score, 6)


def test_scores_do_not_depend_on_blocks(spark):
    rows = corpus()
    one = sorted(scored(spark, rows, 1, block_tokens=10**6), key=key)
    many = sorted(scored(spark, list(reversed(rows)), 5, block_tokens=900, stretch=16), key=key)
    assert len(one) == len(rows) and [key(r) for r in one] == [key(r) for r in many]
    assert [r.score for r in one] == pytest.approx([r.score for r in many], rel=1e-6)
    tokens = [(i, [*(t or "").split(), None]) for i, t in rows]
    train = Counter(w for i, ws in tokens for w in ws if i is None or zlib.crc32(str(i).encode()) % 7 != 2)
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), len(ws), round(sum(log10((train[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert [key(r) for r in one] == want and {r.train_tokens for r in one} == {n}
    # held-out texts of one topic: states that know the topic beat the base
    held = [r for r in one if r.held_out and r.n_tokens > 20]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)
    assert all(np.isfinite(r.score) and r.score < 0 for r in one)


def test_no_training_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    out = scored(spark, [(held, "a b c")], 1)
    assert (out[0].n_tokens, out[0].n_known, out[0].train_tokens, out[0].base_score) == (4, 0, 0, 0.0) and out[0].score == pytest.approx(0)
