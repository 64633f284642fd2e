"""A hidden Markov language model: Baum-Welch over all training documents.

Texts are tokenised once into blocks, written to the shared folder: the
block's distinct words (64-bit hashes), a small hash of each word's ending and
the tokens as indexes.  Each block tells how often it has each of its words;
Spark sums them by word, with a map-side sum, and a join on the word brings the
corpus counts back, so no vocabulary is ever gathered or broadcast and a word
of every block is no group of its own.

Model: the `own_classes` most frequent words (a bounded list) have a class
each, other known words share classes by ending, unknown words have one.
p(word | state) = p(class | state) * p(word | class), the second factor by
add-one counts.  The states start from the training texts of least hash (a
bounded sample, the same for the same texts however they are dealt out) and
are trained by Baum-Welch: every task adds up expected counts for its blocks,
Spark sums them over tasks, and the next iteration starts from the sums.

Texts are trained and scored whole.  For training a long text is cut into
stretches that run side by side: products of the transition steps of each
stretch carry the exact forward and backward values over the cuts.

Defined results: a null or empty text is the end token alone; a null doc_id
is not held out; repeated rows are learned from and scored once each; without
training tokens every score is 0.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderwork.llm import textscan
from ladderwork.llm.common import given_id, null_id, written

END = np.uint64(0x51AB_7E0F_11D3_C0DE)
BLOCKS = "block long, doc_ids binary, at binary, held binary, words binary, endings binary, codes binary"


@dataclass(frozen=True)
class HiddenMarkovParams:
    states: int = 8
    iterations: int = 4
    own_classes: int = 1024
    ending_classes: int = 1024
    #: tokens of a text that one step of the vectorised recursion covers; does not change the result
    stretch: int = 256
    #: stretches that are held at once; bounds a task's memory
    side_by_side: int = 384
    #: tokens in a block, about; bounds a task's memory
    block_tokens: int = 600_000
    #: distinct training texts, of least hash, from which the states start
    seed_texts: int = 256
    seed: int = 3


@dataclass(frozen=True)
class Model:
    own: np.ndarray  # sorted hashes of words with a class of their own
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # states x classes; the last class is the unknown word
    within: np.ndarray  # log10 of the class's summed (count + 1)
    log_total: float  # log10(N + V + 1)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and endings of all tokens, the end token after each text, and each text's number of tokens."""
    h, at, e = textscan.scan_endings(texts)
    return np.insert(h, at[1:], END), np.insert(e, at[1:], np.uint64(0)), np.diff(at) + 1


def _small(endings: np.ndarray, p: HiddenMarkovParams) -> np.ndarray:
    return (endings % np.uint64(p.ending_classes)).astype(np.uint16)


def token_blocks(docs: DataFrame, p: HiddenMarkovParams) -> DataFrame:
    """Dictionary-encoded tokens of about `block_tokens` tokens a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held, lengths, hashes, endings, total = [], [], [], [], [], 0
        block = TaskContext.get().partitionId() << 32

        def flush() -> pd.DataFrame:
            words, first, codes = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
            ends = np.concatenate(endings)[first]
            at = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
            parts = (np.array(ids, dtype=np.int64), at, np.array(held, dtype=bool))
            row = [block, *(x.tobytes() for x in parts), _gaps(words), _small(ends, p).tobytes(), _packed(codes, len(words))]
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            texts = [textscan.as_bytes(t) for t in batch["text"]]
            some_ids, some_held = batch["doc_id"].tolist(), batch["held"].tolist()
            for a, b in textscan.chunks(texts, 1 << 18):
                h, e, n = _tokens(texts[a:b])
                hashes.append(h)
                endings.append(e)
                lengths.append(n)
                ids += some_ids[a:b]
                held += some_held[a:b]
                total += len(h)
                if total >= p.block_tokens:
                    yield flush()
                    block += 1
                    ids, held, lengths, hashes, endings, total = [], [], [], [], [], 0
        if total:
            yield flush()

    rows = docs.select(given_id("doc_id"), "text", _held_out().alias("held"))
    return rows.mapInPandas(run, BLOCKS)


def _held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _packed(codes: np.ndarray, n_words: int) -> bytes:
    """Tokens as places among the block's words, in two bytes where they fit, compressed."""
    return zstandard.compress(codes.astype(np.uint16 if n_words <= 1 << 16 else np.uint32).tobytes(), 1)


def _gaps(words: np.ndarray) -> bytes:
    """Sorted hashes as gaps, byte planes apart: the high ones are nearly empty and compress away."""
    gaps = np.diff(words, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _from_gaps(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _token_mask(at: np.ndarray, held: np.ndarray) -> np.ndarray:
    return np.repeat(~held, np.diff(at))


def _arrays(row) -> tuple[np.ndarray, ...]:
    at, codes = np.frombuffer(row.at, np.int64), zstandard.decompress(row.codes)
    return (
        np.frombuffer(row.doc_ids, np.int64), at, np.frombuffer(row.held, bool), _from_gaps(row.words),
        np.frombuffer(row.endings, np.uint16), np.frombuffer(codes, np.uint16 if len(codes) == 2 * at[-1] else np.uint32),
    )


def block_words(blocks: DataFrame) -> DataFrame:
    """A row for each block and distinct word of it: its place there and its count in the training texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                _, at, held, words, endings, codes = _arrays(row)
                n = np.bincount(codes[_token_mask(at, held)], minlength=len(words))
                for a in range(0, len(words), 50_000):
                    part = slice(a, a + 50_000)
                    yield pd.DataFrame(
                        {
                            "block": row.block, "place": np.arange(len(words), dtype=np.int32)[part],
                            "word": words[part].view(np.int64), "ending": endings[part].astype(np.int32), "n": n[part],
                        }
                    )

    return blocks.mapInPandas(run, "block long, place int, word long, ending int, n long")


def corpus_counts(words: DataFrame) -> DataFrame:
    """word, ending and corpus count (over training texts) of every word that they hold."""
    return words.where("n > 0").groupBy("word", "ending").agg(F.sum("n").alias("count"))


def _frame(counts: DataFrame, p: HiddenMarkovParams) -> tuple[Model, int]:
    """A model without trained states; the frequent words are a bounded list."""
    v, n = counts.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    own = counts.orderBy(F.desc("count"), "word").limit(p.own_classes).toPandas()
    sums = counts.groupBy("ending").agg(F.sum(F.col("count") + 1).alias("total")).toPandas()
    by_ending = np.zeros(p.ending_classes)
    by_ending[sums["ending"].to_numpy(np.int64)] = sums["total"].to_numpy(np.float64)
    words = own["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    mass = (own["count"].to_numpy(np.float64) + 1)[order]
    np.subtract.at(by_ending, own["ending"].to_numpy(np.int64), own["count"].to_numpy(np.float64) + 1)
    by_ending = np.maximum(by_ending, 1.0)
    class_mass = np.concatenate([mass, np.zeros(p.own_classes - len(mass)) + 1e-300, by_ending])
    log_total = float(np.log10(n + v + 1))
    unknown = 1.0 / (n + v + 1)
    flat = class_mass / class_mass.sum() * (1 - unknown)
    emit = np.tile(np.append(flat, unknown), (p.states, 1))
    even = np.full(p.states, 1 / p.states)
    return Model(words[order], even, np.tile(even, (p.states, 1)), emit, np.log10(class_mass), log_total), int(n)


def _classes(words: np.ndarray, endings: np.ndarray, model: Model, p: HiddenMarkovParams) -> np.ndarray:
    out = endings.astype(np.int64) + p.own_classes
    if len(model.own):
        place = np.minimum(np.searchsorted(model.own, words), len(model.own) - 1)
        out = np.where(model.own[place] == words, place, out)
    return out


def _forward(classes: np.ndarray, at: np.ndarray, model: Model) -> np.ndarray:
    """log10 likelihood of each sequence of classes, by scaled forward recursion."""
    lengths = np.diff(at)
    order = np.argsort(-lengths, kind="stable")
    starts, left = at[:-1][order], lengths[order]
    emit = np.ascontiguousarray(model.emit.T)
    alpha = model.start * emit[classes[starts]]
    log_sum = np.zeros(len(order))
    for t in range(int(left[0]) if len(left) else 0):
        if t:
            n = int(np.searchsorted(-left, -t, side="left"))
            alpha = (alpha[:n] @ model.move) * emit[classes[starts[:n] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        log_sum[: len(scale)] += np.log10(scale)
    out = np.empty(len(order))
    out[order] = log_sum
    return out


def _carried(x: np.ndarray, begin: np.ndarray, size: np.ndarray, classes: np.ndarray, model: Model) -> np.ndarray:
    """Row vectors x (n, r, states) carried over size tokens from begin on, up to a factor for each of the n."""
    emit = np.ascontiguousarray(model.emit.T)
    order = np.argsort(-size, kind="stable")
    begin, size, out = begin[order], size[order], x[order]
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))
        here = (out[:n] @ model.move) * emit[classes[begin[:n] + t]][:, None, :]
        if t % 8 == 7:
            here /= here.max(axis=(1, 2), keepdims=True)
        out[:n] = here
    back = np.empty_like(out)
    back[order] = out
    return back


def _unit(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def _stretched(classes: np.ndarray, at: np.ndarray, model: Model, p: HiddenMarkovParams) -> tuple[np.ndarray, ...]:
    """Begin and size of each stretch, whether it is its text's first, the state before it and what follows it."""
    lengths = np.diff(at)
    many = -(-lengths // p.stretch)
    text = np.repeat(np.arange(len(lengths)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin = at[text] + k * p.stretch
    size = np.minimum(begin + p.stretch, at[text + 1]) - begin
    before, after = np.tile(model.start, (len(text), 1)), np.ones((len(text), p.states))
    if len(many) and many.max() > 1:
        ends = np.zeros_like(before)
        heads = np.flatnonzero((k == 0) & (many[text] > 1))
        x = (model.start * model.emit.T[classes[begin[heads]]])[:, None, :]
        ends[heads] = _unit(_carried(x, begin[heads] + 1, size[heads] - 1, classes, model)[:, 0])
        later = np.flatnonzero(k > 0)
        step = np.empty((len(text), p.states, p.states))
        for a in range(0, len(later), p.side_by_side):
            i = later[a : a + p.side_by_side]
            step[i] = _carried(np.tile(np.eye(p.states), (len(i), 1, 1)), begin[i], size[i], classes, model)
        by_k = np.argsort(k[later], kind="stable")
        groups = np.split(later[by_k], np.flatnonzero(np.diff(k[later][by_k])) + 1)
        for i in groups:
            before[i] = ends[i - 1]
            ends[i] = _unit(np.einsum("ns,nst->nt", before[i], step[i]))
        for i in reversed(groups):
            after[i - 1] = _unit(np.einsum("nst,nt->ns", step[i], after[i]))
    return begin, size, k == 0, before, after


def _expected(classes: np.ndarray, at: np.ndarray, model: Model, p: HiddenMarkovParams) -> tuple[np.ndarray, ...]:
    """Expected starts, moves and emissions of whole sequences (forward-backward)."""
    s = p.states
    begins, sizes, firsts, befores, afters = _stretched(classes, at, model, p)
    order = np.argsort(-sizes, kind="stable")
    emit = np.ascontiguousarray(model.emit.T)
    first, move, out = np.zeros(s), np.zeros((s, s)), np.zeros((s, model.emit.shape[1]))
    for a in range(0, len(order), p.side_by_side):
        i = order[a : a + p.side_by_side]
        begin, size, head = begins[i], sizes[i], firsts[i]
        steps = int(size[0])
        active = [int(np.searchsorted(-size, -t, side="left")) for t in range(steps)] + [0]
        alphas, scales, seen = [], [], []
        for t in range(steps):
            n = active[t]
            c = classes[begin[:n] + t]
            e = emit[c]
            alpha = np.where(head[:, None], model.start, befores[i] @ model.move) * e if not t else (alphas[-1][:n] @ model.move) * e
            scale = alpha.sum(axis=1, keepdims=True)
            alphas.append(alpha / scale)
            scales.append(scale)
            seen.append((c, e))
        gammas, beta = [None] * steps, np.zeros((0, s))
        for t in range(steps - 1, -1, -1):
            n, later = active[t], active[t + 1]
            whole = np.empty((n, s))
            whole[:later] = beta
            ending = afters[i[later:n]]
            whole[later:] = ending / (alphas[t][later:] * ending).sum(axis=1, keepdims=True)
            gammas[t] = alphas[t] * whole
            right = seen[t][1] * whole / scales[t]
            if t:
                move += alphas[t - 1][:n].T @ right
            else:
                move += befores[i][~head].T @ right[~head]
            beta = right @ model.move.T
        first += gammas[0][head].sum(axis=0)
        c, g = np.concatenate([x[0] for x in seen]), np.concatenate(gammas)
        for k in range(s):
            out[k] += np.bincount(c, weights=g[:, k], minlength=out.shape[1])
    return first, move * model.move, out


def _train_classes(row, model: Model, p: HiddenMarkovParams) -> tuple[np.ndarray, np.ndarray]:
    """Classes and bounds of a block's training documents."""
    _, at, held, words, endings, codes = _arrays(row)
    classes = _classes(words, endings, model, p)[codes[_token_mask(at, held)]]
    return classes, np.concatenate([[0], np.cumsum(np.diff(at)[~held])])


def _seed_histograms(docs: DataFrame, model: Model, p: HiddenMarkovParams) -> np.ndarray:
    """Class counts of the distinct training texts of least hash, in order of the hash."""
    hashed = docs.where(~_held_out()).where(F.length("text") > 200).select(F.xxhash64("text").alias("h"), "text")
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(p.seed_texts).collect()]
    texts = hashed.where(F.col("h").isin(least)).dropDuplicates(["h"]) if least else hashed.limit(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, text in zip(batch["h"].tolist(), batch["text"], strict=True):
                words, endings, _ = _tokens([textscan.as_bytes(text)])
                n = np.bincount(_classes(words, _small(endings, p), model, p), minlength=model.emit.shape[1])
                cell = np.flatnonzero(n)
                yield pd.DataFrame({"h": h, "cell": cell, "n": n[cell]})

    found = texts.mapInPandas(run, "h long, cell long, n long").toPandas()
    out = np.zeros((len(least), model.emit.shape[1]))
    out[np.searchsorted(np.array(least), found["h"].to_numpy(np.int64)), found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out


def _seeded(docs: DataFrame, model: Model, p: HiddenMarkovParams) -> Model:
    """States that start from unlike texts of a bounded sample."""
    rng = np.random.default_rng(p.seed)
    emit, hist = model.emit.copy(), _seed_histograms(docs, model, p)
    if len(hist):
        unit = np.sqrt(hist / hist.sum(axis=1, keepdims=True))
        chosen = [0]
        while len(chosen) < p.states:
            near = (unit @ unit[chosen].T).max(axis=1)
            chosen.append(int(np.argmin(near)))
        for k, i in enumerate(chosen):
            own = unit[(unit @ unit[i]) >= (unit @ unit[chosen].T).max(axis=1) - 1e-12] ** 2
            emit[k] = 0.5 * emit[k] + 0.5 * own.mean(axis=0)
    emit[:, :-1] *= 1 + 0.05 * rng.random((p.states, emit.shape[1] - 1))
    return _normal(model, np.full(p.states, 1.0), np.eye(p.states) * 8 + 1, emit[:, :-1])


def _normal(model: Model, first: np.ndarray, move: np.ndarray, out: np.ndarray) -> Model:
    unknown = model.emit[0, -1]
    emit = np.hstack([out / out.sum(axis=1, keepdims=True) * (1 - unknown), np.full((len(out), 1), unknown)])
    return Model(model.own, first / first.sum(), move / move.sum(axis=1, keepdims=True), emit, model.within, model.log_total)


def baum_welch(blocks: DataFrame, model: Model, p: HiddenMarkovParams) -> Model:
    """model (with unlike states) after `iterations` rounds over all blocks."""
    prior = model.emit[:, :-1].mean(axis=0)
    for _ in range(p.iterations):
        now = model

        def run(batches: Iterator[pd.DataFrame], now: Model = now) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                for row in batch.itertuples():
                    classes, at = _train_classes(row, now, p)
                    if len(at) > 1:
                        flat = np.concatenate([x.ravel() for x in _expected(classes, at, now, p)])
                        total = flat if total is None else total + flat
            if total is not None:
                cell = np.flatnonzero(total)
                yield pd.DataFrame({"cell": cell, "v": total[cell]})

        s, c = now.emit.shape
        sums = blocks.mapInPandas(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
        flat = np.zeros(s + s * s + s * c)
        flat[sums["cell"].to_numpy()] = sums["v"].to_numpy()
        first, move, out = flat[:s] + 1, flat[s : s + s * s].reshape(s, s) + 1, flat[s + s * s :].reshape(s, c)[:, :-1]
        model = _normal(now, first, move, out + prior * 50)
    return model


#: Blocks in one Arrow batch; the default of 10,000 rows would hold a task's blocks all at once.
BLOCKS_AT_ONCE = 2


@contextmanager
def _few_at_once(spark: SparkSession) -> Iterator[None]:
    """Jobs that start inside hand few blocks at once to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BLOCKS_AT_ONCE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scores(docs: DataFrame, p: HiddenMarkovParams = HiddenMarkovParams()) -> DataFrame:
    """The contract's columns for every row of docs (doc_id, text)."""
    blocks = written(token_blocks(docs, p), "token-blocks")
    with _few_at_once(docs.sparkSession):
        return _scores(docs, blocks, p)


def _scores(docs: DataFrame, blocks: DataFrame, p: HiddenMarkovParams) -> DataFrame:
    words = block_words(blocks)
    counts = written(corpus_counts(words), "word-counts")
    model, train_tokens = _frame(counts, p)
    if train_tokens:
        model = baum_welch(blocks, _seeded(docs, model, p), p)
    told = words.select("block", "place", "word").join(counts.select("word", "count"), "word")
    back = told.groupBy("block").agg(F.collect_list("place").alias("places"), F.collect_list("count").alias("counts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, at, held, words, endings, codes = _arrays(row)
                count = np.zeros(len(words), dtype=np.int64)
                if row.places is not None:
                    count[np.asarray(row.places)] = np.asarray(row.counts)
                known = count > 0
                classes = np.where(known, _classes(words, endings, model, p), model.emit.shape[1] - 1)
                base = np.log10(count + 1.0)
                inside = np.where(known, base - np.append(model.within, 0.0)[classes], 0.0)
                first = at[:-1]
                hidden = _forward(classes[codes], at, model)
                yield pd.DataFrame(
                    {
                        "doc_id": ids,
                        "held_out": held,
                        "n_tokens": np.diff(at),
                        "n_known": np.add.reduceat(known[codes].astype(np.int64), first),
                        "base_score": np.add.reduceat(base[codes], first) - np.diff(at) * model.log_total,
                        "score": hidden + np.add.reduceat(inside[codes], first),
                    }
                )

    out = blocks.join(back, "block", "left").mapInPandas(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return written(out, "scores").select(
        null_id("doc_id"), "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
