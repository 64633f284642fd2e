"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches.

Learning: in labelled training documents the folded words and word beginnings
are counted by class, once for each distinct text; those whose log-odds stay
high at the lower end of their confidence interval make the lexicon.  Word
pairs around a lexicon entry that clean documents hold, and hold more often
than toxic ones by the same kind of bound, make exception phrases; an entry
inside one does not count.  All thresholds are shares of the classes or
log-odds, so they do not move with the size of the corpus.  Scoring: one
automaton pass over a folded text sums the weights, the sum is divided by the
logarithm of the length, and a logistic curve, fitted on a histogram of all
training sums, gives the score.

Folding lower-cases, applies compatibility forms, maps Cyrillic and Greek
look-alikes to Latin and digits and signs to the letters they stand for, and
turns everything else into one space, so an entry with its spaces is a word.

Defined results: null and empty texts match nothing and get the score of a
text without a match; repeated rows get equal scores; with no training label
of either class every document gets the share of toxic labels (0 if none).
Labels that are null, or whose doc_id is null, are left out.  Extra columns
are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, expm1, log, log1p, sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderwork.llm.common import given_id, maybe_broadcast, null_id, written

#: Letters that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
}

#: Signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        out = unicodedata.normalize("NFKC", chr(code)).lower()
        out = "".join(LOOK_ALIKES.get(c, c if c.isalpha() else " ") for c in out) or " "
        self[code] = out
        return out


_FOLD = _Fold()
#: Bytes of ASCII texts; digits and signs are set apart below.
_ASCII = bytes(c + 32 if 65 <= c < 91 else c if 97 <= c < 123 else 32 for c in range(256))
_LEET = {ord(k): v for k, v in SUBSTITUTES.items()}


def _plain(text: str) -> str:
    return text.encode().translate(_ASCII).decode() if text.isascii() else text.translate(_FOLD)


def fold(text: str | None) -> str:
    """Folded words with one space before, between and after them.

    Digits and signs count as letters only inside a word that has letters.
    """
    if not text:
        return " "
    out = _plain(text)
    signs = [w for w in text.split() if not w.isalpha() and any(s in w[:-1] or s in "0134578@$" and s in w for s in SUBSTITUTES)]
    extra = [_plain(w.rstrip("!").translate(_LEET)) for w in signs if any(c.isalpha() for c in w)]
    return f" {' '.join(out.split())} " + (f" {' '.join(' '.join(extra).split())} " if extra else "")


@dataclass(frozen=True)
class ToxicityParams:
    #: letters of a word beginning that may be an entry; it matches longer words only
    beginnings: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    #: a candidate is in so large a share of the toxic training texts, and in two of them; with the
    #: mean number of words in a text this bounds the lexicon, whatever the size of the corpus
    min_share: float = 0.002
    confidence: float = 1.64
    #: least log-odds of an entry at the lower end of its interval
    min_weight: float = 1.5
    #: log-odds by which a beginning has to exceed the longer entries that it stands for
    margin: float = 0.25
    #: share of a class that is added to a count of it
    smooth: float = 0.0005
    #: share of the clean training texts that hold a phrase before it is an exception, and two of them
    min_exception: float = 0.0005
    #: phrases that are exceptions in any case
    exceptions: tuple[str, ...] = ()
    #: features that a task counts before it passes them on
    held: int = 200_000


@dataclass(frozen=True)
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    #: folded phrase, with its outer spaces, to the places in it of the words that do not count
    exceptions: dict[str, tuple[int, ...]] = field(default_factory=dict)
    slope: float = 0.0
    shift: float = 0.0


def remainder(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def _entries(word: str, p: ToxicityParams) -> list[str]:
    """The entries that would match a folded word."""
    return [f" {word} ", *(f" {word[:n]}" for n in p.beginnings if len(word) > n)]


def _features(text: str, p: ToxicityParams) -> set[str]:
    return {x for w in set(fold(text).split()) for x in _entries(w, p)}


def _automaton(lexicon: Lexicon, p: ToxicityParams):
    """Matches say (length, beginning, weight, places that do not count)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for entry in {**lexicon.weights, **lexicon.exceptions}:
        here = lexicon.weights.get(entry)
        machine.add_word(entry, (len(entry), here is not None and not entry.endswith(" "), here, lexicon.exceptions.get(entry, ())))
    machine.make_automaton()
    return machine


def _sum(text: str, machine) -> tuple[float, int]:
    """Summed weights of the entries outside exception phrases, and the number of words."""
    folded = fold(text)
    found, free, last = [], set(), len(folded) - 1
    if len(machine):
        for end, (size, beginning, weight, places) in machine.iter(folded):
            start = end - size + 1
            free.update(start + x for x in places)
            if weight is not None and not (beginning and (end == last or folded[end + 1] == " ")):
                found.append((start, weight))
    return sum(w for start, w in found if start not in free), folded.count(" ")


def normalised(total: float, n_words: int) -> float:
    """The sum, less by the logarithm of the length: one insult weighs about as much in 10 words as in 300."""
    return total / (1 + log1p(n_words / 1000))


def _chosen(weights: dict[str, float], p: ToxicityParams) -> dict[str, float]:
    """One entry of each chain of beginnings: a shorter one only where it is better by a margin."""
    kept: dict[str, float] = {}
    best: dict[str, float] = {}
    for entry in sorted(weights, key=lambda e: (-len(e), e)):
        if entry not in best or weights[entry] > best[entry] + p.margin:
            kept[entry] = weights[entry]
            for n in p.beginnings:
                if n + 1 < len(entry.rstrip()):
                    best[entry[: n + 1]] = max(best.get(entry[: n + 1], 0.0), weights[entry])
    return {e: w for e, w in kept.items() if not any(e[: n + 1] in kept for n in p.beginnings if n + 1 < len(e.rstrip()))}


def _summed(rows: DataFrame, features, p: ToxicityParams) -> DataFrame:
    """Texts of each class by feature: combined in each task, a bounded number at a time, before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def told() -> pd.DataFrame:
            return pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["feature", "toxic", "n"])

        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                mark = int(toxic > 0)
                counts.update((x, mark) for x in features(text))
                if len(counts) >= p.held:
                    yield told()
                    counts.clear()
        if counts:
            yield told()

    told = rows.select("text", "toxic").mapInPandas(run, "feature string, toxic long, n long")
    by_class = [F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("n"))), F.lit(0)).alias(name) for k, name in ((1, "t"), (0, "c"))]
    return told.groupBy("feature").agg(*by_class)


def _odds(mine: int, of: int, others: int, of_others: int, p: ToxicityParams) -> float:
    """Log-odds of a feature in one class against the other, at the lower end of its interval."""
    if not mine:
        return float("-inf")
    ours, theirs = mine / of, (others + 0.5) / of_others + p.smooth
    return log(ours / theirs) - p.confidence * sqrt(1 / (mine + 0.5) + 1 / (others + 0.5))


def _exceptions(rows: DataFrame, weights: dict[str, float], toxic_n: int, clean_n: int, p: ToxicityParams) -> dict[str, tuple[int, ...]]:
    """Phrases (an entry's word and a neighbour) that clean texts hold and toxic ones hold less."""

    def phrases(text: str) -> set[str]:
        words = fold(text).split()
        hit = [any(x in weights for x in _entries(w, p)) for w in words]
        return {f" {a} {b} " for a, b, x, y in zip(words, words[1:], hit, hit[1:]) if x or y}

    least = max(2, p.min_exception * clean_n)
    found = _summed(rows, phrases, p).where(F.col("c") >= least).collect()
    good = [r.feature for r in found if _odds(r.c, clean_n, r.t, toxic_n, p) > 0]
    out = {}
    for phrase in [*good, *(fold(x) for x in p.exceptions)]:
        at, places = 0, []
        for word in phrase.split():
            if any(x in weights for x in _entries(word, p)):
                places.append(at)
            at += len(word) + 1
        out[phrase] = tuple(places)
    return out


def _logistic(histogram: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and shift for (x, clean, toxic) counts; a weak prior keeps them finite."""
    a, b = 1.0, -1.0
    for _ in range(60):
        g0, g1, h00, h01, h11 = -0.02 * a, 0.0, 0.02, 0.0, 1e-6
        for x, clean, toxic in histogram:
            q = 1 / (1 + exp(-max(-30.0, min(30.0, a * x + b))))
            n = clean + toxic
            g0, g1 = g0 + x * (toxic - n * q), g1 + toxic - n * q
            v = n * q * (1 - q)
            h00, h01, h11 = h00 + v * x * x, h01 + v * x, h11 + v
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        scale = min(1.0, 2.0 / max(abs(da), abs(db), 1e-9))
        a, b = a + scale * da, b + scale * db
        if abs(da) + abs(db) < 1e-7:
            break
    return a, b


def learn(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> Lexicon:
    """The lexicon and its curve from labelled documents outside the held-out fold."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(remainder(F.col("doc_id"), 5) != 0)
    rows = docs.select("doc_id", "text").join(maybe_broadcast(marks), "doc_id").select("text", "toxic")
    rows = written(rows.withColumn("h", F.xxhash64("text")).dropDuplicates(["h", "toxic"]).drop("h"), "labelled")
    sizes = {r.toxic: r.n for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic_n, clean_n = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic_n or not clean_n:
        return Lexicon({}, {}, 0.0, 30.0 if toxic_n else -30.0)
    least = max(2, p.min_share * toxic_n)
    seen = {r.feature for r in _summed(rows.where("toxic > 0"), lambda x: _features(x, p), p).where(F.col("t") >= least).select("feature").collect()}
    weights = {}
    for r in _summed(rows, lambda x: _features(x, p) & seen, p).collect():
        low = _odds(r.t, toxic_n, r.c, clean_n, p)
        if low >= p.min_weight:
            weights[r.feature] = round(low, 6)
    weights = _chosen(weights, p)
    exceptions = _exceptions(rows, weights, toxic_n, clean_n, p)
    known = Lexicon(weights, exceptions, 0.0, 0.0)

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _automaton(known, p)
        counts: Counter = Counter()
        for batch in batches:
            for text, toxic_here in zip(batch["text"], batch["toxic"], strict=True):
                counts[round(100 * log1p(normalised(*_sum(text, machine)))), int(toxic_here > 0)] += 1
        if counts:
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["bin", "toxic", "n"])

    # the logarithm keeps the number of bins small
    counted = rows.mapInPandas(bins, "bin long, toxic long, n long").groupBy("bin", "toxic").agg(F.sum("n").alias("n"))
    table: dict[int, list[int]] = {}
    for r in counted.collect():
        table.setdefault(r.bin, [0, 0])[r.toxic] += r.n
    slope, shift = _logistic([(expm1(k / 100), *v) for k, v in sorted(table.items())])
    return Lexicon(weights, exceptions, slope, shift)


def scored(docs: DataFrame, lexicon: Lexicon, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id and score for every row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _automaton(lexicon, p)
        for batch in batches:
            x = [normalised(*_sum(text, machine)) for text in batch["text"]]
            scores = [1 / (1 + exp(-max(-30.0, min(30.0, lexicon.slope * v + lexicon.shift)))) for v in x]
            if scores:
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "score": scores})

    out = docs.select(given_id("doc_id"), "text").mapInPandas(run, "doc_id long, score double")
    return out.withColumn("doc_id", null_id("doc_id"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of docs, all columns, whose score is under one half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(lexicon, p)
        for batch in batches:
            x = (normalised(*_sum(text, machine)) for text in batch.column("text").to_pylist())
            yield batch.filter(pa.array([lexicon.slope * v + lexicon.shift < 0 for v in x], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    out = scored(docs, learn(docs, labels, p), p)
    return out.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
