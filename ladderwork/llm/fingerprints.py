"""Document fingerprints by locally consistent parsing.

The code points of a text are parsed into phrases, phrases into longer
phrases, and so on.  On each level runs of one symbol become one symbol,
deterministic coin tossing relabels every symbol by the lowest bit in which
it differs from its left neighbour, again and again until few labels are
left, and the places where the label is a local maximum begin phrases.  A
phrase is named by a hash of its symbols.  A boundary depends on a few
symbols around it only, so equal substrings have equal phrases inside,
wherever they stand.

Levels go on until a text is one phrase.  The fingerprint is a MinHash, in
hexadecimal, of the names of all phrases of `least_span` code points or more
and of the last one, whatever the level and the text's length; likeness is the
share of equal places.  Equal texts have equal fingerprints.

Defined results: null counts as the empty text; two texts without a name are
alike (1) if both are empty; rows are ordered by descending doc_id, equal ids
by a hash of their text, null ids last; the last row is followed by the first,
and a row that stands alone by itself.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.llm.common import given_id, null_id
from ladderwork.llm.near_duplicates import multipliers
from ladderwork.llm.textscan import mix, segment_hash


@dataclass(frozen=True)
class FingerprintParams:
    places: int = 64
    #: code points of a phrase from which on its name counts
    least_span: int = 12
    seed: int = 17
    #: rows of the sample from which the ranges of rows are cut, for each range
    sample: int = 16


def _powers_sum(symbols: np.ndarray) -> np.ndarray:
    from ladderwork.llm.textscan import _power_tables

    up, _ = _power_tables(len(symbols))
    out = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=out[1:])
    return out


def _lowest_bit(d: np.ndarray) -> np.ndarray:
    low = d & (~d + np.uint64(1))
    return np.log2(low.astype(np.float64)).astype(np.uint64)


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 2 * bit place + bit; a text's first symbol is compared with its complement."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = x[first] ^ np.uint64(1)
    place = _lowest_bit(x ^ left)
    return np.uint64(2) * place + ((x >> place) & np.uint64(1))


def parse(symbols: np.ndarray, text: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level: (names, text and code points of each name) from symbols, their texts and code points."""
    n = len(symbols)
    if not n:
        return symbols, text, span
    new = np.ones(n, dtype=bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, n)).astype(np.uint64)
    x, owner, span = symbols[at], text[at], np.add.reduceat(span, at)
    x = np.where(run > 1, mix(x + run * np.uint64(0xD6E8FEB86659FD93)), x)
    first = np.ones(len(x), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    # two runs side by side never have one symbol, but for a hash collision
    same = np.zeros(len(x), dtype=bool)
    same[1:] = (x[1:] == x[:-1]) & ~first[1:]
    x = np.where(same, x ^ np.uint64(1 << 63), x)
    label = x
    for _ in range(4):  # 64 bits to below 128, 14, 8 and 6 labels
        label = _toss(label, first)
    label = label.astype(np.int64)
    left, right = np.full(len(x), -1), np.full(len(x), -1)
    left[1:], right[:-1] = label[:-1], label[1:]
    last = np.append(first[1:], True)
    left[first] = 99
    right[last] = -1
    begin = ((label > left) & (label > right)) | first
    begin[1:] &= first[1:] | ~first[:-1]  # two symbols at least, so that each level is shorter
    start = np.flatnonzero(begin)
    end = np.append(start[1:], len(x))
    return mix(segment_hash(_powers_sum(x), start, end)), owner[start], np.add.reduceat(span, start)


def signatures(texts: list[str], p: FingerprintParams) -> np.ndarray:
    """A row of `places` 16-bit numbers per text."""
    a = multipliers(p.places, p.seed)
    out = np.zeros((len(texts), p.places), dtype=np.uint16)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (size == 0 or size + len(texts[last]) <= 600_000):
            size += len(texts[last]) + 1
            last += 1
        part = texts[first:last]
        lengths = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        symbols = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        symbols, owner = mix(symbols + np.uint64(1)), np.repeat(np.arange(len(part)), lengths)
        span, many, names, owners = np.ones(len(symbols), dtype=np.int64), lengths, [], []
        while len(symbols):
            keep = (span >= p.least_span) | (many[owner] == 1)
            names.append(symbols[keep])
            owners.append(owner[keep])
            on = many[owner] > 1
            symbols, owner, span = parse(symbols[on], owner[on], span[on])
            many = np.bincount(owner, minlength=len(part))
        s, o = np.concatenate([np.zeros(0, np.uint64), *names]), np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.argsort(o, kind="stable")
        s, bounds = s[order], np.searchsorted(o[order], np.arange(len(part) + 1))
        for i in range(len(part)):
            mine = s[bounds[i] : bounds[i + 1]]
            if len(mine):
                least = np.full(p.places, 2**64 - 1, dtype=np.uint64)
                for j in range(0, len(mine), 8192):
                    np.minimum(least, (mine[None, j : j + 8192] * a[:, None]).min(axis=1), out=least)
                out[first + i] = (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)
        first = last
    return out


def fingerprint(texts: list[str], p: FingerprintParams = FingerprintParams()) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signatures(texts, p)]


def likeness(a: str, b: str) -> float:
    """Share of equal 16-bit places of two fingerprints."""
    x, y = (np.frombuffer(bytes.fromhex(v), dtype=">u2") for v in (a, b))
    return float((x == y).mean())


def fingerprinted(docs: DataFrame, p: FingerprintParams = FingerprintParams()) -> DataFrame:
    """doc_id, text and fingerprint for every row of docs."""
    return _with_fingerprint(_ordered(docs), [], p).select(null_id("doc_id"), "text", "fingerprint")


def _ordered(docs: DataFrame) -> DataFrame:
    """Rows with their order (k1, k2): descending doc_id, then a hash of the text."""
    rows = docs.select(given_id("doc_id"), "text")
    return rows.withColumn("k1", F.bitwise_not("doc_id")).withColumn("k2", F.xxhash64("text"))


def _buckets(k1: pd.Series, k2: pd.Series, bounds: list[tuple[int, int]]) -> list[int]:
    return [bisect_right(bounds, key) for key in zip(k1.tolist(), k2.tolist(), strict=True)]


def _with_fingerprint(rows: DataFrame, bounds: list[tuple[int, int]], p: FingerprintParams) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                texts = [t or "" for t in batch["text"]]
                yield batch.assign(bucket=_buckets(batch["k1"], batch["k2"], bounds), text=texts, fingerprint=fingerprint(texts, p))

    kinds = "doc_id long, text string, k1 long, k2 long, bucket long, fingerprint string"
    return rows.select("doc_id", "text", "k1", "k2").mapInPandas(run, kinds)


def _first_keys(rows: DataFrame, bounds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(bucket, k1, k2) of each bucket's first row, in order: as many as buckets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(bucket=_buckets(batch["k1"], batch["k2"], bounds))

    told = rows.select("k1", "k2").mapInPandas(run, "k1 long, k2 long, bucket long")
    least = told.groupBy("bucket").agg(F.min(F.struct("k1", "k2")).alias("key")).select("bucket", "key.*")
    return sorted(tuple(r) for r in least.collect())


def compared(docs: DataFrame, p: FingerprintParams = FingerprintParams()) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The next row is found inside ranges of (doc_id, text hash), cut by a
    bounded sample, which Spark deals out; only the first row of each range
    (as many as ranges) is joined across them, by the range.
    """
    spark = docs.sparkSession
    rows = _ordered(docs)
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of least hash are a sample that is the same in every run
    some = rows.select("k1", "k2").orderBy(F.xxhash64("k1", "k2")).limit(n * p.sample).collect()
    keys = sorted((r.k1, r.k2) for r in some)
    bounds = sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else []
    firsts = _first_keys(rows, bounds)
    order = [F.col("k1"), F.col("k2")]
    in_range = Window.partitionBy("bucket").orderBy(*order)
    following = _with_fingerprint(rows, bounds, p).select(
        "*", F.lead("text").over(in_range).alias("next_text"), F.lead("fingerprint").over(in_range).alias("next_print")
    )
    links = [(bucket, *after[1:]) for bucket, after in zip([f[0] for f in firsts], firsts[1:] + firsts[:1], strict=True)]
    heads = F.broadcast(spark.createDataFrame(links, "before long, k1 long, k2 long"))  # a row for each range
    across = _with_fingerprint(rows.join(heads, ["k1", "k2"]).select(*rows.columns), bounds, p).dropDuplicates(["k1", "k2"])
    across = across.join(heads, ["k1", "k2"]).select("before", F.col("text").alias("h_text"), F.col("fingerprint").alias("h_print"))
    ends = (following["bucket"] == across["before"]) & following["next_print"].isNull()
    joined = following.join(across, ends, "left").select(
        "doc_id", "text", "fingerprint",
        F.coalesce("next_text", "h_text").alias("next_text"), F.coalesce("next_print", "h_print").alias("next_print"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            edited = []
            for text, after_text in zip(batch["text"], batch["next_text"], strict=True):
                k = len(text) // 3
                edited.append(text[: len(text) - k] + after_text[:k])
            prints = fingerprint(edited, p)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "n_chars": [*map(len, batch["text"])],
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
                    "fingerprint": batch["fingerprint"],
                    "edited_fingerprint": prints,
                    "near_edited": [*map(likeness, batch["fingerprint"], prints)],
                    "near_next": [*map(likeness, batch["fingerprint"], batch["next_print"])],
                }
            )

    out = joined.mapInPandas(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )
    return out.withColumn("doc_id", null_id("doc_id"))
