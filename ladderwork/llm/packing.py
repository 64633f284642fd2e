"""Best-fit packing by minimum bin slack.

Documents are tokenised once into pieces of at most `capacity` tokens; the
pieces (no tokens) go to shards of bounded size by a hash.  In a shard each
sequence starts with the longest piece left, and a subset-sum dynamic
programme over the available lengths, kept as bits of one integer, finds the
combination that leaves the least slack.  It is removed and the next sequence
begins.  Shards are independent, so the work spreads and nothing is gathered.

Ids are those of the vocabulary file byte_bpe_50k.json, added token included.
They are computed from its rank file by a library that takes a fifth of the
time; the tests hold them against `tokenizers` over every code point.

Null text counts as empty: its document is the end id alone.  Rows are packed
as they come: a repeated row is packed again, a null doc_id stays null.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderwork.llm.common import given_id, null_id, written

#: Fixed value: the added token of the vocabulary.
ADDED = {"<|endoftext|>": 50256}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class PackingParams:
    #: the rank file of the vocabulary that byte_bpe_50k.json holds
    vocabulary: str
    capacity: int = 2048
    end_id: int = 0
    #: pieces in a shard, about; bounds a task's memory
    shard_pieces: int = 16_384


def default_params() -> PackingParams:
    import public_tokenizers

    return PackingParams(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids; the added token's string in a text is its id, as in the vocabulary file."""
    encoding = _encoding(path)

    def encode(text: str) -> list[int]:
        if any(token in text for token in ADDED):
            return encoding.encode(text, allowed_special="all")
        return encoding.encode_ordinary(text)

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, p: PackingParams) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the CRC-32 of its ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(p.vocabulary), array("I", [p.end_id])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"], strict=True):
                ids = memoryview(array("I", encode(text or "")) + end).cast("B")
                n = len(ids) // 4
                for k, (start, length) in enumerate(cuts(n, p.capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(given_id("doc_id"), "text").mapInPandas(run, PIECES)


def _combine(room: int, counts: list[int], available: int, mirrored: int, top: int) -> list[int]:
    """Lengths whose sum comes closest to `room` from below, each at most as often as it is there."""
    if available >> room & 1:
        return [room]
    pair = available & (mirrored >> (top - room))
    while pair:
        a = pair.bit_length() - 1
        if 2 * a != room or counts[a] > 1:
            return [a, room - a]
        pair ^= 1 << a
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    left = available & mask
    while left and not reach >> room & 1:
        length = left.bit_length() - 1
        left ^= 1 << length
        for _ in range(min(counts[length], room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
            if reach >> room & 1:
                break
    at, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> at & 1:
            chosen.append(length)
            at -= length
    return chosen


def fill(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences of lengths by minimum bin slack; each holds the longest length left."""
    counts = [0] * (capacity + 1)
    for n in lengths:
        counts[n] += 1
    available = sum(1 << n for n in range(1, capacity + 1) if counts[n])
    mirrored = sum(1 << (capacity - n) for n in range(1, capacity + 1) if counts[n])
    out = []

    def take(n: int) -> None:
        nonlocal available, mirrored
        counts[n] -= 1
        if not counts[n]:
            available ^= 1 << n
            mirrored ^= 1 << (capacity - n)

    while available:
        longest = available.bit_length() - 1
        take(longest)
        chosen = _combine(capacity - longest, counts, available, mirrored, capacity) if longest < capacity else []
        for n in chosen:
            take(n)
        out.append([longest, *chosen])
    return out


def packed(docs: DataFrame, p: PackingParams | None = None) -> DataFrame:
    """pieces() with sequence_id and offset for every piece."""
    p = p or default_params()
    cut = written(pieces(docs, p), "pieces")
    shards = max(1, -(-cut.count() // p.shard_pieces))

    def pack(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        rows = defaultdict(list)
        for i, n in enumerate(shard["length"].tolist()):
            rows[n].append(i)
        sequence, offset = np.zeros(len(shard), dtype=np.int64), np.zeros(len(shard), dtype=np.int64)
        for k, lengths in enumerate(fill(shard["length"].tolist(), p.capacity)):
            at = 0
            for n in lengths:
                i = rows[n].pop()
                sequence[i], offset[i] = (key[0] << 32) + k, at
                at += n
        return shard.drop(columns="shard").assign(sequence_id=sequence, offset=offset)

    # a running number tells equal rows apart, so that no shard gets them all
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    out = dealt.groupBy("shard").applyInPandas(pack, PIECES + ", sequence_id long, offset long")
    return out.withColumn("doc_id", null_id("doc_id"))
