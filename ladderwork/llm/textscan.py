"""Vectorised word scanning of UTF-8 text inside Spark tasks.

Many texts are laid end to end in one byte buffer and cut into words with
numpy table look-ups, so that no Python object is made for a word.  Words get
64-bit hashes: a polynomial over their bytes (odd base, modulo 2**64) that is
then mixed.  Equal words have equal hashes on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
CHUNK = 1 << 20

#: White space of the contract `[^\x20\x09-\x0D]+`.
SPACE_BYTES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def lower_table() -> np.ndarray:
    """A byte table that lower-cases A-Z and leaves every other byte."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_words() -> np.ndarray:
    """True for bytes that belong to a word when only white space separates."""
    table = np.ones(256, dtype=bool)
    table[list(SPACE_BYTES)] = False
    return table


_LOWER, _SPACE_WORDS = lower_table(), space_words()
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n + 1:
        size = max(n + 1, CHUNK + (1 << 17))
        up = np.full(size, _P, dtype=np.uint64)
        down = np.full(size, _P_INV, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; the argument is not changed."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; segment_hash() turns any segment into a hash."""
    return code_sums(buf.astype(np.uint64) + np.uint64(1))


def code_sums(codes: np.ndarray) -> np.ndarray:
    """prefix_sums() of 64-bit codes."""
    up, _ = _power_tables(len(codes))
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], out=out[1:])
    return out


def segment_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = _power_tables(len(sums))
    return (sums[end] - sums[start]) * down[start]


def as_bytes(text: str | bytes | None) -> bytes:
    if text is None:
        return b""
    return text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a longer text stands alone."""
    first, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield first, i
            first, total = i, 0
        total += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


def scan(texts: list[bytes], word_bytes: np.ndarray = _SPACE_WORDS, lower: bool = True):
    """Words of some texts: (hash of each word, first word of each text, n texts + 1 long)."""
    return scan_endings(texts, word_bytes, lower)[:2]


def scan_endings(texts: list[bytes], word_bytes: np.ndarray = _SPACE_WORDS, lower: bool = True):
    """scan(), and a hash of each word's last three bytes and bounded length."""
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    text_at = np.concatenate([[0], np.cumsum(lengths)])
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if lower:
        buf = _LOWER[buf]
    inside = word_bytes[buf]
    inside[text_at[1:] - 1] = False
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = mix(segment_hash(prefix_sums(buf), start, end))
    ending = buf[end - 1].astype(np.uint64)
    for back in (2, 3):
        ending = ending * np.uint64(257) + np.where(end - back >= start, buf[end - back], 0).astype(np.uint64)
    ending = mix(ending * np.uint64(8) + np.minimum((end - start) // 4, 3).astype(np.uint64))
    return hashes, np.searchsorted(start, text_at), ending


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words make one shingle."""
    if not len(words):
        return words
    width_here = min(width, len(words))
    n = len(words) - width_here + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(width_here):
        total *= np.uint64(0x9FB21C651E98DF25)
        total += words[j : j + n]
    return np.unique(mix(total ^ np.uint64(width_here)))
