"""Repeated byte strings by a distributed merge sort of front-coded suffix runs.

A byte goes if a string of `length` bytes that covers it starts anywhere else
too.  Sorting every suffix would exchange `length` bytes for each byte of
text, so suffixes are sampled by content: of the `length - core + 1` cores in
a string the one with the least hash (the leftmost of equal ones) is its
anchor.  Equal strings have equal anchors at equal places, so only suffixes at
anchors whose core occurs twice can matter.

1. Anchors are found once and written beside the texts; their cores are
   counted over the corpus, and unique ones end there.
2. Every task sorts the suffixes at its other anchors, merges equal ones and
   writes them front-coded (length of the prefix shared with the one before,
   and the rest), cut into ranges of the core hash.
3. A range's runs are combined by a loser tree that knows each contender's
   common prefix with the last one out and never compares those bytes again;
   suffixes that come out equal, with equal left context, are one.
4. A string with `d` bytes left of its anchor repeats if another suffix shares
   `length - d` bytes with its suffix and `d` bytes with its left context.  The
   prefixes are those that the merge has found, the left contexts are sorted
   likewise, so the bytes themselves decide.  Groups are resolved as they
   stream out of the merge, and a group has at most `hot_core` suffixes.
5. A core with more occurrences never meets in one task.  Its strings are
   told apart by 128-bit hashes: equal surroundings are combined in the task
   that holds them, and Spark counts the strings with map-side sums.

Defined results: null counts as empty; texts under `length` bytes lose
nothing; strings never cross texts; copies of a text remove each other; each
row of docs is a text of its own, whatever its doc_id.  Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderwork.llm import textscan
from ladderwork.llm.common import written

_ENTRY = struct.Struct("<HHHI")
_OWNER = np.dtype([("row", "<i8"), ("begin", "<i8")])
SPANS = "row long, start long, end long"


@dataclass(frozen=True)
class RepeatParams:
    length: int = 400
    core: int = 200
    #: suffixes that a task holds before it writes its runs, and in a range, about
    run_entries: int = 15_000
    range_entries: int = 12_000
    #: suffixes that are resolved at once, about
    merged_entries: int = 8_000
    #: occurrences from which a core's strings are counted by hash; bounds what is resolved at once
    hot_core: int = 100_000
    #: bits by which rows without repeats are told before their texts travel; 64 make a broadcast row
    filter_bits: int = 1 << 27
    #: cores that take more than one in so many anchors are told by broadcast; there are fewer than that
    frequent: int = 50_000


def _slices(batches: Iterator[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    """Smaller pieces of the batches, so that few texts are held twice."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.iloc[at : at + rows]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every `width` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(values) - width + 1], out[width - have :]) if have < width else out


def anchors(texts: list[bytes], p: RepeatParams) -> tuple[np.ndarray, ...]:
    """Text, place, first and last string start, and core hash of each anchor.

    Places count in the texts laid end to end.
    """
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    at = np.concatenate([[0], np.cumsum(lengths)])
    n = int(at[-1])
    none = np.zeros(0, dtype=np.int64)
    if n < p.length:
        return none, none, none, none, none.view(np.uint64)
    sums = textscan.prefix_sums(np.frombuffer(b"".join(texts), dtype=np.uint8))
    place = np.arange(n - p.core + 1)
    h = textscan.mix(textscan.segment_hash(sums, place, place + p.core))
    least = _sliding(h, p.length - p.core + 1, np.minimum)
    text = np.repeat(np.arange(len(texts)), lengths)
    start = np.flatnonzero(at[text[: n - p.length + 1] + 1] - np.arange(n - p.length + 1) >= p.length)
    least = least[start]
    # the leftmost place in [start, start + length - core] with the least hash
    found = np.full(len(start), -1, dtype=np.int64)
    candidates = np.flatnonzero(np.isin(h, np.unique(least)))
    k = np.searchsorted(candidates, start)
    todo = np.arange(len(start))
    while len(todo):
        hit = h[candidates[k[todo]]] == least[todo]
        found[todo[hit]] = candidates[k[todo[hit]]]
        todo = todo[~hit]
        k[todo] += 1
    new = np.ones(len(start), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    spot = found[first] if len(first) else none
    return text[spot], spot, start[first], start[last], h[spot]


def _marked(docs: DataFrame, p: RepeatParams) -> DataFrame:
    """Every row with an id of its own and its anchors: place, first and last string start, core."""
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                texts = [textscan.as_bytes(t) for t in batch.column("text").to_pylist()]
                bounds, found = [np.zeros(1, dtype=np.int64)], [[np.zeros(0, dtype=np.int64)] for _ in range(4)]
                for lo, hi in textscan.chunks(texts, 1 << 18):
                    text, spot, first, last, core = anchors(texts[lo:hi], p)
                    begin = np.concatenate([[0], np.cumsum([*map(len, texts[lo:hi])])])[text]
                    for out, x in zip(found, (spot - begin, first - begin, last - begin, core.view(np.int64)), strict=True):
                        out.append(x)
                    bounds.append(bounds[-1][-1] + np.searchsorted(text, np.arange(1, hi - lo + 1)))
                at = pa.array(np.concatenate(bounds), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x), t)) for x, t in zip(found, [pa.int32()] * 3 + [pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *lists], schema=pa.schema([*batch.schema, *((n, ints) for n in ("place", "first", "last")), ("core", pa.list_(pa.int64()))])
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    anchors_type = "place array<int>, first array<int>, last array<int>, core array<long>"
    return rows.mapInArrow(run, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, {anchors_type}")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first `known` bytes are known to agree."""
    high = min(len(a), len(b))
    if a[known:high] == b[known:high]:
        return high
    low = known
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def encode_run(entries: list[tuple[bytes, bytes, np.ndarray]]) -> bytes:
    """A sorted run (key, left context, owners), front-coded."""
    parts, before = [], b""
    for key, left, owners in entries:
        shared = common_prefix(before, key)
        parts += [_ENTRY.pack(shared, len(key) - shared, len(left), len(owners)), key[shared:], left, owners.tobytes()]
        before = key
    return zlib.compress(b"".join(parts), 1)


def decode_run(blob: bytes) -> Iterator[tuple[int, bytes, bytes, np.ndarray]]:
    """(prefix shared with the key before, key, left context, owners) in order."""
    data, at, key = zlib.decompress(blob), 0, b""
    while at < len(data):
        shared, rest, left, owners = _ENTRY.unpack_from(data, at)
        at += _ENTRY.size
        key = key[:shared] + data[at : at + rest]
        at += rest
        end = at + left + owners * _OWNER.itemsize
        yield shared, key, data[at : at + left], np.frombuffer(data, _OWNER, owners, at + left)
        at = end


def merge_runs(runs: list[Iterator[tuple[int, bytes, bytes, np.ndarray]]]) -> Iterator[tuple[int, bytes, bytes, np.ndarray]]:
    """The runs' entries in order, each with its common prefix with the one before.

    A loser tree; every contender carries its common prefix with the last
    winner.  The longer prefix wins without a look at the bytes; equal ones
    are compared from there on only.
    """
    size = 1
    while size < len(runs):
        size *= 2
    current: list[tuple[int, bytes, bytes, np.ndarray] | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    prefix = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes that with the winner."""
        x, y = current[a], current[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        shared = common_prefix(x[1], y[1], prefix[a])
        winner, loser = (a, b) if x[1][shared:] <= y[1][shared:] else (b, a)
        prefix[loser] = shared
        return winner, loser

    tree = [0] * (2 * size)
    losers = [0] * size
    for i in range(size):
        tree[size + i] = i
    for i in range(size - 1, 0, -1):
        tree[i], losers[i] = play(tree[2 * i], tree[2 * i + 1])
    winner = tree[1] if size > 1 else 0
    while (entry := current[winner]) is not None:
        yield prefix[winner], *entry[1:]
        following = next(runs[winner], None)
        current[winner] = following
        prefix[winner] = following[0] if following else 0
        node = (size + winner) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _suffixes(batches: Iterator[pd.DataFrame], which: str, p: RepeatParams) -> Iterator[tuple[int, bytes, bytes, bytes, int]]:
    """(row, core name, left context, suffix, first string start) of the wanted anchors."""
    columns = ("row", "text", which, "place", "first", "last", "core")
    for batch in _slices(batches):
        for row, text, wanted, place, first, last, core in zip(*(batch[c] for c in columns), strict=True):
            if wanted is None or not len(wanted):
                continue
            data, k = textscan.as_bytes(text), np.asarray(wanted)
            names = np.asarray(core)[k].astype(">u8").tobytes()
            for j, (s, lo, hi) in enumerate(zip(*(np.asarray(x)[k].tolist() for x in (place, first, last)), strict=True)):
                yield row, names[8 * j : 8 * j + 8], data[lo:s], data[s : hi + p.length], lo


def _runs(docs: DataFrame, ranges: int, p: RepeatParams) -> DataFrame:
    """(range, run) of the suffixes at the anchors listed in `cool`."""
    shift = (1 << 64) // ranges + 1

    def flush(entries: list[tuple[bytes, bytes, tuple[int, int]]]) -> pd.DataFrame:
        entries.sort()
        out: dict[int, list[tuple[bytes, bytes, list]]] = {}
        for key, left, owner in entries:
            run = out.setdefault(int.from_bytes(key[:8], "big") // shift, [])
            if run and run[-1][0] == key and run[-1][1] == left:
                run[-1][2].append(owner)
            else:
                run.append((key, left, [owner]))
        rows = [(k, encode_run([(a, b, np.array(o, dtype=_OWNER)) for a, b, o in run])) for k, run in out.items()]
        return pd.DataFrame(rows, columns=["range", "run"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries: list = []
        for row, name, left, suffix, begin in _suffixes(batches, "cool", p):
            entries.append((name + suffix, left, (row, begin)))
            if len(entries) >= p.run_entries:
                yield flush(entries)
                entries = []
        if entries:
            yield flush(entries)

    return docs.mapInPandas(run, "range long, run binary")


def _repeated(shared: np.ndarray, lefts: list[bytes], sizes: np.ndarray, weight: np.ndarray, p: RepeatParams) -> np.ndarray:
    """Whether the string with d bytes left of its anchor occurs twice, by suffix and d.

    Suffixes come in order; shared is the prefix of each with the one before,
    sizes their lengths and weight how often each is there.
    """
    n, width = len(lefts), p.length - p.core
    shared = shared.copy()
    shared[:1] = 0
    turned = [x[::-1] for x in lefts]
    order = sorted(range(n), key=turned.__getitem__)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    with_last = np.array([0, *(common_prefix(turned[a], turned[b]) for a, b in zip(order, order[1:]))])
    longest, least = np.fromiter(map(len, lefts), dtype=np.int64, count=n), p.length - sizes
    out = np.zeros((n, width + 1), dtype=bool)
    for d in range(width + 1):
        i = np.flatnonzero((least <= d) & (d <= longest))
        if len(i):
            same = np.cumsum(shared < p.length - d)[i] * (n + 1) + np.cumsum(with_last < d)[place[i]]
            _, back = np.unique(same, return_inverse=True)
            out[i, d] = np.bincount(back, weights=weight[i])[back] >= 2
    return out


def _stretches(twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each maximal run of true cells."""
    edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).view(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _spans_of(found: list[tuple[int, bytes, int]], owners: list[list[np.ndarray]], p: RepeatParams) -> pd.DataFrame:
    """What repeats in whole groups of suffixes (prefix shared, left context, size) with equal cores."""
    shared, lefts, sizes = zip(*found, strict=True)
    weight = np.fromiter((sum(map(len, o)) for o in owners), dtype=np.int64, count=len(owners))
    twice = _repeated(np.array(shared), list(lefts), np.array(sizes), weight, p)
    entry, low, high = _stretches(twice)
    left = np.fromiter(map(len, lefts), dtype=np.int64, count=len(lefts))[entry]
    many = weight[entry]  # every span once for each owner of its suffix
    own = np.concatenate([x for i in entry.tolist() for x in owners[i]]) if len(entry) else np.zeros(0, dtype=_OWNER)
    return pd.DataFrame(
        {"row": own["row"], "start": own["begin"] + np.repeat(left - high, many), "end": own["begin"] + np.repeat(left - low + p.length, many)}
    )


def _merged_spans(runs: list[bytes], p: RepeatParams) -> Iterator[pd.DataFrame]:
    """Spans of one range; groups of equal cores are resolved as they come out of the merge."""
    found: list[tuple[int, bytes, int]] = []
    owners: list[list[np.ndarray]] = []
    before: dict[bytes, int] = {}
    size = -1
    for shared, key, left, own in merge_runs([decode_run(b) for b in runs]):
        if shared < 8 + p.core and len(found) >= p.merged_entries:
            yield _spans_of(found, owners, p)
            found, owners = [], []
        if not found or shared != len(key) or size != len(key):
            before, size = {}, len(key)
        if left in before:  # the same suffix and left context again
            owners[before[left]].append(own)
            continue
        before[left] = len(found)
        found.append((shared - 8, left, len(key) - 8))
        owners.append([own])
    if found:
        yield _spans_of(found, owners, p)


def _merged(runs: DataFrame, p: RepeatParams) -> DataFrame:
    """Spans of what repeats, from all runs of each range."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_range = [], None
        for batch in batches:
            for key, blob in zip(batch["range"].tolist(), batch["run"], strict=True):
                if key != held_range and held:
                    yield from _merged_spans(held, p)
                    held = []
                held_range = key
                held.append(blob)
        if held:
            yield from _merged_spans(held, p)

    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(parts, "range").sortWithinPartitions("range").mapInPandas(merge, SPANS)


@lru_cache
def _byte_codes() -> np.ndarray:
    """Two random 64-bit numbers for each byte."""
    return np.random.default_rng(29).integers(0, 2**64, (2, 256), dtype=np.uint64)


def _string_hashes(data: bytes, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of the n strings that start in data."""
    start, buf = np.arange(n), np.frombuffer(data, dtype=np.uint8)
    sums = (textscan.code_sums(codes[buf]) for codes in _byte_codes())
    one, two = (textscan.mix(textscan.segment_hash(s, start, start + length)).view(np.int64) for s in sums)
    return one, two


def _counted(docs: DataFrame, p: RepeatParams) -> DataFrame:
    """Spans of what repeats at the anchors listed in `hot`: strings are counted, not gathered."""

    def hot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[bytes] = set()
        out: list[tuple] = []
        for row, _, left, suffix, begin in _suffixes(batches, "hot", p):
            name = hashlib.blake2b(left + b"|" + suffix, digest_size=16, salt=len(left).to_bytes(2, "little")).digest()
            out.append((*struct.unpack("<qq", name), row, begin, None if name in told else left + suffix, len(left)))
            told.add(name)
            if len(out) >= 5_000:
                yield pd.DataFrame(out, columns=["e1", "e2", "row", "begin", "body", "left"])
                out = []
            if len(told) >= 50_000:
                told.clear()
        if out:
            yield pd.DataFrame(out, columns=["e1", "e2", "row", "begin", "body", "left"])

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, 200):
            parts = []
            for e1, e2, body, n in zip(batch["e1"], batch["e2"], batch["body"], batch["n"], strict=True):
                many = len(body) - p.length + 1
                one, two = _string_hashes(bytes(body), many, p.length)
                parts.append(pd.DataFrame({"e1": e1, "e2": e2, "h1": one, "h2": two, "offset": np.arange(many, dtype=np.int32), "n": n}))
            if parts:
                yield pd.concat(parts)

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches, 5_000):
            out = []
            for row, begin, offsets in zip(batch["row"].tolist(), batch["begin"].tolist(), batch["offsets"], strict=True):
                x = np.sort(np.asarray(offsets, dtype=np.int64))
                first = np.flatnonzero(np.diff(x, prepend=-2) > 1)
                last = np.append(first[1:], len(x)) - 1
                out += [(row, begin + a, begin + b + p.length) for a, b in zip(x[first].tolist(), x[last].tolist(), strict=True)]
            yield pd.DataFrame(out, columns=["row", "start", "end"], dtype="int64")

    owned = written(docs.mapInPandas(hot, "e1 long, e2 long, row long, begin long, body binary, left int"), "hot-suffixes")
    many = owned.groupBy("e1", "e2").agg(F.count("*").alias("n"))
    bodies = owned.where("body is not null").dropDuplicates(["e1", "e2"]).select("e1", "e2", "body")
    told = written(bodies.join(many, ["e1", "e2"]).mapInPandas(strings, "e1 long, e2 long, h1 long, h2 long, offset int, n long"), "hot-strings")
    twice = told.groupBy("h1", "h2").agg(F.sum("n").alias("all")).where("all > 1").select("h1", "h2")
    where = told.join(twice, ["h1", "h2"]).groupBy("e1", "e2").agg(F.collect_list("offset").alias("offsets"), F.max("n").alias("n"))
    where = written(where, "hot-places")
    return _spread_join(owned.drop("body", "left"), where, ["e1", "e2"], p).select("row", "begin", "offsets").mapInPandas(spans, SPANS)


def _spread_join(rows: DataFrame, table: DataFrame, on: list[str], p: RepeatParams) -> DataFrame:
    """rows joined with a table of one row a key that tells how often rows have it (n).

    Keys with more than one in `frequent` of all rows, fewer than `frequent`
    of them, are joined by broadcast, so that no task gets all rows of one.
    """
    share = (table.agg(F.sum("n")).first()[0] or 0) / p.frequent
    often = F.broadcast(table.where(F.col("n") > share))
    rare = rows.join(often.select(*on), on, "left_anti").join(table.where(F.col("n") <= share), on)
    return rows.join(often, on).unionByName(rare)


def _listed(docs: DataFrame, p: RepeatParams) -> tuple[DataFrame, DataFrame]:
    """Marked rows, and by row the anchors (their numbers) whose core occurs twice: `cool`, or `hot`."""
    marked = written(_marked(docs, p), "marked-texts")
    again = marked.select(F.explode("core").alias("core")).groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    again = written(again, "repeated-cores")
    here = marked.select("row", F.posexplode("core").alias("k", "core"))
    each = _spread_join(here, again, ["core"], p)
    cool = F.col("n") <= p.hot_core
    places = each.groupBy("row").agg(F.collect_list(F.when(cool, F.col("k"))).alias("cool"), F.collect_list(F.when(~cool, F.col("k"))).alias("hot"))
    return marked, written(places, "repeat-places")


def _sifted(marked: DataFrame, rows: DataFrame, p: RepeatParams, passing: bool = True) -> DataFrame:
    """Rows of marked that may (or that cannot) be among `rows`, before a join moves their texts.

    A filter of `filter_bits` bits, one hash: its size is bounded whatever the
    data, and on very large ones it lets more rows through.
    """
    pos = F.pmod(F.xxhash64("row"), F.lit(p.filter_bits))
    bit = F.expr("shiftleft(1L, cast(pos & 63 AS int))")
    words = rows.select(pos.alias("pos")).groupBy(F.expr("shiftright(pos, 6)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    both = marked.withColumn("pos", pos).withColumn("word", F.expr("shiftright(pos, 6)"))
    there = F.coalesce(F.col("bits").bitwiseAND(bit), F.lit(0)) != 0
    return both.join(F.broadcast(words), "word", "left").where(there if passing else ~there).drop("pos", "word", "bits")


def _spans(marked: DataFrame, places: DataFrame, p: RepeatParams) -> DataFrame:
    """row and spans (a flat array of starts and ends) of what goes."""
    total, hot = places.agg(F.coalesce(F.sum(F.size("cool")), F.lit(0)), F.coalesce(F.sum(F.size("hot")), F.lit(0))).first()
    ranges = max(1, -(-total // p.range_entries))

    def wanted(rows: DataFrame) -> DataFrame:
        return _sifted(marked, rows.select("row"), p).join(rows, "row")

    found = _merged(_runs(wanted(places), ranges, p), p)
    if hot:
        found = found.unionByName(_counted(wanted(places.where(F.size("hot") > 0)), p))
    return written(found.groupBy("row").agg(F.flatten(F.collect_list(F.array("start", "end"))).alias("spans")), "repeat-spans")


def without_repeats(docs: DataFrame, p: RepeatParams = RepeatParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) and kept_sha256 for every row of docs."""
    marked, places = _listed(docs, p)
    spans = _spans(marked, places, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                out = []
                for text, flat in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    data = textscan.as_bytes(text)
                    kept, at, removed, count, end = [], 0, 0, 0, -1
                    for x, y in sorted(zip(flat[::2], flat[1::2], strict=True)) if flat is not None else ():
                        count += x > end
                        if y > end:
                            kept.append(data[at : max(at, x)])
                            removed += y - max(x, at)
                            at = end = y
                    kept.append(data[at:])
                    body = b"".join(kept)
                    out.append((len(data), int(removed), int(count), body, hashlib.sha256(body).hexdigest()))
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = marked.select("row", "doc_id", "text")
    some = _sifted(texts, spans.select("row"), p).join(spans, "row", "left").select("doc_id", "text", "spans")
    none = _sifted(texts, spans.select("row"), p, passing=False).select("doc_id", "text", F.lit(None).cast("array<long>").alias("spans"))
    joined = some.unionByName(none)
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
