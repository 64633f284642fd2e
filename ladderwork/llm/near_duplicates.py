"""MinHash near-duplicate documents with sequential Bayesian verification.

1. Each text becomes its set of word shingles (64-bit hashes), a MinHash
   signature and band keys.  Texts with equal sets form one class.
2. Classes that agree on a band are candidates.  In each bucket the member
   with the most bucket mates is the pivot and meets all others, so a bucket
   of n gives n-1 pairs.
3. Pairs are compared signature batch by signature batch.  A pair goes when
   the posterior probability that its similarity reaches the threshold falls
   below the chosen miss probability.  Survivors are verified on full sets.
4. Links give components.  Buckets that still hold several components are
   then finished: their members are dealt into blocks of bounded size, and
   each pair of blocks is compared inside a task, signatures first, by the same
   Bayesian bounds.  Only members that have a mate in another component bring
   their sets; the sets are verified in blocks again, and what comes out are
   links that join components.  All buckets go this one way.

Band and row counts make the chance that a pair at the threshold shares no
band below one in a million (see `miss_probability`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderwork.llm import textscan
from ladderwork.llm.common import NO_ID, components, given_id, maybe_broadcast, null_id, written


@dataclass(frozen=True)
class NearDuplicateParams:
    shingle_words: int = 5
    #: similarity threshold as a fraction of whole numbers
    at_least: tuple[int, int] = (80, 100)
    bands: int = 25
    rows: int = 5
    batch: int = 25
    miss: float = 1e-6
    block: int = 384
    seed: int = 11

    @property
    def threshold(self) -> float:
        return self.at_least[0] / self.at_least[1]


#: The contract's parameters for op10: three words, 0.85.
OP10 = NearDuplicateParams(shingle_words=3, at_least=(85, 100))
#: The pipeline's: five words, 0.8; more bands keep the same recall.
STAGE = NearDuplicateParams(bands=36, rows=5, batch=36)


def miss_probability(p: NearDuplicateParams) -> float:
    """Chance that a pair at exactly the threshold shares no band."""
    return (1 - p.threshold**p.rows) ** p.bands


@lru_cache
def multipliers(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache
def least_matches(p: NearDuplicateParams) -> tuple[tuple[int, int], ...]:
    """(hashes compared, matches needed) after each batch.

    With a uniform prior the posterior after m of n matches is
    Beta(m+1, n-m+1), and P(J >= t) = P(Binomial(n+1, t) <= m).
    """
    total, t, out = p.bands * p.rows, p.threshold, []
    for n in range(p.batch, total + 1, p.batch):
        below = 0.0
        for m in range(n + 2):
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= p.miss:
                out.append((n, m))
                break
    return tuple(out)


def signature(shingles: np.ndarray, p: NearDuplicateParams) -> np.ndarray:
    """The least of each multiplied hash; multiplication by an odd number is a bijection."""
    a, out = multipliers(p.bands * p.rows, p.seed), np.full(p.bands * p.rows, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(out, (shingles[None, i : i + 4096] * a[:, None]).min(axis=1), out=out)
    return out


def _text_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    for first, last in textscan.chunks(texts):
        words, at = textscan.scan(texts[first:last])
        for i in range(last - first):
            yield textscan.shingles(words[at[i] : at[i + 1]], width)


def sketches(texts: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """(id, t, text) -> id, t, n_shingles, set key (c1, c2), band keys and signature bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = multipliers(p.rows, p.seed + 1)
        for batch in batches:
            if batch.empty:
                continue
            texts_here = [textscan.as_bytes(t) for t in batch["text"]]
            rows = []
            for s in _text_sets(texts_here, p.shingle_words):
                c1 = int(textscan.mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0
                c2 = int((textscan.mix(s ^ np.uint64(0x5BD1E995)) | np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0
                if not len(s):
                    rows.append((0, 0, 0, None, None))
                    continue
                sig = signature(s, p)
                keys = textscan.mix((sig.reshape(p.bands, p.rows) * weights).sum(axis=1, dtype=np.uint64))
                rows.append((len(s), c1, c2, keys.view(np.int64), (textscan.mix(sig) & np.uint64(255)).astype(np.uint8).tobytes()))
            out = pd.DataFrame(rows, columns=["n_shingles", "c1", "c2", "bands", "sig"])
            out.insert(0, "id", batch["id"].to_numpy())
            out.insert(1, "t", batch["t"].to_numpy())
            yield out

    return texts.select("id", "t", "text").mapInPandas(
        run, "id long, t long, n_shingles long, c1 long, c2 long, bands array<long>, sig binary"
    )


def shingle_sets(texts: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """(id, text) -> id and the sorted 64-bit shingle hashes as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            sets = _text_sets([textscan.as_bytes(t) for t in batch["text"]], p.shingle_words)
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "set": [s.tobytes() for s in sets]})

    return texts.select("id", "text").mapInPandas(run, "id long, set binary")


def _linked(a: np.ndarray, b: np.ndarray, p: NearDuplicateParams) -> bool:
    less, of = p.at_least
    if of * min(len(a), len(b)) < less * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return of * both >= less * (len(a) + len(b) - both)


def _alive(left: np.ndarray, right: np.ndarray, steps: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Rows of two signature tables (the left may be one row) that survive every batch."""
    alive, matches, done = np.arange(len(right)), np.zeros(len(right), dtype=np.int64), 0
    for upto, need in steps:
        ours = left[:, done:upto] if len(left) == 1 else left[alive, done:upto]
        matches[alive] += (ours == right[alive, done:upto]).sum(axis=1)
        alive, done = alive[matches[alive] >= need], upto
        if not len(alive):
            break
    return alive


def pruned(pairs: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """(a, b, sig_a, sig_b) -> pairs that survive every batch of signatures."""
    steps = least_matches(p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            left = np.frombuffer(b"".join(batch["sig_a"]), dtype=np.uint8).reshape(n, -1)
            right = np.frombuffer(b"".join(batch["sig_b"]), dtype=np.uint8).reshape(n, -1)
            alive = _alive(left, right, steps)
            if len(alive):
                yield batch.iloc[alive][["a", "b"]]

    return pairs.select("a", "b", "sig_a", "sig_b").mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [
                _linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), p)
                for x, y in zip(batch["set_a"], batch["set_b"], strict=True)
            ]
            if any(good):
                yield batch.loc[good, ["a", "b"]]

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    # b repeats less often than a (a is the pivot), so b's set travels with the pair
    return pairs.join(right, "b").join(left, "a").mapInPandas(run, "a long, b long")


def _dealt(members: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """Members (bucket, n, id, ...) once for each pair of blocks that holds theirs, by bucket and pair."""
    many = members.withColumn("blocks", F.ceil(F.col("n") / p.block).cast("int"))
    many = many.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    return many.withColumn("pair", pair.cast("long")).drop("n", "blocks", "other")


def _by_pair(dealt: DataFrame, compare, out: str) -> DataFrame:
    """compare(rows of one pair of blocks) -> list of rows, for each pair; a pair's rows are bounded."""
    names = [c.split()[0] for c in out.split(", ")]
    columns = [c for c in dealt.columns if c not in ("bucket", "pair")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_key = [], None
        for batch in batches:
            found = []
            for bucket, pair, *row in zip(batch["bucket"].tolist(), batch["pair"].tolist(), *(batch[c] for c in columns), strict=True):
                if (bucket, pair) != held_key:
                    if len(held) > 1:
                        found += compare(held_key[0], dict(zip(columns, zip(*held, strict=True), strict=True)))
                    held, held_key = [], (bucket, pair)
                held.append(row)
            if found:
                yield pd.DataFrame(found, columns=names)
        if len(held) > 1 and (found := compare(held_key[0], dict(zip(columns, zip(*held, strict=True), strict=True)))):
            yield pd.DataFrame(found, columns=names)

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "bucket", "pair").sortWithinPartitions("bucket", "pair").mapInPandas(run, out)


def _candidates(i: int, roots: np.ndarray, blocks: np.ndarray, sizes: np.ndarray, p: NearDuplicateParams) -> np.ndarray:
    """Later rows of a pair of blocks that i has to meet: other component, other block, fitting size."""
    less, of = p.at_least
    here = sizes[i + 1 :]
    ok = (roots[i + 1 :] != roots[i]) & (of * np.minimum(here, sizes[i]) >= less * np.maximum(here, sizes[i]))
    if blocks[0] != blocks[-1]:  # rows come with the blocks in order
        ok &= blocks[i + 1 :] != blocks[i]
    return np.flatnonzero(ok) + i + 1


def members_with_mates(members: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """(bucket, id) of members that a member of another component may be linked with, by signatures.

    members: bucket, n, id, n_shingles, comp and sig.
    """
    steps = least_matches(p)

    def compare(bucket: int, rows: dict) -> list[tuple[int, int]]:
        order = np.argsort(np.array(rows["block"]), kind="stable")
        ids, roots, blocks, sizes = (np.array(rows[c], dtype=np.int64)[order] for c in ("id", "comp", "block", "n_shingles"))
        sigs = np.frombuffer(b"".join(rows["sig"][k] for k in order), dtype=np.uint8).reshape(len(ids), -1)
        open_ = np.zeros(len(ids), dtype=bool)
        for i in range(len(ids) - 1):
            j = _candidates(i, roots, blocks, sizes, p)
            if len(j) and len(alive := j[_alive(sigs[i : i + 1], sigs[j], steps)]):
                open_[i] = True
                open_[alive] = True
        return [(bucket, x) for x in ids[open_].tolist()]

    return _by_pair(_dealt(members, p), compare, "bucket long, id long").distinct()


def block_links(members: DataFrame, p: NearDuplicateParams) -> DataFrame:
    """Links between components: a forest of them for each pair of blocks.

    members: bucket, n, id, n_shingles, comp, sig and set.
    """
    steps, (less, of) = least_matches(p), p.at_least

    def compare(_: int, rows: dict) -> list[tuple[int, int]]:
        order = np.argsort(np.array(rows["block"]), kind="stable")
        ids, roots, blocks, sizes = (np.array(rows[c], dtype=np.int64)[order] for c in ("id", "comp", "block", "n_shingles"))
        sigs = np.frombuffer(b"".join(rows["sig"][k] for k in order), dtype=np.uint8).reshape(len(ids), -1)
        sets = [np.frombuffer(rows["set"][k], dtype=np.uint64) for k in order]
        names, token = np.unique(np.concatenate(sets), return_inverse=True)
        tokens, mine = np.split(token, np.cumsum([*map(len, sets)])[:-1]), np.zeros(len(names), dtype=bool)
        out = []
        for i in range(len(ids) - 1):
            j = _candidates(i, roots, blocks, sizes, p)
            if not len(j):
                continue
            mine[tokens[i]] = True
            for k in j[_alive(sigs[i : i + 1], sigs[j], steps)].tolist():
                if roots[k] != roots[i]:
                    both = int(np.count_nonzero(mine[tokens[k]]))
                    if of * both >= less * (sizes[i] + sizes[k] - both):
                        out.append((int(ids[i]), int(ids[k])))
                        roots[roots == roots[k]] = roots[i]
            mine[tokens[i]] = False
        return out

    return _by_pair(_dealt(members, p), compare, "a long, b long")


def _class_components(texts: DataFrame, sketch: DataFrame, p: NearDuplicateParams) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (class, c1, c2, n_shingles, rep) and links between classes as (class, component)."""
    less, of = p.at_least
    classes = sketch.where(f"n_shingles > 0 and id <> {NO_ID}").groupBy("c1", "c2", "n_shingles").agg(F.min(F.struct("id", "t")).alias("rep"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    chosen = classes.select("class", "c1", "c2", "n_shingles", "rep.*")
    reps = sketch.join(chosen, ["id", "t", "c1", "c2", "n_shingles"]).dropDuplicates(["class"])
    reps = written(reps.select(F.col("class").alias("id"), "n_shingles", "bands", "sig"), "class-sketches")
    members = reps.select("id", "n_shingles", F.posexplode("bands").alias("band", "key")).select(
        F.xxhash64("band", "key").alias("bucket"), "id", "n_shingles"
    )
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(members.join(buckets, "bucket"), "buckets")
    weight = shared.groupBy("id").agg(F.sum("n").alias("w"))
    pivot = shared.join(weight, "id").groupBy("bucket").agg(F.max_by(F.struct("id", "n_shingles"), F.struct("w", "n_shingles", "id")).alias("pivot"))
    signed = written(reps.join(weight, "id", "left_semi").select("id", "sig"), "signed")
    wanted = chosen.join(weight.select(F.col("id").alias("class")), "class", "left_semi").select("id", "t", "class")
    sets = texts.join(wanted, ["id", "t"]).dropDuplicates(["class"]).select(F.col("class").alias("id"), "text")
    sets = written(shingle_sets(sets, p), "sets")

    sized = F.least("n_shingles", "pivot.n_shingles") * of >= F.greatest("n_shingles", "pivot.n_shingles") * less
    first = (
        shared.join(pivot, "bucket").where(F.col("id") != F.col("pivot.id")).where(sized)
        .select(F.col("pivot.id").alias("a"), F.col("id").alias("b")).distinct()
    )
    left = signed.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    right = signed.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    links = written(verified(pruned(first.join(right, "b").join(left, "a"), p), sets, p), "pivot-links")
    found = written(components(links, "pivot-components"), "found")

    # the rest: buckets of three or more that hold more than one component
    placed = shared.where("n > 2").join(found, "id", "left").select(
        "bucket", "n", "id", "n_shingles", F.coalesce("component", "id").alias("comp")
    )
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    rest = written(placed.join(open_, "bucket").join(signed, "id"), "rest")
    mates = written(members_with_mates(rest, p), "mates")
    n_mates = mates.groupBy("bucket").agg(F.count("*").alias("n"))
    few = rest.drop("n").join(mates, ["bucket", "id"]).join(n_mates, "bucket").join(sets, "id")
    return classes, links.unionByName(block_links(few, p))


def _sketched(docs: DataFrame, p: NearDuplicateParams) -> tuple[DataFrame, DataFrame]:
    texts = docs.select(given_id("doc_id", "id"), F.xxhash64("text").alias("t"), "text")
    return texts, written(sketches(texts, p), "sketches")


def near_duplicates(docs: DataFrame, p: NearDuplicateParams = NearDuplicateParams()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Null and empty texts and texts of white space have no shingles and are
    linked with nothing.  A null doc_id keeps a row of its own: its class id
    is null and it is kept.  Repeated doc_ids with equal text give equal rows;
    with different texts they count as one document that has each text, so
    what is linked with either of them is linked with both.  Extra columns of
    docs are ignored.
    """
    texts, sketch = _sketched(docs, p)
    classes, links = _class_components(texts, sketch, p)
    rows = sketch.select("id", "n_shingles", "c1", "c2").join(classes.drop("rep"), ["c1", "c2", "n_shingles"], "left")
    rows = written(rows.select("id", "n_shingles", "class"), "classed-rows")
    known = (F.col("id") != NO_ID) & F.col("class").isNotNull()
    per_id = rows.where(known).groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("id", "a")
    same_id = rows.where(known).join(per_id, "id").select("a", F.col("class").alias("b")).where("a <> b").distinct()
    joined = components(links.unionByName(same_id), "components")
    placed = classes.select("class", F.col("rep.id").alias("least")).join(joined.withColumnRenamed("id", "class"), "class", "left")
    placed = written(placed.select("class", F.coalesce("component", "class").alias("component"), "least"), "placed-classes")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.select("class", "component").join(least, "component").select("class", "component_id")
    # a text without shingles that shares its doc_id with another text stays alone
    out = rows.join(named, "class", "left")
    known = F.col("id") != NO_ID
    component = F.coalesce(F.col("component_id"), F.col("id"))
    return out.select(
        null_id("id", "doc_id"),
        "n_shingles",
        F.when(known, component).alias("component_id"),
        (~known | (component == F.col("id"))).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, p: NearDuplicateParams = NearDuplicateParams()) -> DataFrame:
    """The rows of docs, all columns, with one row of each group of near-duplicate texts.

    Rows are judged by their text: of a group the row with the least doc_id
    stays (of equal ones that with the least hash of its text), and of rows
    with equal doc_id and text one.  Rows without shingles or doc_id stay.
    """
    texts, sketch = _sketched(docs, p)
    classes, links = _class_components(texts, sketch, p)
    joined = components(links, "components").withColumnRenamed("id", "class")
    placed = written(classes.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class")), "placed-classes")
    leaders = placed.groupBy("component").agg(F.min("rep").alias("rep")).select("rep.*")
    judged = sketch.where(f"n_shingles > 0 and id <> {NO_ID}").groupBy("id", "t").agg(F.count("*").alias("n"))
    stays = judged.join(leaders, ["id", "t"])
    again = written(stays.where("n > 1").select("id", "t"), "repeated-rows")
    gone = written(judged.join(leaders, ["id", "t"], "left_anti").select("id", "t"), "near-gone")

    def marked(marks: DataFrame) -> DataFrame:
        return marks.select(F.col("id").alias("gone_id"), F.col("t").alias("gone_text"))

    def on(marks: DataFrame):
        return (docs["doc_id"] == marks["gone_id"]) & (F.xxhash64(docs["text"]) == marks["gone_text"])

    gone = marked(gone)
    if again.isEmpty():
        return docs.join(maybe_broadcast(gone), on(gone), "left_anti")
    again = marked(again)
    both = gone.unionByName(again)
    rest = docs.join(maybe_broadcast(both), on(both), "left_anti")
    repeated = docs.join(maybe_broadcast(again), on(again), "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.unionByName(repeated)
