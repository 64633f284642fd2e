"""Ranked lexical search with norm buckets over impact vectors.

A document is a vector of integer impacts over the terms that items use, an
item a vector of integer weights; a score is their product.

1. Items come in blocks of bounded size, one block of any size that a task
   can hold; for each the documents are read once and reduced to the terms of
   the block.  Document, term and word counts are summed over all documents.
2. Impact vectors are written ordered by length within each partition, so that
   consecutive rows are a bucket of similar lengths.  Nothing is shuffled.
3. The longest vectors, a fixed share of all, are searched first; the k-th
   best score of each item among them is a bound that the rest starts with.
4. A bucket is skipped for an item if |item| x its greatest length is below the
   bound (Cauchy-Schwarz).  Inside, the item's heaviest coordinates are summed
   by inverted lists and the rest is bounded by the length that is left; rows
   under the bound go.  What survives is scored exactly, in integers.

Each task keeps its k best rows an item, so k x items rows leave it at most.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, floor, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.llm.common import given_id, null_id, written

#: Bytes that separate terms, [\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]; A-Z become a-z.
SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
BYTES = bytes(0x20 if b in SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
VECTORS = "id long, length double, terms binary, impacts binary"
FOUND = "item int, id long, score long"


@dataclass(frozen=True)
class SearchParams:
    top: int = 50
    #: pairs of item and term in one block of items
    block_pairs: int = 200_000
    #: one in so many documents, the longest vectors, is searched first
    first: int = 32
    #: rows of a bucket
    bucket: int = 4096


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split(b" ") if text else []


def _counted(text: str | None) -> Counter:
    found = Counter(terms_of(text))
    found.pop(b"", None)
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms, once each; rows of one item_id are one item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, t) for i, text in zip(batch["item_id"].tolist(), batch["text"], strict=True) for t in _counted(text)]
            yield pd.DataFrame(rows, columns=["item_id", "term"])

    return items.select(given_id("item_id"), "text").mapInPandas(run, "item_id long, term binary").distinct()


def postings(docs: DataFrame, vocabulary, p: SearchParams) -> DataFrame:
    """id, n (terms with repeats), and the numbers and counts of the terms in the broadcast vocabulary; documents without a term are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = vocabulary.value
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"].tolist(), batch["text"], strict=True):
                if n := sum((counts := _counted(text)).values()):
                    known = [(number[t], c) for t, c in counts.items() if t in number]
                    held = np.array(known, dtype=np.int64).reshape(-1, 2)
                    rows.append((i, n, held[:, 0].astype(np.int32).tobytes(), held[:, 1].tobytes()))
            yield pd.DataFrame(rows, columns=["id", "n", "terms", "counts"])

    return docs.select(given_id("doc_id", "id"), "text").mapInPandas(run, "id long, n long, terms binary, counts binary")


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the vocabulary's terms; tasks add up what they read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["terms"]), dtype=np.int32), minlength=size)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"term": held, "df": total[held]})

    out = np.zeros(size, dtype=np.int64)
    for r in found.select("terms").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def impact_vectors(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Documents that hold a term of the block, as vectors of impacts, longest first in each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, n, terms, counts in zip(batch["id"].tolist(), batch["n"].tolist(), batch["terms"], batch["counts"], strict=True):
                if terms:
                    m = 100 - 50 + (50 * n * n_docs) // n_terms
                    tf = np.frombuffer(counts, dtype=np.int64)
                    impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * m)
                    rows.append((i, float(np.sqrt((impacts.astype(float) ** 2).sum())), terms, impacts.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "length", "terms", "impacts"])

    return found.mapInPandas(run, VECTORS).sortWithinPartitions(F.desc("length"))


@dataclass
class Item:
    """An item's coordinates, heaviest first, and what is left of its length after each."""

    terms: np.ndarray
    weights: np.ndarray

    def __post_init__(self) -> None:
        order = np.lexsort((self.terms, -self.weights))
        self.terms, self.weights = self.terms[order], self.weights[order]
        squares = self.weights.astype(float) ** 2
        self.left = np.sqrt(np.append(np.cumsum(squares[::-1])[::-1], 0.0))


class Bucket:
    """Consecutive vectors, by row and by term."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.lengths = rows["id"].to_numpy(), rows["length"].to_numpy()
        sizes = np.array([len(t) // 4 for t in rows["terms"]])
        self.terms = np.frombuffer(b"".join(rows["terms"]), dtype=np.int32)
        self.impacts = np.frombuffer(b"".join(rows["impacts"]), dtype=np.int64)
        self.starts = np.append(0, np.cumsum(sizes))
        order = np.argsort(self.terms, kind="stable")
        self.by_term, self.held = order, self.terms[order]
        self.row = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.longest = self.lengths.max()

    def survivors(self, item: Item, bound: int) -> np.ndarray:
        """Rows whose score may reach the bound (and is not 0)."""
        if item.left[0] * self.longest * (1 + 1e-9) < bound:
            return np.zeros(0, dtype=np.int64)
        sums, squares = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        lo, hi = np.searchsorted(self.held, item.terms, "left"), np.searchsorted(self.held, item.terms, "right")
        used = len(item.terms)
        for k in range(used):
            if item.left[k] * self.longest * 4 < bound:  # what is left can lift no row by more than a quarter of the bound
                used = k
                break
            at = slice(lo[k], hi[k])
            impacts = self.impacts[self.by_term[at]].astype(float)
            sums[self.row[at]] += item.weights[k] * impacts
            squares[self.row[at]] += impacts**2
        rest = np.sqrt(np.maximum(self.lengths**2 * (1 + 1e-9) - squares, 0)) * item.left[used]
        return np.flatnonzero((sums + rest) * (1 + 1e-9) >= max(bound, 1))

    def scores(self, rows: np.ndarray, item: Item, scratch: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; scratch has a zero for each term."""
        scratch[item.terms] = item.weights
        sizes = self.starts[rows + 1] - self.starts[rows]
        heads = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(self.starts[rows] - heads, sizes)
        out = np.add.reduceat(scratch[self.terms[at]] * self.impacts[at], heads)
        scratch[item.terms] = 0
        return out


def best_rows(vectors: DataFrame, items, bounds, size: int, p: SearchParams) -> DataFrame:
    """Each task's best rows for each item that reach its bound: (item, id, score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, floors, scratch = {}, bounds.value.copy(), np.zeros(size, dtype=np.int64)
        for batch in batches:
            for k in range(0, len(batch), p.bucket):
                bucket = Bucket(batch.iloc[k : k + p.bucket])
                for q, item in enumerate(items.value):
                    rows = bucket.survivors(item, floors[q])
                    if not len(rows):
                        continue
                    scores, ids = bucket.scores(rows, item, scratch), bucket.ids[rows]
                    if q in held:
                        scores, ids = np.append(held[q][0], scores), np.append(held[q][1], ids)
                    keep = np.flatnonzero(scores >= max(floors[q], 1))
                    keep = keep[np.lexsort((ids[keep], -scores[keep]))[: p.top]]
                    held[q] = scores[keep], ids[keep]
                    if len(keep) == p.top:
                        floors[q] = held[q][0][-1]
        for q, (scores, ids) in held.items():
            yield pd.DataFrame({"item": q, "id": ids, "score": scores})

    return vectors.mapInPandas(run, FOUND)


def ranked(found: DataFrame, p: SearchParams) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.top)


def _search_block(docs: DataFrame, pairs: DataFrame, p: SearchParams) -> DataFrame:
    spark = docs.sparkSession
    held: dict[int, list[bytes]] = {}
    for r in pairs.collect():  # one block of items: bounded by block_pairs
        held.setdefault(r.item_id, []).append(bytes(r.term))
    names = sorted(held)
    number = {t: k for k, t in enumerate(sorted({t for ts in held.values() for t in ts}))}
    found = written(postings(docs, spark.sparkContext.broadcast(number), p), "postings")
    n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
    df = document_frequencies(found, len(number))
    weights = np.array([weight(n_docs, int(x)) for x in df], dtype=np.int64)
    items = [Item(at := np.array([number[t] for t in held[i]], dtype=np.int64), weights[at]) for i in names]
    items = spark.sparkContext.broadcast(items)
    vectors = written(impact_vectors(found, n_docs, n_terms), "vectors")

    shortest = vectors.agg(F.percentile_approx("length", 1 - 1 / p.first, 1000)).first()[0] or 0.0
    none = spark.sparkContext.broadcast(np.zeros(len(names), dtype=np.int64))
    first = written(ranked(best_rows(vectors.where(F.col("length") >= shortest), items, none, len(number), p), p), "first-ranks")
    bounds = np.zeros(len(names), dtype=np.int64)
    for r in first.where(F.col("rank") == p.top).select("item", "score").collect():  # one row an item of the block
        bounds[r["item"]] = r["score"]
    rest = best_rows(vectors.where(F.col("length") < shortest), items, spark.sparkContext.broadcast(bounds), len(number), p)
    best = ranked(first.drop("rank").unionByName(rest), p)
    known = spark.createDataFrame([*enumerate(names)], "item int, item_id long")
    return best.join(F.broadcast(known), "item").select(null_id("item_id"), "rank", null_id("id", "doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents (doc_id, text) for each item (item_id, text).

    Null and empty texts and texts without terms are no documents: they count
    nowhere and are found by nothing; items without terms find nothing.  Every
    row of docs is a document of its own, so equal rows take ranks of their
    own; null ids come first among equal scores.  Rows of items with one
    item_id are one item that has the terms of all.  Extra columns are ignored.
    """
    pairs = written(item_terms(items), "item-terms")
    blocks = ceil(pairs.count() / p.block_pairs)
    out = None
    for k in range(blocks):
        block = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        found = written(_search_block(docs, block, p), "search-block")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents WHERE text IS NOT NULL),
sized AS (SELECT r, doc_id, len(ts)::BIGINT AS n FROM docs WHERE len(ts) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
tfs AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM docs) GROUP BY r, t),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark WHERE text IS NOT NULL),
weights AS (
    SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM tfs, totals WHERE t IN (SELECT t FROM wanted) GROUP BY t, n_docs),
lengths AS (SELECT r, doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) AS m FROM sized, totals),
scored AS (
    SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM wanted JOIN weights USING (t) JOIN tfs USING (t) JOIN lengths USING (r) GROUP BY item_id, doc_id, r)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
    FROM scored WHERE score > 0)
WHERE rank <= 50
"""
