"""Near-duplicate embeddings by product quantisation.

1. Equal vectors of one label are one class with a weight.
2. An index is fitted on a bounded sample: two levels of coarse words (a list
   is a word of the first and one of the second, so that the lists can follow
   the rows) and, on the residuals, a small codebook for each subspace.  Every
   class is indexed: its list, its code and the error of its code.
3. A class visits its own list and every list that is farther than the nearest
   by a margin at most, level by level.  The margin is measured, not guessed:
   sample vectors get neighbours at exactly the threshold in random directions,
   and the margin is the least that reaches `recall` of these, the hardest ones.
4. Visitors and members of a list meet in groups of bounded size; large lists
   are dealt into blocks.  Asymmetric distances (a look-up table a subspace)
   less the error of the code are lower bounds of true distances, so what they
   prune is certain; survivors are decided by their cosine in double precision.
5. A group returns sums and a spanning forest of its links, one row for each
   class that has one, never pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderwork.llm.common import components, given_id, maybe_broadcast, null_id, written


@dataclass(frozen=True)
class EmbeddingParams:
    cosine: float = 0.93
    #: rows of one label that a list has on average
    list_rows: int = 128
    #: words of a coarse level at most; words**2 lists
    words: int = 2048
    #: numbers in the sample that the index is fitted on (at 64 dimensions 32,768 vectors)
    sample_values: int = 1 << 21
    subspaces: int = 8
    #: share of the neighbours at the threshold itself that the margin reaches on the sample
    recall: float = 0.99
    #: members and visitors in one group
    members: int = 1024
    visitors: int = 4096
    seed: int = 5

    @property
    def chord(self) -> float:
        return float(np.sqrt(2 - 2 * self.cosine))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length 1; scaled first, so that no square overflows."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def stacked(values, dim: int, width: int) -> np.ndarray:
    """Vectors of dim numbers of width bytes each, from their bytes."""
    return np.frombuffer(b"".join(values), dtype=np.float32 if width == 4 else np.float64).reshape(-1, dim)


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] - 2 * (x @ words.T) + (words * words).sum(axis=1)[None]
    return np.sqrt(np.maximum(square, 0))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        sums, sizes = np.zeros_like(words), np.zeros(len(words))
        for i in range(0, len(x), 4096):
            part = x[i : i + 4096]
            near = distances(part, words).argmin(axis=1)
            np.add.at(sums, near, part)
            sizes += np.bincount(near, minlength=len(words))
        words = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], words)
    return words


class Index:
    """Coarse words of two levels, codebooks of the residuals and the margin of the probes."""

    def __init__(self, sample: np.ndarray, lists: int, p: EmbeddingParams):
        rng, k = np.random.default_rng(p.seed), min(p.words, int(np.ceil(np.sqrt(lists))))
        self.dim = sample.shape[1]
        self.first = k_means(sample, k, rng)
        rest = sample - self.first[distances(sample, self.first).argmin(axis=1)]
        self.second = k_means(rest, k, rng)
        rest -= self.second[distances(rest, self.second).argmin(axis=1)]
        cuts = np.linspace(0, self.dim, min(p.subspaces, self.dim) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        self.books = [k_means(rest[:, s], 256, rng) for s in self.parts]
        self.margin = self._margin(sample[:: max(1, len(sample) // 2048)], rng, p)

    def centre(self, number: int) -> np.ndarray:
        return self.first[number // len(self.second)] + self.second[number % len(self.second)]

    def _excess(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """By how much y's words are farther from x than the nearest, at the worse level."""
        a = distances(y, self.first).argmin(axis=1)
        b = distances(y - self.first[a], self.second).argmin(axis=1)
        to_first, to_second, rows = distances(x, self.first), distances(x - self.first[a], self.second), np.arange(len(x))
        return np.maximum(to_first[rows, a] - to_first.min(axis=1), to_second[rows, b] - to_second.min(axis=1))

    def _margin(self, x: np.ndarray, rng: np.random.Generator, p: EmbeddingParams) -> float:
        if len(self.first) * len(self.second) == 1:
            return 0.0
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        away /= np.maximum(np.sqrt((away * away).sum(axis=1, keepdims=True)), 1e-12)
        y = p.cosine * x + np.sqrt(1 - p.cosine**2) * away
        return float(np.quantile(np.minimum(self._excess(x, y), self._excess(y, x)), p.recall)) + 1e-9

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of each vector and the sorted lists that it visits, its own among them."""
        to_first, k = distances(x, self.first), len(self.second)
        near = to_first <= to_first.min(axis=1, keepdims=True) + self.margin
        own_first, own, seen, at = to_first.argmin(axis=1), np.zeros(len(x), dtype=np.int64), [], []
        for a in np.flatnonzero(near.any(axis=0)):
            rows = np.flatnonzero(near[:, a])
            to_second = distances(x[rows] - self.first[a], self.second)
            i, b = np.nonzero(to_second <= to_second.min(axis=1, keepdims=True) + self.margin)
            at.append(rows[i])
            seen.append(a * k + b)
            mine = own_first[rows] == a
            own[rows[mine]] = a * k + to_second[mine].argmin(axis=1)
        at, seen = np.concatenate(at), np.concatenate(seen)
        order = np.lexsort((seen, at))
        return own, np.split(seen[order].astype(np.int32), np.cumsum(np.bincount(at, minlength=len(x)))[:-1])

    def codes(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The residual code of each vector and the length that it misses."""
        rest = x - self.first[own // len(self.second)] - self.second[own % len(self.second)]
        codes, missed = np.zeros((len(x), len(self.parts)), dtype=np.uint8), np.zeros(len(x))
        for k, (s, book) in enumerate(zip(self.parts, self.books, strict=True)):
            codes[:, k] = distances(rest[:, s], book).argmin(axis=1)
            missed += ((rest[:, s] - book[codes[:, k]]) ** 2).sum(axis=1)
        return codes, np.sqrt(missed)

    def asymmetric(self, x: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Distances of x to the coded members of a list, by one look-up table a subspace."""
        rest, out = x - self.centre(number), np.zeros((len(x), len(codes)), dtype=np.float32)
        for k, (s, book) in enumerate(zip(self.parts, self.books, strict=True)):
            out += (distances(rest[:, s], book) ** 2).astype(np.float32)[:, codes[:, k]]
        return np.sqrt(out)


def read_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, width, vector (bytes; null if unusable) and a 128-bit key of the class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for label, v in zip(batch["label"], batch["embedding"], strict=True):
                v = None if v is None or label is None else np.asarray(v, dtype=np.float64 if v.dtype == object else None)
                if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    rows.append((None, None, None, None))
                    continue
                v = v + v.dtype.type(0) if v.dtype == np.float32 else v.astype(np.float64) + 0.0  # -0 becomes 0
                data = v.tobytes()
                rows.append((len(v), v.dtype.itemsize, data, hashlib.blake2b(data, digest_size=16).digest()))
            out = pd.DataFrame(rows, columns=["dim", "width", "vector", "key"], dtype=object)
            yield pd.concat([batch[["vec_id", "label"]].reset_index(drop=True), out], axis=1)

    given = vectors.select(given_id("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    out = given.mapInPandas(run, "vec_id long, label string, dim int, width int, vector binary, key binary")
    return out.withColumn("vec_id", null_id("vec_id"))


def fitted(classes: DataFrame, p: EmbeddingParams) -> Index | None:
    """An index for the most common dimension, from a sample by hash."""
    sizes = classes.groupBy("dim", "width", "label").agg(F.count("*").cast("double").alias("n"))
    sizes = sizes.groupBy("dim", "width").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    top = sizes.orderBy(F.desc("n"), F.desc("dim"), F.desc("width")).first()
    if top is None:
        return None
    share = min(1.0, max(256, p.sample_values // top.dim) / top.n)
    mine = classes.where((F.col("dim") == top.dim) & (F.col("width") == top.width))
    # xxhash64 of the vector's bytes: the same rows whichever way the table is dealt
    sample = mine.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < int(share * (1 << 30))).select("vector").collect()
    sample = sample or mine.select("vector").limit(1).collect()
    rows = units(stacked(sorted(bytes(r.vector) for r in sample), top.dim, top.width))
    return Index(rows, max(1, round(top.squares / top.n / p.list_rows)), p)


def indexed(classes: DataFrame, index, p: EmbeddingParams) -> DataFrame:
    """Each class with its list, the lists that it visits, its code and the error of it.

    Classes of another dimension than the index's share the list 0 of theirs, uncoded.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = index.value
        for batch in batches:
            batch = batch.reset_index(drop=True)
            for (dim, width), part in batch.groupby(["dim", "width"]):
                for k in range(0, len(part), 2048):
                    rows = part.iloc[k : k + 2048].copy()
                    rows["list"], rows["code"], rows["missed"] = 0, b"", 2.0
                    rows["visits"] = [np.zeros(1, dtype=np.int32)] * len(rows)
                    if dim == found.dim:
                        x = units(stacked(rows["vector"], dim, width))
                        own, visits = found.lists(x)
                        codes, missed = found.codes(x, own)
                        rows["list"], rows["visits"], rows["code"], rows["missed"] = own, visits, [c.tobytes() for c in codes], missed
                    yield rows

    return classes.mapInPandas(run, "class long, label string, dim int, width int, n long, vector binary, list long, code binary, missed double, visits array<int>")


def forest(hits: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id of the component of each row and column of a matrix of links, all of which have one."""
    most = np.iinfo(np.int64).max
    while True:
        new_rows = np.minimum(rows, np.where(hits, columns[None], most).min(axis=1))
        new_columns = np.minimum(columns, np.where(hits, new_rows[:, None], most).min(axis=0))
        if (new_rows == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new_rows, new_columns


def met(members: pd.DataFrame, visitors: pd.DataFrame, index: Index, p: EmbeddingParams) -> pd.DataFrame:
    """class, n (weight of the classes linked with it) and to (a class of its component) for a group.

    A link counts for the visitor, and for the member only if the member does
    not visit the visitor's list: then the other group does not see it.
    """
    dim, width, number = (int(members[c].iloc[0]) for c in ("dim", "width", "list"))
    x, y = units(stacked(visitors["vector"], dim, width)), units(stacked(members["vector"], dim, width))
    ids_x, ids_y = visitors["class"].to_numpy(), members["class"].to_numpy()
    w_x, w_y = visitors["n"].to_numpy(), members["n"].to_numpy()
    known, own = np.unique(visitors["own"].to_numpy(), return_inverse=True)
    visits = np.concatenate(members["visits"].to_list())
    rows = np.repeat(np.arange(len(y)), [len(v) for v in members["visits"]])
    at = np.minimum(np.searchsorted(known, visits), len(known) - 1)
    back = np.zeros((len(y), len(known)), dtype=bool)
    back[rows[known[at] == visits], at[known[at] == visits]] = True
    codes = np.frombuffer(b"".join(members["code"]), dtype=np.uint8).reshape(len(y), -1)
    missed = members["missed"].to_numpy()

    hits, n_x, n_y = np.zeros((len(x), len(y)), dtype=bool), np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    for k in range(0, len(x), 512):
        part = slice(k, k + 512)
        near = np.ones((len(x[part]), len(y)), dtype=bool)
        if codes.shape[1]:
            near = index.asymmetric(x[part], number, codes) - missed[None] <= p.chord + 1e-4
        i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(i):
            continue
        hit = (x[part][i] @ y[j].T >= p.cosine) & (ids_x[part][i][:, None] != ids_y[j][None])
        hits[np.ix_(i + k, j)] = hit
        n_x[i + k] += hit @ w_y[j]
        n_y[j] += w_x[part][i] @ (hit & ~back[np.ix_(j, own[part][i])].T)
    i, j = np.flatnonzero(hits.any(axis=1)), np.flatnonzero(hits.any(axis=0))
    to_x, to_y = forest(hits[np.ix_(i, j)], ids_x[i], ids_y[j]) if len(i) else (ids_x[i], ids_y[j])
    return pd.DataFrame({"class": np.append(ids_x[i], ids_y[j]), "n": np.append(n_x[i], n_y[j]), "to": np.append(to_x, to_y)})


def class_links(placed: DataFrame, index, p: EmbeddingParams) -> DataFrame:
    """(class, n, to) of all groups of members and visitors; hot lists are dealt into blocks."""
    key = ["label", "dim", "width", "list"]
    visits = placed.select("class", "label", "dim", "width", "n", "vector", F.col("list").alias("own"), F.explode(F.col("visits").cast("array<long>")).alias("list"))
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n_members"))
    guests = visits.groupBy(*key).agg(F.count("*").alias("n_visitors"))
    blocks = sizes.join(guests, key).select(
        *key, F.ceil(F.col("n_members") / p.members).cast("int").alias("of_m"), F.ceil(F.col("n_visitors") / p.visitors).cast("int").alias("of_v")
    )
    large = maybe_broadcast(written(blocks.where("of_m > 1 or of_v > 1"), "large-lists"))

    def dealt(df: DataFrame, mine: str, other: str) -> DataFrame:
        df = df.join(large, key, "left").withColumn(mine, F.coalesce(f"of_{mine}", F.lit(1))).withColumn(other, F.coalesce(f"of_{other}", F.lit(1)))
        df = df.withColumn(mine, F.pmod(F.xxhash64("class"), F.col(mine)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("of_m", "of_v")

    def compare(members: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        if members.empty or visitors.empty:
            return pd.DataFrame({"class": [], "n": [], "to": []}).astype("int64")
        return met(members, visitors, index.value, p)

    by = [*key, "m", "v"]
    left = dealt(placed.select("class", *key, "n", "vector", "code", "missed", "visits"), "m", "v")
    right = dealt(visits, "v", "m").select("class", *by, "n", "vector", "own")
    right = right.toDF(*right.columns)  # both sides come from one table
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, "class long, n long, to long")


def near_duplicates(vectors: DataFrame, p: EmbeddingParams = EmbeddingParams()) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors (vec_id, embedding, label).

    Rows are linked by the cosine of their vectors, labels being equal and not
    null.  Null, empty and zero vectors and those with null or non-finite
    components are linked with nothing; vectors of different lengths or number
    types are not compared.  Every row is a vector of its own, so equal rows
    are linked with each other.  A null vec_id takes part but names no
    component: where all of a component are null its name is null and they are
    kept.  Extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = written(read_vectors(vectors), "vectors")
    usable = rows.where(F.col("key").isNotNull())
    classes = usable.groupBy("label", "dim", "width", "key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.max("vector").alias("vector"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    index = fitted(classes, p)
    if index is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    shared = spark.sparkContext.broadcast(index)
    placed = written(indexed(classes.select("class", "label", "dim", "width", "n", "vector"), shared, p), "indexed")
    found = written(class_links(placed, shared, p), "class-links")
    counts = found.groupBy("class").agg(F.sum("n").alias("linked"))
    joined = components(found.select(F.col("class").alias("a"), F.col("to").alias("b")), "vector-components").withColumnRenamed("id", "class")
    named = classes.select("class", "label", "dim", "width", "key", "n", "least").join(counts, "class", "left").join(joined, "class", "left")
    named = written(named.withColumn("component", F.coalesce("component", "class")), "named-classes")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("label", "dim", "width", "key", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = usable.join(named, ["label", "dim", "width", "key"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("key").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: All pairs of a label by cosine in double precision; equal to the result where the probes reach every link.
ORACLE_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS l FROM v WHERE len(e) > 0 AND list_inner_product(e, e) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_inner_product(a.e, b.e) / (a.l * b.l) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept
FROM named LEFT JOIN counted USING (vec_id)
"""
