"""Merkle manifest of a dataset by cogrouped subtree exchange.

1. Every row becomes a leaf by Spark's own functions.  Leaves are dealt by
   range of (lang, doc_id), and a leaf's place in its language is its place in
   its partition plus the counts of the partitions before: no window holds a
   language.
2. 2**height consecutive nodes of a tree make a superblock, which is one group
   of bounded size.  A pass reduces every superblock to one node; the nodes of
   a pass are the leaves of the next, until each tree has one.  The subroots
   are the leaves of one more tree, of the same form.
3. On the way down every superblock is cogrouped with the outer nodes that its
   proofs need, one row: the siblings from its own node up to the root.  The
   group reduces its nodes once more, and siblings inside followed by the outer
   ones are the path of each node: the outer nodes of the pass below or, for
   leaves, the proof, which is folded in the same group.

A path is an array of steps: side ("L" or "R") and digest of the sibling, or
empty where a node stands alone in its run.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.llm.common import given_id, maybe_broadcast, null_id, written

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODES = "tree long, depth int, pos long, digest binary"
OUTER = "tree long, block long, subroot binary, path array<binary>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


@dataclass(frozen=True)
class ManifestParams:
    #: levels of a superblock: a group holds 2**height nodes at most
    height: int = 10
    #: rows whose crc32 of the id this divides are tampered with
    tamper: int = 7


def _field(value: Column) -> Column:
    shown = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown))


def leaf_digest(n_chars: Column | None = None) -> Column:
    """Hex sha256 of a row of documents, with another n_chars if given."""
    values = [F.col(c) if c != "n_chars" or n_chars is None else n_chars for c in FIELDS]
    return F.sha2(F.concat(*(_field(v) for v in values)), 256)


def leaves(docs: DataFrame, p: ManifestParams) -> DataFrame:
    """id, lang, digest and changed (the tampered leaf, null where nothing changes) of each row."""
    raised = F.col("n_chars").cast("decimal(20,0)") + 1
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % p.tamper == 0) & F.col("n_chars").isNotNull()
    return docs.select(*FIELDS).select(
        given_id("doc_id", "id"), "lang", F.unhex(leaf_digest()).alias("digest"), F.when(hit, F.unhex(leaf_digest(raised))).alias("changed")
    )


def depth_of(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1))).cast("int")


def placed(df: DataFrame, tree: list[str], order: list[str], name: str) -> DataFrame:
    """df with pos, the place of a row among those of its tree by `order`, and the tree's n.

    Nulls come first.  Rows are dealt by range; equal ones are told apart by a
    running number, so that a range is never one key.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*tree, *order, "row_"]]
    dealt = df.withColumn("row_", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = written(dealt.drop("row_").withColumn("at", F.monotonically_increasing_id()), f"{name}-dealt")
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    counts = dealt.groupBy(*tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("n_part"))
    of = Window.partitionBy(*tree)
    starts = counts.withColumn("n", F.sum("n_part").over(of))
    starts = starts.withColumn("shift", F.sum("n_part").over(of.orderBy("part")) - F.col("n_part") - F.col("first"))
    starts = written(starts.select(*(F.col(c).alias(f"{c}_") for c in tree), F.col("part").alias("part_"), "n", "shift"), f"{name}-starts")
    same = F.col("part") == F.col("part_")
    for c in tree:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_"))
    found = dealt.join(maybe_broadcast(starts), same)
    return found.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "part_", "shift", *(f"{c}_" for c in tree))


def _levels(digests: list[str], depth: int, height: int) -> list[list[str]]:
    """A superblock's nodes by level, its own nodes first; a node alone in its run is hashed alone."""
    out = [digests]
    for _ in range(min(height, depth)):
        row = out[-1]
        out.append([sha256("".join(row[k : k + 2]).encode()).hexdigest() for k in range(0, len(row), 2)])
    return out


def _siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """(side, digest) of node i's sibling at each level below the superblock's top."""
    out = []
    for row in levels[:-1]:
        k = i ^ 1
        out.append(("", "") if k >= len(row) else ("L" if k < i else "R", row[k]))
        i >>= 1
    return out


def _packed(step: tuple[str, str]) -> bytes:
    return step[0].encode() + bytes.fromhex(step[1])


def _unpacked(step: bytes) -> tuple[str, str]:
    return step[:1].decode(), step[1:].hex()


def passes(nodes: DataFrame, p: ManifestParams, name: str) -> list[DataFrame]:
    """Nodes of every pass upwards, the given ones first; the last has one node a tree."""

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        depth = int(group["depth"].iloc[0])
        top = _levels([d.hex() for d in group["digest"]], depth, p.height)[-1]
        return pd.DataFrame(
            {"tree": group["tree"].iloc[:1], "depth": max(0, depth - p.height), "pos": int(group["pos"].iloc[0]) >> p.height, "digest": [bytes.fromhex(top[0])]}
        )

    out, left = [nodes], nodes.agg(F.max("depth")).first()[0]
    while left is not None and (left > 0 or len(out) == 1):
        blocks = out[-1].select("tree", "depth", "pos", "digest").groupBy("tree", F.shiftright("pos", p.height).alias("block"))
        out.append(written(blocks.applyInPandas(reduce, NODES), f"{name}-nodes"))
        left = max(0, left - p.height)
    return out


def _grouped(nodes: DataFrame, outer: DataFrame, p: ManifestParams):
    return nodes.withColumn("block", F.shiftright("pos", p.height)).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))


def outer_nodes(levels: list[DataFrame], top: DataFrame, p: ManifestParams, name: str) -> DataFrame:
    """The outer nodes of every superblock of the lowest pass.

    top: tree, block 0, subroot and the path from the tree's root upwards.
    """

    def extend(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        local = _levels([d.hex() for d in nodes["digest"]], int(nodes["depth"].iloc[0]), p.height)
        above = list(outer["path"].iloc[0])
        paths = [[*map(_packed, _siblings(local, i)), *above] for i in range(len(nodes))]
        return pd.DataFrame({"tree": nodes["tree"], "block": nodes["pos"], "subroot": outer["subroot"].iloc[0], "path": paths})

    outer = top
    for nodes in reversed(levels[1:-1]):
        outer = written(_grouped(nodes, outer, p).applyInPandas(extend, OUTER), f"{name}-outer")
    return outer


def manifest(docs: DataFrame, p: ManifestParams = ManifestParams()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of docs.

    Null fields count as `-` in the leaf; null languages are a tree of their
    own, which comes first, and so do null ids in theirs.  Rows with equal ids
    are ordered by their leaves; equal rows are leaves of their own.  An empty
    text has the length 0.  Without rows there is no result.  Extra columns of
    docs are ignored, whatever their names.
    """
    found = written(leaves(docs, p), "leaves")
    found = placed(found, ["lang"], ["id", "digest"], "leaves")
    langs = placed(found.select("lang").distinct(), [], ["lang"], "langs").select(F.col("lang").alias("of"), F.col("pos").alias("tree"), F.col("n").alias("trees"))
    langs = written(langs, "langs")
    nodes = found.join(maybe_broadcast(langs), F.col("lang").eqNullSafe(F.col("of")))
    nodes = written(nodes.select("id", "tree", depth_of(F.col("n")).alias("depth"), "pos", "digest", "changed"), "placed-leaves")
    inner = passes(nodes, p, "inner")
    subroots = inner[-1].select("tree", F.col("digest").alias("subroot"))

    upper = passes(langs.join(subroots, "tree").select(F.lit(0).cast("long").alias("tree"), depth_of(F.col("trees")).alias("depth"), F.col("tree").alias("pos"), F.col("subroot").alias("digest")), p, "upper")
    root = upper[-1].first()
    root = root["digest"].hex() if root else ""
    start = docs.sparkSession.createDataFrame([(0, 0, None, [])], OUTER)
    above = outer_nodes([upper[0], *upper], start, p, "upper")  # the subroots' own paths are wanted, one pass below superblocks
    top = above.join(subroots.withColumnRenamed("tree", "block").withColumnRenamed("subroot", "own"), "block")
    top = written(top.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("own").alias("subroot"), "path"), "top")
    outer = outer_nodes(inner, top, p, "inner")

    def finish(group: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        local = _levels([d.hex() for d in group["digest"]], int(group["depth"].iloc[0]), p.height)
        above = [*map(_unpacked, around["path"].iloc[0])]
        rest, rows = "".join(d for _, d in above), []
        for i, (doc_id, changed) in enumerate(zip(group["id"].tolist(), group["changed"], strict=True)):
            inside = _siblings(local, i)
            now = changed.hex() if changed is not None else local[0][i]
            for side, sibling in (*inside, *above):
                now = sha256((sibling + now if side == "L" else now + sibling).encode()).hexdigest()
            proof = sha256(("".join(d for _, d in inside) + rest).encode()).hexdigest()
            rows.append((doc_id, local[0][i], around["subroot"].iloc[0].hex(), root, proof, now, now == root))
        return pd.DataFrame(rows, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    out = _grouped(nodes, outer, p).applyInPandas(finish, RESULT)
    return out.withColumn("doc_id", null_id("doc_id"))


#: The same tree level by level in SQL; crc32 is folded bit by bit over the digits.
ORACLE_SQL = """
WITH RECURSIVE fields AS (
    SELECT doc_id, lang, n_chars,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           coalesce(strlen(text) || ':' || text, '-') AS tail,
           xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)))) AS crc
    FROM documents),
leaf AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
           CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL
                THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS changed
    FROM fields),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
up AS (
    SELECT 0 AS lvl, lang, pos, n, leaf AS d FROM ranked
    UNION ALL
    SELECT lvl + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lvl, lang, pos // 2, n),
subroots AS (
    SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
    SELECT 0 AS lvl, pos, n, subroot AS d FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
walk AS (
    SELECT doc_id, lang, leaf, 0 AS lvl, pos, n, coalesce(changed, leaf) AS cur, '' AS proof FROM ranked
    UNION ALL
    SELECT w.doc_id, w.lang, w.leaf, w.lvl + 1, w.pos // 2, (w.n + 1) // 2,
           sha256(CASE WHEN w.pos % 2 = 1 THEN u.d || w.cur ELSE w.cur || coalesce(u.d, '') END), w.proof || coalesce(u.d, '')
    FROM walk w LEFT JOIN up u ON u.lvl = w.lvl AND u.lang IS NOT DISTINCT FROM w.lang AND u.pos = xor(w.pos, 1)
    WHERE w.n > 1),
climb AS (
    SELECT w.doc_id, w.leaf, s.subroot, 0 AS lvl, s.pos, s.n, w.cur, w.proof
    FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
    UNION ALL
    SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.pos // 2, (c.n + 1) // 2,
           sha256(CASE WHEN c.pos % 2 = 1 THEN t.d || c.cur ELSE c.cur || coalesce(t.d, '') END), c.proof || coalesce(t.d, '')
    FROM climb c LEFT JOIN top t ON t.lvl = c.lvl AND t.pos = xor(c.pos, 1)
    WHERE c.n > 1)
SELECT doc_id, leaf, subroot, root.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root.d AS verified
FROM climb, (SELECT d FROM top WHERE n = 1) root WHERE climb.n = 1
"""
