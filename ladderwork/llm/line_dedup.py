"""Fuzzy line deduplication by MinHash, in DataFrame operations.

Lines of all texts are trimmed and lower-cased; equal lines make one class.
A class has the set of all strings of `width` characters at every position of
its line, white space included, as 64-bit hashes; a shorter line is one such
string.  The signature is a one-permutation MinHash: the ring of hashes is cut
into `bins` arcs, and a bin's value is the first hash at or after its start, so
an empty bin takes the next one's.  A band is `rows` bins that lie far apart.
Lines of under `short` strings fill few bins; they get the bands of a second,
independent order as well.

Classes that agree on a band are candidates: in each bucket the class with
most bucket mates meets the others.  A sketch of four bits of every bin drops
pairs that are far from the threshold; the others are verified by exact Jaccard
similarity of their sets, and links are joined by distributed union-find.
Buckets that still hold several components are finished: their classes are
dealt into blocks of bounded size, and each pair of blocks is compared inside
one row by array functions, first by sketches, then, for those that are near
to another component, by their sets.  Only pairs of components come out.

Each component keeps one line, the first by (doc_id, place); the others go.

Defined results: blank lines always stay; null texts stay null; rows with
equal doc_id and text are one document and get equal results; a null doc_id
comes first in order.  Extra columns are kept as they are; a column of docs
that is named n_lines or n_removed gives way to the one that is added.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderwork.llm.common import components, shared_dir, written


@dataclass(frozen=True)
class LineDedupParams:
    width: int = 5
    bins: int = 64
    bands: int = 12
    rows: int = 5
    at_least: tuple[int, int] = (4, 5)
    #: strings under which a line gets the second order's bands
    short: int = 100
    #: bins of 64 that two long lines' sketches must share; a pair at exactly 0.8 shares fewer with a probability of about 1e-5
    shared_bins: int = 38
    #: bins of 64 whose single bit may differ, a cheaper look that comes first; exceeded with a probability of 2.4e-8
    differ: int = 22
    #: classes in a block, about, when a bucket's rest is compared
    block: int = 1024

    @property
    def starts(self) -> list[int]:
        """Where the bins begin on the ring of signed 64-bit numbers."""
        return [-(2**63) + k * 2**64 // self.bins for k in range(self.bins)]


def normal(line: Column) -> Column:
    return F.lower(F.trim(line, F.lit(" \t\r\f\v")))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, place and class of every line that is not blank."""
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    return split.withColumn("norm", normal(F.col("raw"))).where("norm <> ''").withColumn("line", F.xxhash64("norm"))


def _place() -> Column:
    return F.struct("doc_id", "text_hash", "pos")


def _hashes(norm: str, p: LineDedupParams) -> str:
    """SQL of the hashes of all strings of `width` characters, one for each position.

    Four bytes a character make a place a matter of counting; the bytes are a
    lambda's argument, so that they are not copied for every string.
    """
    at = f"sequence(0, greatest(shiftright(octet_length(b), 2) - {p.width}, 0))"
    each = f"transform({at}, i -> xxhash64(substring(b, i * 4 + 1, {4 * p.width})))"
    return f"get(transform(array(encode({norm}, 'UTF-32')), b -> {each}), 0)"


def _set(norm: str, p: LineDedupParams) -> str:
    return f"array_distinct({_hashes(norm, p)})"


def _classes(docs: DataFrame) -> DataFrame:
    """One row per distinct line, bucketed by the class: later joins need no exchange.

    The files lie in the shared folder; the catalog's entry, which only serves
    to make them, goes at once.
    """
    spark = docs.sparkSession
    rows = occurrences(docs).groupBy("line").agg(
        F.first("norm").alias("norm"), F.min(_place()).alias("first"), F.count("*").alias("n")
    )
    name = f"line_classes_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    rows.write.bucketBy(parts, "line").option("compression", "zstd").option("path", path).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def _values(hashes: str, merged: str, p: LineDedupParams) -> Column:
    """The bins' values: the first of the sorted hashes at or after each start, around the ring.

    merged holds the hashes and the starts in order, so a start's place there
    tells how many hashes lie before it.
    """
    first = F.get(hashes, F.lit(0))
    return F.array(
        *[F.coalesce(F.get(hashes, (F.array_position(merged, F.lit(m)) - 1 - k).cast("int")), first) for k, m in enumerate(p.starts)]
    )


def _band_keys(values: str, order: int, p: LineDedupParams) -> Column:
    bands = [[F.get(values, F.lit(b + p.bands * r)) for r in range(p.rows)] for b in range(p.bands)]
    return F.array(*[F.xxhash64(F.lit(order * p.bands + b), *row) for b, row in enumerate(bands)])


def signed(classes: DataFrame, p: LineDedupParams) -> DataFrame:
    """(line, buckets, sketch) of every class; sketch is one bit and four bits of every bin, and a mark for short lines.

    Each select builds on arrays that the one before has made.  The second
    order is computed beside the first one's values because a lambda in the
    same step keeps their many expressions out of one huge generated method.
    """
    shift = 64 - (p.bins - 1).bit_length()
    starts = F.array(*[F.lit(m).cast("long") for m in p.starts])
    ring = classes.selectExpr("line", f"sort_array({_hashes('norm', p)}) AS r")
    least = ring.selectExpr(
        "line", f"size(r) < {p.short} AS short", f"CASE WHEN size(r) < {p.short} THEN r END AS few",
        f"filter(r, (x, i) -> i = 0 OR shiftright(x, {shift}) <> shiftright(get(r, i - 1), {shift})) AS m",
    )
    merged = least.select("line", "short", "few", "m", F.sort_array(F.concat("m", starts)).alias("m_starts"))
    first = merged.select("line", "short", _values("m", "m_starts", p).alias("v"), F.expr("sort_array(transform(few, x -> xxhash64(x)))").alias("few"))
    both = first.select("line", "short", "v", "few", F.sort_array(F.concat("few", starts)).alias("few_starts"))
    nibbles = "aggregate(slice(v, {}, 16), 0L, (a, x) -> shiftleft(a, 4) | (x & 15))"
    bits = F.expr("aggregate(v, 0L, (a, x) -> shiftleft(a, 1) | (shiftright(x, 4) & 1))")
    sketch = F.struct(bits.alias("bits"), *[F.expr(nibbles.format(16 * k + 1)).alias(f"s{k}") for k in range(4)], F.col("short"))
    told = both.select("line", sketch.alias("sketch"), _band_keys("v", 0, p).alias("keys"), F.when(F.col("short"), _values("few", "few_starts", p)).alias("v2"))
    buckets = F.concat("keys", F.when(F.col("v2").isNull(), F.array().cast("array<long>")).otherwise(_band_keys("v2", 1, p)))
    return told.select("line", "sketch", buckets.alias("buckets"))


def _near(x: str, y: str, p: LineDedupParams) -> str:
    """SQL: whether two sketches may belong to a linked pair."""
    unlike = []
    for k in range(4):  # a nibble with any bit set shows in its lowest bit
        d = f"({x}.s{k} ^ {y}.s{k})"
        unlike.append(f"bit_count(({d} | shiftright({d}, 1) | shiftright({d}, 2) | shiftright({d}, 3)) & {0x1111111111111111}L)")
    far = f"bit_count({x}.bits ^ {y}.bits) > {p.differ}"
    return f"({x}.short OR {y}.short OR (NOT {far} AND {' + '.join(unlike)} <= {p.bins - p.shared_bins}))"


def _alike(x: str, y: str, p: LineDedupParams) -> str:
    """SQL: whether two sets reach the threshold; the intersection is taken once."""
    less, of = p.at_least
    fits = f"{of} * least(size({x}), size({y})) >= {less} * greatest(size({x}), size({y}))"
    return f"CASE WHEN {fits} THEN {of + less} * size(array_intersect({x}, {y})) >= {less} * (size({x}) + size({y})) ELSE false END"


def _verified(pairs: DataFrame, classes: DataFrame, p: LineDedupParams) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold; a repeats, so its set is made once."""
    lines = pairs.select(F.col("a").alias("line")).distinct()
    left = written(classes.select("line", "norm").join(lines, "line").selectExpr("line AS a", f"{_set('norm', p)} AS x"), "line-sets")
    right = classes.select(F.col("line").alias("b"), F.col("norm").alias("y"))
    # as a lambda's argument b's set is made once a pair
    alike = F.expr(f"exists(array({_set('y', p)}), z -> {_alike('x', 'z', p)})")
    return pairs.join(right, "b").join(left, "a").where(alike).select("a", "b")


def line_components(classes: DataFrame, p: LineDedupParams) -> DataFrame:
    """(id, component) of every class that is linked with another."""
    marks = written(signed(classes, p), "line-signatures")
    sketches = marks.select("line", "sketch")
    members = marks.select("line", F.explode("buckets").alias("bucket"))  # two longs a row travel
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(members.join(sizes, "bucket"), "line-buckets")
    weight = shared.groupBy("line").agg(F.sum("n").alias("w"))
    pivot = shared.join(weight, "line").groupBy("bucket").agg(F.max_by("line", F.struct("w", "line")).alias("a"))
    met = shared.join(pivot, "bucket").where("line <> a").select("a", F.col("line").alias("b")).distinct()
    left, right = (sketches.select(F.col("line").alias(c), F.col("sketch").alias(f"{c}_sketch")) for c in ("a", "b"))
    first = met.join(right, "b").join(left, "a").where(F.expr(_near("a_sketch", "b_sketch", p))).select("a", "b")
    first = written(first, "line-pairs")
    links = written(_verified(first, classes, p), "line-links")
    found = written(components(links, "line-components"), "line-placed")
    placed = (
        shared.where("n > 2").join(found, shared["line"] == found["id"], "left")
        .select("bucket", "n", "line", F.coalesce("component", "line").alias("comp"))
    )
    open_ = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    rest = _with_mates(placed.join(open_, "bucket").join(sketches, "line"), p)
    more = _component_links(rest, classes, p)
    tied = found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return components(tied.unionByName(more), "line-components")


def _block_pairs(rest: DataFrame, held: list[str], p: LineDedupParams) -> DataFrame:
    """A row (bucket, xs, ys) for each pair of blocks of a bucket's n members."""
    dealt = rest.withColumn("blocks", F.ceil(F.col("n") / p.block).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.struct(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return dealt.groupBy("bucket", pair.alias("pair")).agg(
        F.collect_list(F.when(F.col("block") == F.least("block", "other"), F.struct(*held))).alias("xs"),
        F.collect_list(F.when(F.col("block") == F.greatest("block", "other"), F.struct(*held))).alias("ys"),
    )


def _with_mates(rest: DataFrame, p: LineDedupParams) -> DataFrame:
    """Members near to a bucket mate of another component by their sketches; the others have no link to find."""
    held = _block_pairs(rest, ["comp", "sketch", "line"], p)
    near = lambda xs, ys: f"transform(filter({xs}, x -> exists({ys}, y -> x.comp <> y.comp AND {_near('x.sketch', 'y.sketch', p)})), x -> x.line)"
    lines = held.select("bucket", F.explode(F.expr(f"array_union({near('xs', 'ys')}, {near('ys', 'xs')})")).alias("line")).distinct()
    found = written(rest.drop("n").join(lines, ["bucket", "line"]), "line-rest")
    return found.join(found.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")


def _component_links(rest: DataFrame, classes: DataFrame, p: LineDedupParams) -> DataFrame:
    """Pairs (a, b) of components with a link between their members in a bucket.

    rest: bucket, n, line, sketch, comp.  No pair becomes a row: a row holds
    two blocks and compares them.
    """
    lines = rest.select("line").distinct()
    sets = written(classes.select("line", "norm").join(lines, "line").selectExpr("line", f"{_set('norm', p)} AS set"), "line-sets")
    held = _block_pairs(rest.join(sets, "line"), ["comp", "sketch", "set"], p)
    linked = f"CASE WHEN x.comp <> y.comp AND {_near('x.sketch', 'y.sketch', p)} THEN {_alike('x.set', 'y.set', p)} ELSE false END"
    of_one = f"array_distinct(transform(filter(ys, y -> {linked}), y -> struct(least(x.comp, y.comp) AS a, greatest(x.comp, y.comp) AS b)))"
    found = held.select(F.explode(F.expr(f"array_distinct(flatten(transform(xs, x -> {of_one})))")).alias("link"))
    return written(found.select("link.a", "link.b").distinct(), "line-links")


def removals(docs: DataFrame, p: LineDedupParams = LineDedupParams()) -> DataFrame:
    """doc_id, text_hash and the places of the lines that go."""
    classes = _classes(docs)
    found = written(line_components(classes, p), "line-found")
    firsts = classes.select("line", "first", "n")
    linked = firsts.join(found, firsts["line"] == found["id"]).select("line", "first", "component")
    winners = linked.groupBy("component").agg(F.min("first").alias("winner"))
    fuzzy = linked.join(winners, "component").select("line", "winner")
    exact = firsts.where("n > 1").join(found, firsts["line"] == found["id"], "left_anti").select("line", F.col("first").alias("winner"))
    touched = written(fuzzy.unionByName(exact), "line-winners")
    rows = occurrences(docs).select("line", _place().alias("here")).join(touched, "line")
    gone = rows.where("not here <=> winner").select("here.*").distinct()
    return gone.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("gone"))


def deduplicated(docs: DataFrame, p: LineDedupParams = LineDedupParams()) -> DataFrame:
    """docs with `text` rebuilt from the kept lines, and n_lines and n_removed."""
    gone = removals(docs.select("doc_id", "text"), p).withColumnRenamed("doc_id", "gone_id").withColumnRenamed("text_hash", "gone_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = rows["row.doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(rows["row.text"]) == gone["gone_hash"])
    joined = rows.join(gone, same, "left")
    lines = F.split("row.text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept)
    given = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in given],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def line_dedup(docs: DataFrame, p: LineDedupParams = LineDedupParams()) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars and kept_sha256 of the kept text."""
    out = deduplicated(docs.select("doc_id", "text"), p)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"),
        "n_removed",
        F.length(text).cast("long").alias("n_chars"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )
