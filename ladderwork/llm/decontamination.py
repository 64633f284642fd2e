"""Benchmark decontamination: a prefix-filtered set join in DataFrame operations.

An item's windows are runs of `window` consecutive words (one shorter window
for a shorter item).  A window lies in a document only if all its shingles do,
so its rarest shingle is a sufficient prefix: shingles of the benchmark are
counted over the whole corpus, each window keeps the rarest, and documents
join on it.  The place of the shingle in window and document then fixes where
the window would start; it has to fit there (positional and length bound), and
the words are compared one by one.

Everything runs in the JVM.  The windows are broadcast only behind a count of
their words.  Otherwise a shingle of a document travels as three numbers (a
hash of the row, place, shingle); the places that the bounds leave go back to
their texts, and the words are compared there.  Hot shingles are left to the
splits of adaptive execution.

Defined results: null texts have no words; items with null or wordless text
or null item_id are left out; repeated items count once; every row of docs
gives one row (rows with equal doc_id are told apart by their text).  Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderwork.llm.common import maybe_broadcast, small_enough, text_key, written

#: Fixed value: what separates words once A-Z are lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 10
    shingle: int = 3


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _runs(width: str, array: str = "words") -> Column:
    """Start places of all runs of `width` words."""
    return F.expr(f"sequence(0, size({array}) - {width})")


def windows(benchmark: DataFrame, p: DecontaminationParams) -> DataFrame:
    """item_id and each of its windows, with an id made of the window's words."""
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("len", F.least(F.size("words"), F.lit(p.window)))
    return (
        items.withColumn("at", F.explode(_runs("len")))
        .select("item_id", "len", F.expr("slice(words, at + 1, len)").alias("window"))
        .withColumn("window_id", F.sha2(F.concat_ws(" ", "window").cast("binary"), 256))
        .distinct()
    )


def _shingle_at(array: str, at: str, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.expr(f"get({array}, {at} + {j})") for j in range(width)])


def _shingled(docs: DataFrame, widths: list[int]) -> DataFrame:
    """A row per word place and width with the shingle that starts there."""
    placed = docs.select("*", F.posexplode("words").alias("pos", "word"))
    hashes = [_shingle_at("words", "pos", w) for w in widths]
    if len(hashes) == 1:
        return placed.withColumn("shingle", hashes[0])
    return placed.withColumn("shingle", F.explode(F.array(*hashes)))


def hits(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """Verified occurrences: doc_id, text key, start, len and window_id."""
    spans = windows(benchmark, p).select("window_id", "window", "len").distinct()
    spans = spans.withColumn("width", F.least(F.col("len"), F.lit(p.shingle)))
    # a window shorter than a shingle has one shingle of its own width
    tokens = spans.withColumn("at", F.explode(F.expr("sequence(0, len - width)")))
    shingle = F.coalesce(*[F.when(F.col("width") == w, _shingle_at("window", "at", w)) for w in range(1, p.shingle + 1)])
    tokens = written(tokens.withColumn("shingle", shingle), "window-shingles")
    widths = sorted(r.width for r in tokens.select("width").distinct().collect())
    if not widths:
        widths = [p.shingle]
    texts = docs.select("doc_id", "text", words(F.col("text")).alias("words"))
    known = maybe_broadcast(tokens.select("shingle").distinct())
    counts = _shingled(texts.select("words"), widths).join(known, "shingle").groupBy("shingle").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("window_id").orderBy("n", "shingle", "at")
    # a window with a shingle that no document has cannot occur: the inner rank keeps n = 0
    ranked = tokens.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = ranked.withColumn("rank", F.row_number().over(rarest)).where("rank = 1 and n > 0")
    prefix = written(prefix.select("shingle", "at", "len", "window", "window_id"), "window-prefixes")
    if small_enough(prefix, 2 * F.size("window")):
        met = _shingled(texts, widths).join(F.broadcast(prefix), "shingle").where("pos >= at and pos - at + len <= size(words)")
        found = met.where("slice(words, pos - at + 1, len) = window").withColumn("text_key", text_key(F.col("text")))
    else:
        found = _met_by_shuffle(docs, texts, prefix, widths)
    return found.select("doc_id", "text_key", (F.col("pos") - F.col("at")).alias("start"), "len", "window_id")


def _met_by_shuffle(docs: DataFrame, texts: DataFrame, prefix: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, text_key, pos, at, len and window_id of verified occurrences, without a broadcast.

    Two rows with one hash only cost a comparison: the words decide.  Equal
    rows share one set of places, so k of them meet it k times and not k * k.
    """
    row = F.xxhash64("doc_id", "text")
    places = _shingled(texts.select(row.alias("row"), "words"), widths).select("row", "pos", "shingle")
    met = places.join(prefix.select("shingle", "at", "len", "window_id"), "shingle").where("pos >= at")
    by_row = met.groupBy("row").agg(F.collect_set(F.struct("pos", "at", "len", "window_id")).alias("met"))
    rows = docs.select(row.alias("row"), "doc_id", "text").join(by_row, "row").withColumn("words", words(F.col("text")))
    each = rows.select("doc_id", "text", "words", F.explode("met").alias("m")).select("doc_id", "text", "words", "m.*")
    fits = each.where("pos - at + len <= size(words)").withColumn("seen", F.expr("slice(words, pos - at + 1, len)"))
    # the text stays behind: its key and the words in question go to the window
    fits = fits.select("doc_id", text_key(F.col("text")).alias("text_key"), "pos", "at", "len", "window_id", "seen")
    return fits.join(prefix.select("window_id", "window"), "window_id").where("seen = window")


def contamination(docs: DataFrame, benchmark: DataFrame, p: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """n_words, n_hit, n_items, items_sha256 and contaminated for every row of docs."""
    found = written(hits(docs, benchmark, p).distinct(), "hits")
    by_doc = Window.partitionBy("doc_id", "text_key").orderBy("start", "len")
    before = F.max(F.col("start") + F.col("len")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("doc_id", "text_key", "start", "len").distinct()
    new = F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", F.coalesce(before, F.lit(0))))
    covered = spans.withColumn("new", new).groupBy("doc_id", "text_key").agg(F.sum("new").cast("long").alias("n_hit"))
    owners = windows(benchmark, p).select("window_id", F.col("item_id").cast("string").alias("item")).distinct()
    items = (
        found.select("doc_id", "text_key", "window_id").distinct().join(maybe_broadcast(owners), "window_id")
        .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    marks = covered.join(items, on=[covered.doc_id.eqNullSafe(items.doc_id), covered.text_key == items.text_key]).select(
        covered.doc_id.alias("m_id"), covered.text_key.alias("m_key"), "n_hit", "items"
    )
    base = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(marks, on=[base.doc_id.eqNullSafe(marks.m_id), base.text_key == marks.m_key], how="left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, list_slice(w, i + 1, i + least(10, len(w))) AS g
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, l, list_slice(w, i + 1, i + l) AS g
  FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.l, bw.item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
