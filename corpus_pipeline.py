"""The corpus pipeline: STAGES over documents, each written and read again.

Every stage but the last returns the columns of documents and works on all
that its predecessor kept: toxic documents go, repeated lines go from the
texts, one document of each near-duplicate group stays, documents that hold a
window of a benchmark item go, and the rest is packed into sequences.

Rows are judged one by one: a doc_id that repeats with another text is another
row.  Null texts and null ids stay until they are packed; other columns of
docs, whatever their names, are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderwork.llm import decontamination, line_dedup, near_duplicates, packing, toxicity
from ladderwork.llm.common import maybe_broadcast, table, text_key, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half stay."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, lexicon).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts keep one line of each group of similar lines; n_chars follows the text.

    A document that lost every line that was not blank has only copies of
    lines kept elsewhere, and goes.
    """
    out = line_dedup.deduplicated(docs).where((F.col("n_removed") == 0) | (F.trim("text", F.lit(" \t\r\n\f\v")) != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts stays."""
    return near_duplicates.without_near_duplicates(docs, near_duplicates.STAGE).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window stay."""
    hits = decontamination.hits(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    found = written(hits.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(found["hit_id"]) & (text_key(docs["text"]) == found["hit_key"])
    return docs.join(maybe_broadcast(found), same, "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: The stages learn from labels, hash and tokenise; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
