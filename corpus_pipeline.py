"""Corpus pipeline: language ID, near-dedup, substring dedup, benchmark decontamination, BPE encoding.

Each stage takes the documents that its predecessor kept and returns documents (the last: their tokens). Between
stages the documents are written as Parquet and read again. ORACLE_SQL is None: language ID by a fitted model, MinHash
and BPE can't be said in SQL; tests/llm hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, language, near_dedup, word_dedup
from graphloom.llm.common import stage, table, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without any letter, or with no likely language, go."""
    docs = docs.select(*COLUMNS)
    found = language.documents_language(docs).filter("NOT accepted")
    gone = stage(found.select("doc_id", "th"))
    # By text as well as id: of rows that share a doc_id, only those rejected go, null ids included.
    mine = (F.coalesce("doc_id", F.lit(-1)) == F.coalesce("_id", F.lit(-1))) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_th"))
    return docs.join(gone.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")), mine, "left_anti")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of near-duplicates. Repeated rows of a doc_id are one document;
    rows without a doc_id stay."""
    docs = docs.select(*COLUMNS)
    found = stage(near_dedup.near_duplicates(docs))
    kept = without(docs, "doc_id", found.filter("class_id <> doc_id").select(F.col("doc_id").alias("ord")))
    if found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id IS NULL"))


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 50 words or more that an earlier document has; a text that loses all its words goes."""
    done = word_dedup.dedup(docs.select(*COLUMNS), carry=("lang", "source"), preserve=True)
    return done.filter("n_removed = 0 OR n_removed < n_words").select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    return without(docs, "doc_id", found.select(F.col("doc_id").alias("ord")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
