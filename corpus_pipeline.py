"""From raw documents to packed training windows, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, in the columns of documents, for the next;
the last returns packed pieces. What a stage returns is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwood.llm import language_id, line_dedup, near_dup, packing, secret_scan, shared

#: A document stays if the label probabilities of its words give its language this share.
LEAST_LANGUAGE_SHARE = 0.4


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    """In the columns of documents, n_chars counted again."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those in which no language prevails, go."""
    told = language_id.identify(docs, language_id.train(docs))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SHARE)).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents that consist of nothing else."""
    told = line_dedup.dedup(docs)
    return _as_documents(told.where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines"))), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    gone = near_dup.near_duplicates(docs, words=5, threshold=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay."""
    return _as_documents(secret_scan.redact(docs), docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training windows."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_windows),
]

#: Learned labels and random bands are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
