"""Cleaning a document corpus in five stages, from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet in the shared folder
and reads it back as the next stage's docs. All stages but the last return the columns of documents.

Null and empty texts are rejected by the first stage (they have no words). Columns beyond those of documents are
dropped, whatever their names. Empty documents give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm import bpe, decontamination, near_dedup, quality, secret_scan
from kindred.llm.common import scratch, shared_dir, table, two_columns
from kindred.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The documents whose doc_id is in keep; a null doc_id matches a null one."""
    ids = keep.select(F.col("doc_id").alias("_keep_id")).distinct()
    return docs.select(*COLUMNS).join(ids, F.col("doc_id").eqNullSafe(F.col("_keep_id")), "left_semi")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Rows that share a doc_id stay if one of them is good."""
    return _only(docs, quality.quality_scores(two_columns(docs)).filter("kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id."""
    found = near_dedup.near_duplicates(two_columns(docs))
    return _only(docs, found.filter("kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window that is like a benchmark item go."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    bad = decontamination.contaminated(two_columns(docs), items).withColumnRenamed("doc_id", "_bad_id")
    return docs.select(*COLUMNS).join(bad, F.col("doc_id").eqNullSafe(F.col("_bad_id")), "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the spans of its secrets, nested ones too, are masked, and n_chars follows."""
    return secret_scan.redacted_documents(docs.select(*COLUMNS))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 digests of the ids and of the decoded text."""
    out = bpe.encode(two_columns(docs), vocabulary(), digests=True)
    return out.select(
        "doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", classify_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("BPE encoding", encode_tokens),
]

#: EM, a fitted scorer, decoding of nested layers and BPE are not SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):  # what a stage writes on its way is deleted once its result is there
            result = stage(spark, docs, sf_dir)
            path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
