"""Adapters from the benchmark tables to the caption, vector and frame relations.

The tables have no part-of-speech tags and their words are invented, so tags here are synthetic (by word
length) and the lexicons below are words that occur in the tables. Operators default to the real lexicons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kindred import schema as S
from kindred.functions.text import words
from kindred.sources.layout import spread

PROXY_TAGS = ("NOUN", "VERB", "ADJ", "ADV", "ADP", "PRON")
PROXY_DIRECTION = ("of", "the", "and", "de", "thatin", "that")
PROXY_SPEED = ("to", "in", "was", "que", "inoran")
PROXY_BODY = ("ononst", "attion", "thtion", "retion", "of")
PROXY_ACTORS = {
    "male": ("thatin", "the&&&"),
    "female": ("ononst", "and&&&"),
    "neutral": ("inoran", "hehely", "attion"),
}
PROXY_PRONOUNS = {
    "male": ("thble", "nicht"),
    "female": ("thing", "of%%%"),
    "neutral": ("erble", "oning"),
}
PROXY_CONNECTIVES = ("and", "for", "de", "y", "that")

# Frame arrays cut from 64-value vectors: 5 joints use 59 values, the rest make the root position.
FRAME_JOINTS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proxy_tags(text: Column) -> Column:
    names = F.array(*[F.lit(t) for t in PROXY_TAGS])
    tagged = F.transform(
        words(text), lambda w: F.concat(w, F.lit("/"), F.get(names, F.length(w) % F.lit(len(PROXY_TAGS))))
    )
    return F.array_join(tagged, " ")


def document_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents grouped by source; the language is the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return spread(docs, "doc_id").select(
        F.col("source").alias(S.GROUP),
        F.col("doc_id").cast("string").alias(S.CAPTION),
        F.col("lang").alias("dataset"),
        F.col("text").alias(S.TEXT),
        proxy_tags(F.col("text")).alias(S.TAGS),
    )


def conversation_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns grouped by conversation."""
    return spread(table(spark, sf_dir, "conversations"), "conv_id", "turn").select(
        F.col("conv_id").cast("string").alias(S.GROUP),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias(S.CAPTION),
        F.col("turn").cast("int").alias(S.LINE),
        F.col("role").alias("dataset"),
        F.col("text").alias(S.TEXT),
        proxy_tags(F.col("text")).alias(S.TAGS),
    )


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors grouped by label: few, large groups."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias(S.GROUP),
        F.col("vec_id").cast("string").alias(S.CAPTION),
        F.col("embedding").alias("vec"),
    )


def octet_vectors(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """Vectors in groups of eight consecutive ids, the size of a caption group."""
    vec = F.transform("embedding", lambda x: x.cast("double") * F.lit(scale))
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / F.lit(8)).cast("string").alias(S.GROUP),
        F.col("vec_id").cast("string").alias(S.CAPTION),
        (F.col("embedding") if scale == 1.0 else vec).alias("vec"),
    )


def feature_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias(S.GROUP),
        F.col("vec_id").cast("int").alias("frame"),
        F.col("embedding").alias("vec"),
    )


def joint_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint positions derived from the same vectors, off by a data-dependent amount per joint."""
    e = F.col("embedding")
    root = F.transform(F.slice(e, 61, 3), lambda x: x.cast("double"))
    drift = F.get(e, F.lit(63)).cast("double") * F.lit(0.1)
    moved = F.transform(
        F.sequence(F.lit(1), F.lit(FRAME_JOINTS - 1)),
        lambda k: F.zip_with(
            F.slice(e, k * F.lit(3) + F.lit(2), F.lit(3)), root, lambda a, r: a.cast("double") + r + drift * k
        ),
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias(S.GROUP),
        F.col("vec_id").cast("int").alias("frame"),
        F.concat(F.array(root), moved).alias("joints"),
    )
