"""Vectors for captions: masked mean pooling of token vectors and user-supplied encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, functions as F

from kindred import schema as S
from kindred.functions.text import text_key
from kindred.functions.vectors import l2_normalise
from kindred.operators.similarity import vector_sums
from kindred.storage import materialise


def normalise_vectors(df: DataFrame, vec_col: str = "vec", eps: float = 0.0) -> DataFrame:
    return df.withColumn(vec_col, l2_normalise(F.col(vec_col), eps))


def mean_pool(
    token_vectors: DataFrame,
    keys: Sequence[str] = (S.CAPTION,),
    vec_col: str = "vec",
    mask_col: str = "mask",
    dim: int | None = None,
) -> DataFrame:
    """``sum(mask * vec) / max(sum(mask), 1e-6)`` per key; zeros where every mask is 0."""
    masked = token_vectors.select(
        *keys,
        F.col(mask_col).cast("double").alias("_mask"),
        F.transform(vec_col, lambda x: x.cast("double") * F.col(mask_col)).alias("_vec"),
    )
    sums = vector_sums(masked, list(keys), "_vec", dim, _mass=F.sum("_mask"))
    mass = F.greatest(F.col("_mass"), F.lit(1e-6))
    return sums.select(*keys, F.transform("_sum", lambda x: x / mass).alias(vec_col))


def encode(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    text_col: str = S.TEXT,
    vec_col: str = "vec",
    batch_size: int = 128,
    eps: float = 0.0,
) -> DataFrame:
    """Add unit vectors from a user encoder.

    ``make_encoder`` runs once per task and returns a function from a list of texts to a float matrix, so a
    model is loaded once and fed ``batch_size`` texts at a time. Null texts are encoded as ''.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            values = texts.fillna("").tolist()
            parts = [
                np.asarray(encoder(values[i : i + batch_size]), dtype=np.float32)
                for i in range(0, len(values), batch_size)
            ]
            yield pd.Series(list(np.concatenate(parts)) if parts else [], dtype=object)

    return normalise_vectors(df.withColumn(vec_col, run(F.col(text_col))), vec_col, eps)


def distinct_vectors(
    df: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    text_col: str = S.TEXT,
    vec_col: str = "vec",
    batch_size: int = 128,
    eps: float = 0.0,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``(_key, vec)``: the unit vector, in DOUBLE, of each different text (null: '') under its SHA-256.

    Copies collapse map-side before the encoder sees them. Texts reach it in batches of like length, so that padding is
    short; a length class is dealt over partitions by the text's hash. ``profile`` asks for the executors that the encoder needs
    (GPUs, memory) for this stage only.
    """
    text = F.coalesce(text_col, F.lit(""))
    texts = df.select(text_key(text).alias("_key"), text.alias("_text")).groupBy("_key").agg(F.first("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_size):
                part = batch.slice(at, batch_size)
                vectors = np.asarray(encoder(part.column("_text").to_pylist()), np.float64)
                offsets = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))], names=["_key", vec_col]
                )

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = texts.repartition(n, "_key").sortWithinPartitions(F.length("_text"), "_key")
    return normalise_vectors(ready.mapInArrow(run, f"_key binary, {vec_col} array<double>", profile=profile), vec_col, eps)


def encode_distinct(df: DataFrame, make_encoder, text_col: str = S.TEXT, vec_col: str = "vec", **options) -> DataFrame:
    """Add unit vectors from a user encoder that sees every different text once (see :func:`distinct_vectors`).

    The vectors are written to the shared folder and joined back by the text's hash; adaptive execution splits the
    partition of a text that is in very many rows.
    """
    vectors = materialise(distinct_vectors(df, make_encoder, text_col, vec_col, **options), "vectors")
    keyed = df.withColumn("_key", text_key(F.coalesce(text_col, F.lit(""))))
    return keyed.join(vectors, "_key").drop("_key")
