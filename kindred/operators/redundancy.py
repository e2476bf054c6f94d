"""Duplicate captions and frequent n-grams of the normalised text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from kindred import schema as S
from kindred.functions.text import normalised, normalised_words, sized_ngrams, text_key
from kindred.operators import grams
from kindred.operators.frames import item_counts, top_counts, top_k


def with_normalised(df: DataFrame, text_col: str = S.TEXT) -> DataFrame:
    return df.withColumn("desc_norm", normalised(F.col(text_col)))


def duplicate_rate(df: DataFrame, by: Sequence[str] = (), text_col: str = S.TEXT) -> DataFrame:
    """``1 - distinct texts / rows``; NULL on empty input. Null texts count as rows, not as texts.

    Copies collapse map-side before the shuffle, so a text that makes up a third of the corpus costs one row
    per map task.
    """
    keyed = df.select(*by, text_key(normalised(F.col(text_col))).alias("_key"))
    copies = keyed.groupBy(*by, "_key").agg(F.count(F.lit(1)).alias("_n"))
    return copies.groupBy(*by).agg(
        (F.lit(1.0) - F.try_divide(F.count("_key"), F.sum("_n"))).alias("duplicate_rate")
    )


def ngram_counts(
    df: DataFrame, n_values: Sequence[int] = (2, 3), by: Sequence[str] = (), text_col: str = S.TEXT
) -> DataFrame:
    """Counts of within-caption n-grams, every n in one shuffle (see :mod:`kindred.operators.grams`)."""
    return grams.counts(df, normalised_words(F.col(text_col)), by, n_values)


def top_ngrams(
    df: DataFrame,
    n_values: Sequence[int] = (2, 3),
    k: int = 30,
    by: Sequence[str] = (),
    text_col: str = S.TEXT,
    tie: str = "key",
    order: Sequence[str] = (S.CAPTION,),
) -> DataFrame:
    """``tie="first_seen"`` lists equal counts in the order in which the n-grams first occur."""
    if tie != "key":
        prepared = df.select(*by, *order, normalised_words(F.col(text_col)).alias("_words"))
        sized = F.concat(*[sized_ngrams(F.col("_words"), n) for n in n_values])
        return top_counts(item_counts(prepared, by, sized, order=order), k, ["ngram"], [*by, "n"], tie)
    counted = grams.counts(df, normalised_words(F.col(text_col)), by, n_values, k=k)  # a bucket gives its k first
    return top_k(counted, k, "cnt", ["ngram"], [*by, "n"])


def redundancy_analysis(
    df: DataFrame, n_values: Sequence[int] = (2, 3), by: Sequence[str] = ()
) -> dict[str, DataFrame]:
    return {
        "duplicate_rate": duplicate_rate(df, by),
        "top_ngrams": top_ngrams(df, n_values, by=by),
    }
