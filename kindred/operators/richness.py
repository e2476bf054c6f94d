"""Lexical richness: type-token ratio, distinct-n, verbs per caption, connectives."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kindred.functions.tags import tag_count
from kindred.functions.text import KEY_SEPARATOR
from kindred.lexicons import CONNECTIVES
from kindred.operators import grams
from kindred.operators.frames import attach
from kindred.operators.parsing import ensure_parsed


def distinct_ngrams(df: DataFrame, n_values: Sequence[int] = (1, 2, 3), by: Sequence[str] = ()) -> DataFrame:
    """Per n: number of distinct and of all n-grams of the raw-case tokens, and their ratio."""
    return _gram_totals(df, n_values, by).select(
        *by, "n", "distinct_cnt", "total_cnt", F.try_divide("distinct_cnt", "total_cnt").alias("ratio")
    )


def _gram_totals(df: DataFrame, n_values: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Distinct and total n-grams per n, from one shuffle of the n-grams (see :mod:`kindred.operators.grams`).

    ``words_cnt`` of n = 1 counts the distinct lower-cased tokens: a bucket says its two numbers for each n, and only
    its distinct unigrams go on as rows.
    """

    def measure(key, found, counted):
        names, cnt = grams.totals(found, counted)
        return {"_distinct": [len(cnt)], "_total": [int(cnt.sum())], "_words": [names.to_pylist() if key[-1] == 1 else None]}

    outputs = {
        "_distinct": (pa.int64(), "bigint"), "_total": (pa.int64(), "bigint"), "_words": (pa.list_(pa.string()), "array<string>")
    }
    buckets = grams.gathered(ensure_parsed(df), F.col("tokens"), by, n_values, KEY_SEPARATOR, outputs, measure)
    first = F.coalesce(F.col("_place"), F.lit(0)) == 0
    words = buckets.select(*by, "n", "_distinct", "_total", F.posexplode_outer("_words").alias("_place", "_word")).groupBy(
        *by, "n", F.lower("_word").alias("_word")
    ).agg(F.sum(F.when(first, F.col("_distinct"))).alias("_distinct"), F.sum(F.when(first, F.col("_total"))).alias("_total"))
    return words.groupBy(*by, "n").agg(
        F.sum("_distinct").alias("distinct_cnt"), F.sum("_total").alias("total_cnt"), F.count("_word").alias("words_cnt")
    )


def lexical_richness(
    df: DataFrame,
    by: Sequence[str] = (),
    connectives: Sequence[str] = CONNECTIVES,
    n_values: Sequence[int] = (1, 2, 3),
) -> DataFrame:
    """One row per ``by`` key with TTR, distinct-n, mean verbs per caption and connective rate."""

    def ratio(n: int, distinct: str = "distinct_cnt") -> Column:
        return F.max(F.when(F.col("n") == n, F.try_divide(distinct, "total_cnt")))

    ratios = (
        _gram_totals(df, sorted({1, *n_values}), by)
        .groupBy(*by)
        .agg(ratio(1, "words_cnt").alias("TTR"), *[ratio(n).alias(f"distinct-{n}") for n in n_values])
    )
    bag = list(connectives)
    found = F.size(F.filter("tokens", lambda t: F.lower(t).isin(bag)))
    rates = (
        ensure_parsed(df)
        .groupBy(*by)
        .agg(
            F.avg(tag_count(F.col("pos_list"), "VERB")).alias("mean_verbs_per_caption"),
            F.try_divide(F.sum(found), F.sum(F.size("tokens"))).alias("conj_rate"),
        )
    )
    distinct = [F.coalesce(F.col(f"`distinct-{n}`"), F.lit(0.0)).alias(f"distinct-{n}") for n in n_values]
    return attach(rates, ratios, by).select(
        *by, "TTR", *distinct, "mean_verbs_per_caption", "conj_rate"
    )
