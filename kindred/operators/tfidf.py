"""TF-IDF over unigrams and bigrams as a long, never densified weight table.

Smooth idf ``ln((1 + n) / (1 + df)) + 1``, raw term frequency, unit L2 norm per caption. ``pyspark.ml``'s
IDF lacks the ``+ 1`` and hashes or collects its vocabulary, so the weights are built from joins here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kindred import schema as S
from kindred.functions.text import TERM_PATTERN, let, ngrams, term_counts
from kindred.operators import grams
from kindred.operators.frames import attach, unnest


def term_words(df: DataFrame, text_col: str = S.TEXT) -> Column:
    """The words that terms are made of."""
    cut = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TERM_PATTERN), F.lit(0))
    return F.col("term_words") if "term_words" in df.columns else cut


def document_frequencies(
    df: DataFrame, ngram_range: tuple[int, int] = (1, 2), by: Sequence[str] = (), text_col: str = S.TEXT
) -> DataFrame:
    """``(by, term, df)``: in how many captions each term is, without a row for each term of a caption."""
    low, high = ngram_range
    found = grams.counts(df, term_words(df, text_col), by, range(low, high + 1), whole_row=True)
    return found.select(*by, F.col("ngram").alias("term"), F.col("cnt").alias("df"))


def caption_terms(
    df: DataFrame,
    ngram_range: tuple[int, int] = (1, 2),
    by: Sequence[str] = (),
    group_col: str = S.GROUP,
    id_col: str = S.CAPTION,
    text_col: str = S.TEXT,
) -> DataFrame:
    """``(by, group, caption, term, tf)``: counted inside the row, so the explode is one row per distinct term.

    A column ``term_words`` of words that are cut already is used instead of the text.
    """
    low, high = ngram_range
    terms = let(term_words(df, text_col), lambda t: F.concat(*[ngrams(t, n) for n in range(low, high + 1)]))
    return unnest(df, [*by, group_col, id_col], term_counts(terms))


def _bound(limit: int | float, n_docs: Column) -> Column:
    """An int is a number of captions, a float a share of them."""
    return F.lit(limit) if isinstance(limit, int) else F.lit(limit) * n_docs


def vocabulary(
    terms: DataFrame,
    n_docs: DataFrame,
    min_df: int | float = 2,
    max_df: int | float = 0.9,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by, term, df, idf)`` of the terms kept by the document-frequency limits.

    ``terms`` is what :func:`caption_terms` gives, or :func:`document_frequencies`.
    """
    counts = terms if "df" in terms.columns else terms.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))
    n = F.col("n_docs")
    kept = attach(counts, n_docs, by).filter(
        (F.col("df") >= _bound(min_df, n)) & (F.col("df") <= _bound(max_df, n))
    )
    return kept.select(
        *by, "term", "df", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf")
    )


def tfidf_weights(
    df: DataFrame,
    min_df: int | float = 2,
    max_df: int | float = 0.9,
    ngram_range: tuple[int, int] = (1, 2),
    by: Sequence[str] = (),
    group_col: str = S.GROUP,
    id_col: str = S.CAPTION,
    text_col: str = S.TEXT,
) -> DataFrame:
    """``(by, group, caption, term, w)`` with unit L2 norm per caption.

    A caption without any kept term has no rows (its vector is zero). The vocabulary join carries no hint:
    adaptive execution broadcasts the vocabulary when its measured size allows and otherwise splits the
    partitions of frequent terms.
    """
    terms = caption_terms(df, ngram_range, by, group_col, id_col, text_col)
    n_docs = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"))
    vocab = vocabulary(terms, n_docs, min_df, max_df, by)
    weighted = terms.join(vocab.select(*by, "term", "idf"), [*by, "term"]).select(
        *by, group_col, id_col, "term", (F.col("tf") * F.col("idf")).alias("w")
    )
    captions = weighted.groupBy(*by, group_col, id_col).agg(
        F.collect_list(F.struct("term", "w")).alias("_terms"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"),
    )
    unit = F.transform(
        "_terms", lambda e: F.struct(e["term"].alias("term"), (e["w"] / F.col("_norm")).alias("w"))
    )
    return unnest(captions, [*by, group_col, id_col], unit)
