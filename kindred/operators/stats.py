"""Corpus statistics over parsed captions.

Every operator takes ``by``: grouping columns (for example a corpus name) to compute the statistic per
value in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kindred import schema as S
from kindred.functions.tags import tag_count, tagged_words, word_tag, word_token
from kindred.functions.text import KEY_SEPARATOR
from kindred.lexicons import KEPT_TAGS
from kindred.operators.frames import attach_all, item_counts, top_counts, top_k, unnest
from kindred.operators.parsing import ensure_parsed


def word_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by, _word, _n)``: how often each tagged word occurs, and how many captions have how many words.

    A caption's length is one more word, the number after a separator that no tagged word contains. Words are taken
    apart by the readers of this table, which is after they were counted.
    """
    words = df.select(*by, tagged_words(F.col(S.TAGS)).alias("_words"))
    length = F.concat(F.lit(KEY_SEPARATOR), F.size("_words").cast("string"))
    rows = unnest(words, by, F.concat(F.array(length), F.col("_words")), "_word")
    return rows.groupBy(*by, "_word").agg(F.count(F.lit(1)).alias("_n"))


def _countable(df: DataFrame) -> bool:
    return S.TAGS in df.columns and not {"parsed_pos", "tokens", "pos_list"} & set(df.columns)


def _is_length() -> Column:
    """Readers of :func:`word_counts` use all its columns and no filter, which would move below its exchange: so they share it."""
    return F.col("_word").startswith(KEY_SEPARATOR)


def caption_scalars(
    df: DataFrame, by: Sequence[str] = (), tags: Sequence[str] = KEPT_TAGS, counts: DataFrame | None = None
) -> DataFrame:
    """Row count, token-length moments and mean tag counts per caption, in one aggregation.

    The exact median keeps one counter per distinct caption length, which is bounded by the longest
    caption and combined map-side. ``counts`` is the :func:`word_counts` of ``df`` where the caller has it; captions
    that come parsed are not counted by word.
    """
    if counts is None and _countable(df):
        counts = word_counts(df, by)
    if counts is not None:
        return _counted_scalars(counts, by, tags)
    parsed = ensure_parsed(df)
    length = F.size("tokens")
    return parsed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_captions"),
        F.avg(length).alias("avg_tokens"),
        F.stddev_samp(length).alias("std_tokens"),
        F.percentile(length, F.lit(0.5)).alias("median_tokens"),
        *[F.avg(tag_count(F.col("pos_list"), t)).alias(f"mean_{t}") for t in tags],
    )


def _counted_scalars(counts: DataFrame, by: Sequence[str], tags: Sequence[str]) -> DataFrame:
    """Sums are whole numbers, so the moments lose nothing to order."""
    is_length = _is_length()
    ready = counts.select(
        *by, "_n",
        F.when(is_length, F.substring("_word", 2, 10).cast("int")).alias("_length"),
        F.when(~is_length, word_tag(F.col("_word"))).alias("_tag"),
    )
    captions = F.when(F.col("_length").isNotNull(), F.col("_n"))
    length = F.col("_length").cast("bigint")
    totals = ready.groupBy(*by).agg(
        F.coalesce(F.sum(captions), F.lit(0)).alias("num_captions"),
        F.sum(captions * length).alias("_total"),
        F.sum((captions * length * length).cast("decimal(38,0)")).alias("_squares"),
        F.percentile("_length", F.lit(0.5), F.col("_n")).alias("median_tokens"),
        *[F.coalesce(F.sum(F.when(F.col("_tag") == t, F.col("_n"))), F.lit(0)).alias(f"_count_{t}") for t in tags],
    )
    n, total = F.col("num_captions"), F.col("_total").cast("decimal(38,0)")
    spread = (F.col("_squares") * n.cast("decimal(38,0)") - total * total).cast("double")
    return totals.select(
        *by, "num_captions",
        F.try_divide("_total", n).alias("avg_tokens"),
        F.when(n > 1, F.sqrt(spread / (n.cast("double") * (n - 1)))).alias("std_tokens"),
        "median_tokens",
        *[F.try_divide(F.col(f"`_count_{t}`"), n).alias(f"mean_{t}") for t in tags],
    )


def pos_means(df: DataFrame, by: Sequence[str] = (), tags: Sequence[str] = KEPT_TAGS) -> DataFrame:
    """Mean number of tokens per caption for each kept tag, zeros included."""
    parsed = ensure_parsed(df)
    return parsed.groupBy(*by).agg(
        *[F.avg(tag_count(F.col("pos_list"), t)).alias(f"mean_{t}") for t in tags]
    )


def captions_per_group(df: DataFrame, by: Sequence[str] = (), group_col: str = S.GROUP) -> DataFrame:
    """Number of groups, mean and median captions per group.

    Group sizes are folded to a (size, groups) histogram first: N captions have at most sqrt(2N) distinct
    group sizes, so the exact median never sees one row per group.
    """
    sizes = df.filter(F.col(group_col).isNotNull()).groupBy(*by, group_col).agg(F.count(F.lit(1)).alias("_n"))
    histogram = sizes.groupBy(*by, "_n").agg(F.count(F.lit(1)).alias("_groups"))
    groups = F.sum("_groups")
    return histogram.groupBy(*by).agg(
        F.coalesce(groups, F.lit(0)).alias("num_motions"),
        F.try_divide(F.sum(F.col("_n") * F.col("_groups")), groups).alias("captions_per_motion_mean"),
        F.percentile("_n", F.lit(0.5), F.col("_groups")).alias("captions_per_motion_median"),
    )


def corpus_scalars(df: DataFrame, by: Sequence[str] = (), group_col: str = S.GROUP) -> DataFrame:
    """All scalar corpus statistics, one row per ``by`` key; captions are parsed once, for lengths, tags and vocabulary."""
    counts = word_counts(df, by) if _countable(df) else None
    return attach_all(
        [
            caption_scalars(df, by, counts=counts),
            captions_per_group(df, by, group_col),
            vocab_size(df, by, counts),
        ],
        by,
    )


def vocab_table(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lower-cased token frequencies."""
    tokens = unnest(ensure_parsed(df), by, F.col("tokens"), "_tok")
    return tokens.groupBy(*by, F.lower("_tok").alias("token")).agg(F.count(F.lit(1)).alias("cnt"))


def vocab_size(df: DataFrame, by: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """``counts`` is the :func:`word_counts` of ``df`` where the caller has it."""
    if counts is None:
        return vocab_table(df, by).groupBy(*by).agg(F.count(F.lit(1)).alias("vocab_size"))
    token = F.when(~_is_length(), F.lower(word_token(F.col("_word"))))
    table = counts.groupBy(*by, token.alias("token")).agg(F.sum("_n").alias("cnt"))
    sizes = table.groupBy(*by).agg(F.count(F.when(F.col("cnt") > 0, F.col("token"))).alias("vocab_size"))
    return sizes.filter("vocab_size > 0") if by else sizes  # as above: no row for a key without tokens


def top_words(
    df: DataFrame, k: int = 20, by: Sequence[str] = (), tie: str = "key", order: Sequence[str] = (S.CAPTION,)
) -> DataFrame:
    """``tie="first_seen"`` lists equal counts in the order in which the words first occur: by ``order``, then place."""
    if tie == "key":
        return top_k(vocab_table(df, by), k, "cnt", ["token"], by)
    words = F.transform("tokens", lambda t: F.struct(F.lower(t).alias("token")))
    return top_counts(item_counts(ensure_parsed(df), by, words, order=order), k, ["token"], by, tie)


def pos_distribution(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Token count of every tag, the empty tag included."""
    tags = unnest(ensure_parsed(df), by, F.col("pos_list"), "pos")
    return tags.groupBy(*by, "pos").agg(F.count(F.lit(1)).alias("cnt"))


def corpus_stats(df: DataFrame, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The whole statistics section; ``vocabulary`` is the full frequency table."""
    return {
        "scalars": corpus_scalars(df, by),
        "top_20_words": top_words(df, 20, by),
        "pos_distribution": pos_distribution(df, by),
        "vocabulary": vocab_table(df, by),
    }
