"""Lexicons handed in as tables, of any size.

A lexicon has a word (lower case) per row with its category and, optionally, the tags it counts under (``tags array<string>``;
null: any). Its size is measured before it is joined: up to ``limit`` bytes it is broadcast. Beyond that the join shuffles by word,
and the few words that make up more than a ``1 / HEAVY`` of all tokens each, at most ``HEAVY`` of them, are met by
a broadcast of their own entries instead, so that no word is a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kindred.functions.text import term_counts
from kindred.operators.frames import unnest
from kindred.operators.parsing import ensure_parsed

BROADCAST = 8 << 20
HEAVY = 1000


def measured_bytes(lexicon: DataFrame) -> int:
    """About what the entries take in memory."""
    tags = F.size("tags") if "tags" in lexicon.columns else F.lit(0)
    size = F.length("word") + F.length("category") + F.greatest(tags, F.lit(0)) * 8 + 48
    return lexicon.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def _fits(pos: str, lexicon: DataFrame) -> Column:
    """Whether an entry counts under the token's tag."""
    if "tags" not in lexicon.columns:
        return F.lit(True)
    return F.col("tags").isNull() | F.array_contains("tags", F.col(pos))


def caption_tokens(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, word, pos, tf)``: the different lower-cased tokens of each caption with their tag and count."""
    pairs = F.zip_with("tokens", "pos_list", lambda t, p: F.struct(F.lower(t).alias("word"), p.alias("pos")))
    return unnest(ensure_parsed(df), keys, term_counts(pairs)).select(*keys, "term.word", "term.pos", "tf")


def matches(tokens: DataFrame, lexicon: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """The rows of ``tokens`` (word, pos, ...) with the category of each lexicon entry they match."""
    entries = lexicon.select("word", "category", *(["tags"] if "tags" in lexicon.columns else [])).distinct()
    if measured_bytes(lexicon) <= limit:
        met = tokens.join(F.broadcast(entries), "word")
    else:
        counts = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
        total = tokens.agg(F.count(F.lit(1)).alias("_n")).scalar()
        heavy = counts.filter(F.col("_n") * HEAVY > total).select("word")  # fewer than HEAVY words
        named = entries.join(F.broadcast(heavy), "word", "left_semi")
        met = tokens.join(F.broadcast(heavy), "word", "left_anti").join(entries, "word").unionByName(
            tokens.join(F.broadcast(heavy), "word", "left_semi").join(F.broadcast(named), "word")
        )
    return met.filter(_fits("pos", lexicon)).drop("tags")


def lexicon_hits(
    df: DataFrame, lexicon: DataFrame, keys: Sequence[str], categories: Sequence[str], limit: int = BROADCAST
) -> DataFrame:
    """``(keys, one count per category)`` for every caption, zeros included. ``keys`` name a caption."""
    found = matches(caption_tokens(df, keys), lexicon, limit).groupBy(*keys).agg(
        *[F.sum(F.when(F.col("category") == c, F.col("tf"))).alias(c) for c in categories]
    )
    return df.select(*keys).join(found, list(keys), "left").select(
        *keys, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in categories]
    )


def lexicon_counts(df: DataFrame, lexicon: DataFrame, by: Sequence[str] = (), limit: int = BROADCAST) -> DataFrame:
    """``(by, token, category, cnt)`` over all captions.

    Tokens are added up before the join, so a word has one row there per corpus and tag.
    """
    pairs = F.zip_with("tokens", "pos_list", lambda t, p: F.struct(F.lower(t).alias("word"), p.alias("pos")))
    counts = unnest(ensure_parsed(df), by, pairs).groupBy(*by, "word", "pos").agg(F.count(F.lit(1)).alias("_n"))
    return matches(counts, lexicon, limit).groupBy(*by, F.col("word").alias("token"), "category").agg(F.sum("_n").alias("cnt"))
