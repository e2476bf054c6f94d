"""From tagged strings to token columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kindred import schema as S
from kindred.functions import tags as tg
from kindred.functions.text import word_count


def ensure_parsed(df: DataFrame, tags_col: str = S.TAGS) -> DataFrame:
    """Add ``parsed_pos``, ``tokens`` and ``pos_list`` where they are missing.

    Without a supplied ``parsed_pos`` each column is its own expression over the tag string, so a query that
    only reads tokens never builds tags or structs.
    """
    supplied = "parsed_pos" in df.columns
    columns = {
        "parsed_pos": tg.parse_tags,
        "tokens": (lambda _: F.col("parsed_pos.tok")) if supplied else tg.tagged_tokens,
        "pos_list": (lambda _: F.col("parsed_pos.pos")) if supplied else tg.tagged_tags,
    }
    missing = {c: make for c, make in columns.items() if c not in df.columns}
    if tags_col not in df.columns and not supplied:
        missing.pop("parsed_pos", None)
    return df.withColumns({c: make(F.col(tags_col)) for c, make in missing.items()})


def with_tokens_by_tag(df: DataFrame, tags_col: str = S.TAGS) -> DataFrame:
    return ensure_parsed(df, tags_col).withColumn("tokens_by_pos", tg.tokens_by_tag(F.col("parsed_pos")))


def tag_mismatch(df: DataFrame, text_col: str = S.TEXT, tags_col: str = S.TAGS) -> DataFrame:
    """Rows whose text and tag string have different word counts; a null on either side is a mismatch."""
    same = word_count(F.col(text_col)) == word_count(F.col(tags_col))
    return df.filter(~F.coalesce(same, F.lit(False)))
