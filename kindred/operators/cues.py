"""Lexicon cues: direction, speed and body-part mentions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from kindred import lexicons as L, schema as S
from kindred.functions.tags import hits, lexicon_tokens, tokens_tagged
from kindred.operators.frames import item_counts, top_counts, top_k, unnest
from kindred.operators.parsing import ensure_parsed

# Output column of each tag list.
TAG_COLUMNS = {"VERB": "verbs", "ADJ": "adjs", "ADV": "advs", "NOUN": "nouns"}


def with_cues(
    df: DataFrame,
    direction: Sequence[str] = L.DIRECTION_WORDS,
    speed: Sequence[str] = L.SPEED_WORDS,
    body: Sequence[str] = L.BODY_PARTS,
) -> DataFrame:
    """Add the four lower-cased token lists and the three hit counts.

    Direction words count as adjective, adverb or noun; speed words as adjective or adverb; body parts as
    noun. A row-local projection: no shuffle. Lexicon words are picked out once, the counts read those few.
    """
    parsed, found = F.col("parsed_pos"), F.col("_found")
    anywhere = sorted({*direction, *speed, *body})
    return (
        ensure_parsed(df)
        .withColumns({c: tokens_tagged(parsed, t) for t, c in TAG_COLUMNS.items()})
        .withColumn("_found", lexicon_tokens(parsed, ("ADJ", "ADV", "NOUN"), anywhere))
        .withColumns(
            {
                "direction_hits": hits(found, ("ADJ", "ADV", "NOUN"), direction),
                "speed_hits": hits(found, ("ADJ", "ADV"), speed),
                "body_part_mentions": hits(found, ("NOUN",), body),
            }
        )
        .drop("_found")
    )


def cue_rates(df: DataFrame, by: Sequence[str] = (), **lexicons: Sequence[str]) -> DataFrame:
    """Share of captions with at least one hit of each kind."""

    def rate(c: str):
        return F.avg((F.col(c) > 0).cast("double"))

    return (
        with_cues(df, **lexicons)
        .groupBy(*by)
        .agg(
            rate("direction_hits").alias("caption_rate_with_direction_cues"),
            rate("speed_hits").alias("caption_rate_with_speed_cues"),
            rate("body_part_mentions").alias("caption_rate_with_body_part_mentions"),
        )
    )


def top_by_tag(
    df: DataFrame, k: int = 30, tags: Sequence[str] = tuple(TAG_COLUMNS), by: Sequence[str] = (), tie: str = "key",
    order: Sequence[str] = (S.CAPTION,),
) -> DataFrame:
    """The k most frequent lower-cased tokens of each tag, from one explode and one aggregation.

    ``tie="first_seen"`` lists equal counts in the order in which the words first occur with that tag.
    """
    if tie != "key":
        kept = F.filter(F.arrays_zip(F.col("pos_list").alias("pos"), F.col("tokens").alias("tok")), lambda x: x["pos"].isin(list(tags)))
        keys = {"pos": F.col("pos"), "token": F.lower("tok")}
        return top_counts(item_counts(ensure_parsed(df), by, kept, keys, order), k, ["token"], [*by, "pos"], tie)
    tagged = F.arrays_zip(F.col("tokens").alias("tok"), F.col("pos_list").alias("pos"))
    counts = (
        unnest(ensure_parsed(df), by, tagged)
        .select(*by, "pos", F.lower("tok").alias("token"))
        .filter(F.col("pos").isin(list(tags)))
        .groupBy(*by, "pos", "token")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return top_k(counts, k, "cnt", ["token"], [*by, "pos"])


def cue_analysis(
    df: DataFrame, by: Sequence[str] = (), **lexicons: Sequence[str]
) -> tuple[dict[str, DataFrame], DataFrame]:
    """``(summary frames, cue-enriched captions)``."""
    summary = {"rates": cue_rates(df, by, **lexicons), "top_by_tag": top_by_tag(df, by=by)}
    return summary, with_cues(df, **lexicons)
