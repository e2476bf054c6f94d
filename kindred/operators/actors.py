"""How captions address their actor: gendered or neutral nouns and pronouns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from kindred.functions.tags import hits, lexicon_tokens
from kindred.lexicons import ACTOR_NOUNS, PRONOUNS
from kindred.operators.frames import item_counts, top_counts, top_k
from kindred.operators.parsing import ensure_parsed
from kindred import schema as S

Lexicon = Mapping[str, Sequence[str]]

# Label precedence, first match wins.
LABELS = ("male_noun", "female_noun", "neutral_noun", "male_pron", "female_pron", "neutral_pron")
NO_LABEL = "none"
GENDERED = ("male_noun", "female_noun", "male_pron", "female_pron")
NEUTRAL = ("neutral_noun", "neutral_pron")


def _counter_of(label: str) -> str:
    category, kind = label.split("_")
    return f"{kind}_{category}"


def with_addressing(df: DataFrame, nouns: Lexicon = ACTOR_NOUNS, pronouns: Lexicon = PRONOUNS) -> DataFrame:
    """Add six counters and ``addressing_label``. Any noun outranks any pronoun; row-local."""
    bags = {"noun": ("NOUN", nouns), "pron": ("PRON", pronouns)}
    anywhere = sorted({w for _, lexicon in bags.values() for bag in lexicon.values() for w in bag})
    counters = {
        f"{kind}_{category}": hits(F.col("_found"), (tag,), lexicon[category])
        for kind, (tag, lexicon) in bags.items()
        for category in ("male", "female", "neutral")
    }
    found = lexicon_tokens(F.col("parsed_pos"), ("NOUN", "PRON"), anywhere)
    counted = ensure_parsed(df).withColumn("_found", found).withColumns(counters).drop("_found")
    label: Column = F.coalesce(
        *[F.when(F.col(_counter_of(x)) > 0, F.lit(x)) for x in LABELS], F.lit(NO_LABEL)
    )
    return counted.withColumn("addressing_label", label)


def label_rates(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of captions per label in descending order; labels that do not occur are absent.

    One aggregation with a counter per label, unpivoted afterwards.
    """
    names = [*LABELS, NO_LABEL]
    counts = labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col("addressing_label") == x).alias(x) for x in names],
    )
    pairs = F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("cnt")) for x in names])
    return (
        counts.select(*by, "_total", F.inline(pairs))
        .filter(F.col("cnt") > 0)
        .select(*by, "label", "cnt", (F.col("cnt") / F.col("_total")).alias("rate"))
        .orderBy(*by, F.col("cnt").desc(), "label")
    )


def group_shares(labelled: DataFrame, group_col: str = S.GROUP, by: Sequence[str] = ()) -> DataFrame:
    """Per group, the share of captions with a gendered and with a neutral label."""

    def share(labels: Sequence[str]) -> Column:
        return F.avg(F.col("addressing_label").isin(list(labels)).cast("int"))

    return (
        labelled.filter(F.col(group_col).isNotNull())
        .groupBy(*by, group_col)
        .agg(
            share(GENDERED).alias("share_gendered_captions"),
            share(NEUTRAL).alias("share_neutral_captions"),
        )
    )


def top_group_shares(shares: DataFrame, k: int = 5, group_col: str = S.GROUP, by: Sequence[str] = ()) -> DataFrame:
    return top_k(shares, k, "share_gendered_captions", [group_col], by)


def actor_noun_counts(
    df: DataFrame, nouns: Lexicon = ACTOR_NOUNS, by: Sequence[str] = (), order: Sequence[str] = ()
) -> DataFrame:
    """Frequency and category of every NOUN token found in the actor lexicon; with ``order`` also ``first_seen``."""
    category = F.create_map(
        *[F.lit(x) for cat, bag in nouns.items() for word in bag for x in (word, cat)]
    )
    words = [w for bag in nouns.values() for w in bag]
    found = lexicon_tokens(F.col("parsed_pos"), ("NOUN",), words)
    counts = item_counts(ensure_parsed(df), by, found, {"token": F.col("tok")}, order)
    return counts.withColumn("category", F.try_element_at(category, F.col("token")))


def top_actor_nouns(
    df: DataFrame, k: int = 20, nouns: Lexicon = ACTOR_NOUNS, by: Sequence[str] = (), tie: str = "key",
    order: Sequence[str] = (S.CAPTION,),
) -> DataFrame:
    """``tie="first_seen"`` lists equal counts in the order in which the nouns first occur."""
    return top_counts(actor_noun_counts(df, nouns, by, order if tie == "first_seen" else ()), k, ["token"], by, tie)


def actor_analysis(
    df: DataFrame, by: Sequence[str] = (), nouns: Lexicon = ACTOR_NOUNS, pronouns: Lexicon = PRONOUNS
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``(labelled captions, summary frames)``."""
    labelled = with_addressing(df, nouns, pronouns)
    return labelled, {
        "label_rates": label_rates(labelled, by),
        "top_actor_nouns": top_actor_nouns(df, 20, nouns, by),
        "per_motion_summary": group_shares(labelled, by=by),
    }
