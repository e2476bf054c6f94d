"""The sections of the report from one pass over the captions.

Every caption says all that the sections count, as (kind, key, n) facts: its words with their tags, n-grams, text, group,
length and scalars. One explode and one aggregation add them up, combined map-side, and the sums are
written once. The sections are small queries over that table, which is partitioned by kind, so each reads its own part.

Kinds: ``token`` (tag and raw token), ``raw2`` and ``raw3`` (n-grams of raw tokens), ``norm2`` and ``norm3`` (of the
normalised text), ``text`` (SHA-256 of the normalised text, null for a null one), ``group``, ``gendered`` and ``neutral`` (captions of a
group, and those with such a label), ``length`` (number of tokens) and ``scalar`` (named sums over all captions).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from kindred import lexicons as L, schema as S
from kindred.functions.tags import tag_count
from kindred.functions.text import KEY_SEPARATOR, TERM_PATTERN, normalised, normalised_words, sized_ngrams
from kindred.operators import actors, cues
from kindred.operators.frames import attach_all, top_k, unnest
from kindred.operators.parsing import ensure_parsed
from kindred.storage import materialise

RAW, NORM = (2, 3), (2, 3)
#: columns of :func:`parsed_captions` that hold the words of the normalised text and of TF-IDF
NORM_WORDS, TERM_WORDS = "norm_words", "term_words"


@dataclass(frozen=True)
class Lexicons:
    direction: Sequence[str] = L.DIRECTION_WORDS
    speed: Sequence[str] = L.SPEED_WORDS
    body: Sequence[str] = L.BODY_PARTS
    nouns: Mapping[str, Sequence[str]] = field(default_factory=lambda: L.ACTOR_NOUNS)
    pronouns: Mapping[str, Sequence[str]] = field(default_factory=lambda: L.PRONOUNS)
    connectives: Sequence[str] = L.CONNECTIVES


def parsed_captions(df: DataFrame) -> DataFrame:
    """The captions with every word list that the report needs, so that the texts are parsed once."""
    return ensure_parsed(df).withColumns({
        NORM_WORDS: normalised_words(F.col(S.TEXT)),
        TERM_WORDS: F.regexp_extract_all(F.lower(F.col(S.TEXT)), F.lit(TERM_PATTERN), F.lit(0)),
    })


def caption_facts(parsed: DataFrame, by: Sequence[str] = (), lexicons: Lexicons = Lexicons()) -> DataFrame:
    """``(by, kind, key, n)``: the facts of all captions, added up."""
    said = cues.with_cues(parsed, lexicons.direction, lexicons.speed, lexicons.body)
    said = actors.with_addressing(said, lexicons.nouns, lexicons.pronouns)
    label, size = F.col("addressing_label"), F.size("tokens")
    bag = list(lexicons.connectives)

    def fact(kind: str, key: Column, n: Column = F.lit(1)) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), n.cast("bigint").alias("n"))

    def each(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda key: fact(kind, key))

    def grams(prefix: str, words: str, sizes: Sequence[int], separator: str) -> list[Column]:
        return [each(f"{prefix}{n}", sized_ngrams(F.col(words), n, separator)["ngram"]) for n in sizes]

    tagged = F.zip_with("pos_list", "tokens", lambda p, t: F.concat(p, F.lit(KEY_SEPARATOR), t))
    scalars = {
        "captions": F.lit(1), "tokens": size, "tokens_squared": size.cast("bigint") * size,
        "direction": (F.col("direction_hits") > 0).cast("int"), "speed": (F.col("speed_hits") > 0).cast("int"),
        "body": (F.col("body_part_mentions") > 0).cast("int"),
        "connectives": F.size(F.filter("tokens", lambda t: F.lower(t).isin(bag))),
        **{f"tag {t}": tag_count(F.col("pos_list"), t) for t in dict.fromkeys([*L.KEPT_TAGS, "VERB"])},
    }
    in_group = F.col(S.GROUP).isNotNull()
    single = [
        fact("text", F.sha2(normalised(F.col(S.TEXT)), 256)), fact("length", size),
        fact("scalar", F.concat(F.lit("label "), label)),
        *[F.when(v != 0, fact("scalar", F.lit(name), v)) for name, v in scalars.items()],
        F.when(in_group, fact("group", F.col(S.GROUP))),
        F.when(in_group & label.isin(list(actors.GENDERED)), fact("gendered", F.col(S.GROUP))),
        F.when(in_group & label.isin(list(actors.NEUTRAL)), fact("neutral", F.col(S.GROUP))),
    ]
    facts = F.concat(
        F.filter(F.array(*single), lambda x: x.isNotNull()), each("token", tagged),
        *grams("raw", "tokens", RAW, KEY_SEPARATOR), *grams("norm", NORM_WORDS, NORM, " "),
    )
    return unnest(said, by, facts).groupBy(*by, "kind", "key").agg(F.sum("n").alias("n"))


def stored_facts(parsed: DataFrame, by: Sequence[str] = (), lexicons: Lexicons = Lexicons()) -> DataFrame:
    return materialise(caption_facts(parsed, by, lexicons), "facts", ["kind"])


def _kind(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.filter(F.col("kind").isin(*kinds))


def _words(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``(by, pos, tok, n)``: the raw tokens with their tags."""
    parts = F.split("key", KEY_SEPARATOR, 2)
    return _kind(facts, "token").select(*by, parts[0].alias("pos"), parts[1].alias("tok"), "n")


def _counts(rows: DataFrame, *keys: str | Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("cnt"))


def _named(name: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("key") == name, F.col("n"))), F.lit(0))


def _per_caption(names: Mapping[str, str]) -> list[Column]:
    return [F.try_divide(_named(key), _named("captions")).alias(column) for column, key in names.items()]


def caption_scalars(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """As :func:`kindred.operators.stats.corpus_scalars`; sums are whole numbers, so the moments lose nothing to order."""
    wide = lambda c: c.cast("decimal(38,0)")
    n, total, squares = _named("captions"), _named("tokens"), _named("tokens_squared")
    spread = (wide(squares) * wide(n) - wide(total) * wide(total)).cast("double")
    scalars = _kind(facts, "scalar").groupBy(*by).agg(
        n.alias("num_captions"), F.try_divide(total, n).alias("avg_tokens"),
        F.when(n > 1, F.sqrt(spread / (n.cast("double") * (n - 1)))).alias("std_tokens"),
        *_per_caption({f"mean_{t}": f"tag {t}" for t in L.KEPT_TAGS}),
    )
    median = _kind(facts, "length").groupBy(*by).agg(
        F.percentile(F.col("key").cast("int"), F.lit(0.5), F.col("n")).alias("median_tokens")
    )
    sizes = _kind(facts, "group").groupBy(*by, F.col("n").alias("_n")).agg(F.count(F.lit(1)).alias("_groups"))
    groups = F.sum("_groups")
    per_group = sizes.groupBy(*by).agg(
        F.coalesce(groups, F.lit(0)).alias("num_motions"),
        F.try_divide(F.sum(F.col("_n") * F.col("_groups")), groups).alias("captions_per_motion_mean"),
        F.percentile("_n", F.lit(0.5), F.col("_groups")).alias("captions_per_motion_median"),
    )
    words = _words(facts, by).groupBy(*by).agg(F.count_distinct(F.lower("tok")).alias("vocab_size"))
    means = [f"mean_{t}" for t in L.KEPT_TAGS]
    return attach_all([scalars, median, per_group, words], by).select(
        *by, "num_captions", "avg_tokens", "std_tokens", "median_tokens", *means, "num_motions",
        "captions_per_motion_mean", "captions_per_motion_median",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("vocab_size",)],
    )


def _label_rates(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    names = [*actors.LABELS, actors.NO_LABEL]
    totals = _kind(facts, "scalar").groupBy(*by).agg(
        _named("captions").alias("_total"), *[_named(f"label {x}").alias(x) for x in names]
    )
    pairs = F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).alias("cnt")) for x in names])
    return totals.select(*by, "_total", F.inline(pairs)).filter(F.col("cnt") > 0).select(
        *by, "label", "cnt", (F.col("cnt") / F.col("_total")).alias("rate")
    ).orderBy(*by, F.col("cnt").desc(), "label")


def _group_shares(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    share = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)) / F.sum(
        F.when(F.col("kind") == "group", F.col("n"))
    )
    return _kind(facts, "group", "gendered", "neutral").groupBy(*by, F.col("key").alias(S.GROUP)).agg(
        share("gendered").alias("share_gendered_captions"), share("neutral").alias("share_neutral_captions")
    )


def _richness(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    rates = _kind(facts, "scalar").groupBy(*by).agg(
        *_per_caption({"mean_verbs_per_caption": "tag VERB"}),
        F.try_divide(_named("connectives"), _named("tokens")).alias("conj_rate"),
    )
    words = _words(facts, by).groupBy(*by).agg(
        F.try_divide(F.count_distinct(F.lower("tok")), F.sum("n")).alias("TTR"),
        F.try_divide(F.count_distinct("tok"), F.sum("n")).alias("distinct-1"),
    )
    ratio = lambda n: F.try_divide(
        F.count_if(F.col("kind") == f"raw{n}"), F.sum(F.when(F.col("kind") == f"raw{n}", F.col("n")))
    ).alias(f"distinct-{n}")
    # ``n`` keeps corpora whose captions are too short for any n-gram
    grams = _kind(facts, "scalar", *[f"raw{n}" for n in RAW]).groupBy(*by).agg(*[ratio(n) for n in RAW])
    distinct = [F.coalesce(F.col(f"`distinct-{n}`"), F.lit(0.0)).alias(f"distinct-{n}") for n in (1, *RAW)]
    return attach_all([rates, words, grams], by).select(*by, "TTR", *distinct, "mean_verbs_per_caption", "conj_rate")


def sections(facts: DataFrame, by: Sequence[str] = (), lexicons: Lexicons = Lexicons()) -> dict[str, dict[str, DataFrame]]:
    """The sections of :func:`kindred.plans.report.analyse` but similarity, with the same frames."""
    words = _words(facts, by)
    vocabulary = _counts(words, *by, F.lower("tok").alias("token"))
    tagged = _counts(words.filter(F.col("pos").isin(list(cues.TAG_COLUMNS))), *by, "pos", F.lower("tok").alias("token"))
    category = F.create_map(*[F.lit(x) for c, bag in lexicons.nouns.items() for word in bag for x in (word, c)])
    nouns = [w for bag in lexicons.nouns.values() for w in bag]
    actor_nouns = _counts(
        words.filter((F.col("pos") == "NOUN") & F.lower("tok").isin(nouns)), *by, F.lower("tok").alias("token")
    ).withColumn("category", F.try_element_at(category, F.col("token")))
    texts = _kind(facts, "text").groupBy(*by).agg(
        (F.lit(1.0) - F.try_divide(F.count("key"), F.sum("n"))).alias("duplicate_rate")
    )
    grams = _kind(facts, *[f"norm{n}" for n in NORM]).select(
        *by, F.substring("kind", 5, 2).cast("int").alias("n"), F.col("key").alias("ngram"), F.col("n").alias("cnt")
    )
    rates = {
        "caption_rate_with_direction_cues": "direction", "caption_rate_with_speed_cues": "speed",
        "caption_rate_with_body_part_mentions": "body",
    }
    return {
        "corpus_stats": {
            "scalars": caption_scalars(facts, by), "top_20_words": top_k(vocabulary, 20, "cnt", ["token"], by),
            "pos_distribution": _counts(words, *by, "pos"), "vocabulary": vocabulary,
        },
        "cues": {
            "rates": _kind(facts, "scalar").groupBy(*by).agg(*_per_caption(rates)),
            "top_by_tag": top_k(tagged, 30, "cnt", ["token"], [*by, "pos"]),
        },
        "actors": {
            "label_rates": _label_rates(facts, by), "top_actor_nouns": top_k(actor_nouns, 20, "cnt", ["token"], by),
            "per_motion_summary": _group_shares(facts, by),
        },
        "redundancy": {"duplicate_rate": texts, "top_ngrams": top_k(grams, 30, "cnt", ["ngram"], [*by, "n"])},
        "richness": {"richness": _richness(facts, by)},
    }
