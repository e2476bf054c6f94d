"""Column expressions over ``token/TAG`` strings and parsed token arrays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from kindred.functions.text import SPACE


# A word with a last slash that is not its first character: what precedes it, and the tag after it.
_TAGGED = rf"(?U)(?<![^{SPACE}])([^{SPACE}]+)/([^{SPACE}/]*)"
_WHOLE = rf"(?U)(?<![^{SPACE}])[^{SPACE}][^{SPACE}/]*+/[^{SPACE}]*+"


def tagged_tokens(tagged: Column) -> Column:
    """The tokens of ``token/TAG token/TAG ...``, split at each word's last slash.

    Words without a slash or with nothing before the last slash are dropped; NULL gives an empty array.
    """
    return F.regexp_extract_all(F.coalesce(tagged, F.lit("")), F.lit(_TAGGED), F.lit(1))


def tagged_tags(tagged: Column) -> Column:
    """The upper-cased, possibly empty tags that belong to :func:`tagged_tokens`."""
    return F.regexp_extract_all(F.upper(F.coalesce(tagged, F.lit(""))), F.lit(_TAGGED), F.lit(2))


def tagged_words(tagged: Column) -> Column:
    """The words that :func:`tagged_tokens` and :func:`tagged_tags` take apart, whole, in one pass without backtracking.

    A word has a slash after its first character; none contains whitespace.
    """
    return F.regexp_extract_all(F.coalesce(tagged, F.lit("")), F.lit(_WHOLE), F.lit(0))


def word_token(word: Column) -> Column:
    """The token of one of :func:`tagged_words`."""
    return F.substring(word, F.lit(1), F.length(word) - F.length(F.substring_index(word, "/", -1)) - F.lit(1))


def word_tag(word: Column) -> Column:
    """The upper-cased, possibly empty tag of one of :func:`tagged_words`."""
    return F.upper(F.substring_index(word, "/", -1))


def parse_tags(tagged: Column) -> Column:
    """Both as ``array<struct<tok, pos>>``. Regex passes only, so the expression stays out of lambdas."""
    return F.arrays_zip(tagged_tokens(tagged).alias("tok"), tagged_tags(tagged).alias("pos"))


def tokens_tagged(parsed: Column, *tags: str) -> Column:
    """Lower-cased tokens carrying one of ``tags``, in text order."""
    return F.transform(F.filter(parsed, lambda x: x["pos"].isin(*tags)), lambda x: F.lower(x["tok"]))


def tokens_by_tag(parsed: Column) -> Column:
    """``map<tag, array<token>>`` with tokens in text order."""
    return F.map_from_entries(
        F.transform(
            F.array_distinct(parsed["pos"]),
            lambda p: F.struct(
                p, F.transform(F.filter(parsed, lambda x: x["pos"] == p), lambda x: x["tok"])
            ),
        )
    )


def tag_count(tags: Column, tag: str) -> Column:
    return F.size(tags) - F.size(F.array_remove(tags, tag))


def lexicon_tokens(parsed: Column, tags: Iterable[str], lexicon: Iterable[str]) -> Column:
    """Parsed tokens, lower-cased, that carry one of ``tags`` and are in ``lexicon``."""
    names, bag = list(tags), list(lexicon)
    return F.transform(
        F.filter(parsed, lambda x: x["pos"].isin(names) & F.lower(x["tok"]).isin(bag)),
        lambda x: F.struct(F.lower(x["tok"]).alias("tok"), x["pos"].alias("pos")),
    )


def hits(found: Column, tags: Iterable[str], lexicon: Iterable[str]) -> Column:
    """How many of the tokens from :func:`lexicon_tokens` carry one of ``tags`` and are in ``lexicon``."""
    names, bag = list(tags), list(lexicon)
    return F.size(F.filter(found, lambda x: x["pos"].isin(names) & x["tok"].isin(bag)))
