"""Column expressions over free text and token arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# What Python's str.split() and str.strip() treat as whitespace. Java's Unicode \s lacks only
# \x1c-\x1f. (Spelling the whole class out instead of using \s makes the matcher ten times slower.)
SPACE = r"\s\x1c-\x1f"
WORD_PATTERN = rf"(?U)[^{SPACE}]+"

# Fixed value: a run of two or more word characters.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    A column used inside a higher-order lambda may be inlined there by the optimizer and recomputed for
    every element; a lambda variable cannot.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN))


def normalised(text: Column) -> Column:
    """Lower-case letters and digits, every other run of characters as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalised_words(text: Column) -> Column:
    """The words of ``normalised(text)`` without building the string."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def text_key(text: Column) -> Column:
    """A grouping key of fixed size for a text: its SHA-256, so that de-duplication shuffles no texts."""
    return F.unhex(F.sha2(text, 256))


def windows(tokens: Column, n: int, piece: Callable[[Column, Column], Column]) -> Column:
    """``piece(tokens, start)`` for every 1-based start of an n-token window."""

    def build(t: Column) -> Column:
        # sequence() counts downwards when stop < start, hence the size guard.
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - F.lit(n - 1)))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: piece(t, i))

    return let(tokens, build)


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams, an empty array when there are fewer than n tokens."""
    if n == 1:
        return tokens
    return windows(tokens, n, lambda t, i: F.array_join(F.slice(t, i, F.lit(n)), " "))


# Joins the tokens of a grouping key. It counts as whitespace, so no parsed token contains it.
KEY_SEPARATOR = "\x1f"


def sized_ngrams(tokens: Column, n: int, separator: str = " ") -> Column:
    """``array<struct<n, ngram>>``, ready to be concatenated with other sizes and exploded together."""

    def piece(t: Column, i: Column) -> Column:
        gram = F.get(t, i - F.lit(1)) if n == 1 else F.array_join(F.slice(t, i, F.lit(n)), separator)
        return F.struct(F.lit(n).alias("n"), gram.alias("ngram"))

    return windows(tokens, n, piece)


def term_counts(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of the distinct terms of one row, without a shuffle.

    The sorted array is cut where neighbours differ; run lengths are the counts.
    """

    def runs(s: Column) -> Column:
        positions = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - F.lit(1)))
        starts = F.filter(
            F.coalesce(positions, F.array().cast("array<int>")),
            lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - F.lit(1))),
        )
        return let(
            starts,
            lambda st: F.zip_with(
                st,
                F.slice(F.concat(st, F.array(F.size(s))), F.lit(2), F.size(st)),
                lambda a, b: F.struct(F.get(s, a).alias("term"), (b - a).alias("tf")),
            ),
        )

    return let(F.sort_array(terms), runs)
