"""Helpers for composing small result frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def unnest(df: DataFrame, keep: Sequence[str], array: Column, name: str | None = None) -> DataFrame:
    """One row per element of ``array``, as column ``name`` or, for structs, as their fields.

    A plain explode makes the optimizer infer a filter on the array's size below it, which computes an
    expensive array twice. The outer variant does not; its row for an empty array is filtered out. Elements
    (or the first field of structs) must not be null. The array is a column of its own so that the explode
    stays inside generated code when the array's expression cannot.
    """
    ready = df.select(*keep, array.alias("_items"))
    if name is None:
        out = ready.select(*keep, F.inline_outer("_items"))
        first = out.columns[len(keep)]
    else:
        out = ready.select(*keep, F.explode_outer("_items").alias(name))
        first = name
    return out.filter(F.col(f"`{first}`").isNotNull())


def item_counts(
    df: DataFrame, by: Sequence[str], items: Column, keys: dict[str, Column] | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """``(by, keys, cnt)`` of the structs in the array ``items``; ``keys`` are expressions over their fields (default: the fields).

    With ``order`` each key also has ``first_seen``: the least (order columns, place in the array) it occurs at. It is a
    minimum beside the count, so it combines map-side with it.
    """
    if not order:
        rows = unnest(df, by, items)
        names = {c: F.col(f"`{c}`") for c in rows.columns[len(by):]} if keys is None else keys
        return rows.groupBy(*by, *[c.alias(n) for n, c in names.items()]).agg(F.count(F.lit(1)).alias("cnt"))
    seen = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    placed = F.transform(items, lambda x, i: F.struct(x.alias("_item"), i.alias("_place")))
    flat = unnest(df.select(*by, *seen, placed.alias("_placed")), [*by, *[f"_o{i}" for i in range(len(order))]], F.col("_placed"))
    rows = flat.select(*by, "_item.*", F.struct(*[f"_o{i}" for i in range(len(order))], "_place").alias("_seen"))
    names = {c: F.col(f"`{c}`") for c in rows.columns[len(by):-1]} if keys is None else keys
    return rows.groupBy(*by, *[c.alias(n) for n, c in names.items()]).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("_seen").alias("first_seen")
    )


def top_counts(
    counts: DataFrame, k: int, keys: Sequence[str], by: Sequence[str] = (), tie: str = "key"
) -> DataFrame:
    """The k most frequent rows. Equal counts: the smaller key first, or with ``tie="first_seen"`` the one seen earlier."""
    if tie not in ("key", "first_seen"):
        raise ValueError(f"tie must be 'key' or 'first_seen', not {tie!r}")
    if tie == "key":
        return top_k(counts, k, "cnt", keys, by)
    return top_k(counts, k, "cnt", ["first_seen", *keys], by).drop("first_seen")


def attach(left: DataFrame, right: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the columns of ``right`` to ``left``: one row per ``by`` key, or a single row without keys.

    The single row comes in as a scalar subquery, so nothing is joined without a key.
    """
    if by:
        named = right.withColumnsRenamed({c: f"_right_{c}" for c in by})
        same = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in by]  # rows without a corpus are one of their own
        return left.join(named, reduce(lambda a, b: a & b, same), "left").drop(*[f"_right_{c}" for c in by])
    one = right.select(F.struct("*").alias("row")).scalar()
    return left.select("*", one.alias("_row")).select(
        *[F.col(f"`{c}`") for c in left.columns],
        *[F.col("_row").getField(c).alias(c) for c in right.columns],
    )


def attach_all(frames: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    return reduce(lambda a, b: attach(a, b, by), frames)


def top_k(
    counts: DataFrame, k: int, first: str | Column, keys: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """The k first rows by ``first`` (a column name sorts descending), ties by key ascending.

    Without ``by`` this is a bounded heap per partition. With ``by`` the row_number filter is pushed below
    the exchange as a group limit, so each map task sends at most k rows per key.
    """
    lead = F.col(first).desc() if isinstance(first, str) else first
    order = [lead, *[F.col(c).asc() for c in keys]]
    if not by:
        return counts.orderBy(*order).limit(k)
    w = Window.partitionBy(*by).orderBy(*order)
    return counts.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")
