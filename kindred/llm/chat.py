"""Chat formatting of logged conversations, in which a log entry may be a snapshot of a longer conversation.

Logging systems often store a conversation after every turn, so the same turns are there many times. A prefix of a
conversation is known by a rolling hash: the sum over its turns of a 128-bit hash of (place, role, text), with one
running window per conversation. A conversation whose last prefix hash is also a proper prefix of a longer one is a snapshot,
and an anti-join removes it; of equal conversations the smallest conv_id stays. Both sides of the anti-join hold each
(length, hash) once, added up before the shuffle, so a first turn or a conversation that a third of all rows share is
one row there and no hot key.

Kept conversations are rendered with a template per turn. A conversation is one row of the result and is put together
in one place; nothing larger than a conversation is.

Defined cases: turns are ordered by turn, then role, then text, nulls first, and repeated (turn, role, text) rows of a
conversation are repeated turns; null roles and texts render as empty and count as such in the hash; a row without conv_id
is a conversation of its own (with equal rows, if there are any); other columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN = "<|{role}|>\n{text}<|end|>\n"


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "place", "role", "text").cast("decimal(38,0)")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, own (tells rows without conv_id apart), place (1, 2, ...), role, text, and the rolling hash (h1, h2) of the
    turns up to this one."""
    plain = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("own", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(0))
    order = Window.partitionBy("conv_id", "own").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = plain.withColumn("place", F.row_number().over(order))
    return placed.select(
        "conv_id", "own", "place", "role", "text",
        F.sum(_hash(1)).over(upto).alias("h1"), F.sum(_hash(2)).over(upto).alias("h2"),
        F.count(F.lit(1)).over(Window.partitionBy("conv_id", "own")).alias("n_turns"),
    )


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, own, n_turns and copies (equal conversations, itself included) of those that are no prefix of another."""
    rows = prefixes(turns).select("conv_id", "own", "place", "n_turns", "h1", "h2")
    named = F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "own")  # one with a conv_id stands for its copies
    ends = rows.filter("place = n_turns").groupBy("place", "h1", "h2").agg(
        F.min(named).alias("first"), F.count(F.lit(1)).alias("copies")
    )
    inner = rows.filter("place < n_turns").select("place", "h1", "h2").distinct()
    return ends.join(inner, ["place", "h1", "h2"], "left_anti").select(
        "first.conv_id", "first.own", F.col("place").cast("bigint").alias("n_turns"), "copies"
    )


def render(turns: DataFrame, template: str = TURN) -> DataFrame:
    """conv_id, own and the turns in order, each put into the template's {role} and {text}."""
    before, _, rest = template.partition("{role}")
    between, _, after = rest.partition("{text}")
    line = F.concat(F.lit(before), "role", F.lit(between), "text", F.lit(after))
    return prefixes(turns).groupBy("conv_id", "own").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), ""
        ).alias("rendered")
    )


def chat_texts(turns: DataFrame, template: str = TURN) -> DataFrame:
    """conv_id, n_turns, copies and rendered text of every maximal conversation."""
    keep = maximal(turns)
    texts = render(turns, template).withColumnsRenamed({"conv_id": "of_conv", "own": "of_own"})
    same = keep.conv_id.eqNullSafe(texts.of_conv) & (keep.own == texts.of_own)
    return keep.join(texts, same).select("conv_id", "n_turns", "copies", "rendered")
