"""Packing documents into shards of equal bytes, tokens and rows.

Equal texts form a group. Groups are vectors (bytes, tokens, rows), placed largest first where the dot product with
the residual capacity of the shards is highest. The placement itself sees a bounded number of items, whatever the
size of the corpus:

* groups above ``1 / grain`` of a shard's capacity in some dimension are items of their own: at most
  ``3 * grain * shards`` of them can exist;
* all other groups are dealt by their hash into ``grain * shards`` bundles, each one an item;
* a group larger than a whole shard in some dimension cannot stay together: it is cut into ``pieces`` by a hash of
  doc_id, and its pieces are items. All other equal texts share a shard.

So at most ``(4 * grain + pieces * 3) * shards`` items reach the one task that places them. Every size is summed over all rows.

Null texts count as empty; a null doc_id is a row like any other; columns other than doc_id and text are ignored, whatever
their names; an empty table gives an empty result; a very long text is one row and is never cut. Size is the UTF-8 length plus ``overhead``; tokens are words between white space. The result is a function
of the rows alone: ties are broken by the item's hash, and slots follow (hash of doc_id, doc_id, size, checksum).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.llm.common import scalar_row

OVERHEAD = 8
DIMENSIONS = ("bytes", "tokens", "rows")


def measured(docs: DataFrame, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, tokens, text_crc32 and the 128-bit key (k1, k2) of the text."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(overhead)).cast("bigint").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit("second"), text).alias("k2"),
    )


def _piece(pieces: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("piece"), F.col("doc_id")), F.lit(pieces))


def item_key(grain: int, shards: int) -> Column:
    """Of a group's part with its group's totals and the corpus totals in view: the item it is packed with."""
    over = lambda times: (
        (F.col("g_bytes") * (shards * times) > F.col("t_bytes"))
        | (F.col("g_tokens") * (shards * times) > F.col("t_tokens"))
        | (F.col("g_rows") * (shards * times) > F.col("t_rows"))
    )
    bundle = F.pmod(F.col("k1"), F.lit(grain * shards))
    return (
        F.when(over(1), F.xxhash64("k1", "k2", "piece"))
        .when(over(grain), F.xxhash64("k1", "k2", F.lit(-1)))
        .otherwise(bundle)
    )


def pack(items: pd.DataFrame, shards: int) -> pd.DataFrame:
    """Place items (item, bytes, tokens, rows), largest first, by the dot product with the residual capacity."""
    import numpy as np

    sizes = items[list(DIMENSIONS)].to_numpy(float)
    total = np.maximum(sizes.sum(0), 1.0)
    need = sizes / total * shards  # in shares of one shard
    order = np.lexsort((items["item"].to_numpy(), -need.sum(1), -need.max(1)))
    left = np.ones((shards, len(DIMENSIONS)))
    place = np.zeros(len(items), np.int32)
    for i in order:
        fits = (left >= need[i] - 1e-9).all(1)
        # where nothing fits any more, the fullest dimension decides
        score = left @ need[i] if fits.any() else (left - need[i]).min(1)
        place[i] = np.argmax(np.where(fits, score, -np.inf) if fits.any() else score)
        left[place[i]] -= need[i]
    return pd.DataFrame({"item": items["item"], "shard": place})


def assign_shards(docs: DataFrame, shards: int = 24, grain: int = 256, pieces: int = 192) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs (doc_id, text)."""
    rows = measured(docs)
    parts = rows.withColumn("piece", _piece(pieces)).groupBy("k1", "k2", "piece").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
    )
    # at most `pieces` rows per group, so this window is never large however many copies there are
    group = Window.partitionBy("k1", "k2")
    parts = parts.select("*", *[F.sum(c).over(group).alias(f"g_{c}") for c in DIMENSIONS])
    totals = rows.agg(
        F.sum("size").alias("t_bytes"), F.sum("tokens").alias("t_tokens"), F.count(F.lit(1)).alias("t_rows")
    )
    total = scalar_row(totals)
    parts = parts.select("*", total.alias("_t")).select("*", "_t.*").withColumn("item", item_key(grain, shards))
    items = parts.groupBy("item").agg(*[F.sum(c).alias(c) for c in DIMENSIONS])
    placed = items.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
        lambda p: pack(p, shards), "item bigint, shard int"
    )
    # only groups that are items of their own need a lookup by text; there is a bounded number of them
    own = parts.filter(F.col("item") != F.pmod(F.col("k1"), F.lit(grain * shards))).select("k1", "k2", "piece", "item")
    located = (
        rows.withColumn("piece", _piece(pieces))
        .join(own, ["k1", "k2", "piece"], "left")
        .withColumn("item", F.coalesce("item", F.pmod(F.col("k1"), F.lit(grain * shards))))
        .join(placed, "item", "left")
    )
    return with_slots(located.select("doc_id", "size", "text_crc32", "shard"))


def with_slots(located: DataFrame) -> DataFrame:
    """Add ``slot``: positions 0, 1, 2, ... in each shard, numbered in slices so that no task sees a whole shard."""
    slices = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    cut = located.withColumn("_slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int"))
    counts = cut.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_slice").orderBy("doc_id", "size", "text_crc32")
    return (
        cut.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "_slice"])
        .withColumn("slot", (F.col("_start") + F.col("_row")).cast("bigint"))
        .drop("_slice", "_row", "_start")
    )
