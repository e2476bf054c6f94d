"""A metric index over the vectors of large groups, for statistics over all pairs that need few of them.

A group is cut into blocks: every vector goes to its nearest pivot (vectors far from each other, out of
some drawn by hash), and a pivot's vectors are cut into chunks in the order of their length. A block knows its centre (a direction), its radius (the largest angle
to the centre) and its shortest and longest vector. By the triangle inequality the angles between two blocks lie in
``centre angle -+ both radii``, which bounds every dot product of a pair of blocks (a *cell*) without looking at its
vectors. Callers evaluate only the cells whose bounds leave the answer open; which ones those are never changes
a result. Vectors of length zero are a block of their own, whose dot products are known.

Bounds are per pair of blocks, so their number is quadratic in the number of blocks, (n / block)^2 / 2 for a
group of n.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kindred.functions.vectors import dot, squared_norm
from kindred.operators.similarity import vector_sums
from kindred.storage import materialise

PIVOTS = 256
#: vectors drawn for each pivot
CANDIDATES = 4
#: vectors of a group that one task assigns to pivots
SHARE = 50_000
#: more than the rounding of an angle from a dot product of unit vectors
SLACK = 1e-7
ZERO = -1
#: vectors of neighbouring blocks that travel and are multiplied together
TILE = 2048


def _spread(candidates: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the candidates, each the one farthest from those before it."""
    chosen = [0]
    near = candidates @ candidates[0]
    for _ in range(min(count, len(candidates)) - 1):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, candidates @ candidates[chosen[-1]])
    return candidates[chosen]


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pivot of each vector; a group's pivots come in a row before its vectors."""
    group, pivots = None, None
    for batch in batches:
        groups, kinds = batch.column("_g").to_numpy(), batch.column("_kind").to_numpy()
        out = np.full(batch.num_rows, ZERO, np.int32)
        edges = np.flatnonzero(np.concatenate(([True], (groups[1:] != groups[:-1]) | (kinds[1:] != kinds[:-1]) | (kinds[1:] == 0), [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if kinds[a] == 0:
                group = groups[a]
                pivots = _spread(np.array(batch.column("_pivots")[a].as_py(), float), int(batch.column("_count")[a].as_py()))
            elif group == groups[a]:
                part = batch.column("_vec").slice(a, b - a)
                vectors = np.asarray(part.flatten(), float).reshape(b - a, -1)
                length = np.sqrt((vectors * vectors).sum(1))
                out[a:b] = np.where(length > 0, (vectors @ pivots.T).argmax(1), ZERO)
        vectors_only = pa.array(kinds == 1)
        names = [n for n in batch.schema.names if n not in ("_g", "_salt", "_kind", "_pivots", "_count")]
        yield pa.RecordBatch.from_arrays(
            [*batch.select(names).columns, pa.array(out)], names=[*names, "_pivot"]
        ).filter(vectors_only)


def place(ready: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """``(keys, _id, _vec, _norm, _block)`` for rows ``(keys, _id, _vec)`` of double vectors, written to the shared folder."""
    keys = list(keys)
    rows = ready.select(*keys, "_id", "_vec").withColumn("_norm", F.sqrt(squared_norm(F.col("_vec"))))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, F.least(F.ceil(F.col("_n") / block), F.lit(PIVOTS)).alias("_count"), F.ceil(F.col("_n") / SHARE).alias("_salts")
    )
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("_id"), "_id")
    drawn = (
        rows.filter(F.col("_norm") > 0).select(*keys, "_id", F.transform("_vec", lambda x: x / F.col("_norm")).alias("_unit"))
        .withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= CANDIDATES * PIVOTS)
        .join(sizes, keys).filter(F.col("_place") <= CANDIDATES * F.col("_count"))
        .groupBy(*keys, "_salts", "_count").agg(F.array_sort(F.collect_list(F.struct("_place", "_unit")))["_unit"].alias("_pivots"))
    )
    tag = F.xxhash64(*keys).alias("_g")  # groups that share it would share pivots, which harms nothing
    none = lambda c: F.lit(None).cast(rows.schema[c].dataType).alias(c)
    heads = drawn.select(
        *keys, none("_id"), none("_vec"), none("_norm"), tag,
        F.explode(F.sequence(F.lit(0), (F.col("_salts") - 1).cast("int"))).alias("_salt"), F.lit(0).alias("_kind"), "_pivots", "_count",
    )
    body = rows.join(sizes.select(*keys, "_salts"), keys).select(
        *keys, "_id", "_vec", "_norm", tag, F.pmod(F.xxhash64("_id"), "_salts").cast("int").alias("_salt"), F.lit(1).alias("_kind"),
        F.lit(None).cast("array<array<double>>").alias("_pivots"), F.lit(None).cast("bigint").alias("_count"),
    )
    n = int(ready.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*rows.schema.fields, T.StructField("_pivot", T.IntegerType())])
    near = heads.unionByName(body).repartition(n, "_g", "_salt").sortWithinPartitions("_g", "_salt", "_kind").mapInArrow(_nearest, schema)
    by_length = Window.partitionBy(*keys, "_pivot").orderBy(F.desc("_norm"), "_id")
    chunk = F.floor((F.row_number().over(by_length) - 1) / block)
    placed = near.select(
        *keys, "_id", "_vec", "_norm", (F.col("_pivot").cast("bigint") * (1 << 32) + chunk).alias("_block")
    )
    return materialise(placed, "placed")  # read several times, and blocks must be the same each time


def block_table(placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, _block, n, shortest, longest, centre, radius)``; zero vectors have radius null."""
    keys = [*keys, "_block"]
    unit = F.when(F.col("_norm") > 0, F.transform("_vec", lambda x: x / F.col("_norm"))).otherwise(F.col("_vec"))
    rows = placed.withColumn("_unit", unit)
    sums = vector_sums(
        rows, keys, "_unit", None, n=F.count(F.lit(1)), shortest=F.min("_norm"), longest=F.max("_norm")
    )
    length = F.sqrt(squared_norm(F.col("_sum")))
    centres = sums.select(
        *keys, "n", "shortest", "longest",
        F.when(length > 0, F.transform("_sum", lambda x: x / length)).otherwise(F.col("_sum")).alias("centre"),
    )
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min(dot(F.col("_unit"), F.col("centre"))))))
    radii = rows.join(centres.select(*keys, "centre"), keys).groupBy(*keys).agg(
        F.when(F.max("_norm") > 0, F.least(angle + SLACK, F.lit(math.pi))).alias("radius")
    )
    return centres.join(radii, keys)


def bounded_cells(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, lo, hi, pairs, dot_low, dot_high)`` for every pair of blocks of a group that has vector pairs."""
    keys = list(keys)
    columns = ("_block", "n", "shortest", "longest", "centre", "radius")
    left = blocks.select(*keys, *[F.col(c).alias(f"l_{c}") for c in columns])
    right = blocks.select(*keys, *[F.col(c).alias(f"r_{c}") for c in columns])
    met = left.join(right, keys).filter(F.col("l__block") <= F.col("r__block"))
    same = F.col("l__block") == F.col("r__block")
    n, m = F.col("l_n"), F.col("r_n")
    between = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("l_centre"), F.col("r_centre")))))
    reach = F.col("l_radius") + F.col("r_radius")
    apart = F.when(same, F.lit(0.0)).otherwise(between)
    low = F.cos(F.least(F.lit(math.pi), apart + reach + SLACK)) - SLACK
    high = F.cos(F.greatest(F.lit(0.0), apart - reach - SLACK)) + SLACK
    short, long = F.col("l_shortest") * F.col("r_shortest"), F.col("l_longest") * F.col("r_longest")

    def scaled(cosine: Column, up: bool) -> Column:
        """The extreme of length * length * cosine."""
        return cosine * F.when((cosine > 0) == F.lit(up), long).otherwise(short)

    zero = F.col("l_radius").isNull() | F.col("r_radius").isNull()
    cells = met.select(
        *keys, F.col("l__block").alias("lo"), F.col("r__block").alias("hi"),
        F.when(same, (n * (n - 1) / 2).cast("bigint")).otherwise(n * m).alias("pairs"),
        F.when(zero, F.lit(0.0)).otherwise(scaled(low, False)).alias("dot_low"),
        F.when(zero, F.lit(0.0)).otherwise(scaled(high, True)).alias("dot_high"),
    ).filter(F.col("pairs") > 0)
    return materialise(cells, "cells")


def tiles(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, _block, _tile)``: neighbouring blocks of about ``TILE`` vectors.

    Bounds are per cell, but vectors sent for each cell by itself are n / block copies of every vector. A pair of tiles is
    sent if one of its cells is wanted, which is n / TILE copies at most.
    """
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    return blocks.select(*keys, "_block", F.floor(start / TILE).cast("bigint").alias("_tile"))


def tiled(cells: DataFrame, of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells with ``lo`` and ``hi`` of their tiles in place of their blocks."""
    for end in ("lo", "hi"):
        cells = cells.join(of.withColumnsRenamed({"_block": end, "_tile": f"_{end}"}), [*keys, end])
    return cells.withColumns({"lo": F.col("_lo"), "hi": F.col("_hi")}).drop("_lo", "_hi")


def tile_vectors(placed: DataFrame, wanted: DataFrame, of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`cell_vectors` of pairs of tiles, written to the shared folder: each pass over them has the same products."""
    rows = placed.join(of, [*keys, "_block"]).drop("_block").withColumnRenamed("_tile", "_block")
    return materialise(cell_vectors(rows, wanted, keys), "tiles")


def cell_vectors(placed: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, lo, hi, left, right)`` of the wanted cells, as :func:`kindred.operators.blocks.pair_cells` has them."""
    keys = list(keys)
    ends = F.array_distinct(F.array("lo", "hi"))
    sides = wanted.select(*keys, "lo", "hi", F.explode(ends).alias("_block"))
    return sides.join(placed, [*keys, "_block"]).groupBy(*keys, "lo", "hi").agg(
        F.collect_list(F.when(F.col("_block") == F.col("lo"), F.col("_vec"))).alias("left"),
        F.collect_list(F.when((F.col("_block") == F.col("hi")) & (F.col("lo") != F.col("hi")), F.col("_vec"))).alias("right"),
    )


BINS = 4096


def _distances(cells: DataFrame) -> DataFrame:
    """The cells with bounds of ``1 - dot``, dots clipped to [-1, 1]."""
    clip = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c)))
    return cells.withColumns({"near": 1.0 - clip("dot_high"), "far": 1.0 - clip("dot_low")})


def extreme_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells that can hold a group's smallest or largest distance."""
    keys = list(keys)
    bounded = _distances(cells)
    limits = bounded.groupBy(*keys).agg(F.min("far").alias("_least_far"), F.max("near").alias("_most_near"))
    return bounded.join(limits, keys).filter(
        (F.col("near") <= F.col("_least_far")) | (F.col("far") >= F.col("_most_near"))
    ).select(*keys, "lo", "hi")


def median_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, lo, hi, _pairs, _below)``: the cells that can hold one of the middle ranks, the group's pairs, and how many
    of them are in cells that lie wholly below.

    At least as many distances are below a value as cells' upper bounds say, and at most as many as their lower bounds
    say. The counts go through a histogram of the bounds, rounded outwards to its edges.
    """
    keys = list(keys)
    joined = _bracketed(cells, keys)
    below = joined.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("far") < F.col("_from"), F.col("pairs"))), F.lit(0)).alias("_below")
    )
    return joined.filter((F.col("far") >= F.col("_from")) & (F.col("near") <= F.col("_to"))).join(below, keys).select(
        *keys, "lo", "hi", "_pairs", "_below"
    )


def median_tiles(cells: DataFrame, of: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`median_cells` for pairs of tiles; ``_below`` counts the pairs of the tiles that are left out."""
    keys = list(keys)
    joined = tiled(_bracketed(cells, keys), of, keys)
    wanted = (F.col("far") >= F.col("_from")) & (F.col("near") <= F.col("_to"))
    pairs = joined.groupBy(*keys, "_pairs", "lo", "hi").agg(
        F.max(wanted).alias("_wanted"), F.coalesce(F.sum(F.when(F.col("far") < F.col("_from"), F.col("pairs"))), F.lit(0)).alias("_b")
    )
    below = pairs.groupBy(*keys).agg(F.coalesce(F.sum(F.when(~F.col("_wanted"), F.col("_b"))), F.lit(0)).alias("_below"))
    return pairs.filter("_wanted").join(below, keys).select(*keys, "lo", "hi", "_pairs", "_below")


def _bracketed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells with bounds of their distances, the group's pairs, and bounds of its two middle distances."""
    bounded = _distances(cells)
    edge = BINS / 2.0
    at = F.array(
        F.struct(F.floor(F.col("near") * edge).cast("int").alias("_bin"), F.col("pairs").alias("_started"), F.lit(0).cast("bigint").alias("_ended")),
        F.struct(F.ceil(F.col("far") * edge).cast("int").alias("_bin"), F.lit(0).cast("bigint").alias("_started"), F.col("pairs").alias("_ended")),
    )
    histogram = bounded.select(*keys, F.inline(at)).groupBy(*keys, "_bin").agg(
        F.sum("_started").alias("_started"), F.sum("_ended").alias("_ended")
    )
    order, whole = Window.partitionBy(*keys).orderBy("_bin"), Window.partitionBy(*keys)
    running = histogram.select(
        *keys, "_bin", F.sum("_started").over(order).alias("_s"), F.sum("_ended").over(order).alias("_e"),
        F.sum("_started").over(whole).alias("_pairs"),
    )
    first, second = F.floor((F.col("_pairs") - 1) / 2), F.floor(F.col("_pairs") / 2)
    brackets = running.groupBy(*keys, "_pairs").agg(
        (F.min(F.when(F.col("_s") > first, F.col("_bin"))) / edge).alias("_from"),
        (F.min(F.when(F.col("_e") > second, F.col("_bin"))) / edge).alias("_to"),
    )
    return bounded.join(brackets, keys)


def clipped_cells(cells: DataFrame, keys: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """The cells with a dot product that may lie outside [-1, 1] by more than the tolerance."""
    return cells.filter((F.col("dot_high") > 1.0 + tolerance) | (F.col("dot_low") < -1.0 - tolerance)).select(*keys, "lo", "hi")
