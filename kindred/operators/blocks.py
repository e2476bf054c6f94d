"""Statistics over all vector pairs of a group, for measures that do not reduce to sums.

Pairs are never rows. A group is cut into blocks of about ``block`` vectors; each *cell* is a pair of blocks
and is evaluated as one matrix product in an Arrow batch, returning a handful of numbers. A group that fits
one block is a single cell, so the usual small group costs one row in one shuffle. The arithmetic for a group
of n vectors stays quadratic, spread over (n / block)^2 / 2 independent cells; use
:func:`kindred.operators.similarity.dense_similarity` where the linear form is valid.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from kindred import schema as S
from kindred.functions.vectors import l2_normalise, squared_norm
from kindred.operators import metric
from kindred.operators.frames import top_k
from kindred.operators.quantiles import exact_quantiles
from kindred.operators.similarity import vector_sums
from kindred.storage import materialise

BLOCK = 128
# Histogram refinement for medians of groups beyond one block: 3 levels of 1024 bins over [0, 2].
BINS = 1024
LEVELS = 3


def pair_cells(
    df: DataFrame, keys: Sequence[str], id_col: str, vec_col: str, block: int = BLOCK
) -> DataFrame:
    """``(keys, lo, hi, left, right)``: the vectors of two blocks, or of one block twice (``right`` empty).

    Only groups beyond one block are looked up by size; adaptive execution broadcasts that list when it is
    small and splits the hot partitions of the join when it is not.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(id_col).alias("_id"), F.transform(vec_col, lambda x: x.cast("double")).alias("_vec"))
    large = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > block)
        .select(*keys, F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_blocks"))
    )
    blocks = F.coalesce("_blocks", F.lit(1))
    placed = rows.join(large, keys, "left").select(
        *keys,
        "_vec",
        F.pmod(F.xxhash64("_id"), blocks).cast("int").alias("_own"),
        F.explode(F.sequence(F.lit(0), blocks - F.lit(1))).alias("_other"),
    )
    lo, hi, own = F.col("lo"), F.col("hi"), F.col("_own")
    return (
        placed.withColumns({"lo": F.least("_own", "_other"), "hi": F.greatest("_own", "_other")})
        .groupBy(*keys, "lo", "hi")
        .agg(
            F.collect_list(F.when(own == lo, F.col("_vec"))).alias("left"),
            F.collect_list(F.when((own == hi) & (lo != hi), F.col("_vec"))).alias("right"),
        )
    )


def _cell_mapper(kept: list[str], outputs: pa.Schema, measure):
    """Wrap ``measure(dots, rows) -> {column: list}`` as an Arrow batch function over cells.

    Cells of equal shape are multiplied together. ``dots`` is ``[cells, pairs]`` and clipped to [-1, 1];
    ``rows`` are the positions of those cells in the batch. A closure over plain values: executors need not
    have this package.
    """
    budget = 1 << 22

    def matrix(column):
        lengths = np.asarray(column.value_lengths())
        inner = column.flatten()
        widths = np.unique(np.asarray(inner.value_lengths()))
        if len(widths) > 1:
            raise ValueError(f"vectors of different lengths: {widths.tolist()}")
        width = int(widths[0]) if len(widths) else 0
        flat = np.asarray(inner.flatten()).reshape(-1, width) if width else np.zeros((0, 0))
        return lengths, np.concatenate([[0], np.cumsum(lengths)])[:-1], flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_left, at_left, left = matrix(batch.column("left"))
            n_right, at_right, right = matrix(batch.column("right"))
            lo, hi = np.asarray(batch.column("lo")), np.asarray(batch.column("hi"))
            rows_out: dict[int, dict] = {}
            shapes = np.stack([n_left, n_right, lo == hi], axis=1)
            for nl, nr, diagonal in np.unique(shapes, axis=0):
                members = np.flatnonzero((shapes == [nl, nr, diagonal]).all(axis=1))
                pairs = nl * (nl - 1) // 2 if diagonal else nl * nr
                if pairs == 0:
                    continue
                step = max(1, budget // int(max(nl * nl, nl * nr)))
                for i in range(0, len(members), step):
                    part = members[i : i + step]
                    a = left[at_left[part][:, None] + np.arange(nl)]
                    if diagonal:
                        up = np.triu_indices(nl, 1)
                        dots = (a @ a.transpose(0, 2, 1))[:, up[0], up[1]]
                    else:
                        b = right[at_right[part][:, None] + np.arange(nr)]
                        dots = (a @ b.transpose(0, 2, 1)).reshape(len(part), -1)
                    rows_out.update(measure(dots, part, batch))
            order = sorted(rows_out)
            taken = batch.select(kept).take(pa.array(order, pa.int64()))
            extra = [pa.array([rows_out[r][f.name] for r in order], f.type) for f in outputs]
            yield pa.RecordBatch.from_arrays([*taken.columns, *extra], [*kept, *outputs.names])

    return run


def _map_cells(cells: DataFrame, kept: list[str], outputs: dict[str, tuple[pa.DataType, T.DataType]], measure) -> DataFrame:
    arrow = pa.schema([(name, a) for name, (a, _) in outputs.items()])
    schema = T.StructType(
        [cells.schema[k] for k in kept] + [T.StructField(name, t) for name, (_, t) in outputs.items()]
    )
    return cells.mapInArrow(_cell_mapper(kept, arrow, measure), schema)


def _summaries(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per cell: pair count, sums of raw and clipped dots, extremes and the median of the clipped dots."""
    number = (pa.float64(), T.DoubleType())
    outputs = {"pairs": (pa.int64(), T.LongType())}
    outputs |= dict.fromkeys(["raw", "clipped", "low", "high", "middle"], number)

    def measure(dots, rows, batch):
        cut = np.clip(dots, -1.0, 1.0)
        stats = zip(
            rows.tolist(), dots.sum(1), cut.sum(1), cut.min(1), cut.max(1), np.median(cut, axis=1), strict=True
        )
        return {
            r: {"pairs": dots.shape[1], "raw": a, "clipped": b, "low": c, "high": d, "middle": e}
            for r, a, b, c, d, e in stats
        }

    return _map_cells(cells, [*keys, "lo", "hi"], outputs, measure)


def pairwise_similarity(
    vectors: DataFrame,
    by: Sequence[str] = (),
    group_col: str = S.GROUP,
    id_col: str = S.CAPTION,
    vec_col: str = "vec",
    normalise: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Mean over all pairs of the dot product clipped to [-1, 1], evaluated pair by pair in cells."""
    keys = [*by, group_col]
    ready = _ready(vectors, keys, id_col, vec_col, normalise)
    stats = _summaries(pair_cells(ready, keys, "_id", "_vec", block), keys)
    means = stats.groupBy(*keys).agg(F.try_divide(F.sum("clipped"), F.sum("pairs")).alias(S.SIM))
    return _with_sizes(ready, means, keys)


def _ready(vectors: DataFrame, keys: list[str], id_col: str, vec_col: str, normalise: bool) -> DataFrame:
    vec = l2_normalise(F.col(vec_col)) if normalise else F.col(vec_col)
    return vectors.filter(F.col(keys[-1]).isNotNull()).select(
        *keys, F.col(id_col).alias("_id"), vec.alias("_vec")
    )


def _with_sizes(ready: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    sizes = ready.groupBy(*keys).agg(F.count(F.lit(1)).alias(S.SIZE))
    return sizes.join(values, keys, "left").select(*keys, S.SIM, S.SIZE)


def raw_similarity(
    vectors: DataFrame,
    dim: int | None = None,
    by: Sequence[str] = (),
    group_col: str = S.GROUP,
    id_col: str = S.CAPTION,
    vec_col: str = "vec",
    block: int = BLOCK,
    tolerance: float = 0.0,
) -> DataFrame:
    """Mean clipped dot product of vectors of any length.

    Clipping can only matter for pairs whose norms multiply to more than 1, so the linear form covers all
    pairs and only vectors with ``norm * (largest norm of the group) > 1`` go through cells, for the
    difference. Of groups with more than one block of these, the cells whose lengths and angles keep every dot product
    within [-1, 1] are skipped (see :mod:`kindred.operators.metric`). Vectors meant to be of length 1 belong to :func:`dense_similarity`; a ``tolerance`` keeps those whose
    norms multiply to a little more than 1 on the linear path here too, unclipped.
    """
    keys = [*by, group_col]
    ready = _ready(vectors, keys, id_col, vec_col, False).withColumn("_norm", F.sqrt(squared_norm(F.col("_vec"))))
    linear = _unclipped_sums(ready, keys, dim)
    longest = ready.groupBy(*keys).agg(F.max("_norm").alias("_max")).filter(F.col("_max") > 1.0)
    long = ready.join(longest, keys).filter(F.col("_norm") * F.col("_max") > 1.0 + tolerance)
    small, large = split_by_size(long, keys, block)
    stats = _summaries(pair_cells(small, keys, "_id", "_vec", block), keys).select(*keys, "clipped", "raw")
    if large is not None:
        placed = metric.place(_doubles(large, keys), keys, block)
        table = materialise(metric.block_table(placed, keys), "blocks")
        of = metric.tiles(table, keys)
        wanted = metric.tiled(metric.clipped_cells(metric.bounded_cells(table, keys), keys, tolerance), of, keys).distinct()
        stats = stats.unionByName(_summaries(metric.tile_vectors(placed, wanted, of, keys), keys).select(*keys, "clipped", "raw"))
    cut = stats.groupBy(*keys).agg(F.sum(F.col("clipped") - F.col("raw")).alias("_cut"))
    pairs = F.col("num").cast("double") * (F.col("num") - F.lit(1)) / F.lit(2.0)
    mean = (F.col("_total") + F.coalesce("_cut", F.lit(0.0))) / pairs
    return linear.join(cut, keys, "left").select(
        *keys, F.when(F.col("num") >= 2, mean).alias(S.SIM), F.col("num").alias(S.SIZE)
    )


def _unclipped_sums(ready: DataFrame, keys: list[str], dim: int | None) -> DataFrame:
    sums = vector_sums(
        ready, keys, "_vec", dim, _norms=F.sum(F.col("_norm") * F.col("_norm")), num=F.count(F.lit(1))
    )
    total = (squared_norm(F.col("_sum")) - F.col("_norms")) / F.lit(2.0)
    return sums.select(*keys, "num", total.alias("_total"))


def split_by_size(ready: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups that fit one block, and those of the others (None if there are no such groups)."""
    large = ready.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block).select(*keys)
    if not large.limit(1).count():
        return ready, None
    return ready.join(large, keys, "left_anti"), ready.join(large, keys, "left_semi")


def _doubles(ready: DataFrame, keys: list[str]) -> DataFrame:
    return ready.select(*keys, "_id", F.transform("_vec", lambda x: x.cast("double")).alias("_vec"))


def caption_distances(
    vectors: DataFrame,
    by: Sequence[str] = (),
    group_col: str = S.GROUP,
    id_col: str = S.CAPTION,
    vec_col: str = "vec",
    normalise: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Per group of two or more: mean, median, largest and smallest ``1 - cosine`` over all pairs.

    In groups of one block a cell has all distances. Larger groups go through a metric index
    (:mod:`kindred.operators.metric`): the mean is linear; the extremes and the median look only into the cells whose bounds can
    hold them. The median is exact for groups of any size: histograms of those cells narrow the two middle ranks
    down to bins of 2 / 1024^3, and then the distances of those bins are ranked.
    """
    keys = [*by, group_col]
    ready = _ready(vectors, keys, id_col, vec_col, normalise)
    small, large = split_by_size(ready, keys, block)
    one = F.lit(1.0)
    stats = _summaries(pair_cells(small, keys, "_id", "_vec", block), keys)
    merged = stats.groupBy(*keys).agg(
        (one - F.sum("clipped") / F.sum("pairs")).alias("dist_mean"), (one - F.max("middle")).alias("dist_median"),
        (one - F.min("low")).alias("dist_max"), (one - F.max("high")).alias("dist_min"),
    )
    if large is not None:
        merged = merged.unionByName(_large_distances(large, keys, block))
    sizes = ready.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_captions"))
    return sizes.join(merged, keys).select(*keys, "n_captions", "dist_mean", "dist_median", "dist_max", "dist_min")


def _large_distances(ready: DataFrame, keys: list[str], block: int) -> DataFrame:
    one = F.lit(1.0)
    placed = metric.place(_doubles(ready, keys), keys, block)
    table = materialise(metric.block_table(placed, keys), "blocks")
    of, cells = metric.tiles(table, keys), metric.bounded_cells(table, keys)
    extreme = metric.tiled(metric.extreme_cells(cells, keys), of, keys).distinct()
    ends = _summaries(metric.tile_vectors(placed, extreme, of, keys), keys).groupBy(*keys).agg(
        (one - F.min("low")).alias("dist_max"), (one - F.max("high")).alias("dist_min")
    )
    middle = metric.median_tiles(cells, of, keys)
    targets = middle.select(*keys, "_pairs", "_below").distinct()
    medians = _refined_medians(metric.tile_vectors(placed, middle.select(*keys, "lo", "hi"), of, keys), targets, keys)
    mean = raw_similarity(
        ready, None, keys[:-1], keys[-1], "_id", "_vec", block, tolerance=1e-9
    ).select(*keys, (one - F.col(S.SIM)).alias("dist_mean"))
    return ends.join(medians, keys).join(mean, keys).select(
        *keys, "dist_mean", F.col("_refined").alias("dist_median"), "dist_max", "dist_min"
    )


def _refined_medians(cells: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """Medians of the groups in ``large`` by repeated histograms of the cells that can hold them; ``(keys, _refined)``.

    Of a group's ``_pairs`` pairs, ``_below`` are in cells below these. The two middle ranks are followed separately: each
    level finds the bin a rank falls into and the next level counts only inside that bin.
    """
    ranks = F.array(
        F.floor((F.col("_pairs") - F.lit(1)) / F.lit(2)) - F.col("_below"), F.floor(F.col("_pairs") / F.lit(2)) - F.col("_below")
    )
    targets = large.select(
        *keys, F.posexplode(ranks).alias("_which", "_rank"), F.lit(0).cast("bigint").alias("_prefix")
    )
    for level in range(LEVELS):
        wanted = targets.groupBy(*keys).agg(F.sort_array(F.collect_set("_prefix")).alias("_prefixes"))
        counts = _histograms(cells.join(wanted, keys), keys, level)
        w = Window.partitionBy(*keys, "_prefix").orderBy("_bin")
        bins = (
            counts.groupBy(*keys, "_prefix", "_bin")
            .agg(F.sum("_c").alias("_c"))
            .withColumn("_end", F.sum("_c").over(w))
        )
        start = F.col("_end") - F.col("_c")
        targets = (
            targets.join(bins, [*keys, "_prefix"])
            .filter((F.col("_rank") >= start) & (F.col("_rank") < F.col("_end")))
            .select(
                *keys,
                "_which",
                (F.col("_rank") - start).alias("_rank"),
                (F.col("_prefix") * F.lit(BINS) + F.col("_bin")).alias("_prefix"),
            )
        )
    wanted = targets.groupBy(*keys).agg(F.sort_array(F.collect_set("_prefix")).alias("_prefixes"))
    found = _distances(cells.join(wanted, keys), keys).groupBy(*keys, "_prefix", "_d").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy(*keys, "_prefix").orderBy("_d")
    found = found.withColumn("_end", F.sum("_c").over(w))
    exact = targets.join(found, [*keys, "_prefix"]).filter(
        (F.col("_rank") >= F.col("_end") - F.col("_c")) & (F.col("_rank") < F.col("_end"))
    )
    return exact.groupBy(*keys).agg(F.avg("_d").alias("_refined"))


def _distances(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The distances of the wanted last-level bins, each value of a cell once with its count."""
    scale, top = BINS**LEVELS / 2.0, BINS**LEVELS - 1
    fields = [("prefix", pa.int64(), T.LongType()), ("d", pa.float64(), T.DoubleType()), ("c", pa.int64(), T.LongType())]
    outputs = {
        "_found": (
            pa.list_(pa.struct([(n, a) for n, a, _ in fields])),
            T.ArrayType(T.StructType([T.StructField(n, t) for n, _, t in fields])),
        )
    }

    def measure(dots, rows, batch):
        distances = 1.0 - np.clip(dots, -1.0, 1.0)
        codes = np.minimum((distances * scale).astype(np.int64), top)
        out = {}
        for row, code, distance in zip(rows.tolist(), codes, distances, strict=True):
            inside = np.isin(code, np.asarray(batch.column("_prefixes")[row].values))
            values, c = np.unique(distance[inside], return_counts=True)
            bins = np.minimum((values * scale).astype(np.int64), top)
            out[row] = {
                "_found": [{"prefix": int(p), "d": float(v), "c": int(k)} for p, v, k in zip(bins, values, c, strict=True)]
            }
        return out

    mapped = _map_cells(cells, list(keys), outputs, measure)
    return mapped.select(*keys, F.inline("_found").alias("_prefix", "_d", "_c"))


def _histograms(cells: DataFrame, keys: list[str], level: int) -> DataFrame:
    bins, scale = BINS, BINS ** (level + 1) / 2.0
    top = BINS ** (level + 1) - 1
    outputs = {
        "_counts": (
            pa.list_(pa.struct([("prefix", pa.int64()), ("bin", pa.int64()), ("c", pa.int64())])),
            T.ArrayType(
                T.StructType([T.StructField(n, T.LongType()) for n in ("prefix", "bin", "c")])
            ),
        )
    }

    def measure(dots, rows, batch):
        distances = 1.0 - np.clip(dots, -1.0, 1.0)
        codes = np.minimum((distances * scale).astype(np.int64), top)
        out = {}
        for row, code in zip(rows.tolist(), codes, strict=True):
            wanted = np.asarray(batch.column("_prefixes")[row].values)
            code = code[np.isin(code // bins, wanted)]
            found, c = np.unique(code, return_counts=True)
            out[row] = {
                "_counts": [
                    {"prefix": int(x) // bins, "bin": int(x) % bins, "c": int(k)} for x, k in zip(found, c, strict=True)
                ]
            }
        return out

    mapped = _map_cells(cells, list(keys), outputs, measure)
    return mapped.select(*keys, F.inline("_counts").alias("_prefix", "_bin", "_c"))


def distance_summary(distances: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Smallest, median, mean and largest of the per-group mean and median distances.

    Both measures go through one long table, so the distances are read once per pass and not per measure.
    """
    measures = ("dist_mean", "dist_median")
    cells = F.array(*[F.struct(F.lit(m).alias("_measure"), F.col(m).alias("_value")) for m in measures])
    long = distances.select(*by, F.inline(cells))
    plain = {"min": F.min, "mean": F.avg, "max": F.max}
    stats = exact_quantiles(long, "_value", [0.5], [*by, "_measure"], extra=plain)
    stats = stats.withColumn("median", F.get("quantiles", F.lit(0)))
    return stats.groupBy(*by).agg(*[
        F.max(F.when(F.col("_measure") == m, F.col(c))).alias(f"{m}_{c}")
        for m in measures
        for c in ("min", "median", "mean", "max")
    ])


def most_diverse(distances: DataFrame, k: int = 10, group_col: str = S.GROUP, by: Sequence[str] = ()) -> DataFrame:
    return top_k(distances, k, "dist_mean", [group_col], by)


def least_diverse(distances: DataFrame, k: int = 10, group_col: str = S.GROUP, by: Sequence[str] = ()) -> DataFrame:
    return top_k(distances, k, F.col("dist_mean").asc(), [group_col], by)
