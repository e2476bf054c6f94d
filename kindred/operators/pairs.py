"""Text pairs of the same group, at most ``cap`` per group, drawn without replacement.

A group of n captions has n(n-1)/2 pairs; they are never listed beyond ``cap``. Pair ranks are drawn and
unranked to two positions, and the few positions that were hit are given to the captions with the smallest
seeded hashes. Hash order is a random permutation of the group, so every pair is equally likely. The ranks of a group are drawn by
one task, which holds ``cap`` numbers; pairs are rows that meet their captions in joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from kindred import schema as S


#: drawn pairs that leave a task at once
BATCH = 100_000


def _ranks(total: int, cap: int, head: str) -> np.ndarray:
    """``min(total, cap)`` distinct ranks below ``total`` (Floyd's sampling: one step per drawn rank)."""
    if total <= cap:
        return np.arange(total, dtype=np.int64)
    chosen: set[int] = set()
    for j in range(total - cap, total):
        pick = int(hashlib.md5(f"{head}:{j}".encode()).hexdigest()[:15], 16) % (j + 1)
        chosen.add(j if pick in chosen else pick)
    return np.fromiter(chosen, np.int64, len(chosen))


def _unrank(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank ``j(j-1)/2 + i`` back to ``(i, j)`` with i < j."""
    j = np.floor((1.0 + np.sqrt(1.0 + 8.0 * k)) / 2.0).astype(np.int64)
    # The double square root can be off by one for large ranks.
    j -= j * (j - 1) // 2 > k
    j += j * (j + 1) // 2 <= k
    return k - j * (j - 1) // 2, j


def _drawn(group: list[str], cap: int, seed: int):
    """Arrow batches ``(group, _n, _name)`` to the drawn pairs of each group, as places among the captions that were hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (n, name) in enumerate(zip(batch.column("_n").to_pylist(), batch.column("_name").to_pylist())):
                i, j = _unrank(_ranks(n * (n - 1) // 2, cap, f"{seed}:{name}"))
                places = np.unique(np.concatenate((i, j)), return_inverse=True)[1] + 1
                for start in range(0, len(i), BATCH):
                    x, y = places[: len(i)][start : start + BATCH], places[len(i) :][start : start + BATCH]
                    key = pa.array(np.full(len(x), at))
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(key) for c in group], pa.array(x), pa.array(y)], names=[*group, "_x", "_y"]
                    )

    return run


def same_group_pairs(
    df: DataFrame,
    cap: int = 100,
    seed: int = 42,
    group_col: str = S.GROUP,
    id_col: str = S.CAPTION,
    text_col: str = S.TEXT,
    salts: int = 16,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by, group, caption_a, caption_b, text_a, text_b, label = 1.0)`` with caption_a < caption_b.

    With ``by`` a group is one of its corpus, and equal ids of other corpora are other groups. Pair ranks must fit a
    BIGINT: a larger group fails with an overflow error.
    Null texts are ignored and groups below two texts give nothing. Each map task keeps only the
    ``2 * cap`` smallest hashes per group; ``salts`` spreads what remains of a hot group over that many tasks
    before the final cut. (Spark pushes the cut below the shuffle up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` rows, 1000 by default.)
    """
    group = [*by, group_col]
    texts = df.filter(F.col(group_col).isNotNull() & F.col(text_col).isNotNull()).select(
        *group, F.col(id_col).alias("_id"), F.col(text_col).alias("_text")
    )
    sizes = texts.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2)

    keyed = texts.withColumns(
        {
            "_key": F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in group], F.col("_id").cast("string"))),
            "_salt": F.pmod(F.spark_partition_id(), F.lit(salts)),
        }
    )
    for keys in ([*group, "_salt"], group):
        w = Window.partitionBy(*keys).orderBy("_key", "_id", "_text")
        keyed = keyed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2 * cap)

    named = F.concat_ws(":", *[F.col(c).cast("string") for c in group])
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = sizes.select(*group, "_n", named.alias("_name")).repartition(tasks, *group)
    schema = T.StructType([*[sizes.schema[c] for c in group], T.StructField("_x", T.LongType()), T.StructField("_y", T.LongType())])
    joined = drawn.mapInArrow(_drawn(group, cap, seed), schema)
    for place, name in (("_x", "x"), ("_y", "y")):  # the captions are few beside the pairs
        captions = keyed.select(*group, F.col("_r").cast("bigint").alias(place), F.struct("_id", "_text").alias(name))
        joined = joined.join(captions.hint("shuffle_hash"), [*group, place])
    ordered = F.col("x._id") <= F.col("y._id")
    first = F.when(ordered, F.col("x")).otherwise(F.col("y"))
    second = F.when(ordered, F.col("y")).otherwise(F.col("x"))
    return joined.select(*group, first.alias("a"), second.alias("b")).select(
        *group,
        F.col("a._id").alias("caption_a"),
        F.col("b._id").alias("caption_b"),
        F.col("a._text").alias("text_a"),
        F.col("b._text").alias("text_b"),
        F.lit(1.0).alias("label"),
    )
