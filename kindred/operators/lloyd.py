"""k-means by Lloyd's rounds as Spark aggregations, one model per corpus, with a result that SQL can repeat.

The start is drawn by hash: the k captions of least MD5 of their id. In each round every vector goes to its nearest centre (equal
distances: the smaller cluster) and a centre becomes the mean of its vectors; a cluster that has none keeps its centre. The
model, (by, cluster, centre), is written to the shared folder after each round. It has k vectors per corpus; up to
``MODEL_BYTES`` of it are sent to the tasks, which then multiply whole batches, and beyond that it is joined by corpus.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from kindred import schema as S
from kindred.operators.frames import attach, top_k
from kindred.operators.similarity import vector_sums
from kindred.storage import forget, materialise

MODEL_BYTES = 16 << 20
STEP = 1 << 20


def seeds(vectors: DataFrame, k: int, by: Sequence[str], id_col: str, vec_col: str) -> DataFrame:
    """``(by, cluster, centre)`` of the start; fewer than k if a corpus has fewer captions."""
    by = list(by)
    rows = vectors.select(
        *by, F.md5(F.col(id_col).cast("string").cast("binary")).alias("_h"), F.col(id_col).alias("_id"),
        F.transform(vec_col, lambda x: x.cast("double")).alias("centre"),
    )
    drawn = top_k(rows, k, F.col("_h").asc(), ["_id"], by)  # at most k rows a corpus from here on
    order = Window.partitionBy(*by).orderBy("_h", "_id") if by else Window.orderBy("_h", "_id")
    return drawn.select(*by, (F.row_number().over(order) - 1).alias("cluster"), "centre")


def assigned(vectors: DataFrame, model: DataFrame, by: Sequence[str] = (), vec_col: str = "vec", limit: int = MODEL_BYTES) -> DataFrame:
    """The rows with the ``cluster`` of their nearest centre. Rows of a corpus without a model have none."""
    by = list(by)
    size = model.agg(F.coalesce(F.sum(F.size("centre") * 8 + 64), F.lit(0))).first()[0]
    if size <= limit:
        return _multiplied(vectors, model, by, vec_col)
    near = F.transform("_model", lambda c: F.struct(
        F.aggregate(
            F.zip_with(vec_col, c["centre"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x
        ).alias("d"), c["cluster"].alias("cluster"),
    ))
    models = model.groupBy(*by).agg(F.collect_list(F.struct("cluster", "centre")).alias("_model"))
    return attach(vectors, models, by).withColumn("cluster", F.array_min(near)["cluster"]).drop("_model")


def _multiplied(vectors: DataFrame, model: DataFrame, by: list[str], vec_col: str) -> DataFrame:
    centres: dict[tuple, list] = {}
    for row in model.orderBy("cluster").collect():  # its size is checked
        centres.setdefault(tuple(row[c] for c in by), []).append((row["cluster"], row["centre"]))
    table = {key: (np.array([c for c, _ in rows], np.int32), np.array([v for _, v in rows], float)) for key, rows in centres.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, -1, np.int32)
            names = list(zip(*[batch.column(c).to_pylist() for c in by])) if by else [()] * batch.num_rows
            rows: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                rows.setdefault(name, []).append(i)
            for name, at in rows.items():
                if name not in table:
                    continue
                clusters, points = table[name]
                part = batch.column(vec_col).take(pa.array(at))
                values = np.asarray(part.flatten(), float).reshape(len(at), -1)
                step = max(STEP // max(points.size, 1), 1)
                for i in range(0, len(at), step):
                    apart = ((values[i : i + step, None, :] - points[None]) ** 2).sum(2)
                    out[at[i : i + step]] = clusters[apart.argmin(1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, mask=out < 0)], names=[*batch.schema.names, "cluster"]
            )

    schema = T.StructType([*vectors.schema.fields, T.StructField("cluster", T.IntegerType())])
    return vectors.mapInArrow(run, schema)


def lloyd(
    vectors: DataFrame, k: int = 20, rounds: int = 10, by: Sequence[str] = (), id_col: str = S.CAPTION, vec_col: str = "vec",
    limit: int = MODEL_BYTES,
) -> DataFrame:
    """``(by, cluster, centre, cnt)`` after a fixed number of rounds; ``cnt`` is the size at the last assignment.

    :func:`assigned` with this model gives the clusters of captions. Vectors of different lengths fail.
    """
    by = list(by)
    rows = vectors.select(*by, F.col(vec_col).alias("_vec"))
    model = materialise(
        seeds(vectors, k, by, id_col, vec_col).withColumn("cnt", F.lit(0).cast("bigint")), "model"
    )
    for _ in range(rounds):
        placed = assigned(rows, model, by, "_vec", limit).filter(F.col("cluster").isNotNull())
        sums = vector_sums(placed, [*by, "cluster"], "_vec", None, _n=F.count(F.lit(1)))
        means = sums.select(
            *[F.col(c).alias(f"_{c}") for c in by], F.col("cluster").alias("_cluster"),
            F.transform("_sum", lambda x: x / F.col("_n")).alias("_mean"), "_n",
        )
        same = F.col("cluster") == F.col("_cluster")
        for c in by:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        moved = model.join(means, same, "left").select(
            *by, "cluster", F.coalesce("_mean", "centre").alias("centre"), F.coalesce("_n", F.lit(0)).alias("cnt")
        )
        new = materialise(moved, "model")
        forget(model)
        model = new
    return model
