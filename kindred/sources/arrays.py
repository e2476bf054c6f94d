"""Scan ``.npy`` files, one array per group, as one row per leading index (frame)."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred import schema as S


def _decoder(dtype: type, key: str = S.GROUP):
    # A closure over plain values is shipped by value, so executors need not have this package.
    def decode(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in files:
            for name, content in zip(batch["name"], batch["content"]):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                count = array.shape[0] if array.ndim else 0
                framed = array.ndim > 1 and count > 0
                # A file without frames still reports its shape, in one row.
                rows = count if framed else 1
                yield pd.DataFrame(
                    {
                        key: [name] * rows,
                        "ndim": [array.ndim] * rows,
                        "n_frames": [count] * rows,
                        "frame": range(count) if framed else [None],
                        "vec": list(array.reshape(count, -1).astype(dtype)) if framed else [None],
                    }
                )

    return decode


def read_arrays(spark: SparkSession, path: str, double: bool = False) -> DataFrame:
    """``(motion_id, ndim, n_frames, frame, vec)``; higher ranks are flattened per frame.

    Values are FLOAT, or DOUBLE with ``double=True`` for files of that precision.

    Decode once and keep the result as Parquet: later scans then prune columns and split long recordings.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.npy")
        .load(path)
        .select(F.regexp_replace(F.col("_metadata.file_name"), r"\.npy$", "").alias("name"), "content")
    )
    schema = S.frames("double" if double else "float")
    return files.mapInPandas(_decoder(np.float64 if double else np.float32), schema)
