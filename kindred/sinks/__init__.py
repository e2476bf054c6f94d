"""Writers. Every sink writes to a new path; nothing is rewritten or deleted in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from kindred import schema as S


def write_similarity_csv(sims: DataFrame, path: str, ordered: bool = False, group_col: str = S.GROUP) -> None:
    """Similarity table as CSV with header; ``ordered`` sorts ascending, missing similarities last."""
    if ordered:
        sims = sims.orderBy(F.col(S.SIM).asc_nulls_last(), group_col)
    sims.write.option("header", True).csv(path)


def write_splits(lines: DataFrame, path: str) -> None:
    """Split lists as text, one folder per split, lines in their original order.

    Lines are range-partitioned by (split, line number), so a long list is written by many tasks and its part
    files read in order.
    """
    (
        lines.repartitionByRange(F.col("split"), F.col("line_no"))
        .sortWithinPartitions("split", "line_no")
        .select("split", F.col("line").alias("value"))
        .write.partitionBy("split")
        .text(path)
    )


def write_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.partitionBy(*partition_by).parquet(path)
