"""Threshold groups by similarity and filter datasets and split lists by the outcome.

Id sets are ordinary DataFrames joined with semi and anti joins. No side is forced to broadcast: their size
depends on the data, so adaptive execution decides from measured sizes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from kindred import schema as S
from kindred.functions.text import strip
from kindred.lexicons import THRESHOLDS


def threshold_ids(
    sims: DataFrame, thresholds: Sequence[float] = THRESHOLDS, group_col: str = S.GROUP, by: Sequence[str] = ()
) -> DataFrame:
    """``(by, threshold, group)`` for every threshold a group's similarity is below, in one pass.

    Groups without a similarity are below no threshold.
    """
    below = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col(S.SIM) < t)
    return sims.select(*by, F.explode(below).alias("threshold"), F.col(group_col).cast("string").alias(group_col))


def threshold_counts(
    sims: DataFrame, thresholds: Sequence[float] = THRESHOLDS, by: Sequence[str] = ()
) -> DataFrame:
    """Number of groups below each threshold, zeros included. ``sims`` has one row per group."""
    counts = sims.groupBy(*by).agg(*[F.count_if(F.col(S.SIM) < float(t)).alias(f"_t{i}") for i, t in enumerate(thresholds)])
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("num_bad"))
        for i, t in enumerate(thresholds)
    ]
    return counts.select(*by, F.inline(F.array(*rows)))


def bad_groups(
    sims: DataFrame, threshold: float, group_col: str = S.GROUP, by: Sequence[str] = ()
) -> DataFrame:
    """Ids of the groups below one threshold, with their corpus."""
    return threshold_ids(sims, [threshold], group_col, by).select(*by, group_col)


def lookup_group(sims: DataFrame, group, group_col: str = S.GROUP) -> DataFrame:
    return sims.filter(F.col(group_col) == group)


def drop_groups(
    df: DataFrame, bad: DataFrame, group_col: str = S.GROUP, by: Sequence[str] = ()
) -> DataFrame:
    """Rows whose group is not listed; duplicates are kept."""
    return df.join(bad, [*by, group_col], "left_anti")


def only_groups(
    df: DataFrame, bad: DataFrame, group_col: str = S.GROUP, by: Sequence[str] = ()
) -> DataFrame:
    return df.join(bad, [*by, group_col], "left_semi")


def filter_split_lines(
    lines: DataFrame, bad: DataFrame, line_col: str = "line", group_col: str = S.GROUP, by: Sequence[str] = ()
) -> DataFrame:
    """Split-list lines whose stripped text is not a listed id. Kept lines are unchanged."""
    ids = bad.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(group_col).cast("string").alias("_id"))
    same = strip(F.col(line_col)) == F.col("_id")
    for c in by:
        same &= F.col(c) == F.col(f"_{c}")
    return lines.join(ids, same, "left_anti")


def deletion_manifest(
    bad: DataFrame, files: DataFrame, artefacts: Mapping[str, str], group_col: str = S.GROUP, by: Sequence[str] = ()
) -> DataFrame:
    """``(by, group, artefact, file_name, path, exists)`` for the files that belong to listed groups.

    ``artefacts`` maps an artefact name to its file suffix; ``files`` is a listing with ``artefact``,
    ``file_name`` and ``path``. Nothing is deleted.
    """
    kinds = F.array(
        *[F.struct(F.lit(a).alias("artefact"), F.lit(s).alias("_suffix")) for a, s in artefacts.items()]
    )
    wanted = (
        bad.select(*by, F.col(group_col).cast("string").alias(group_col))
        .distinct()
        .select(*by, group_col, F.inline(kinds))
        .select(*by, group_col, "artefact", F.concat(group_col, "_suffix").alias("file_name"))
    )
    return wanted.join(files.select(*by, "artefact", "file_name", "path"), [*by, "artefact", "file_name"], "left").select(
        *by, group_col, "artefact", "file_name", "path", F.col("path").isNotNull().alias("exists")
    )
