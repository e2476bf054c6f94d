"""Per-frame motion arrays: name their parts and compare feature vectors with joint positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from kindred import schema as S
from kindred.functions.vectors import mean_squared_difference, root_relative, rows, split_frame
from kindred.operators.frames import attach, top_k

FRAME = "frame"


def with_parts(features: DataFrame, joints: int = 22, vec_col: str = "vec") -> DataFrame:
    """Feature frames with their seven named parts as columns."""
    return features.withColumn("_parts", split_frame(F.col(vec_col), joints)).select(
        *features.columns, "_parts.*"
    )


def joint_rows(frames: DataFrame, joints: int = 22, vec_col: str = "vec") -> DataFrame:
    """Flat frames of ``joints * 3`` values as ``joints array<array<float>>``."""
    return frames.withColumn("joints", rows(F.col(vec_col), joints, 3))


def twin_status(
    features: DataFrame, joints: DataFrame, num_joints: int = 22, group_col: str = S.GROUP, by: Sequence[str] = ()
) -> DataFrame:
    """Shape check per file: ok, missing, bad_rank, frame_mismatch or bad_width.

    Both inputs carry ``ndim``, ``n_frames`` and ``width`` (values in this frame) on every frame; feature frames have
    ``12 * num_joints - 1`` values and joint frames ``3 * num_joints``. One frame of another width fails its file.
    """
    keys = [*by, group_col]
    widths = {"vec": 12 * num_joints - 1, "joints": 3 * num_joints}

    def shapes(df: DataFrame, suffix: str) -> DataFrame:
        fits = F.coalesce(F.col("width") == widths[suffix], F.lit(False))
        return df.groupBy(*keys).agg(
            F.max("ndim").alias(f"ndim_{suffix}"), F.max("n_frames").alias(f"n_frames_{suffix}"),
            F.bool_and(fits).alias(f"_fits_{suffix}"),
        )

    both = shapes(features, "vec").join(shapes(joints, "joints"), keys, "full_outer")
    missing = F.col("ndim_vec").isNull() | F.col("ndim_joints").isNull()
    status = (
        F.when(missing, "missing")
        .when((F.col("ndim_vec") != 2) | (F.col("ndim_joints") != 3), "bad_rank")
        .when(F.col("n_frames_vec") != F.col("n_frames_joints"), "frame_mismatch")
        .when(~(F.col("_fits_vec") & F.col("_fits_joints")), "bad_width")
        .otherwise("ok")
    )
    return both.withColumn("status", status).drop("_fits_vec", "_fits_joints")


def frame_mse(
    features: DataFrame,
    joints: DataFrame,
    num_joints: int = 22,
    group_col: str = S.GROUP,
    vec_col: str = "vec",
    joints_col: str = "joints",
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean squared difference, per frame, of root-relative joints and the relative positions in the features.

    The join key is (group, frame), so one long recording is spread over many tasks.
    """
    key = [*by, group_col, FRAME]
    twins = features.select(*key, F.col(vec_col).alias("_vec")).join(
        joints.select(*key, F.col(joints_col).alias("_joints")), key
    )
    ric = rows(F.slice("_vec", 5, 3 * (num_joints - 1)), num_joints - 1, 3)
    return twins.select(
        *key, mean_squared_difference(root_relative(F.col("_joints")), ric).alias("mse")
    )


def file_extremes(mse: DataFrame, group_col: str = S.GROUP, by: Sequence[str] = ()) -> DataFrame:
    return mse.groupBy(*by, group_col).agg(F.max("mse").alias("max_mse"), F.min("mse").alias("min_mse"))


def global_extremes(extremes: DataFrame, group_col: str = S.GROUP) -> DataFrame:
    """One row: the largest maximum and smallest minimum with their files, ties to the smallest id."""
    top = top_k(extremes, 1, "max_mse", [group_col]).select("max_mse", F.col(group_col).alias("max_file"))
    bottom = top_k(extremes, 1, F.col("min_mse").asc(), [group_col]).select(
        "min_mse", F.col(group_col).alias("min_file")
    )
    return attach(top, bottom)


def check_twins(
    features: DataFrame, joints: DataFrame, num_joints: int = 22, group_col: str = S.GROUP
) -> dict[str, DataFrame]:
    """The whole consistency check: status per file, then errors of the files that pass."""
    features, joints = (df.withColumn("width", F.coalesce(F.size("vec"), F.lit(-1))) for df in (features, joints))
    status = twin_status(features, joints, num_joints, group_col)
    passed = status.filter(F.col("status") == "ok").select(group_col)
    usable = features.join(passed, group_col, "left_semi")
    mse = frame_mse(usable, joint_rows(joints, num_joints), num_joints, group_col)
    extremes = file_extremes(mse, group_col)
    return {
        "status": status,
        "frame_mse": mse,
        "file_extremes": extremes,
        "global_extremes": global_extremes(extremes, group_col),
    }
