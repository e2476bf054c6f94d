"""The metric index: cells that are skipped never matter, and clustered groups skip most of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import blocks, metric


def clustered(n, clusters, spread, dim=8, seed=3, lengths=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    v = centres[rng.integers(0, clusters, n)]
    v = v / np.linalg.norm(v, axis=1, keepdims=True) + rng.normal(size=(n, dim)) * spread
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    return v * rng.uniform(0.05, 1.3, (n, 1)) if lengths else v


def table(spark, groups):
    rows = [(g, f"{g}:{i}", x) for g, v in groups.items() for i, x in enumerate(v.tolist())]
    return spark.createDataFrame(rows, "motion_id string, caption_id string, vec array<double>")


def index(df, block):
    ready = df.select("motion_id", F.col("caption_id").alias("_id"), F.col("vec").alias("_vec"))
    placed = metric.place(ready, ["motion_id"], block)
    return placed, metric.bounded_cells(metric.block_table(placed, ["motion_id"]), ["motion_id"])


@pytest.fixture(scope="module")
def groups():
    zero = np.zeros((3, 8))
    return {
        "tight": clustered(220, 6, 0.05), "loose": clustered(150, 3, 0.8), "one": clustered(90, 1, 0.0),
        "zeros": np.concatenate([clustered(60, 2, 0.1), zero]), "small": clustered(7, 2, 0.3), "nothing": np.zeros((40, 8)),
    }


def test_bounds_hold_for_every_cell(spark, groups):
    placed, cells = index(table(spark, groups), 16)
    at = {}
    for r in placed.collect():
        at.setdefault((r.motion_id, r._block), []).append(r._vec)
    seen = {}
    for c in cells.collect():
        a, b = np.array(at[c.motion_id, c.lo]), np.array(at[c.motion_id, c.hi])
        assert len(a) <= 16 and len(b) <= 16
        dots = (a @ b.T)[np.triu_indices(len(a), 1)] if c.lo == c.hi else (a @ b.T).ravel()
        assert c.pairs == len(dots) and c.dot_low <= dots.min() + 1e-15 and dots.max() - 1e-15 <= c.dot_high
        seen[c.motion_id] = seen.get(c.motion_id, 0) + len(dots)
    assert seen == {g: len(v) * (len(v) - 1) // 2 for g, v in groups.items()}


@pytest.mark.parametrize("block", [128, 9])
def test_distances_equal_all_pairs(spark, groups, block):
    got = {r.motion_id: r for r in blocks.caption_distances(table(spark, groups), block=block).collect()}
    for g, v in groups.items():
        d = 1 - np.clip(v @ v.T, -1, 1)[np.triu_indices(len(v), 1)]
        r = got[g]
        assert (r.dist_mean, r.dist_max, r.dist_min) == pytest.approx((d.mean(), d.max(), d.min()), abs=1e-9)
        assert r.dist_median == pytest.approx(np.median(d), abs=2e-9)


@pytest.mark.parametrize("block", [128, 9])
def test_clipped_dots_equal_all_pairs(spark, block):
    groups = {g: clustered(n, 4, 0.2, seed=i, lengths=True) for i, (g, n) in enumerate([("a", 160), ("b", 40), ("c", 9)])}
    got = {r.motion_id: r.mean_intra_caption_sim for r in blocks.raw_similarity(table(spark, groups), block=block).collect()}
    for g, v in groups.items():
        want = np.clip(v @ v.T, -1, 1)[np.triu_indices(len(v), 1)].mean()
        assert got[g] == pytest.approx(want, abs=1e-12)


def test_a_large_clustered_group_evaluates_few_cells(spark):
    v = clustered(20_000, 60, 0.002, dim=16)
    placed, cells = index(table(spark, {"g": v}), 128)
    cells = cells.cache()
    total = cells.count()
    extremes = metric.extreme_cells(cells, ["motion_id"])
    median = metric.median_cells(cells, ["motion_id"]).select("motion_id", "lo", "hi")
    assert extremes.unionByName(median).distinct().count() < 0.2 * total
    long = clustered(20_000, 60, 0.02, dim=16, lengths=True)
    _, cells = index(table(spark, {"g": long}), 128)
    assert metric.clipped_cells(cells, ["motion_id"]).count() < 0.2 * cells.count()
