import numpy as np
import pytest

from kindred.operators import blocks
from test_vectors_motion import as_table, brute, random_groups


def approx(values, tol=1e-12):
    return {g: (None if v is None else pytest.approx(v, abs=tol)) for g, v in values.items()}


@pytest.mark.parametrize("block", [128, 7])
@pytest.mark.parametrize("scale", [None, 1.5])
def test_pairwise_and_raw_similarity_equal_brute_force(spark, block, scale):
    groups = random_groups(scale)
    table, want = as_table(spark, groups), approx(brute(groups))
    for sims in (
        blocks.pairwise_similarity(table, block=block),
        blocks.raw_similarity(table, block=block),
        blocks.raw_similarity(table, dim=6, block=block, tolerance=0.0),
    ):
        rows = sims.collect()
        assert {r.motion_id: r.mean_intra_caption_sim for r in rows} == want
        assert {r.motion_id: r.num_captions for r in rows} == {g: len(v) for g, v in groups.items()}


def test_raw_fixture(spark):
    table = as_table(spark, {"a": [[2.0, 0.0], [1.0, 0.0]], "b": [[1.0, 1.0]]})
    got = {r.motion_id: r.mean_intra_caption_sim for r in blocks.raw_similarity(table).collect()}
    assert got == {"a": 1.0, "b": None}


@pytest.mark.parametrize("block", [128, 7])
def test_distances(spark, block):
    groups = random_groups()
    groups["same"] = [[1.0] + [0.0] * 5] * 30
    groups["opposed"] = [[1.0] + [0.0] * 5] * 10 + [[-1.0] + [0.0] * 5] * 10
    got = {r.motion_id: r for r in blocks.caption_distances(as_table(spark, groups), block=block).collect()}
    assert "g0" not in got
    for g, vs in groups.items():
        if g == "g0":
            continue
        v = np.array(vs)
        d = 1 - np.clip(v @ v.T, -1, 1)[np.triu_indices(len(v), 1)]
        r = got[g]
        assert r.n_captions == len(v)
        assert (r.dist_mean, r.dist_max, r.dist_min) == pytest.approx((d.mean(), d.max(), d.min()), abs=1e-12)
        assert r.dist_median == pytest.approx(np.median(d), abs=1e-12 if len(v) <= block else 2e-9)


def test_distance_summary(spark):
    rows = [("a", 0.1, 0.2), ("b", 0.3, 0.1), ("c", 0.8, 0.9)]
    df = spark.createDataFrame(rows, "motion_id string, dist_mean double, dist_median double")
    got = blocks.distance_summary(df).collect()[0]
    assert list(got) == pytest.approx([0.1, 0.3, 0.4, 0.8, 0.1, 0.2, 0.4, 0.9])
    assert [r.motion_id for r in blocks.most_diverse(df, 2).collect()] == ["c", "b"]
    assert [r.motion_id for r in blocks.least_diverse(df, 1).collect()] == ["a"]
