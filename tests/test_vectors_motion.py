import numpy as np
import pytest

from kindred.functions import vectors as V
from kindred.operators import embedding, motion, similarity
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_l2_normalise(spark):
    df = frame(spark, [([3.0, 4.0],), ([0.0, 0.0],)], "vec array<double>")
    got = [r.vec for r in embedding.normalise_vectors(df).collect()]
    assert got == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0]]
    eps = [r.vec for r in embedding.normalise_vectors(df, eps=1e-9).collect()]
    assert eps[0][0] == pytest.approx(3 / (5 + 1e-9), abs=1e-15) and eps[1] == [0.0, 0.0]


@pytest.mark.parametrize("dim", [None, 2])
def test_mean_pool(spark, dim):
    rows = [("a", 1, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("a", 0, [100.0, 100.0]), ("b", 0, [5.0, 5.0])]
    df = frame(spark, rows, "caption_id string, mask int, vec array<float>")
    got = {r.caption_id: r.vec for r in embedding.mean_pool(df, dim=dim).collect()}
    assert got == {"a": [2.0, 3.0], "b": [0.0, 0.0]}


def brute(groups):
    out = {}
    for g, vs in groups.items():
        v = np.array(vs, dtype=np.float64)
        n = len(v)
        out[g] = None if n < 2 else float(np.clip(v @ v.T, -1, 1)[np.triu_indices(n, 1)].mean())
    return out


def random_groups(scale=None, seed=7):
    rng = np.random.default_rng(seed)
    groups = {}
    for i, n in enumerate([1, 2, 3, 5, 40]):
        v = rng.normal(size=(n, 6))
        v = v / np.linalg.norm(v, axis=1, keepdims=True) if scale is None else v * scale
        groups[f"g{i}"] = v.tolist()
    groups["zero"] = [[0.0] * 6] * 3
    return groups


def as_table(spark, groups):
    rows = [(g, f"{g}:{i}", v) for g, vs in groups.items() for i, v in enumerate(vs)]
    return frame(spark, rows, "motion_id string, caption_id string, vec array<double>")


@pytest.mark.parametrize("dim", [None, 6])
def test_dense_similarity_equals_all_pairs(spark, dim):
    groups = random_groups()
    got = {r.motion_id: r.mean_intra_caption_sim for r in similarity.dense_similarity(as_table(spark, groups), dim).collect()}
    assert got == {g: (None if v is None else pytest.approx(v, abs=1e-12)) for g, v in brute(groups).items()}


def test_dense_similarity_normalises(spark):
    groups = random_groups(scale=3.0)
    unit = {g: [np.array(v) / (np.linalg.norm(v) or 1) for v in vs] for g, vs in groups.items()}
    table = similarity.dense_similarity(as_table(spark, groups), 6, normalise=True)
    got = {r.motion_id: r.mean_intra_caption_sim for r in table.collect()}
    assert got == {g: (None if v is None else pytest.approx(v, abs=1e-12)) for g, v in brute(unit).items()}


def test_wrong_dimension_fails(spark):
    with pytest.raises(Exception, match="expected vectors of 5 values"):
        similarity.dense_similarity(as_table(spark, random_groups()), 5).collect()


def test_split_frame(spark):
    df = frame(spark, [([float(i) for i in range(265)],)], "vec array<float>")
    r = motion.with_parts(df).collect()[0]
    assert (r.root_rot_vel, r.root_lin_vel, r.root_y) == (0, [1, 2], 3)
    assert (r.ric[0], len(r.ric), r.ric[-1]) == ([4, 5, 6], 21, [64, 65, 66])
    assert (r.rot6d[0][0], len(r.rot6d), r.rot6d[-1][-1]) == (67, 21, 192)
    assert (r.local_vel[0][0], len(r.local_vel), r.local_vel[-1][-1]) == (193, 22, 258)
    assert r.foot_contact == [259, 260, 261, 262]


def twins(spark, offset=0.0, joints=22):
    rng = np.random.default_rng(1)
    vec = rng.normal(size=12 * joints - 1)
    root = rng.normal(size=3)
    positions = np.vstack([root, root + vec[4 : 4 + 3 * (joints - 1)].reshape(-1, 3)])
    positions[3, 1] += offset
    features = frame(spark, [("m", 2, 1, 0, vec.tolist())], "motion_id string, ndim int, n_frames bigint, frame int, vec array<double>")
    flat = frame(spark, [("m", 3, 1, 0, positions.ravel().tolist())], "motion_id string, ndim int, n_frames bigint, frame int, vec array<double>")
    return features, flat


@pytest.mark.parametrize("offset,want", [(0.0, 0.0), (1.0, 1 / 63)])
def test_frame_mse(spark, offset, want):
    features, flat = twins(spark, offset)
    got = motion.frame_mse(features, motion.joint_rows(flat)).collect()
    assert [r.mse for r in got] == [pytest.approx(want, abs=1e-12)]


def test_check_twins(spark):
    schema = "motion_id string, ndim int, n_frames bigint, frame int, vec array<double>"
    good_f, good_j = twins(spark, 1.0)
    extra_f = frame(spark, [("n", 2, 5, 0, [0.0] * 263), ("p", 1, 9, None, None), ("q", 2, 1, 0, [0.0] * 263)], schema)
    extra_j = frame(spark, [("n", 3, 4, 0, [0.0] * 66), ("p", 3, 9, 0, [0.0] * 66)], schema)
    out = motion.check_twins(good_f.unionByName(extra_f), good_j.unionByName(extra_j))
    assert {r.motion_id: r.status for r in out["status"].collect()} == {
        "m": "ok", "n": "frame_mismatch", "p": "bad_rank", "q": "missing",
    }
    row = out["global_extremes"].collect()[0]
    assert (row.max_file, row.min_file) == ("m", "m")
    assert row.max_mse == pytest.approx(1 / 63) and row.min_mse == pytest.approx(1 / 63)


def test_global_extremes_ties(spark):
    ext = frame(spark, [("b", 2.0, 1.0), ("a", 2.0, 1.0), ("c", 1.0, 1.5)], "motion_id string, max_mse double, min_mse double")
    assert tuple(motion.global_extremes(ext).collect()[0]) == (2.0, "a", 1.0, "a")


def test_clip(spark):
    got = spark.range(1).select(V.clip(F.lit(2.0)), V.clip(F.lit(-3.0)), V.clip(F.lit(0.5))).collect()[0]
    assert tuple(got) == (1.0, -1.0, 0.5)


def test_encode(spark):
    def make_encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = frame(spark, [("a", "x"), ("a", None), ("b", "yyyy")], "motion_id string, description string")
    got = {r.description: r.vec for r in embedding.encode(df, make_encoder, batch_size=2).collect()}
    assert got[None] == [0.0, 1.0]
    assert got["yyyy"] == [pytest.approx(4 / 17**0.5, abs=1e-6), pytest.approx(1 / 17**0.5, abs=1e-6)]
