"""Corpora that share ids stay apart."""

import pytest
from pyspark.errors import PySparkException

from kindred.operators import blocks, curation, frames, motion, pairs
from kindred.plans.backends import Precomputed


def test_precomputed_vectors_are_looked_up_per_corpus(spark):
    captions = spark.createDataFrame(
        [(d, "m", c) for d in "ab" for c in ("m:0", "m:1")], "dataset string, motion_id string, caption_id string"
    )
    rows = [("a", "m:0", [1.0, 0.0]), ("a", "m:1", [1.0, 0.0]), ("b", "m:0", [1.0, 0.0]), ("b", "m:1", [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "dataset string, caption_id string, vec array<double>")
    got = Precomputed(vectors).similarity(captions, ["dataset"]).collect()
    assert {r.dataset: (r.mean_intra_caption_sim, r.num_captions) for r in got} == {"a": (1.0, 2), "b": (0.0, 2)}
    with pytest.raises(ValueError, match="dataset"):
        Precomputed(vectors.drop("dataset")).similarity(captions, ["dataset"])
    with pytest.raises(PySparkException, match="not exactly one vector"):
        Precomputed(vectors.filter("vec[1] = 0")).similarity(captions, ["dataset"]).collect()


def test_pairs_do_not_cross_corpora(spark):
    rows = [(d, "m", f"m:{i}", f"{d}{i}") for d in "ab" for i in range(3)]
    df = spark.createDataFrame(rows, "dataset string, motion_id string, caption_id string, description string")
    got = pairs.same_group_pairs(df, by=["dataset"]).collect()
    assert len(got) == 6 and all(r.text_a[0] == r.text_b[0] == r.dataset for r in got)


def test_curation_per_corpus(spark):
    df = spark.createDataFrame([(d, g) for d in "ab" for g in ("1", "2")], "dataset string, motion_id string")
    bad = spark.createDataFrame([("a", "1"), ("b", "2")], "dataset string, motion_id string")
    key = {"by": ["dataset"]}
    assert {tuple(r) for r in curation.drop_groups(df, bad, **key).collect()} == {("a", "2"), ("b", "1")}
    assert {tuple(r) for r in curation.only_groups(df, bad, **key).collect()} == {("a", "1"), ("b", "2")}
    lines = df.select("dataset", df.motion_id.alias("line"))
    assert curation.filter_split_lines(lines, bad, **key).count() == 2


def test_rows_without_a_corpus_keep_their_statistics(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "dataset string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "dataset string, y int")
    assert {r.x: r.y for r in frames.attach(left, right, ["dataset"]).collect()} == {1: 10, 2: 20}


def test_width_is_checked(spark):
    schema = "motion_id string, ndim int, n_frames bigint, frame int, vec array<double>"
    features = spark.createDataFrame([("m", 2, 1, 0, [0.0] * 20)], schema)
    joints = spark.createDataFrame([("m", 3, 1, 0, [0.0] * 66)], schema)
    assert motion.check_twins(features, joints)["status"].first().status == "bad_width"


@pytest.mark.parametrize("block", [7, 128, 1000])
def test_median_is_exact_whatever_the_block(spark, block):
    import numpy as np

    rng = np.random.default_rng(4)
    vec = rng.normal(size=(60, 5))
    vec[40:] = vec[:20]  # ties
    vec /= np.linalg.norm(vec, axis=1)[:, None]
    df = spark.createDataFrame(
        [("m", f"c{i}", v.tolist()) for i, v in enumerate(vec)], "motion_id string, caption_id string, vec array<double>"
    )
    row = blocks.caption_distances(df, block=block).first()
    d = 1 - np.clip((vec @ vec.T)[np.triu_indices(60, 1)], -1, 1)
    assert row.dist_median == pytest.approx(np.median(d), abs=1e-12)
    assert (row.dist_max, row.dist_min) == (pytest.approx(d.max(), abs=1e-12), pytest.approx(d.min(), abs=1e-12))
