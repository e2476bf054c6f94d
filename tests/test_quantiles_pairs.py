import itertools

import numpy as np
import pandas as pd
import pytest

from kindred.operators.pairs import same_group_pairs
from kindred.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("accuracy", [10_000, 10])
@pytest.mark.parametrize("n", [1, 2, 7, 3000])
def test_exact_quantiles(spark, n, accuracy):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.4, 0.5, rng.normal(size=n))
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    row = exact_quantiles(df, "v", PROBS, accuracy=accuracy).collect()[0]
    assert row.n == n
    assert row.quantiles == pytest.approx(np.quantile(values, PROBS).tolist(), abs=1e-12)


def test_exact_quantiles_by_key_and_nulls(spark):
    rows = [("a", float(x)) for x in [1, 2, 4, 9]] + [("a", None), ("b", 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.quantiles for r in exact_quantiles(df, "v", [0.1, 0.25, 0.5], ["k"]).collect()}
    assert got == {"a": pytest.approx([1.3, 1.75, 3.0]), "b": [3.0] * 3, "c": [None] * 3}
    empty = exact_quantiles(df.filter("k = 'c'"), "v", [0.5]).collect()[0]
    assert empty.n == 0 and empty.quantiles == [None]


def captions(spark, sizes):
    rows = [(g, i, f"t{i}") for g, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "motion_id string, caption_id int, description string")


def test_pairs_below_the_cap_are_complete(spark):
    df = captions(spark, {"one": 1, "three": 3, "fourteen": 14}).repartition(5)
    null = spark.createDataFrame([("one", 9, None)], df.schema)
    got = same_group_pairs(df.union(null)).collect()
    by_group = {g: sorted((r.caption_a, r.caption_b) for r in got if r.motion_id == g) for g in ["one", "three", "fourteen"]}
    assert by_group["one"] == []
    assert by_group["three"] == list(itertools.combinations(range(3), 2))
    assert by_group["fourteen"] == list(itertools.combinations(range(14), 2))
    assert {r.label for r in got} == {1.0}
    assert all(r.text_a == f"t{r.caption_a}" and r.text_b == f"t{r.caption_b}" for r in got)


def test_pairs_above_the_cap_are_a_sample(spark):
    df = captions(spark, {"a": 15, "b": 400, "c": 5000})
    first = same_group_pairs(df).collect()
    again = same_group_pairs(df.repartition(7), salts=3).collect()
    other = same_group_pairs(df, seed=1).collect()
    keys = [(r.motion_id, r.caption_a, r.caption_b) for r in first]
    assert len(keys) == len(set(keys)) == 300
    assert all(a < b for _, a, b in keys)
    assert sorted(keys) == sorted((r.motion_id, r.caption_a, r.caption_b) for r in again)
    assert sorted(keys) != sorted((r.motion_id, r.caption_a, r.caption_b) for r in other)


def test_every_pair_is_equally_likely(spark):
    df = captions(spark, {f"g{i}": 6 for i in range(1500)})
    got = same_group_pairs(df, cap=5).groupBy("caption_a", "caption_b").count().collect()
    counts = np.array([r["count"] for r in got])
    assert len(counts) == 15 and counts.sum() == 7500
    # 500 expected per pair, standard deviation about 18
    assert abs(counts - 500).max() < 90
