"""Clusters, topics, distinct states, lexicon tables and the encoder over different texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred import lexicons as L
from kindred.operators import cues, distinct, embedding, factors, lexicon, lloyd
from kindred.plans.backends import Encoder


def vectors(spark, corpora, dim=4, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(c, f"{c}:{i}", rng.normal(size=dim).tolist()) for c, n in corpora for i in range(n)]
    return spark.createDataFrame(rows, "dataset string, caption_id string, vec array<double>")


def brute_lloyd(points, k, rounds):
    import hashlib

    order = sorted(points, key=lambda p: (hashlib.md5(p[0].encode()).hexdigest(), p[0]))
    centres = [np.array(v) for _, v in order[:k]]
    for _ in range(rounds):
        at = [min(range(len(centres)), key=lambda j: (((np.array(v) - centres[j]) ** 2).sum(), j)) for _, v in points]
        counts = [at.count(j) for j in range(len(centres))]
        centres = [
            np.mean([v for (_, v), a in zip(points, at) if a == j], axis=0) if counts[j] else centres[j] for j in range(len(centres))
        ]
    return centres, counts


@pytest.mark.parametrize("limit", [lloyd.MODEL_BYTES, 0])
def test_lloyd_equals_brute_force(spark, limit):
    df = vectors(spark, [("a", 60), ("b", 3), (None, 20)])
    df = df.unionByName(df.limit(2).withColumn("dataset", F.lit("same")).withColumn("vec", F.lit([1.0, 1.0, 1.0, 1.0])))
    model = lloyd.lloyd(df, 5, 3, ["dataset"], limit=limit).collect()
    for corpus in ("a", "b", None, "same"):
        points = [(r.caption_id, r.vec) for r in df.collect() if r.dataset == corpus]
        centres, counts = brute_lloyd(points, 5, 3)
        got = sorted((r.cluster, r.centre, r.cnt) for r in model if r.dataset == corpus)
        assert [c for _, _, c in got] == counts
        assert np.allclose([v for _, v, _ in got], centres, atol=1e-12)
    # two equal vectors: the second cluster is empty and keeps its centre
    assert sorted(r.cnt for r in model if r.dataset == "same") == [0, 2]


def test_lloyd_without_corpora_and_empty(spark):
    df = vectors(spark, [("a", 40)]).drop("dataset")
    model = lloyd.lloyd(df, 4, 2)
    assert sum(r.cnt for r in model.collect()) == 40
    placed = lloyd.assigned(df, model)
    assert placed.filter("cluster IS NULL").count() == 0 and placed.columns == ["caption_id", "vec", "cluster"]
    assert lloyd.lloyd(df.limit(0), 4, 2).count() == 0


def test_factors_equal_matrix_updates(spark):
    texts = ["ab cd ef ab", "cd ef gh", "ab ab gh", "cd zz", "ef gh ab cd"]
    df = spark.createDataFrame([("g", f"c{i}", t) for i, t in enumerate([*texts, None])], "motion_id string, caption_id string, description string")
    k, rounds = 2, 4
    got = factors.factor_topics(df, k, 99, rounds, min_df=2, ngram_range=(1, 1)).collect()
    words = ["ab", "cd", "ef", "gh"]  # zz is in one caption only
    x = np.array([[t.split().count(w) for w in words] for t in texts], float)
    import hashlib

    start = lambda name, kind: [0.5 + int(hashlib.md5(f"{kind}{j}:{name}".encode()).hexdigest()[:8], 16) / 2**32 for j in range(k)]
    w, h = np.array([start(f"c{i}", "w") for i in range(5)]), np.array([start(t, "h") for t in words])
    errors = []
    for _ in range(rounds):
        h = h * (x.T @ w) / (h @ (w.T @ w) + 1e-12)
        w = w * (x @ h) / (w @ (h.T @ h) + 1e-12)
        errors.append(((x - w @ h.T) ** 2).sum())
    share = h / h.sum(0)
    assert {(r.topic, r.term): r.weight for r in got} == {
        (j, t): pytest.approx(share[i, j], rel=1e-9) for i, t in enumerate(words) for j in range(k)
    }
    assert errors == sorted(errors, reverse=True)
    for j in range(k):
        assert [r.term for r in sorted((r for r in got if r.topic == j), key=lambda r: r["rank"])] == [
            words[i] for i in np.argsort(-share[:, j], kind="stable")
        ]


def test_factors_plan_has_no_vocabulary(spark):
    df = spark.createDataFrame([("g", "c", "aa bb")], "motion_id string, caption_id string, description string")
    assert factors.factor_topics(df, 2, 5, 1, min_df=1).count() == 6
    assert factors.factor_topics(df.limit(0), 2, 5, 1).count() == 0


def test_distinct_states_unite(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("c"), F.concat(F.lit("v"), F.col("id") % 41_000).alias("v"))
    whole = distinct.distinct_state(df, "v", ["c"])
    halves = [distinct.distinct_state(df.filter(F.xxhash64("v") % 2 == i), "v", ["c"]) for i in (-1, 0, 1)]
    one = {(r.c, r.register): r.position for r in whole.collect()}
    assert {(r.c, r.register): r.position for r in distinct.united(halves, ["c"]).collect()} == one
    for state, by in ((whole, ["c"]), (distinct.united([whole]), [])):
        exact = {tuple(r)[:-1]: r[-1] for r in df.groupBy(*by).agg(F.count_distinct("v")).collect()}
        for r in distinct.estimated_count(state, by).collect():
            assert abs(r.estimate - exact[tuple(r)[:-1]]) < 0.03 * exact[tuple(r)[:-1]]
    few = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "v string")
    assert distinct.estimated_count(distinct.distinct_state(few, "v")).first().estimate == pytest.approx(2, abs=0.01)
    assert distinct.estimated_count(distinct.distinct_state(few.limit(0), "v")).first().estimate == pytest.approx(0, abs=1e-9)
    with pytest.raises(ValueError):
        distinct.distinct_state(few, "v", bits=3)


def cue_table(spark):
    kinds = {"direction": (L.DIRECTION_WORDS, ["ADJ", "ADV", "NOUN"]), "speed": (L.SPEED_WORDS, ["ADJ", "ADV"]), "body": (L.BODY_PARTS, ["NOUN"])}
    return spark.createDataFrame(
        [(w, c, tags) for c, (words, tags) in kinds.items() for w in words], "word string, category string, tags array<string>"
    )


@pytest.mark.parametrize("limit", [lexicon.BROADCAST, 0])
def test_lexicon_table_equals_the_literals(spark, micro, limit):
    many = micro.crossJoin(spark.range(40)).withColumn("caption_id", F.concat_ws(":", "caption_id", "id"))
    got = lexicon.lexicon_hits(many, cue_table(spark), ["caption_id"], ["direction", "speed", "body"], limit)
    want = cues.with_cues(many).select("caption_id", "direction_hits", "speed_hits", "body_part_mentions")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("direction > 0").count() > 0


def test_a_lexicon_of_a_million_words(spark, micro):
    words = spark.range(1_000_000).select(F.concat(F.lit("w"), F.col("id")).alias("word"), F.lit("other").alias("category"))
    table = words.unionByName(spark.createDataFrame([("walk", "walk"), ("a", "article")], "word string, category string"))
    assert lexicon.measured_bytes(table) > lexicon.BROADCAST
    counts = lexicon.lexicon_counts(micro, table)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    assert {(r.token, r.category): r.cnt for r in counts.collect()} == {("walk", "walk"): 4, ("a", "article"): 3}


def test_the_encoder_sees_each_text_once(spark):
    rows = [("g", f"c{i}", t) for i, t in enumerate(["same"] * 50 + ["other", None, "", "long " * 50, "same "])]
    df = spark.createDataFrame(rows, "motion_id string, caption_id string, description string").repartition(5)
    seen = spark.sparkContext.accumulator(0)

    def make():
        def encode(texts):
            seen.add(len(texts))
            assert [len(t) for t in texts] == sorted(len(t) for t in texts)
            return np.array([[len(t) + 1.0, t.count("e")] for t in texts])

        return encode

    got = {r.caption_id: r.vec for r in embedding.encode_distinct(df, make).collect()}
    assert seen.value == 5 and len(got) == len(rows)
    for _, c, t in rows:
        v = np.array([len(t or "") + 1.0, (t or "").count("e")])
        assert np.allclose(got[c], v / np.linalg.norm(v), atol=1e-15)
    plain = {r.caption_id: r.vec for r in embedding.encode(df, lambda: lambda ts: np.array([[len(t) + 1.0, t.count("e")] for t in ts])).collect()}
    assert all(np.allclose(plain[c], got[c], atol=1e-6) for c in got)
    sims = Encoder(make, dim=2).similarity(df).collect()
    assert [(r.motion_id, r.num_captions) for r in sims] == [("g", len(rows))]
