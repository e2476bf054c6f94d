"""Grams as bytes, pairs drawn as rows, tiles of a metric index: same results, and plans without what did not scale."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred import schema as S
from kindred.operators import blocks, clustering, grams, metric, pairs, redundancy, richness, similarity, tfidf


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)] + ["é", "Éa", "ab"]
    rows = [(f"g{i % 4}" if i % 9 else None, f"c{i % 50}" if i % 11 else None, "x" if i % 3 else "y", " ".join(rng.choice(words, i % 17))) for i in range(60)]
    return spark.createDataFrame([*rows, ("g0", "null", "x", None)], f"{S.GROUP} string, {S.CAPTION} string, dataset string, {S.TEXT} string")


def test_gram_counts(spark, texts):
    got = {(r.dataset, r.n, r.ngram): r.cnt for r in grams.counts(texts, F.split(S.TEXT, " "), ["dataset"], (1, 3), "\x1f").collect()}
    want = Counter()
    for r in texts.collect():
        w = r[S.TEXT].split(" ") if r[S.TEXT] is not None else []
        want.update((r.dataset, n, "\x1f".join(w[i : i + n])) for n in (1, 3) for i in range(len(w) - n + 1))
    assert got == dict(want)


def test_frequencies_are_those_of_the_terms(texts):
    old = texts.transform(tfidf.caption_terms, by=["dataset"]).groupBy("dataset", "term").count()
    assert sorted(tfidf.document_frequencies(texts, by=["dataset"]).collect()) == sorted(old.collect())


def test_no_row_for_each_gram_before_the_shuffle(micro):
    for found in (redundancy.top_ngrams(micro), tfidf.document_frequencies(micro)):
        assert "Generate" not in plan(found) and "MapInArrow" in plan(found)
    assert "ngram" not in plan(richness.distinct_ngrams(micro))


def test_similarity_is_that_of_the_weights(texts):
    named = texts.filter(F.col(S.GROUP).isNotNull())
    w = tfidf.tfidf_weights(texts, by=["dataset"]).groupBy("dataset", S.GROUP, "term").agg(F.sum("w").alias("s"), F.sum(F.col("w") ** 2).alias("q"))
    sums = w.groupBy("dataset", S.GROUP).agg((F.sum(F.col("s") ** 2) - F.sum("q")).alias("d"))
    sizes = named.groupBy("dataset", S.GROUP).agg(F.count("*").alias("n")).join(sums, ["dataset", S.GROUP], "left")
    want = {(r[0], r[1]): (None if r.n < 2 else max(-1, min(1, (r.d or 0) / (r.n * (r.n - 1)))), r.n) for r in sizes.collect()}
    sims = similarity.tfidf_similarity(texts, by=["dataset"])
    got = {(r[0], r[1]): (r[2], r[3]) for r in sims.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert "Aggregate" not in plan(sims)  # read several times, computed once


def test_many_drawn_pairs(spark):
    n, cap, seed = 300, 20_000, 42
    df = spark.range(n).select(F.lit("g").alias(S.GROUP), F.format_string("c%03d", "id").alias(S.CAPTION), F.lit("t").alias(S.TEXT))
    found = pairs.same_group_pairs(df, cap=cap, seed=seed)
    total, chosen = n * (n - 1) // 2, []
    taken = set()
    for j in range(total - cap, total):
        t = int(hashlib.md5(f"{seed}:g:{j}".encode()).hexdigest()[:15], 16) % (j + 1)
        chosen.append(j if t in taken else t)
        taken.add(chosen[-1])
    ranks = [(k, j) for j in range(n) for k in range(j)]
    order = sorted(range(n), key=lambda i: hashlib.md5(f"{seed}:g:c{i:03d}".encode()).hexdigest())
    used = sorted({p for c in chosen for p in ranks[c]})
    at = {p: f"c{order[i]:03d}" for i, p in enumerate(used)}
    want = sorted(tuple(sorted((at[ranks[c][0]], at[ranks[c][1]]))) for c in chosen)
    assert sorted((r.caption_a, r.caption_b) for r in found.collect()) == want
    assert "array_position" not in plan(found) and "collect_list" not in plan(found)


def test_topics_plan_has_the_leading_terms_only(spark):
    df = spark.range(40).select(F.concat_ws(" ", F.lit("common"), F.concat(F.lit("rare"), F.col("id") % 20)).alias(S.TEXT))
    found = clustering.topics(df, k=2, terms=2, max_iter=2)
    assert {r.rank for r in found.collect()} == {0, 1} and all(r.term for r in found.collect())
    assert sum(f"rare{i}" in found._jdf.queryExecution().logical().toString() for i in range(20)) <= 4


def test_tiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([("g", str(i), x) for i, x in enumerate(v.tolist())], "motion_id string, caption_id string, vec array<double>")
    monkeypatch.setattr(metric, "TILE", 32)
    d = 1 - (v @ v.T)[np.triu_indices(90, 1)]
    row = blocks.caption_distances(df, block=8).collect()[0]
    assert row[2:] == pytest.approx((d.mean(), np.median(d), d.max(), d.min()))
    placed = metric.place(df.selectExpr("motion_id", "caption_id _id", "vec _vec"), ["motion_id"], 8)
    of = metric.tiles(metric.block_table(placed, ["motion_id"]), ["motion_id"])
    assert 2 <= of.select("_tile").distinct().count() <= 4
