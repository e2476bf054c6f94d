"""Captions in pieces: disk of the similarity of large corpora, and topics without a vocabulary on the driver."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred import schema as S
from kindred.operators import clustering, lda, pieces, similarity, tfidf
from kindred.storage import CLEANUP, materialise


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i:02d}" for i in range(40)] + ["élan", "ab", "ab_"]
    rows = [("x" if i % 3 else "y", f"g{i % 3}", f"c{i}", " ".join(rng.choice(words, i % 13))) for i in range(120)]
    return spark.createDataFrame(rows, f"dataset string, {S.GROUP} string, {S.CAPTION} string, {S.TEXT} string").repartition(3)


def test_shuffles_of_a_stored_table_are_removed(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for d in manager.localDirsString() for _, _, names in os.walk(d) for name in names if name.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(CLEANUP)
    stored = materialise(spark.range(100_000).repartition(7, "id"), "ids")
    until = time.time() + 10
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(CLEANUP) == setting
    assert stored.count() == 100_000


def test_cut_cells():
    values, at = np.array([3, -1, 70_000, 5, 9], np.int32), np.array([0, 2, 2, 5])
    cells = pieces.cut(at, values).to_pylist()
    assert [pieces.uncut(c, np.int32).tolist() for c in cells] == [[3, -1], [], [70_000, 5, 9]]
    stepped = pieces.steps(values, at)
    assert stepped.dtype == values.dtype and np.cumsum(stepped[2:]).tolist() == values[2:].tolist()


@pytest.mark.parametrize("size", [1 << 20, 40])
def test_terms_of_pieces(spark, texts, monkeypatch, size):
    monkeypatch.setattr(pieces, "PIECE", size)
    base = materialise(pieces.pieces(texts, tfidf.term_words(texts), ["dataset"], {"_id": F.col(S.CAPTION)}), "pieces")
    assert base.select(F.sum("_many")).first()[0] == 120 and (base.count() > 10) == (size == 40)
    told = materialise(pieces.answers(base, ["dataset"], [1, 2], " ", 2, names=True), "answers")

    def use(row, piece, terms):
        out = []
        for n, bucket, ids, dfs, term, at, tf in terms:
            out += [(row["dataset"], row["_id"][r], n, int(bucket[t]), int(ids[t]), int(dfs[t]), int(f)) for t, r, f in zip(term, at, tf) if ids[t]]
        names = ["dataset", "id", "n", "bucket", "number", "df", "tf"]
        return [pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out], schema)]

    kinds = {"dataset": pa.string(), "id": pa.string(), "n": pa.int32(), "bucket": pa.int32(), "number": pa.int32(), "df": pa.int64(), "tf": pa.int64()}
    schema = pa.schema(list(kinds.items()))
    found = pieces.met(base, told, [1, 2], use, "dataset string, id string, n int, bucket int, number int, df bigint, tf bigint", ["dataset", "_id"])
    names = {
        (r.dataset, r.n, r._bucket, i): name.decode()
        for r in told.filter("_piece = -1").collect() for i, name in enumerate(bytes(r._names).split(pieces.END)[:-1], 1)
    }
    got = sorted((r.dataset, r.id, names[r.dataset, r.n, r.bucket, r.number], r.df, r.tf) for r in found.collect())
    long = tfidf.caption_terms(texts, by=["dataset"])
    df = long.groupBy("dataset", "term").agg(F.count("*").alias("df")).filter("df >= 2")
    assert got == sorted((r.dataset, r[1], r.term, r.df, r.tf) for r in long.join(df, ["dataset", "term"]).select("dataset", S.CAPTION, "term", "df", "tf").collect())
    assert len(set(names.values())) == len({r.term for r in df.collect()})


def test_similarity_in_small_pieces_and_turns(texts, monkeypatch):
    """Whole pieces, pieces of few captions and another number of turns agree; captions of one id in several pieces are one vector."""
    again = texts.withColumn(S.CAPTION, F.when(F.col(S.CAPTION) < "c3", "same").otherwise(F.col(S.CAPTION)))
    of = lambda: [{tuple(r)[:2]: r[2] for r in similarity.tfidf_similarity(t, by=["dataset"]).collect()} for t in (texts, again)]
    whole = of()
    monkeypatch.setattr(pieces, "PIECE", 40)
    monkeypatch.setattr(similarity, "TURNS", 3)
    small = of()
    for a, b in zip(whole, small):
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    assert whole[0] != whole[1]


def brute_topics(docs, size, k, rounds, seed):
    """``docs``: (row, {number: count}); one caption and one term at a time, as the estimator's own description has it."""
    expect = lambda a: lda.digamma(np.array(a)) - lda.digamma(np.array(a).sum())
    lam, alpha, done = lda.started(seed, k, np.arange(size)), np.full(k, 1 / k), 0
    for t in range(rounds):
        drawn = [(r, c, int(lda.times_drawn(lda.hashed(seed, 2, t, np.array([r])))[0])) for r, c in docs]
        drawn = [(r, c) for r, c, n in drawn for _ in range(n)]
        if not drawn:
            continue
        done += 1
        beta = np.exp(np.array([expect(x) for x in lam]))
        stat, logs, many = np.zeros(lam.shape), np.zeros(k), 0
        for r, c in drawn:
            if not c:
                continue
            ids, x = np.array(sorted(c)), np.array([c[i] for i in sorted(c)], float)
            gamma = np.array([lda.gammas(lda.hashed(seed, 3, t, j, np.array([r])))[0] for j in range(k)])
            theta, change = np.exp(expect(gamma)), 1.0
            norm = theta @ beta[:, ids] + 1e-100
            while change > 1e-3:
                last, gamma = gamma, theta * (beta[:, ids] @ (x / norm)) + alpha
                theta = np.exp(expect(gamma))
                norm, change = theta @ beta[:, ids] + 1e-100, np.abs(gamma - last).sum() / k
            stat[:, ids] += np.outer(theta, x / norm)
            logs, many = logs + expect(gamma), many + 1
        if many:
            rho = (1024 + done) ** -0.51
            lam = (1 - rho) * lam + rho * (stat * beta * len(docs) / np.ceil(0.05 * len(docs)) + 1 / k)
            alpha = lda.next_alpha(alpha, logs, many, rho)
    return lam


@pytest.mark.parametrize("slot, size", [(1 << 17, 1 << 20), (16, 150)])
def test_topics_on_tables_equal_brute_force(spark, texts, monkeypatch, slot, size):
    monkeypatch.setattr(lda, "SLOT", slot)
    monkeypatch.setattr(pieces, "PIECE", size)
    base = materialise(pieces.pieces(texts, tfidf.term_words(texts), [], {"_id": F.col(S.CAPTION)}), "pieces")
    told = materialise(pieces.answers(base, [], [1, 2], " ", 2, names=True), "answers")
    total, offsets = lda.numbered(told)
    long = texts.transform(tfidf.caption_terms).select(S.CAPTION, "term", "tf").collect()
    names = {}
    for r in told.filter("_piece = -1").collect():
        for i, name in enumerate(bytes(r._names).split(pieces.END)[:-1]):
            names[name.decode()] = int(offsets[r.n][r._bucket]) + i
    assert sorted(names.values()) == list(range(total))
    of = {}
    for r in long:
        if r.term in names:
            of.setdefault(r[0], {})[names[r.term]] = r.tf
    rows = base.select(F.explode(F.arrays_zip("_at", "_id")).alias("c")).select("c.*").collect()
    want = brute_topics([(r._at, of.get(r._id, {})) for r in rows], total, 3, 4, 42)
    slots, sums = lda.fitted(base, told, 3, 4, 42)
    assert sums == pytest.approx(want.sum(1)) and slots.count() == -(-total // slot)
    got = {(t, name): w for t, _, name, w in lda.leading(slots, told, sums, total)}
    share = want / want.sum(1, keepdims=True)
    assert len(got) == 3 * total and all(got[t, n] == pytest.approx(share[t, i], rel=1e-4) for n, i in names.items() for t in range(3))


def test_topics_beyond_the_limit(spark):
    """Two kinds of captions: each topic's first words are of one kind. The result has the estimator's columns and order."""
    kinds = {0: [f"cat{i}" for i in range(6)], 1: [f"sea{i}" for i in range(6)]}
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(" ".join(rng.choice(kinds[i % 2], 12)),) for i in range(600)] + [(None,), ("",)], f"{S.TEXT} string")
    small = clustering.topics(df, k=2, terms=5, max_iter=3)
    found = clustering.topics(df, k=2, terms=5, max_iter=12, limit=0)
    assert found.schema.simpleString() == small.schema.simpleString()
    rows = found.collect()
    assert [(r.topic, r["rank"]) for r in rows] == [(t, i) for t in range(2) for i in range(5)]
    for t in range(2):
        weights = [r.weight for r in rows if r.topic == t]
        assert weights == sorted(weights, reverse=True) and 0 < sum(weights) < 1
    assert [{r.term[:3] for r in rows if r.topic == t} for t in range(2)] in ([{"cat"}, {"sea"}], [{"sea"}, {"cat"}])


def test_draws():
    keys = lda.hashed(5, np.arange(200_000))
    g = lda.gammas(keys)
    assert g.mean() == pytest.approx(1, abs=1e-3) and g.var() == pytest.approx(0.01, rel=0.02)
    times = lda.times_drawn(keys)
    assert times.mean() == pytest.approx(0.05, rel=0.05) and times.max() >= 2
    assert lda.digamma(np.array([1.0, 0.1]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert float(lda.trigamma(np.array(1.0))) == pytest.approx(np.pi**2 / 6, abs=1e-11)
