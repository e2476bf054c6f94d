"""Caption clusters and coarse topics, on the distributed estimators of ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from kindred import schema as S
from kindred.functions.text import TERM_PATTERN, let, ngrams
from kindred.operators import lda, pieces
from kindred.operators.frames import top_k
from kindred.storage import forget, materialise

#: numbers that the topics' estimator may keep on the driver, as one matrix of several
ON_DRIVER = 1 << 20


def cluster_captions(vectors: DataFrame, k: int = 20, seed: int = 42, vec_col: str = "vec") -> DataFrame:
    """Add a ``cluster`` column."""
    ready = vectors.withColumn("_features", array_to_vector(F.col(vec_col)))
    kept = ready.select("_features").persist()
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(kept)
    kept.unpersist()
    return model.transform(ready).drop("_features")


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("cnt"))


def largest_clusters(clustered: DataFrame, k: int = 5) -> DataFrame:
    return top_k(cluster_sizes(clustered), k, "cnt", ["cluster"])


def topics(
    df: DataFrame,
    k: int = 3,
    terms: int = 12,
    vocab_size: int | None = None,
    min_df: float = 2.0,
    max_iter: int = 10,
    seed: int = 42,
    text_col: str = S.TEXT,
    limit: int = ON_DRIVER,
) -> DataFrame:
    """``(topic, rank, term, weight)`` of the leading unigrams and bigrams of each topic.

    The vocabulary is what ``min_df`` keeps; ``vocab_size`` bounds it further if given. The estimator keeps a number for each topic
    and term on the driver; beyond ``limit`` of them the same method runs on tables (:mod:`kindred.operators.lda`), from another
    random start. A ``vocab_size`` is taken as the caller's bound for the driver.
    """
    tokens = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TERM_PATTERN), F.lit(0))
    named = df.filter(F.col(text_col).isNotNull())
    if not vocab_size:
        base = materialise(pieces.pieces(named, tokens), "pieces")
        least = min_df if min_df >= 1 else min_df * (base.agg(F.sum("_many")).first()[0] or 0)
        told = materialise(pieces.answers(base, [], [1, 2], " ", least, names=True), "frequencies", compression="zstd")
        found = None
        if lda.numbered(told)[0] * k > limit:
            slots, sums = lda.fitted(base, told, k, max_iter, seed)
            found = lda.leading(slots, told, sums, terms)
            forget(slots)
        forget(base)
        forget(told)
        if found is not None:
            return df.sparkSession.createDataFrame(found, "topic int, rank int, term string, weight double")
    grams = let(tokens, lambda t: F.concat(t, ngrams(t, 2)))
    prepared = named.select(grams.alias("_terms"))
    counter = CountVectorizer(
        inputCol="_terms", outputCol="features", vocabSize=vocab_size or (1 << 31) - 1, minDF=min_df
    ).fit(prepared)
    counted = counter.transform(prepared).select("features").persist()
    model = LDA(k=k, maxIter=max_iter, seed=seed).fit(counted)
    counted.unpersist()
    described = model.describeTopics(terms)
    # The vocabulary stays in the JVM: only the terms that lead a topic are fetched and become part of the plan.
    words = counter._java_obj.vocabulary()
    leading = sorted({i for row in described.select("termIndices").collect() for i in row.termIndices})
    names = F.create_map(*[F.lit(x) for i in leading for x in (i, words[i])]) if leading else F.lit(None).cast("map<int,string>")
    return described.select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "_t")
    ).select(
        "topic", "rank", F.try_element_at(names, F.col("_t.termIndices")).alias("term"), F.col("_t.termWeights").alias("weight")
    )
