"""Topics as non-negative factors of the long term table: no vocabulary on the driver, and a result that SQL can repeat.

The counts x of terms in captions are approximated by w h with k columns; both factors start from hashes and take a fixed number of
multiplicative updates. A factor is a table with an array of k numbers per caption or term. An update is one join of the long
table with the other factor, k sums that combine map-side, and a k by k matrix that is the only thing every row sees. The
terms never leave the tables: the dictionary is the table of h itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred import schema as S
from kindred.operators.frames import attach, top_k
from kindred.operators.tfidf import caption_terms
from kindred.storage import forget, materialise

TINY = 1e-12


def start(name: Column, kind: str, k: int) -> Column:
    """k numbers in [0.5, 1.5) from the MD5 of the name."""
    def one(j: int) -> Column:
        digest = F.md5(F.concat(F.lit(f"{kind}{j}:"), name).cast("binary"))
        return F.lit(0.5) + F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))

    return F.array(*[one(j) for j in range(k)])


def _gram(factor: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """``(by, _g)``: the k by k products of the factor's columns, row by row."""
    cell = lambda i, j: F.sum(F.get("_f", F.lit(i)) * F.get("_f", F.lit(j)))
    return factor.groupBy(*by).agg(F.array(*[cell(i, j) for i in range(k) for j in range(k)]).alias("_g"))


def updated(counts: DataFrame, mine: DataFrame, other: DataFrame, name: str, other_name: str, by: Sequence[str], k: int) -> DataFrame:
    """``mine`` (by, name, _f) after one update with the other factor (by, other_name, _f)."""
    by = list(by)
    met = counts.join(other, [*by, other_name])
    sums = met.groupBy(*by, name).agg(
        F.array(*[F.sum(F.col("x") * F.get("_f", F.lit(j))) for j in range(k)]).alias("_s")
    )
    ready = attach(mine.join(sums, [*by, name]), _gram(other, by, k), by)

    def value(j: int) -> Column:
        below = sum((F.get("_f", F.lit(i)) * F.get("_g", F.lit(i * k + j)) for i in range(k)), F.lit(0.0))
        return F.get("_f", F.lit(j)) * F.get("_s", F.lit(j)) / (below + F.lit(TINY))

    return ready.select(*by, name, F.array(*[value(j) for j in range(k)]).alias("_f"))


def factor_topics(
    df: DataFrame, k: int = 3, terms: int = 12, rounds: int = 10, min_df: int = 2, by: Sequence[str] = (),
    ngram_range: tuple[int, int] = (1, 2), id_col: str = S.CAPTION, text_col: str = S.TEXT,
) -> DataFrame:
    """``(by, topic, rank, term, weight)`` of the leading terms of each topic; a topic's weights over all terms add up to 1.

    Terms in fewer than ``min_df`` captions are left out. Captions are known by ``id_col`` within their corpus.
    """
    by = list(by)
    named = df.filter(F.col(text_col).isNotNull())
    long = caption_terms(named, ngram_range, by, S.GROUP, id_col, text_col).select(
        *by, F.col(id_col).alias("doc"), "term", F.col("tf").cast("double").alias("x")
    )
    often = long.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("_df")).filter(F.col("_df") >= min_df).drop("_df")
    counts = materialise(long.join(often, [*by, "term"]), "terms")
    first = lambda name, kind: materialise(
        counts.select(*by, name).distinct().withColumn("_f", start(F.col(name).cast("string"), kind, k)), "factor"
    )
    w, h = first("doc", "w"), first("term", "h")
    for _ in range(rounds):
        for mine, other in (("term", "doc"), ("doc", "term")):
            old, fixed = (h, w) if mine == "term" else (w, h)
            new = materialise(updated(counts, old, fixed, mine, other, by, k), "factor")
            forget(old)
            h, w = (new, w) if mine == "term" else (h, new)
    flat = h.select(*by, "term", F.posexplode("_f").alias("topic", "_v"))
    totals = flat.groupBy(*by, "topic").agg(F.sum("_v").alias("_total"))
    weights = flat.join(totals, [*by, "topic"]).select(*by, "topic", "term", (F.col("_v") / F.col("_total")).alias("weight"))
    best = top_k(weights, terms, "weight", ["term"], [*by, "topic"])
    place = F.row_number().over(Window.partitionBy(*by, "topic").orderBy(F.desc("weight"), "term"))
    return best.select(*by, "topic", (place - 1).alias("rank"), "term", "weight")
