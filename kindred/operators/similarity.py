"""Mean pairwise similarity of the captions inside each group, and its summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from kindred import schema as S
from kindred.functions.vectors import clip, l2_normalise, squared_norm
from kindred.lexicons import QUANTILES
from kindred.operators import grams, pieces
from kindred.operators.frames import attach, top_k
from kindred.operators.quantiles import exact_quantiles
from kindred.operators.tfidf import term_words
from kindred.storage import forget, materialise


#: The sums of terms are sent in so many turns, each with the buckets of one remainder: disk for one, at the price of cutting terms again.
TURNS = 2


def _from_sums(sum_norm: Column, norm_sum: Column, n: Column) -> Column:
    """Mean of all pairwise dots from ``|sum v|^2``, ``sum |v|^2`` and n; NULL below two vectors."""
    pairs = n.cast("double") * (n - F.lit(1))
    return F.when(n >= 2, clip((sum_norm - norm_sum) / pairs))


def vector_sums(df: DataFrame, keys: Sequence[str], vec_col: str, dim: int | None, **extra: Column) -> DataFrame:
    """Element-wise sum of a vector column per key as ``_sum array<double>``, plus extra aggregates.

    One array-valued aggregate of any length, combined map-side. ``dim`` only checks the length: a column per dimension
    would leave generated code at the widths of real embeddings.
    """
    aggs = [c.alias(name) for name, c in extra.items()]
    vector = F.col(vec_col)
    if dim is not None:
        size = F.size(vec_col)
        vector = F.when(size == dim, vector).otherwise(
            F.raise_error(F.concat(F.lit(f"expected vectors of {dim} values, found "), size.cast("string")))
        )
    total = Summarizer.sum(array_to_vector(vector)).alias("_sum")
    return df.groupBy(*keys).agg(total, *aggs).withColumn("_sum", vector_to_array("_sum"))


def dense_similarity(
    vectors: DataFrame,
    dim: int | None = None,
    by: Sequence[str] = (),
    group_col: str = S.GROUP,
    vec_col: str = "vec",
    normalise: bool = False,
) -> DataFrame:
    """Per group ``(similarity, number of vectors)`` for unit (or zero) vectors.

    Uses ``(|sum v|^2 - sum |v|^2) / (n (n - 1))``, which equals the mean over all pairs, needs one pass and
    combines map-side; a group holding a third of all rows is no special case. Vectors longer than 1 need
    ``normalise=True`` here, or :func:`kindred.operators.blocks.pairwise_similarity` for clipped raw dots.
    """
    ready = vectors.filter(F.col(group_col).isNotNull()).select(
        *by, group_col, (l2_normalise(F.col(vec_col)) if normalise else F.col(vec_col)).alias("_vec")
    )
    sums = vector_sums(
        ready,
        [*by, group_col],
        "_vec",
        dim,
        _norms=F.sum(squared_norm(F.col("_vec"))),
        num=F.count(F.lit(1)),
    )
    sim = _from_sums(squared_norm(F.col("_sum")), F.col("_norms"), F.col("num"))
    return sums.select(*by, group_col, sim.alias(S.SIM), F.col("num").alias(S.SIZE))


def tfidf_similarity(
    df: DataFrame,
    min_df: int | float = 2,
    max_df: int | float = 0.9,
    ngram_range: tuple[int, int] = (1, 2),
    by: Sequence[str] = (),
    group_col: str = S.GROUP,
    id_col: str = S.CAPTION,
    text_col: str = S.TEXT,
) -> DataFrame:
    """Group similarity under TF-IDF vectors.

    ``|sum v|^2`` is the sum over terms of squared per-term sums. Captions are stored in pieces that learn the frequencies of
    their terms (see :mod:`kindred.operators.pieces`); a piece then knows its captions' lengths, adds up its unit vectors for each group
    and sends the sums on, as numbers. A group of two or more captions whose vectors are
    all zero has similarity 0; below two captions it is NULL. Rows of one caption id in a group are one vector; only if there are
    any, the lengths of rows are looked up by id.
    The pieces, the group sizes, the frequencies and the result are written to the shared folder; only the result stays there.
    """
    by, (low, high) = list(by), ngram_range
    words, group, sizes = term_words(df, text_col), [*by, group_col], range(low, high + 1)
    base = materialise(pieces.pieces(df, words, by, {"_group": F.col(group_col), "_id": F.col(id_col)}), "pieces")
    captions = base.select(*by, "_piece", F.posexplode(F.arrays_zip("_at", "_group", "_id")).alias("_place", "_c")).select(
        *by, F.col("_c._group").alias(group_col), F.col("_c._id").alias("_id"), F.col("_c._at").alias("_at"), "_piece", "_place"
    )
    n_docs = materialise(base.groupBy(*by).agg(F.sum("_many").alias("_docs")), "sizes")
    groups = materialise(
        captions.filter(F.col(group_col).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("num"), F.min("_at").alias("_gid")), "groups"
    )
    located = captions.join(groups.select(*group, "_gid"), group, "left").select("_piece", "_place", "_at", "_gid", "_id")
    told = materialise(pieces.answers(base, by, sizes, " ", min_df if isinstance(min_df, int) else 0), "frequencies", compression="zstd")

    def weighted(row, piece, terms):
        """The squared lengths of the rows, and of each size the kept terms' rows and weights."""
        docs, parts, sq = row["_docs"], [], np.zeros(len(piece.lens))
        bound = lambda limit: limit if isinstance(limit, int) else limit * docs
        for n, bucket, ids, dfs, term, at, tf in terms:
            kept = (ids > 0) & (dfs >= bound(min_df)) & (dfs <= bound(max_df))
            some = kept[term]
            term, at = term[some], at[some]
            w = tf[some] * (np.log((1.0 + docs) / (1.0 + dfs)) + 1.0)[term]
            sq += np.bincount(at, weights=w * w, minlength=len(sq))
            parts.append((n, bucket, ids, term, at, w))
        return sq, parts

    def lengths(row, piece, terms):
        sq, _ = weighted(row, piece, terms)
        some = np.flatnonzero(sq)
        return [pa.RecordBatch.from_arrays([pa.array(np.array(row["_at"], np.int64)[some]), pa.array(sq[some])], names=["_at", "_sq"])]

    def sums(row, piece, terms, turn):
        sq, parts = weighted(row, piece, terms)
        total = np.array([x if t is None else t for x, t in zip(sq.tolist(), row["_totals"])], float)
        scale = np.divide(1.0, np.sqrt(total), out=np.zeros(len(sq)), where=total > 0)
        gids, which = np.unique(np.array([-1 if g is None else g for g in row["_gids"]], np.int64), return_inverse=True)
        out = []

        def cells(n, bucket, gid, ids, s):
            at = pieces.starts(bucket)
            columns = [pa.array(np.full(len(at) - 1, n, np.int32)), pa.array(bucket[at[:-1]].astype(np.int32))]
            columns += [pieces.cut(at, x) for x in (gid, pieces.steps(ids, at), s)]
            out.append(pa.RecordBatch.from_arrays(columns, names=["n", "_bucket", "_gids", "_ids", "_s"]))

        some = np.flatnonzero(gids >= 0)
        own = np.bincount(which, weights=sq * scale * scale, minlength=len(gids))[some]
        if turn == 0:
            cells(0, np.full(len(some), row["_piece"] % grams.BUCKETS), gids[some], np.zeros(len(some), np.int32), own)
        for n, bucket, ids, term, at, w in parts:
            some = (gids[which[at]] >= 0) & (bucket[term] % TURNS == turn)
            term, at, w = term[some], at[some], w[some]
            key, place = np.unique((bucket[term] * len(gids) + which[at]) * max(len(ids), 1) + term, return_inverse=True)
            term, gid = key % max(len(ids), 1), gids[key // max(len(ids), 1) % max(len(gids), 1)]
            cells(n, bucket[term], gid, ids[term], np.bincount(place, weights=w * scale[at], minlength=len(key)))
        return out

    def squares(batches):
        for (_, n), held in pieces.runs(batches, ["_bucket", "n"], ["_gids", "_ids", "_s"]):
            gid, ids, s = zip(*held)
            gid, s = (np.concatenate([pieces.uncut(x, kind) for x in part]) for part, kind in ((gid, np.int64), (s, np.float64)))
            ids = np.concatenate([np.cumsum(pieces.uncut(x, np.int32)) for x in ids])
            gids, which = np.unique(gid, return_inverse=True)
            many = int(ids.max(initial=0)) + 1
            pairs, at = np.unique(which * many + ids, return_inverse=True)
            s = np.bincount(at, weights=s, minlength=len(pairs))
            found = np.bincount(pairs // many, weights=s * s if n else s, minlength=len(gids))
            none = np.zeros(len(gids))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gids, found if n else none, none if n else found)], names=["_gid", "_ss", "_q"])

    ready = attach(base, n_docs, by)
    double = F.lit(None).cast("double")
    vector = ["_gid", "_id"]
    again = located.filter(F.col("_gid").isNotNull()).groupBy(*vector).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_vector")).filter(F.col("_n") > 1)
    stored = []
    if again.isEmpty():
        totals = located.withColumn("_total", double)
    else:
        named = again.select(F.col("_gid").alias("_g"), F.col("_id").alias("_i"), "_vector")
        rows = located.join(named, (F.col("_gid") == F.col("_g")) & F.col("_id").eqNullSafe(F.col("_i"))).select("_at", "_vector")
        one = materialise(pieces.met(ready, told, sizes, lengths, "_at bigint, _sq double", ["_docs", "_at"]), "lengths")
        whole = rows.join(one, "_at").groupBy("_vector").agg(F.sum("_sq").alias("_total"))
        totals = located.join(rows.join(whole, "_vector").select("_at", "_total"), "_at", "left")
        stored.append(one)
    facts = totals.groupBy("_piece").agg(F.sort_array(F.collect_list(F.struct("_place", "_gid", "_total"))).alias("_f"))
    ready = ready.join(facts.select("_piece", F.col("_f._gid").alias("_gids"), F.col("_f._total").alias("_totals")), "_piece")
    schema = "n int, _bucket int, _gids binary, _ids binary, _s binary"
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(TURNS):
        cells = pieces.met(ready, told, sizes, partial(sums, turn=turn), schema, ["_docs", "_gids", "_totals"])
        two = cells.repartition(tasks, "_bucket").sortWithinPartitions("_bucket", "n").mapInArrow(squares, "_gid bigint, _ss double, _q double")
        stored.append(materialise(two.groupBy("_gid").agg(F.sum("_ss").alias("_ss"), F.sum("_q").alias("_q")), "sums"))
    found = reduce(DataFrame.unionByName, stored[-TURNS:]).groupBy("_gid").agg(F.sum("_ss").alias("_sum_norm"), F.sum("_q").alias("_norms"))
    zero = F.lit(0.0)
    sim = _from_sums(F.coalesce("_sum_norm", zero), F.coalesce("_norms", zero), F.col("num"))
    result = materialise(groups.join(found, "_gid", "left").select(*group, sim.alias(S.SIM), F.col("num").alias(S.SIZE)), "similarity")
    for table in (base, n_docs, groups, told, *stored):
        forget(table)
    return result


def most_consistent(sims: DataFrame, k: int = 10, group_col: str = S.GROUP, by: Sequence[str] = ()) -> DataFrame:
    """Highest similarity first, groups without a similarity last, ties by group."""
    return _ranked(sims, k, group_col, by, F.col(S.SIM).desc_nulls_last())


def least_consistent(sims: DataFrame, k: int = 10, group_col: str = S.GROUP, by: Sequence[str] = ()) -> DataFrame:
    """Lowest similarity first, groups without a similarity last, ties by group."""
    return _ranked(sims, k, group_col, by, F.col(S.SIM).asc_nulls_last())


def _ranked(sims: DataFrame, k: int, group_col: str, by: Sequence[str], order: Column) -> DataFrame:
    return top_k(sims, k, order, [group_col], by)


def similarity_summary(
    sims: DataFrame, by: Sequence[str] = (), probs: Sequence[float] = QUANTILES
) -> DataFrame:
    """``mean_of_means``, ``median_of_means`` and a quantile map over the groups that have a similarity."""
    wanted = [*probs, 0.5]
    quantiles = exact_quantiles(sims, S.SIM, wanted, by, extra={"mean_of_means": F.avg})
    as_map = F.map_from_arrays(
        F.array(*[F.lit(float(p)) for p in probs]), F.slice("quantiles", 1, len(probs))
    )
    return quantiles.select(
        *by,
        "mean_of_means",
        F.get("quantiles", F.lit(len(probs))).alias("median_of_means"),
        as_map.alias("quantiles"),
    )


def stack_backends(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One long similarity table with a ``backend`` column."""
    labelled = [t.withColumn("backend", F.lit(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), labelled)


def backend_comparison(
    tables: Mapping[str, DataFrame], probs: Sequence[float] = QUANTILES, by: Sequence[str] = ()
) -> DataFrame:
    """One summary row per backend (and corpus). Each table is summarised by itself: joined on a backend name that is
    a literal, the rows of one backend would meet without a key."""
    return stack_backends({name: similarity_summary(t, by, probs) for name, t in tables.items()}).select(
        "backend", *by, "mean_of_means", "median_of_means", "quantiles"
    )
