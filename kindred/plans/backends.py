"""Where caption vectors come from. A backend turns a caption table into a group-similarity table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, functions as F

from kindred import schema as S
from kindred.operators.embedding import encode_distinct
from kindred.operators.similarity import dense_similarity, tfidf_similarity


class Backend(Protocol):
    def similarity(self, captions: DataFrame, by: Sequence[str] = ()) -> DataFrame: ...


@dataclass(frozen=True)
class Tfidf:
    """Built-in sparse vectors, fitted on the captions themselves (per ``by`` key)."""

    min_df: int | float = 2
    max_df: int | float = 0.9
    ngram_range: tuple[int, int] = (1, 2)

    def similarity(self, captions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        return tfidf_similarity(captions, self.min_df, self.max_df, self.ngram_range, by)


@dataclass(frozen=True)
class Precomputed:
    """Vectors from a table keyed by corpus (the ``by`` columns, which it must have) and caption.

    ``normalise=False`` when they are unit vectors already. A key with two vectors fails the query. So does a caption without
    one, since a similarity of part of the captions would pass for one of all; with ``missing="count"`` the groups are
    those of the captions that have one, their size says how many that are, and :meth:`coverage` how many have none.
    """

    vectors: DataFrame
    dim: int | None = None
    id_col: str = S.CAPTION
    vec_col: str = "vec"
    normalise: bool = True
    missing: str = "fail"

    def _table(self, by: Sequence[str]) -> DataFrame:
        lacking = set(by) - set(self.vectors.columns)
        if lacking:
            raise ValueError(f"the vectors have no column {sorted(lacking)}, so corpora would share them")
        table = self.vectors.select(*by, F.col(self.id_col).alias(S.CAPTION), F.col(self.vec_col).alias("vec"))
        return table.groupBy(*by, S.CAPTION).agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("_copies"))

    def coverage(self, captions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """``(by, num_with_vector, num_missing)``."""
        known = self._table(by).select(*by, S.CAPTION, F.lit(1).alias("_known"))
        return captions.select(*by, S.CAPTION).join(known, [*by, S.CAPTION], "left").groupBy(*by).agg(
            F.count("_known").alias("num_with_vector"), F.count_if(F.col("_known").isNull()).alias("num_missing")
        )

    def similarity(self, captions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        key = [*by, S.CAPTION]
        if self.missing not in ("fail", "count"):
            raise ValueError(f"missing must be 'fail' or 'count', not {self.missing!r}")
        checked = F.when(F.col("_copies") == 1, F.col("vec")).otherwise(F.raise_error(F.concat_ws(
            " ", F.lit("not exactly one vector for caption"), *[F.col(c).cast("string") for c in key]
        )))
        how = "left" if self.missing == "fail" else "inner"
        joined = captions.select(*by, S.GROUP, S.CAPTION).join(self._table(by), key, how).withColumn("vec", checked)
        return dense_similarity(joined, self.dim, by, normalise=self.normalise)


@dataclass(frozen=True)
class Encoder:
    """Vectors from a user encoder, loaded once per task, which sees every different text once."""

    make_encoder: Callable[[], Callable[[list[str]], np.ndarray]]
    dim: int | None = None
    batch_size: int = 128
    profile: ResourceProfile | None = None

    def similarity(self, captions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        named = captions.select(*by, S.GROUP, S.TEXT)
        vectors = encode_distinct(named, self.make_encoder, batch_size=self.batch_size, profile=self.profile)
        return dense_similarity(vectors, self.dim, by)
