"""Helpers the training-data operators share."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kindred.storage import forget, materialise, scratch, shared_dir

__all__ = ["forget", "materialise", "scratch", "shared_dir"]

MASK32 = 0xFFFFFFFF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def two_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the key and the text (null: empty), whatever other columns there are."""
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def scalar_row(df: DataFrame) -> Column:
    """A one-row frame as a struct-valued subquery."""
    return df.select(F.struct("*").alias("row")).scalar()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers from a seed."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        return mix(steps) | np.uint64(1)


class WordCodes(dict):
    """64-bit hash of each distinct word (as bytes); forgets all words when it holds too many."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(codes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash for each run of k codes."""
    n = len(codes) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i, c in enumerate(odd_constants(k, seed)):
        out += codes[i : i + len(out)] * c
    return mix(out)


def split_words(text: bytes) -> list[bytes]:
    """Words between space, tab, line feed, vertical tab, form feed and carriage return (what bytes.split means)."""
    return text.split()


def give_back() -> None:
    """Return freed memory to the system: worker processes live on, and what they keep counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
