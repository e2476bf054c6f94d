"""N-grams of token arrays, counted in Arrow batches and dealt to buckets by their hash.

A task numbers the words of a piece of its captions, so that a gram is one integer, and counts there; only the different
grams of a piece leave it, those of one bucket as one row of bytes. All rows of a bucket meet in one task, which holds one bucket at
a time. Buckets are many more than partitions: what a task holds is the grams of the corpus divided by ``BUCKETS``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

BUCKETS = 2048
#: words that are counted together
PIECE = 1 << 20


def _paired(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """One number for each different pair; ``b`` is below ``size``."""
    if len(a) and int(a.max()) >= (1 << 62) // max(size, 1):
        a = np.unique(a, return_inverse=True)[1]
    return a.astype(np.int64) * size + b


def _counter(keys: list[str], carried: list[str], sizes: list[int], separator: str, per_row: bool, whole_row: bool):
    """Arrow batches ``(keys, carried, _words)`` to cells: one row per key, gram size and bucket.

    ``per_row`` counts within a row, and each gram has its row's carried values; ``whole_row`` counts the rows that have a gram.
    """

    def cells(batch: pa.RecordBatch, group: np.ndarray, names: list[tuple]) -> Iterator[dict]:
        lists = batch.column("_words")
        lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        words = lists.flatten()
        row = np.repeat(np.arange(batch.num_rows), lengths)
        coded = words.dictionary_encode()
        code, v = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        crc = np.array([zlib.crc32(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
        number, hashed = code, crc[code] if v else np.zeros(0, np.uint64)
        for n in range(1, max(sizes) + 1):
            if n > 1:
                number, hashed = _paired(number[:-1], code[n - 1:], v), hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + crc[code[n - 1:]]
            if n not in sizes:
                continue
            inside = np.flatnonzero(row[: len(number)] == row[n - 1:])
            which = row[inside]
            grams = _paired(number[inside], which if per_row or whole_row else group[which], batch.num_rows if per_row or whole_row else len(names))
            _, first, count = np.unique(grams, return_index=True, return_counts=True)
            first = inside[first]
            if whole_row:  # from rows to the rows of a key
                _, again, count = np.unique(_paired(number[first], group[row[first]], len(names)), return_index=True, return_counts=True)
                first = first[again]
            mixed = hashed[first]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            bucket = (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS
            place = group[row[first]] * BUCKETS + bucket
            order = np.argsort(place, kind="stable")
            first, place, count = first[order], place[order], count[order]
            at = np.concatenate((np.flatnonzero(np.diff(place, prepend=-1)), [len(place)])).astype(np.int32)
            parts = [words.take(pa.array(first + j)) for j in range(n)]
            joined = (pc.binary_join_element_wise(*parts, separator) if n > 1 else parts[0]).cast(pa.binary())
            ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
            yield {
                "n": n, "group": place[at[:-1]] // BUCKETS, "bucket": place[at[:-1]] % BUCKETS, "at": at,
                "bytes": (ends[at], joined.buffers()[2] if len(joined) else pa.py_buffer(b"")), "sizes": np.diff(ends).astype(np.int32),
                "counts": count.astype(np.int64), "rows": row[first],
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            total = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(whole.column("_words")), 0)))
            cuts = np.unique(np.concatenate(([0], np.searchsorted(total, np.arange(PIECE, int(total[-1]) if len(total) else 0, PIECE)), [whole.num_rows])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                batch = whole.slice(a, b - a)
                index: dict[tuple, int] = {}
                key_rows = zip(*[batch.column(k).to_pylist() for k in keys]) if keys else [()] * batch.num_rows
                group = np.array([index.setdefault(k, len(index)) for k in key_rows], np.int64)
                names = list(index)
                for cell in cells(batch, group, names):
                    at, many = cell["at"], len(cell["at"]) - 1
                    binary = lambda ends, data: pa.BinaryArray.from_buffers(pa.binary(), many, [None, pa.py_buffer(ends.astype(np.int32)), data])
                    packed = lambda values: binary(at * values.dtype.itemsize, pa.py_buffer(np.ascontiguousarray(values)))
                    out = [pa.array([names[g][i] for g in cell["group"].tolist()], batch.schema.field(k).type) for i, k in enumerate(keys)]
                    out += [pa.array(np.full(many, cell["n"], np.int32)), pa.array(cell["bucket"].astype(np.int32))]
                    out += [binary(*cell["bytes"]), packed(cell["sizes"]), packed(cell["counts"])]
                    out += [packed(batch.column(c).to_numpy(zero_copy_only=False)[cell["rows"]]) for c in carried]
                    yield pa.RecordBatch.from_arrays(out, names=[*keys, "n", "_bucket", "_bytes", "_sizes", "_counts", *[f"_{c}" for c in carried]])

    return run


def _gatherer(keys: list[str], carried: dict[str, type], outputs: pa.Schema, measure: Callable):
    """Sorted cells to ``measure(key, grams, counts, carried)`` of everything in a bucket, as columns without the keys."""
    columns = ["_bytes", "_sizes", "_counts", *[f"_{c}" for c in carried]]

    def made(key: tuple, held: list[tuple], types: list) -> pa.RecordBatch:
        data, lengths, counts, *more = (b"".join(part) for part in zip(*held))
        ends = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, np.int32), dtype=np.int64)))
        grams = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))
        values = measure(key, grams, np.frombuffer(counts, np.int64), *[np.frombuffer(m, t) for m, t in zip(more, carried.values())])
        many = len(next(iter(values.values())))
        out = [pa.array([k] * many, t) for k, t in zip(key, types)]
        return pa.RecordBatch.from_arrays([*out, *[pa.array(values[f.name], f.type) for f in outputs]], names=[*keys, *outputs.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, types = [], None, []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            for i, now in enumerate(zip(batch.column("_bucket").to_pylist(), *[batch.column(k).to_pylist() for k in keys])):
                if now != last and held:
                    yield made(last[1:], held, types)
                    held = []
                last = now
                held.append(tuple(batch.column(c)[i].as_py() for c in columns))
        if held:
            yield made(last[1:], held, types)

    return run


def gathered(
    df: DataFrame, words: Column, by: Sequence[str], sizes: Sequence[int], separator: str,
    outputs: dict[str, tuple[pa.DataType, str]], measure: Callable,
    carried: Sequence[str] = (), per_row: bool = False, whole_row: bool = False,
) -> DataFrame:
    """``(by, n, outputs)`` of ``measure(key, grams, counts, *carried)``, called once per bucket, ``by`` key and gram size.

    ``key`` is the ``by`` values and n. ``grams`` come once per piece of captions (``per_row``: once per row), with
    their counts and, for numeric columns ``carried``, the values of their row. Null words must not occur.
    """
    by, carried = list(by), list(carried)
    ready = df.select(*by, *carried, words.alias("_words"))
    kinds = {c: np.dtype({"bigint": "int64", "double": "float64"}[ready.schema[c].dataType.simpleString()]).type for c in carried}
    fields = [ready.schema[c] for c in by]
    binary = [T.StructField(c, T.BinaryType()) for c in ("_bytes", "_sizes", "_counts", *[f"_{c}" for c in carried])]
    middle = T.StructType([*fields, T.StructField("n", T.IntegerType()), T.StructField("_bucket", T.IntegerType()), *binary])
    cells = ready.mapInArrow(_counter(by, carried, list(sizes), separator, per_row, whole_row), middle)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, "n"]
    arrow = pa.schema([(name, kind) for name, (kind, _) in outputs.items()])
    out = T.StructType([*fields, T.StructField("n", T.IntegerType()), *[T.StructField(name, T._parse_datatype_string(s)) for name, (_, s) in outputs.items()]])
    return cells.repartition(tasks, "_bucket").sortWithinPartitions("_bucket", *keys).mapInArrow(_gatherer(keys, kinds, arrow, measure), out)


def totals(grams: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Each different gram and the sum of its counts."""
    coded = grams.dictionary_encode()
    summed = np.bincount(coded.indices.to_numpy(), weights=counts, minlength=len(coded.dictionary))
    return coded.dictionary, summed.astype(np.int64)


def counts(
    df: DataFrame, words: Column, by: Sequence[str], sizes: Sequence[int], separator: str = " ", whole_row: bool = False, k: int | None = None
) -> DataFrame:
    """``(by, n, ngram, cnt)``; with ``k`` at least the k most frequent of each key and n, equal counts by the smaller gram."""

    def measure(key, grams, counted):
        names, cnt = totals(grams, counted)
        if k is not None and len(cnt) > k:
            least = np.partition(cnt, len(cnt) - k)[len(cnt) - k]
            some = np.flatnonzero(cnt >= least)
            order = pc.sort_indices(pa.table({"c": cnt[some], "g": names.take(pa.array(some))}), sort_keys=[("c", "descending"), ("g", "ascending")])
            best = some[order.to_numpy()[:k]]
            names, cnt = names.take(pa.array(best)), cnt[best]
        return {"ngram": names.cast(pa.string()), "cnt": cnt}

    outputs = {"ngram": (pa.string(), "string"), "cnt": (pa.int64(), "bigint")}
    return gathered(df, words, by, sizes, separator, outputs, measure, whole_row=whole_row)
