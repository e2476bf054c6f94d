"""Captions in pieces whose terms are known by number: no row leaves a task for each term of a caption.

A piece is up to ``PIECE`` words of captions of one corpus, stored as one row of bytes. Its different terms go to buckets as bytes, once
per piece. A bucket counts the captions that have a term, numbers the terms that are in enough of them, and answers each piece with
the numbers and counts in the order the piece sent its terms. A piece that meets its answers has the terms of its captions as numbers,
so what it sends on are numbers too.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from kindred.operators.grams import BUCKETS, _paired

#: words and captions of a piece
PIECE = 1 << 20
#: ends each term in the bytes of a bucket; no byte of UTF-8
END = b"\xff"


def squeeze(values: np.ndarray | bytes) -> bytes:
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def loose(data: bytes, kind: type | None = None) -> np.ndarray | bytes:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], n, codec="zstd", asbytes=True) if n else b""
    return raw if kind is None else np.frombuffer(raw, kind)


def pieces(df: DataFrame, words: Column, by: Sequence[str] = (), carried: dict[str, Column] | None = None) -> DataFrame:
    """``(by, _piece, _many, _at, carried, bytes)``, to be materialised: ``_at`` numbers the rows, ``_piece`` is the first of them.

    ``_at`` and what is carried are arrays with a value per caption. Null words must not occur; captions without words are rows too.
    """
    by, carried = list(by), carried or {}
    ready = df.select(*by, *[c.alias(name) for name, c in carried.items()], F.monotonically_increasing_id().alias("_at"), words.alias("_words"))
    lists = ["_at", *carried]

    def made(key: tuple, held: list[pa.RecordBatch], fields: list[pa.Field]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        captions = table.column("_words")
        coded = captions.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.binary())
        order = pc.sort_indices(names)  # so that neighbours in a bucket have numbers close to each other
        rank = np.empty(len(names), np.int32)
        rank[order.to_numpy()] = np.arange(len(names), dtype=np.int32)
        names = names.take(order).to_pylist()
        blobs = {
            "_lens": np.asarray(pc.fill_null(pc.list_value_length(captions), 0), np.int32), "_codes": rank[coded.indices.to_numpy()],
            "_ends": np.cumsum([len(x) for x in names], dtype=np.int64).astype(np.int32), "_names": b"".join(names),
        }
        many = table.num_rows
        out = [pa.array([x], f.type) for x, f in zip(key, fields)] + [table.column("_at")[:1], pa.array([many], pa.int32())]
        out += [pa.ListArray.from_arrays(pa.array([0, many], pa.int32()), table.column(c)) for c in lists]
        out += [pa.array([squeeze(b)], pa.binary()) for b in blobs.values()]
        return pa.RecordBatch.from_arrays(out, names=[*by, "_piece", "_many", *lists, *blobs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        size: dict[tuple, int] = {}
        fields: list[pa.Field] = []
        for whole in batches:
            fields = [whole.schema.field(c) for c in by]
            rows: dict[tuple, list[int]] = {}
            if by:
                for i, key in enumerate(zip(*[whole.column(c).to_pylist() for c in by])):
                    rows.setdefault(key, []).append(i)
            parts = {key: whole.take(pa.array(at)) for key, at in rows.items()} if by else {(): whole}
            for key, part in parts.items():
                total = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(part.column("_words")), 0), np.int64) + 1)
                begun, done = 0, 0
                while begun < part.num_rows:
                    room = PIECE - size.get(key, 0)
                    end = max(int(np.searchsorted(total, done + room, "right")), begun)
                    if end == begun and not held.get(key):
                        end = begun + 1  # a caption longer than a piece
                    if end > begun:
                        held.setdefault(key, []).append(part.slice(begun, end - begun))
                        size[key] = size.get(key, 0) + int(total[end - 1]) - done
                        begun, done = end, int(total[end - 1])
                    if begun < part.num_rows:
                        yield made(key, held.pop(key), fields)
                        size.pop(key)
            if sum(size.values()) > 4 * PIECE:  # of many corpora
                for key in list(held):
                    yield made(key, held.pop(key), fields)
                size.clear()
        for key, some in held.items():
            yield made(key, some, fields)

    schema = [ready.schema[c] for c in by] + [T.StructField("_piece", T.LongType()), T.StructField("_many", T.IntegerType())]
    schema += [T.StructField(c, T.ArrayType(ready.schema[c].dataType)) for c in lists]
    return ready.mapInArrow(run, T.StructType([*schema, *[T.StructField(c, T.BinaryType()) for c in ("_lens", "_codes", "_ends", "_names")]]))


BYTES = ("_lens", "_codes", "_ends", "_names")


class Opened:
    """A piece: its words as numbers, and its terms of each size in the order of their buckets."""

    def __init__(self, row: dict[str, bytes]):
        self.lens, self.code = loose(row["_lens"], np.int32).astype(np.int64), loose(row["_codes"], np.int32).astype(np.int64)
        ends, names = loose(row["_ends"], np.int32), loose(row["_names"])
        self.names = [names[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        self.row = np.repeat(np.arange(len(self.lens)), self.lens)

    def terms(self, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(n, first, bucket, term, row, tf)``: where each different term begins and its bucket, sorted by bucket; then of each
        caption's different terms the place in that order, the caption and how often it has the term."""
        code, row, v, rows = self.code, self.row, max(len(self.names), 1), max(len(self.lens), 1)
        crc = np.array([zlib.crc32(w) for w in self.names], np.uint64)
        number, hashed = code, crc[code] if len(code) else np.zeros(0, np.uint64)
        for n in range(1, max(sizes) + 1):
            if n > 1:
                number, hashed = _paired(number[:-1], code[n - 1:], v), hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + crc[code[n - 1:]]
            if n not in sizes:
                continue
            inside = np.flatnonzero(row[: len(number)] == row[n - 1:])
            _, first, tf = np.unique(_paired(number[inside], row[inside], rows), return_index=True, return_counts=True)
            first = inside[first]
            new = np.diff(number[first], prepend=-1) != 0
            heads, term = first[new], np.cumsum(new) - 1
            mixed = hashed[heads]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            bucket = (mixed >> np.uint64(40)).astype(np.int64) % BUCKETS
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            yield n, heads[order], bucket[order], place[term], row[first], tf


def _binary(at: np.ndarray, data) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])


def cut(at: np.ndarray, values: np.ndarray) -> pa.Array:
    """The values between the places ``at``, as bytes: all first bytes, all second ones and so on, which shuffles store in less room."""
    width, many = values.dtype.itemsize, np.diff(at)
    data = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width)
    out = np.empty(data.size, np.uint8)
    step = np.repeat(many, many)
    place = np.arange(len(values)) + np.repeat(at[:-1] * (width - 1), many)
    for i in range(width):
        out[place + i * step] = data[:, i]
    return _binary(at * width, out)


def uncut(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, len(data) // width).T.copy().view(kind).ravel()


def starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where the values change, and the end."""
    return np.concatenate((np.flatnonzero(np.diff(sorted_values, prepend=-1)), [len(sorted_values)])).astype(np.int64)


def steps(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Differences to the value before, from 0 at each of the places ``at``: small numbers, which take little room."""
    out = np.diff(values, prepend=values.dtype.type(0))
    begin = at[:-1][at[:-1] < at[1:]]
    out[begin] = values[begin]
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str], columns: Sequence[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of sorted batches that agree in ``keys``, as ``(key, [values of columns])``."""
    held, last = [], None
    for batch in batches:
        values = zip(*[batch.column(c).to_pylist() for c in columns])
        for now, row in zip(zip(*[batch.column(k).to_pylist() for k in keys]), values):
            if now != last and held:
                yield last, held
                held = []
            last = now
            held.append(row)
    if held:
        yield last, held


def answers(base: DataFrame, by: Sequence[str], sizes: Sequence[int], separator: str, least: float, names: bool = False) -> DataFrame:
    """``(by, _piece, n, _bucket, _ids, _dfs)``: of each term of the piece in the bucket its number in the bucket, from 1, or 0 if fewer
    than ``least`` captions of the corpus have it; and of the numbered ones in how many captions they are. Numbers are given as :func:`steps` from one numbered term to the next.

    Terms are numbered in the order of their bytes. With ``names`` a bucket also has a row with ``_piece`` -1: ``_dfs`` and, each ended
    by :data:`END`, ``_names`` of its numbered terms in their order.
    """
    by, sizes = list(by), list(sizes)
    fields = [base.schema[c] for c in by]
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                piece = Opened({c: batch.column(c)[i].as_py() for c in BYTES})
                some = pa.array(piece.names, pa.binary())
                last = pa.array([w + END for w in piece.names], pa.binary())
                for n, first, bucket, term, _, _ in piece.terms(sizes):
                    if not len(first):
                        continue
                    parts = [(last if j == n - 1 else some).take(pa.array(piece.code[first + j])) for j in range(n)]
                    joined = pc.binary_join_element_wise(*parts, separator.encode()) if n > 1 else parts[0]
                    ends = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
                    at = starts(bucket)
                    many = len(at) - 1
                    df = np.bincount(term, minlength=len(first)).astype(np.uint32)
                    out = [batch.column(c).take(pa.array([i] * many)) for c in [*by, "_piece"]]
                    out += [pa.array(np.full(many, n, np.int32)), pa.array(bucket[at[:-1]].astype(np.int32)), _binary(ends[at], joined.buffers()[2]), cut(at, df)]
                    yield pa.RecordBatch.from_arrays(out, names=[*by, "_piece", "n", "_bucket", "_bytes", "_counts"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, n, *key), held in runs(batches, ["_bucket", "n", *by], ["_piece", "_bytes", "_counts"]):
            at, data, counts = zip(*held)
            data, counts = b"".join(data), [uncut(c, np.uint32) for c in counts]
            ends = np.concatenate(([0], np.flatnonzero(np.frombuffer(data, np.uint8) == END[0]) + 1))
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
            code = coded.indices.to_numpy()
            df = np.bincount(code, weights=np.concatenate(counts), minlength=len(coded.dictionary)).astype(np.uint32)
            kept = np.flatnonzero(df >= least)
            some = coded.dictionary.take(pa.array(kept))
            order = pc.sort_indices(some).to_numpy()
            ids = np.zeros(len(df), np.int32)
            ids[kept[order]] = np.arange(1, len(kept) + 1)
            mine, mine_df = ids[code], df[code]
            known = mine > 0
            cuts = np.concatenate(([0], np.cumsum([len(c) for c in counts])))
            inside = np.concatenate(([0], np.cumsum(known)))[cuts]
            words = [None] * len(at)
            mine[known] = steps(mine[known], inside) + (1 << 30)  # 0 stays for the others; a step may be negative
            id_cells, df_cells = cut(cuts, mine), cut(inside, mine_df[known])
            if names:
                at, words = [*at, -1], [*words, b"".join(some.take(pa.array(order)).to_pylist())]
                id_cells = pa.concat_arrays([id_cells, pa.array([b""], pa.binary())])
                df_cells = pa.concat_arrays([df_cells, cut(np.array([0, len(kept)]), df[kept[order]])])
            many = len(at)
            out = [pa.array([k] * many, kinds[c]) for c, k in zip(by, key)]
            out += [pa.array(at, pa.int64()), pa.array([n] * many, pa.int32()), pa.array([bucket] * many, pa.int32()), id_cells, df_cells]
            out += [pa.array(words, pa.binary())] * names
            yield pa.RecordBatch.from_arrays(out, names=[*by, "_piece", "n", "_bucket", "_ids", "_dfs", *["_names"] * names])

    kinds = {f.name: to_arrow_type(f.dataType) for f in fields}
    head = [T.StructField("_piece", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("_bucket", T.IntegerType())]
    blobs = lambda *some: [T.StructField(c, T.BinaryType()) for c in some]
    cells = base.select(*by, "_piece", *BYTES).mapInArrow(sent, T.StructType([*fields, *head, *blobs("_bytes", "_counts")]))
    met = cells.repartition(tasks, "_bucket").sortWithinPartitions("_bucket", "n", *by)
    return met.mapInArrow(answered, T.StructType([*fields, *head, *blobs("_ids", "_dfs", *["_names"] * names)]))


def numbers(data: bytes) -> np.ndarray:
    """The numbers of an answer."""
    out = uncut(data, np.int32)
    known = out != 0
    out[known] = np.cumsum(out[known] - (1 << 30))
    return out


def met(base: DataFrame, told: DataFrame, sizes: Sequence[int], use: Callable, schema: str, facts: Sequence[str] = ()) -> DataFrame:
    """The batches that ``use(row, piece, terms)`` gives for each piece and its answers.

    ``row`` has the columns ``_piece`` and ``facts`` of the piece, ``terms`` are ``(n, bucket, ids, dfs, term, row, tf)``: of each
    different term, sorted by bucket, bucket, number and frequency (0 for those without a number), then as in :meth:`Opened.terms`.
    """
    sizes, facts = list(sizes), ["_piece", *facts]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cells: dict[int, list] = {}
        for n, bucket, ids, dfs in zip(*[right.column(c).to_pylist() for c in ("n", "_bucket", "_ids", "_dfs")]):
            cells.setdefault(n, []).append((bucket, ids, dfs))

        def terms(piece: Opened):
            for n, first, bucket, term, row, tf in piece.terms(sizes):
                some = sorted(cells.get(n, []))
                ids = np.concatenate([np.zeros(0, np.int32), *[numbers(c[1]) for c in some]])
                if len(ids) != len(first):
                    raise ValueError(f"{len(first)} terms, {len(ids)} answers")
                dfs = np.zeros(len(ids), np.int64)
                dfs[ids > 0] = np.concatenate([np.zeros(0, np.uint32), *[uncut(c[2], np.uint32) for c in some]])
                yield n, bucket, ids, dfs, term, row, tf

        out = []
        for row in left.to_pylist():
            piece = Opened(row)
            out += use({c: row[c] for c in facts}, piece, terms(piece))
        return pa.Table.from_batches(out) if out else arrow.empty_table()

    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    mine = base.select(*dict.fromkeys([*facts, *BYTES])).groupBy("_piece")
    return mine.cogroup(told.filter(F.col("_piece") >= 0).select("_piece", "n", "_bucket", "_ids", "_dfs").groupBy("_piece")).applyInArrow(run, schema)
