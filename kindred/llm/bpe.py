"""Byte-level BPE over a table of distinct words.

1. The text is split into words by the tokenizer's own pattern (its special tokens are words too), once. Each map task works
   in blocks of documents: a block has a dictionary of its distinct words, by falling frequency, and a document is
   the list of their ranks. One shuffle takes the documents to their block's task and the dictionaries, cut by a hash of
   the word into buckets, to their bucket's task. No word is a hot key: the most frequent one has one entry per block.
2. A bucket's task gives each distinct word a number and encodes it once. The (number, id) rows of the distinct words are
   joined with the table of pieces by id, which decodes each distinct word once. The table's size is that of the vocabulary;
   up to ``BROADCAST`` bytes of it are broadcast, beyond that the join shuffles.
3. Ids and decoded pieces of the dictionaries go back to the blocks and are put in place by rank.

Blocks are bounded by ``block_words`` words (a document is never cut; a longer one is a block alone). A block is named
by a hash of its documents and not by its task, so that a rerun of a lost task names it alike; the join back fails
loudly if a word of a block has no ids. Equal blocks share a name and have equal dictionaries.

Defined cases: null and empty texts have no ids and decode to the empty string; a null doc_id is carried along; repeated rows
and rows that share a doc_id are encoded separately; very long texts are whole; columns other than doc_id and text are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: the pattern that byte-level vocabularies of this kind split text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

BLOCK_WORDS = 2_000_000
#: bytes of pieces that may be broadcast
BROADCAST = 16 << 20


def special_tokens(vocabulary: str) -> list[str]:
    """Special tokens of a tokenizer file's text, longest first."""
    return sorted((t["content"] for t in json.loads(vocabulary)["added_tokens"]), key=lambda t: (-len(t), t))


class Splitter:
    def __init__(self, specials: list[str]):
        self.words = regex.compile(PATTERN).findall
        self.specials = frozenset(specials)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")").split if specials else None

    def __call__(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.specials):
            return self.words(text)
        out: list[str] = []
        for part in self.cut(text):
            out += [part] if part in self.specials else self.words(part)
        return out


def to_varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, low bits first; the high bit says that more follow."""
    v = values.astype(np.uint32)
    sizes = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21) + (v >= 1 << 28)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - sizes
    for i in range(int(sizes.max()) if len(sizes) else 0):
        has = sizes > i
        more = (sizes[has] > i + 1).astype(np.uint8) << 7
        out[starts[has] + i] = ((v[has] >> np.uint32(7 * i)) & np.uint32(127)).astype(np.uint8) | more
    return out.tobytes()


def from_varints(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], last[:-1] + 1)) if len(last) else last
    sizes = last - starts + 1
    out = np.zeros(len(last), np.int64)
    for i in range(int(sizes.max()) if len(sizes) else 0):
        has = sizes > i
        out[has] |= (data[starts[has] + i] & 127).astype(np.int64) << (7 * i)
    return out


def packed(sizes: np.ndarray, data: bytes) -> bytes:
    """Byte strings of these sizes, one after the other in ``data``, as one compressed value."""
    lengths = to_varints(sizes)
    return zstandard.ZstdCompressor(level=1).compress(len(lengths).to_bytes(8, "little") + lengths + data)


def unpacked(value: bytes) -> tuple[np.ndarray, bytes]:
    whole = zstandard.ZstdDecompressor().decompress(value)
    end = 8 + int.from_bytes(whole[:8], "little")
    return from_varints(np.frombuffer(whole, np.uint8)[8:end]), whole[end:]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


class _Block:
    def __init__(self):
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.docs: list[tuple[object, np.ndarray]] = []
        self.words = 0
        self.name = xxhash.xxh3_64()

    def add(self, doc_id, text: str, words: list[str]) -> None:
        at = np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))
        self.docs.append((doc_id, at))
        self.words += len(words)
        self.name.update(repr(doc_id).encode() + b"\0" + text.encode() + b"\0")

    def rows(self, kind: pa.DataType, buckets: int) -> Iterator[pa.RecordBatch]:
        """The dictionary by bucket, then the documents."""
        counts = np.zeros(len(self.index), np.int64)
        for _, at in self.docs:
            counts += np.bincount(at, minlength=len(counts))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        name = _signed(self.name.intdigest())
        words = [w.encode() for w in self.index]
        words = [words[i] for i in order.tolist()]
        of = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)
        by_bucket = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[by_bucket], np.arange(buckets + 1))
        some, size = [], 0
        for bucket in np.flatnonzero(np.diff(edges)).tolist():
            ranks = by_bucket[edges[bucket] : edges[bucket + 1]]
            own = [words[i] for i in ranks.tolist()]
            data = packed(np.fromiter(map(len, own), np.int64, len(own)), b"".join(own))
            # the key of a bucket; block names are its equals only by chance, which does no harm
            some.append((_signed(xxhash.xxh3_64_intdigest(bucket.to_bytes(4, "little"))), bucket, None, data, to_varints(np.diff(ranks, prepend=0))))
            size += len(data)
            if size > 4 << 20:
                yield _rows(kind, name, some)
                some, size = [], 0
        for doc_id, at in self.docs:
            some.append((name, -1, doc_id, to_varints(rank[at]), None))
            size += len(some[-1][3])
            if size > 4 << 20:
                yield _rows(kind, name, some)
                some, size = [], 0
        if some:
            yield _rows(kind, name, some)


def _rows(kind: pa.DataType, name: int, rows: list) -> pa.RecordBatch:
    key, bucket, doc_id, data, ranks = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array([name] * len(rows), pa.int64()), pa.array(bucket, pa.int32()),
         pa.array(doc_id, kind), pa.array(data, pa.binary()), pa.array(ranks, pa.binary())],
        names=["key", "block", "bucket", "doc_id", "data", "ranks"],
    )


def blocks(docs: DataFrame, specials: list[str], buckets: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows of two kinds, by key and block in their partitions. Key is the block of a document and the bucket of words.

    Documents: bucket -1, doc_id, data (ranks of its words). Words: bucket, data (packed words), ranks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, block, kind = Splitter(specials), _Block(), None
        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                words = split(text)
                if block.docs and block.words + len(words) > block_words:
                    yield from block.rows(kind, buckets)
                    block = _Block()
                    _give_back()
                block.add(doc_id, text, words)
        if block.docs:
            yield from block.rows(kind, buckets)
        del block
        _give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        docs.select("doc_id", "text")
        .mapInArrow(run, f"key bigint, block bigint, bucket int, doc_id {kind}, data binary, ranks binary")
        .repartition(n, "key")
    )


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    """Loaded once in a worker process and not for every task."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _give_back() -> None:
    """Return freed memory to the system: worker processes live on, and what they keep counts against the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def encode_words(rows: DataFrame, vocabulary: str) -> DataFrame:
    """The distinct words of each bucket as (bucket, seq, no, id) rows, one for each of a word's ids, and between them
    the dictionaries as (bucket, seq, block, ranks, numbers) rows, each after the words it names for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary)
        current, number, seq = None, {}, 0

        def out(size, no=None, ids=None, block=None, ranks=None, numbers=None):
            nonlocal seq
            columns = [
                pa.array(np.full(size, current, np.int32)), pa.array(np.arange(seq, seq + size)),
                *(pa.nulls(size, t) if x is None else pa.array(x, t) for x, t in (
                    (no, pa.int32()), (ids, pa.int32()), (block, pa.int64()), (ranks, pa.binary()), (numbers, pa.binary())
                )),
            ]
            seq += size
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "seq", "no", "id", "block", "ranks", "numbers"])

        for batch in batches:
            for at in np.flatnonzero(batch.column("bucket").to_numpy() >= 0).tolist():
                bucket = batch.column("bucket")[at].as_py()
                if bucket != current:
                    current, number, seq = bucket, {}, 0
                sizes, data = unpacked(batch.column("data")[at].as_py())
                ends = np.cumsum(sizes)
                words = [data[a:b].decode() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                fresh = [w for w in words if w not in number]
                for begin in range(0, len(fresh), 5_000):
                    part = fresh[begin : begin + 5_000]
                    ids = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                    first = len(number)
                    number.update(zip(part, range(first, first + len(part))))
                    no = np.repeat(np.arange(first, first + len(part), dtype=np.int32), [len(i) for i in ids])
                    if len(no):
                        yield out(len(no), no, np.concatenate([np.array(i, np.int32) for i in ids]))
                numbers = np.fromiter(map(number.__getitem__, words), "<i4", len(words)).tobytes()
                yield out(1, None, None, [batch.column("block")[at].as_py()], [batch.column("ranks")[at].as_py()], [numbers])
        _give_back()

    return rows.sortWithinPartitions("key", "block").mapInArrow(
        run, "bucket int, seq bigint, no int, id int, block bigint, ranks binary, numbers binary"
    )


def with_pieces(encoded: DataFrame, vocabulary: str, broadcast: int = BROADCAST) -> DataFrame:
    """The rows of :func:`encode_words`, in their order, with the piece of each id."""
    table = pieces(encoded.sparkSession, vocabulary)
    if sum(map(len, piece_bytes(vocabulary).values())) <= broadcast:
        return encoded.join(F.broadcast(table), "id", "left")
    n = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return encoded.join(table, "id", "left").repartition(n, "bucket").sortWithinPartitions("bucket", "seq")


def dictionaries(joined: DataFrame, wide: bool) -> DataFrame:
    """(key, ranks, ids, texts) for each dictionary: its block, and the ids and decoded words in the order of its ranks."""
    form = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, texts = None, [], []  # of the words of the bucket, by number
        held: list[pa.RecordBatch] = []  # (no, id, piece) rows that are not yet in the lists

        def take() -> None:
            """Put held rows into the lists; a word without ids has no row."""
            table = pa.Table.from_batches(held)
            held.clear()
            no = table.column("no").to_numpy()
            id_ = table.column("id").to_numpy().astype(form)
            offsets, data = _binary(table.column("piece"))
            edges = np.flatnonzero(np.concatenate(([True], no[1:] != no[:-1], [True])))
            blob = data.tobytes()
            for a, b, at, to in zip(edges[:-1].tolist(), edges[1:].tolist(), offsets[edges[:-1]].tolist(), offsets[edges[1:]].tolist()):
                while len(ids) < no[a]:
                    ids.append(b"")
                    texts.append(b"")
                ids.append(id_[a:b].tobytes())
                texts.append(blob[at:to])

        for batch in batches:
            bucket, named = batch.column("bucket").to_numpy(), np.flatnonzero(batch.column("numbers").is_valid().to_numpy(False))
            words = batch.select(["no", "id", "piece"])
            out, at = [], 0
            for stop in [*named.tolist(), batch.num_rows]:
                if stop > at or stop < batch.num_rows:
                    here = int(bucket[at] if stop > at else bucket[stop])
                    if here != current:
                        current, ids, texts = here, [], []
                if stop > at:
                    held.append(words.slice(at, stop - at))
                if stop == batch.num_rows:
                    break
                numbers = np.frombuffer(batch.column("numbers")[stop].as_py(), "<i4")
                if held:
                    take()
                while len(ids) <= numbers.max():
                    ids.append(b"")
                    texts.append(b"")
                own, said = [ids[i] for i in numbers.tolist()], [texts[i] for i in numbers.tolist()]
                width = np.dtype(form).itemsize
                out.append((
                    batch.column("block")[stop].as_py(), batch.column("ranks")[stop].as_py(),
                    packed(np.fromiter(map(len, own), np.int64, len(own)) // width, b"".join(own)),
                    packed(np.fromiter(map(len, said), np.int64, len(said)), b"".join(said)),
                ))
                at = stop + 1
            if out:
                key, ranks, packs, spoken = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), *(pa.array(c, pa.binary()) for c in (ranks, packs, spoken))],
                    names=["key", "ranks", "ids", "texts"],
                )
        _give_back()

    return joined.select("bucket", "no", "id", "block", "ranks", "numbers", "piece").mapInArrow(
        run, "key bigint, ranks binary, ids binary, texts binary"
    )


def piece_bytes(vocabulary: str) -> dict[int, bytes]:
    """The bytes of each id of the vocabulary."""
    spec = json.loads(vocabulary)
    byte_of = {c: bytes([b]) for b, c in enumerate(byte_characters())}
    rows = {i: b"".join(byte_of.get(c) or c.encode() for c in token) for token, i in spec["model"]["vocab"].items()}
    rows.update({t["id"]: t["content"].encode() for t in spec["added_tokens"]})
    return rows


def pieces(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(id, piece): the piece table; the vocabulary bounds its size."""
    rows = [(i, bytearray(p)) for i, p in sorted(piece_bytes(vocabulary).items())]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id and decoded text for rows (doc_id, ids array<int>), by a join of every id with the piece table.

    Null and empty lists decode to the empty string. Rows that share a doc_id need other keys first.
    """
    rows = encoded.select("doc_id", F.posexplode_outer("ids").alias("at", "id")).join(table, "id", "left")
    parts = F.array_sort(F.collect_list(F.struct("at", F.coalesce("piece", F.lit(b"")).alias("piece"))))
    return rows.groupBy("doc_id").agg(parts.alias("parts")).select(
        "doc_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["piece"])).cast("string").alias("decoded")
    )


def byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if it is printable Latin-1,
    else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        if b in shown:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


def _gather(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = int(sizes.sum())
    if not total:
        return buffer[:0]
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return buffer[shift + np.arange(total)]


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column; nulls have no bytes."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def encode(docs: DataFrame, vocabulary: str, digests: bool = False, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) and decoded text for rows (doc_id, text).

    ``vocabulary`` is the text of a tokenizer file. With ``digests`` the last two are SHA-256 digests instead, of the
    ids as little-endian 32-bit integers and of the decoded text, so that long lists need not travel.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    wide = max(piece_bytes(vocabulary)) >= 1 << 16
    rows = blocks(docs, special_tokens(vocabulary), 4 * n, block_words)
    words = dictionaries(with_pieces(encode_words(rows, vocabulary), vocabulary), wide)

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.filter(pc.equal(left.column("bucket"), -1))
        ranks, id_sizes, id_values, text_sizes, text_values = [], [], [], [], []
        for rank, packs, said in zip(*(right.column(c).to_pylist() for c in ("ranks", "ids", "texts"))):
            ranks.append(np.cumsum(from_varints(np.frombuffer(rank, np.uint8))))
            for value, form, sizes, values in ((packs, "<u4" if wide else "<u2", id_sizes, id_values), (said, np.uint8, text_sizes, text_values)):
                size, data = unpacked(value)
                sizes.append(size)
                values.append(np.frombuffer(data, form))
        order = np.zeros(0, np.int64)
        if ranks and left.num_rows:
            found, order = np.unique(np.concatenate(ranks), return_index=True)  # equal blocks come more than once
            if not np.array_equal(found, np.arange(len(found))):
                raise ValueError("a block's words and documents do not belong together; was the input read differently?")
            id_sizes, text_sizes = np.concatenate(id_sizes), np.concatenate(text_sizes)
            id_at, text_at = np.cumsum(id_sizes) - id_sizes, np.cumsum(text_sizes) - text_sizes
            id_at, id_sizes, text_at, text_sizes = (x[order] for x in (id_at, id_sizes, text_at, text_sizes))
            id_values, text_values = np.concatenate(id_values), np.concatenate(text_values)
        counts, ids, texts = [], [], []
        for value in left.column("data").to_pylist():
            r = from_varints(np.frombuffer(value, np.uint8))
            if len(r) and r.max() >= len(order):
                raise ValueError("a document names a word that its block does not have")
            own = _gather(id_values, id_at[r], id_sizes[r]).astype("<u4") if len(r) else np.zeros(0, "<u4")
            text = _gather(text_values, text_at[r], text_sizes[r]).tobytes().decode("utf-8", "replace") if len(r) else ""
            counts.append(len(own))
            if digests:
                ids.append(hashlib.sha256(own.tobytes()).hexdigest())
                texts.append(hashlib.sha256(text.encode()).hexdigest())
            else:
                ids.append(own.astype(np.int32))
                texts.append(text)
        _give_back()
        return pa.table({
            "doc_id": left.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
            "ids": pa.array(ids, pa.string() if digests else pa.list_(pa.int32())),
            "decoded": pa.array(texts, pa.string()),
        })

    return (
        rows.groupBy("key").cogroup(words.groupBy("key"))
        .applyInArrow(
            place, f"doc_id {kind}, n_tokens bigint, ids {'string' if digests else 'array<int>'}, decoded string"
        )
    )
