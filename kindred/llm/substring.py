"""Exact substring deduplication with prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words of one document. Every word that lies in a window whose words also start
anywhere else is removed. The repeats are found in trees of suffixes, built in pieces:

1. A suffix is indexed where it begins with an *anchor*: of the ``w`` word n-grams inside a window the one of least
   hash (the leftmost of equals). Equal windows have the same anchor at the same place, and neighbouring windows
   mostly share theirs, so about one position in ``w / 2`` is indexed and no repeat is lost.
2. Suffixes whose first n-gram occurs once in the corpus are leaves at a depth below the window and dropped.
3. The others are dealt by their first n-gram, the shortest prefix. A task takes whole groups until its memory-sized
   chunk is full and builds the trees of the chunk: the suffixes rightwards from the anchor, and the words leftwards
   from it, both sorted, with the lengths of common prefixes of neighbours. A node of the tree at depth d is a run of
   neighbours that agree in d words. A window of which o words lie left of its anchor is repeated if another suffix
   shares both its right node at depth ``window - o`` and its left node at depth o: together they make a repeat
   of at least the window's length, and the union of such windows is the maximal repeats.
4. A group of more than ``group_limit`` suffixes does not fit. Each of its windows is then a suffix of its own, read from the
   anchor to the right end and on leftwards, and its prefix is lengthened by an n-gram at a time until the group of
   those that share it fits, or is alone; those groups get trees like the others. At the full length of the window a group is
   a single leaf that repeats itself. Prefixes are counted before the shuffle, and counts are read back from storage, so
   a passage that is in a third of all documents is no hot key.

Words are compared by 64-bit hashes inside a group whose n-gram agrees in 64 bits.

Defined cases: null texts have no words; documents shorter than the window lose nothing; very long texts are one row
and are never cut; rows are known by a hash of doc_id and text, so rows that share a doc_id (or have none) are documents
of their own, and equal rows repeat each other; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import WordCodes, forget, materialise, mix, rolling, split_words

WINDOW = 35
GRAM = 8
CHUNK = 20_000
GROUP_LIMIT = CHUNK
#: keys of 8 bytes that may be broadcast
BROADCAST_KEYS = 1_000_000
ANCHOR_SEED, PREFIX_SEED = 11, 12

# One number says where a run of windows lies: its first word, the number of its windows, the words of its first window
# left of the anchor, and a checksum of the document.
_COUNT, _OFFSET, _SUM = 27, 22, 22


def _packed(first, count, offset, checksum):
    return (first << 32) | (count << _COUNT) | (offset << _OFFSET) | checksum


def _checksum(text: bytes) -> int:
    return zlib.crc32(text) & ((1 << _SUM) - 1)


def gram_length(window: int) -> int:
    """At least GRAM words where the window has them; at most 28 n-grams to a window, so that counts fit five bits."""
    return max(min(GRAM, window), window - 27)


def _runs(codes: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """anchor hash, first window, number of windows, words left of the anchor, for each run of windows."""
    k = gram_length(window)
    grams = rolling(codes, k, ANCHOR_SEED)
    owner = np.arange(len(codes) - window + 1) + sliding_window_view(grams, window - k + 1).argmin(axis=1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1))
    count = np.diff(np.append(first, len(owner)))
    return grams[owner[first]], first, count, owner[first] - first


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and key, which tells rows with different ids or texts apart."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))


def anchor_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, key, run) for every run of windows that share their anchor, of keyed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for batch in batches:
            keys, anchors, runs, size = [], [], [], 0
            own, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary())
            for at in range(batch.num_rows):
                text = texts[at].as_py()
                codes = cache.of(split_words(text))
                if len(codes) >= window:
                    anchor, first, count, offset = _runs(codes, window)
                    anchors.append(anchor.view(np.int64))
                    runs.append(_packed(first, count, offset, _checksum(text)))
                    keys.append(np.full(len(anchor), own[at]))
                    size += len(anchor)
                if size > 200_000 or (size and at == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in (anchors, keys, runs)], names=["anchor", "key", "run"]
                    )
                    keys, anchors, runs, size = [], [], [], 0

    return docs.select("key", "text").mapInArrow(run, "anchor bigint, key bigint, run bigint")


def counted(rows: DataFrame, group: str) -> DataFrame:
    """The rows (read from storage) whose group has n >= 2 of them, with n.

    Read back from storage, the counts are shuffled anew for the join, which lets Spark split a hot group's rows;
    straight from the aggregation they would keep its partitioning and pin each group to one task.
    """
    often = materialise(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
    return rows.join(often, group)


def _with_lists(docs: DataFrame, rows: DataFrame, how: str, *columns: str) -> DataFrame:
    """Documents with the list of their different rows; a document's list is no longer than the document.

    All columns are kept for every caller, so that one shuffle of the texts serves several joins.
    """
    lists = rows.groupBy(F.col("key").alias("of")).agg(F.collect_set(F.struct(*columns)).alias("rows"))
    out = docs.join(lists, docs.key == lists.of, how)
    return out.select("key", "text", "doc_id", *[F.col("rows")[c].alias(f"{c}s") for c in columns])


def _fields(runs: list[int], text: bytes) -> tuple[np.ndarray, ...]:
    """Index into ``runs``, first, count, offset of the runs of this text (others are of rows whose key is equal by chance)."""
    r = np.array(runs, np.int64)
    own = np.flatnonzero((r & ((1 << _SUM) - 1)) == _checksum(text))
    r = r[own]
    return own, r >> 32, (r >> _COUNT) & 31, (r >> _OFFSET) & 31


def suffix_rows(docs: DataFrame, groups: DataFrame, window: int = WINDOW) -> DataFrame:
    """(group, key, run, words): each run of a group with the codes of the words its windows span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            keys, groups_, runs, words, size = [], [], [], [], 0
            for at in range(batch.num_rows):
                text = texts[at].as_py()
                own_runs, own_groups = batch.column("runs")[at].as_py(), batch.column("groups")[at].as_py()
                own, first, count, _ = _fields(own_runs, text)
                codes = cache.of(split_words(text))
                for i, a, n in zip(own.tolist(), first.tolist(), count.tolist()):
                    words.append(codes[a : a + n + window - 1].tobytes())
                    runs.append(own_runs[i])
                    groups_.append(own_groups[i])
                    size += len(words[-1])
                keys += [batch.column("key")[at].as_py()] * len(own)
                if size > 8 << 20 or (size and at == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(groups_, pa.int64()), pa.array(keys, pa.int64()), pa.array(runs, pa.int64()), pa.array(words, pa.binary())],
                        names=["group", "key", "run", "words"],
                    )
                    keys, groups_, runs, words, size = [], [], [], [], 0

    return _with_lists(docs, groups, "inner", "run", "group").mapInArrow(
        run, "group bigint, key bigint, run bigint, words binary"
    )


def _nodes(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the rows by (group, words), and for each but the first in it the words it shares with the one
    before (-1 across groups): the shape of the tree of these sequences."""
    order = np.lexsort([*words.T[::-1], group])
    g, s = group[order], words[order]
    differ = s[1:] != s[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), words.shape[1])
    return order, np.where(g[1:] == g[:-1], shared, -1)


def _node_ids(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    ids = np.empty(len(order), np.int64)
    ids[order] = np.concatenate(([0], np.cumsum(shared < depth)))
    return ids


def repeated_windows(group: np.ndarray, run: np.ndarray, words: list[bytes], window: int) -> np.ndarray:
    """For each row a mask: bit i says that the i-th window of the run occurs more than once among the rows."""
    n = len(run)
    count, offset = (run >> _COUNT) & 31, (run >> _OFFSET) & 31
    left_size = window - gram_length(window)
    right = np.zeros((n, window), np.uint64)
    left = np.zeros((n, max(left_size, 1)), np.uint64)
    for i in range(n):
        codes = np.frombuffer(words[i], np.uint64)
        o = offset[i]
        tail = codes[o : o + window]
        right[i, : len(tail)] = tail
        left[i, :o] = codes[:o][::-1]
    right_order, right_shared = _nodes(group, right)
    left_order, left_shared = _nodes(group, left)
    masks = np.zeros(n, np.int64)
    for o in range(left_size + 1):
        i = offset - o
        rows = np.flatnonzero((i >= 0) & (i < count))
        if len(rows) < 2:
            continue
        pair = _node_ids(right_order, right_shared, window - o)[rows] * n + _node_ids(left_order, left_shared, o)[rows]
        _, at, times = np.unique(pair, return_inverse=True, return_counts=True)
        again = rows[times[at] > 1]
        masks[again] |= np.int64(1) << i[again]
    return masks


def tree_marks(suffixes: DataFrame, window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """(key, run, mask) of the runs with repeated windows, from the trees of whole groups of suffixes."""

    def marks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        masks = repeated_windows(
            table.column("group").to_numpy(), table.column("run").to_numpy(), table.column("words").to_pylist(), window
        )
        hit = np.flatnonzero(masks)
        out = table.select(["key", "run"]).take(pa.array(hit)).append_column("mask", pa.array(masks[hit]))
        yield from out.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= chunk:
                table = pa.Table.from_batches(held)
                groups = table.column("group").to_numpy()
                end = int(np.searchsorted(groups, groups[-1]))  # the last group may go on
                if end:
                    yield from marks(table.slice(0, end))
                held, size = table.slice(end).to_batches(), len(groups) - end
        if size:
            yield from marks(pa.Table.from_batches(held))

    n = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        suffixes.repartition(n, "group").sortWithinPartitions("group").mapInArrow(run, "key bigint, run bigint, mask bigint")
    )


def prefix_lengths(window: int) -> list[int]:
    """Of the prefixes that are longer than the anchor's n-gram, up to the window."""
    k = gram_length(window)
    return [*range(2 * k, window, k), window]


def window_prefixes(docs: DataFrame, hot: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, run, p0, p1, ...): each window of the runs of ``hot`` as a run of its own, with the hashes of its prefixes."""
    lengths = prefix_lengths(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for at in range(batch.num_rows):
                text = texts[at].as_py()
                _, first, count, offset = _fields(batch.column("runs")[at].as_py(), text)
                if not len(first):
                    continue
                codes = cache.of(split_words(text))
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start, left = np.repeat(first, count) + step, np.repeat(offset, count) - step
                hashes = []
                for p in lengths:  # p words from the anchor on, the last ones of them before it
                    begin = start + left - np.maximum(p - (window - left), 0)
                    hashes.append(mix(rolling(codes, p, PREFIX_SEED + p)[begin] + left.astype(np.uint64)).view(np.int64))
                runs = _packed(start, 1, left, _checksum(text))
                for i in range(0, len(runs), 100_000):
                    part = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(runs[part]), batch.column("key")[at].as_py())), pa.array(runs[part]),
                         *(pa.array(h[part]) for h in hashes)],
                        names=["key", "run", *(f"p{j}" for j in range(len(lengths)))],
                    )

    columns = ", ".join(f"p{j} bigint" for j in range(len(lengths)))
    return _with_lists(docs, hot, "inner", "run").drop("doc_id").mapInArrow(run, f"key bigint, run bigint, {columns}")


def split_groups(docs: DataFrame, hot: DataFrame, window: int, limit: int) -> tuple[list[DataFrame], DataFrame]:
    """(group, key, run) of the windows of hot runs under the prefix with which their group fits; (key, run, mask) of
    those that share all their words with more than ``limit`` others."""
    keys = hot.select("key").distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:  # then only their texts are shuffled
        docs = docs.join(F.broadcast(keys), "key", "left_semi")
    rows, fit = materialise(window_prefixes(docs, hot, window), "windows"), []
    levels = len(prefix_lengths(window))
    for level in range(levels):
        rows = counted(rows, f"p{level}")
        if level < levels - 1:
            rows = materialise(rows, "windows")
            fit.append(rows.filter(F.col("n") <= limit).select(F.col(f"p{level}").alias("group"), "key", "run"))
            rows = rows.filter(F.col("n") > limit).drop("n")
    return fit, rows.select("key", "run", F.lit(1).cast("bigint").alias("mask"))


def drop_repeats(
    docs: DataFrame, window: int = WINDOW, group_limit: int = GROUP_LIMIT, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, for rows (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = keyed(docs)
    runs = materialise(anchor_runs(docs, window), "runs")
    live = materialise(counted(runs, "anchor"), "live-runs")
    forget(runs)
    groups = live.filter(F.col("n") <= group_limit).select(F.col("anchor").alias("group"), "key", "run")
    hot = live.filter(F.col("n") > group_limit)
    leaves = None
    if hot.limit(1).count():
        fit, leaves = split_groups(docs, hot.select("key", "run"), window, group_limit)
        for more in fit:
            groups = groups.unionByName(more)
    marks = tree_marks(suffix_rows(docs, groups, window), window, chunk)
    if leaves is not None:
        marks = marks.unionByName(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for begin in range(0, batch.num_rows, 512):
                totals, removed, kept = [], [], []
                part = range(begin, min(begin + 512, batch.num_rows))
                for at in part:
                    text = texts[at].as_py()
                    words = split_words(text)
                    runs = batch.column("runs")[at].as_py()
                    gone = np.zeros(len(words), bool)
                    if runs:
                        own, first, _, _ = _fields(runs, text)
                        masks = np.array(batch.column("masks")[at].as_py(), np.int64)[own]
                        edges = np.zeros(len(words) + 1, np.int64)
                        for i in range(28):
                            starts = first[(masks >> i) & 1 == 1] + i
                            np.add.at(edges, starts, 1)
                            np.add.at(edges, starts + window, -1)
                        gone = np.cumsum(edges[:-1]) > 0
                    totals.append(len(words))
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(begin, len(part)), pa.array(totals, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    return _with_lists(docs, marks, "left", "run", "mask").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string"
    )
