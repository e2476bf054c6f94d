"""Ranked lexical search by exact inner products over sparse ball trees.

A query's score for a document is the inner product of two sparse vectors of whole numbers: the query's (times a term
occurs, times the term's weight) and the document's (a saturating function of the term's count and of the document's length).

1. Queries are taken in blocks of at most ``QUERY_TERMS`` terms with repeats, read one partition at a time, so what the driver and the
   tasks hold of them is bounded; the blocks go over the documents one after the other.
2. One pass over the texts keeps of every document its length and the counts of the block's terms. Numbers of documents
   and of terms are sums over all documents.
3. Each task puts its documents into ball trees of ``TREE`` documents: a node has a centroid and radii and is split at the median along the
   line between two far members. One radius is that of the whole space, <q, centroid> + |q| * radius; since text vectors
   are all far from each other, a node also has a radius in each coordinate, <q, centroid + radii>, which only pays for the
   terms of the query that the node has at all. The smaller bound counts.
4. Queries descend best-first: the subtree with the highest bound comes next, and a query is done when that bound is
   below its worst kept score (equal ones are still opened, since ties go to the smaller doc_id). Centroids, radii
   and bounds are rounded up by more than the error of their sums, so no subtree is pruned wrongly; scores at the leaves
   are 64-bit integer sums and exact.
5. Each task returns the best ``top`` of its documents for each query, and a rank over these gives the best of all.

Terms are the maximal runs of digits, ASCII letters and non-ASCII characters, with A-Z in lower case.

Defined cases: null and empty texts have no terms and never match; every row is a document, repeated rows included, and
equal scores are ranked by doc_id (null first); every query row is a query, so a repeated item_id has its ranking repeated;
a query without terms or matches has no rows; columns other than the two named are ignored, whatever their names; empty
tables give an empty result. Texts are used whole. A document or a query is held whole by one task.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kindred.llm.common import materialise

TOP = 20
QUERY_TERMS = 200_000
TREE = 4096
LEAF = 8
#: relative error that sums of doubles here stay below by far
SLACK = 1e-9
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def query_blocks(queries: DataFrame, limit: int = QUERY_TERMS) -> Iterator[list[tuple[object, dict[bytes, int]]]]:
    """Blocks of (item_id, counts of its terms), each of at most ``limit`` terms or of one query."""
    block, held = [], 0
    for item, text in queries.toLocalIterator():
        found = terms((text or "").encode())
        if block and held + len(found) > limit:
            yield block
            block, held = [], 0
        block.append((item, dict(Counter(found))))
        held += len(found)
    if block:
        yield block


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n_terms (with repeats), and of the terms in the vocabulary their numbers and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for begin in range(0, batch.num_rows, 2000):
                part = texts.slice(begin, 2000)
                sizes, ids, counts = [], [], []
                for text in part:
                    found = terms(text.as_py() or b"")
                    sizes.append(len(found))
                    at = np.fromiter((i for i in map(number, found) if i is not None), np.int32)
                    one, count = np.unique(at, return_counts=True)
                    ids.append(one)
                    counts.append(count.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(part)), pa.array(sizes, pa.int64()),
                     pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                    names=["doc_id", "n_terms", "terms", "counts"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_terms bigint, terms array<int>, counts array<int>"
    )


class Rows:
    """Sparse rows: the terms and values of row i stand at start[i] : start[i + 1]. No row is empty."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, start: np.ndarray):
        self.ids, self.values, self.start = ids, values, start
        self.n = len(start) - 1

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * dense[self.ids], self.start[:-1])

    def take(self, keep: np.ndarray) -> Rows:
        sizes = np.diff(self.start)
        there = np.repeat(keep, sizes)
        return Rows(self.ids[there], self.values[there], np.concatenate(([0], np.cumsum(sizes[keep]))))


class BallTree:
    """Nodes 0 (the root) and on; a node has two children or, at a leaf, document rows.

    A node's ball has a radius in the whole space, and one in each coordinate: how far a document's value lies above the
    centroid's at most. Queries have no negative values, so values below it do not matter. Kept are the coordinates that a
    document of the node has, by term, so a tree's memory follows its documents and not the vocabulary.
    """

    def __init__(self, rows: Rows, n_terms: int, leaf: int = LEAF):
        self.n_terms, self.leaf = n_terms, leaf
        self.children: list[tuple[int, int] | None] = []
        self.leaves: dict[int, tuple[np.ndarray, Rows]] = {}
        self.radius: list[float] = []
        self._ids: list[np.ndarray] = []
        self._centre: list[np.ndarray] = []
        self._upper: list[np.ndarray] = []
        self._build(rows, np.arange(rows.n))
        node = np.repeat(np.arange(len(self._ids)), [len(i) for i in self._ids])
        ids, centre, upper = (np.concatenate(x) for x in (self._ids, self._centre, self._upper))
        order = np.argsort(ids, kind="stable")
        self.node, self.centre, self.upper = node[order], centre[order], upper[order]
        self.start = np.searchsorted(ids[order], np.arange(n_terms + 1))
        self.radii = np.array(self.radius)
        del self._ids, self._centre, self._upper

    def _build(self, rows: Rows, number: np.ndarray) -> int:
        node = len(self.children)
        values = rows.values.astype(float)
        squares = np.add.reduceat(values * values, rows.start[:-1])
        total = np.bincount(rows.ids, values, self.n_terms)
        highest = np.zeros(self.n_terms)
        np.maximum.at(highest, rows.ids, values)
        ids = np.flatnonzero(highest)
        centroid = total / rows.n
        self._ids.append(ids)
        self._centre.append(centroid[ids])
        self._upper.append(highest[ids])  # centroid + radius of the coordinate, as a value of a document: exact
        length = (centroid * centroid).sum()
        distance = np.maximum(squares - 2 * rows.dot(centroid) + length, 0)
        self.radius.append(math.sqrt(distance.max() + SLACK * (squares.max() + length)) * (1 + SLACK))
        self.children.append(None)
        if rows.n <= self.leaf or not distance.max() > SLACK * (squares.max() + length):
            self.leaves[node] = (number, rows)
            return node
        one = self._dense(rows, int(distance.argmax()))
        spread = (one * one).sum() - 2 * rows.dot(one) + squares
        along = rows.dot(self._dense(rows, int(spread.argmax())) - one)
        left = np.zeros(rows.n, bool)
        left[np.argsort(along, kind="stable")[: rows.n // 2]] = True
        self.children[node] = (
            self._build(rows.take(left), number[left]), self._build(rows.take(~left), number[~left])
        )
        return node

    def _dense(self, rows: Rows, i: int) -> np.ndarray:
        out = np.zeros(self.n_terms)
        at = slice(rows.start[i], rows.start[i + 1])
        out[rows.ids[at]] = rows.values[at]
        return out

    def bounds(self, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each node a number that no score of its documents exceeds: the smaller of the two balls' bounds."""
        values = values.astype(float)
        spans = [np.arange(self.start[i], self.start[i + 1]) for i in ids.tolist()]
        at = np.concatenate(spans) if spans else np.empty(0, np.int64)
        weight = np.repeat(values, [len(x) for x in spans])
        node = self.node[at]
        inner = np.bincount(node, weight * self.centre[at], len(self.children))
        coordinates = np.bincount(node, weight * self.upper[at], len(self.children))
        ball = inner + math.sqrt((values * values).sum()) * self.radii
        return np.minimum(ball, coordinates) * (1 + SLACK) + 1


class Best:
    """The ``top`` best (score, doc_id) of one query so far; equal scores: the smaller doc_id."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    @property
    def least(self) -> int:
        """What a score must reach to count."""
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def add(self, score: int, rank: int) -> None:
        entry = (score, -rank)
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


def descend(tree: BallTree, ids: np.ndarray, values: np.ndarray, dense: np.ndarray, ranks: list[int], best: Best) -> int:
    """Add to ``best`` what the tree has for one query; returns how many leaves were opened."""
    bounds = tree.bounds(ids, values)
    queue, opened = [(-bounds[0], 0)], 0
    while queue and -queue[0][0] >= best.least:
        _, node = heapq.heappop(queue)
        pair = tree.children[node]
        if pair is not None:
            for child in pair:
                if bounds[child] >= best.least:
                    heapq.heappush(queue, (-bounds[child], child))
            continue
        opened += 1
        number, rows = tree.leaves[node]
        scores = rows.dot(dense)
        for i in np.flatnonzero(scores >= best.least):
            best.add(int(scores[i]), ranks[number[i]])
    return opened


def best_of_tasks(
    counts: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, width: int, top: int,
    tree_size: int, leaf: int,
) -> DataFrame:
    """query (its number in the block), doc_id and score of the best ``top`` documents of each task."""
    floor = -(1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bests = [Best(top) for _ in queries]
        held: list[pa.RecordBatch] = []
        kind, keys = None, []  # of doc_id; what a rank in a heap stands for if doc_id is no number

        def search() -> None:
            docs = pa.Table.from_batches(held).combine_chunks()
            ids = docs.column("doc_id").to_pylist()
            ranks = [floor if x is None else x for x in ids]
            lists, tf = docs.column("terms").chunk(0), docs.column("counts").chunk(0).flatten().to_numpy().astype(np.int64)
            start = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            length = docs.column("n_terms").to_numpy()
            m = 75 + 25 * length * n_docs // n_terms
            value = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(start)))
            tree = BallTree(Rows(lists.flatten().to_numpy(), value, start), width, leaf)
            dense = np.zeros(width, np.int64)
            for (at, weight), best in zip(queries, bests):
                if len(at):
                    dense[at] = weight
                    descend(tree, at, weight, dense, ranks, best)
                    dense[at] = 0

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for begin in range(0, batch.num_rows, tree_size):
                held.append(batch.slice(begin, tree_size))
                if sum(x.num_rows for x in held) >= tree_size:
                    search()
                    held.clear()
        if held:
            search()
        rows = [(q, -r, s) for q, best in enumerate(bests) for s, r in best.heap]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([None if r[1] == floor else r[1] for r in rows], kind),
                 pa.array([r[2] for r in rows], pa.int64())],
                names=["query", "doc_id", "score"],
            )

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.filter(F.size("terms") > 0).mapInArrow(run, f"query int, doc_id {kind}, score bigint")


def _search_block(docs: DataFrame, block: list, top: int, tree_size: int, leaf: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {term: i for i, term in enumerate(sorted({t for _, found in block for t in found}))}
    counts = materialise(term_counts(docs, vocabulary), "term-counts")
    n_docs, n_terms = counts.agg(F.count_if(F.col("n_terms") > 0), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    held_by = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator())
    weight = {i: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for i, n in held_by.items()}
    queries = []
    for _, found in block:
        used = sorted((vocabulary[t], n) for t, n in found.items() if weight.get(vocabulary[t]))
        queries.append((np.array([i for i, _ in used], np.int64), np.array([weight[i] * n for i, n in used], np.int64)))
    per_task = best_of_tasks(counts, queries, n_docs, n_terms, len(vocabulary), top, tree_size, leaf)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = per_task.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return materialise(ranked.select("query", "rank", "doc_id", "score"), "ranked")


def ranked_search(
    docs: DataFrame, queries: DataFrame, top: int = TOP, tree_size: int = TREE, leaf: int = LEAF,
    block_terms: int = QUERY_TERMS,
) -> DataFrame:
    """item_id, rank (1 is best), doc_id and score of the ``top`` best documents with a score above 0.

    ``docs``: doc_id (a whole number) and text; ``queries``: item_id and text.
    """
    spark = docs.sparkSession
    names = queries.select("item_id").schema
    parts = []
    for block in query_blocks(queries.select("item_id", "text"), block_terms):
        found = _search_block(docs, block, top, tree_size, leaf)
        label = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, item_id {names[0].dataType.simpleString()}")
        parts.append(found.join(label, "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {names[0].dataType.simpleString()}, rank int, doc_id {kind}, score bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
