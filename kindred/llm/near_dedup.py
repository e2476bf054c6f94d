"""Near duplicates by SetSketch registers, verified on the full shingle sets.

1. Every text becomes its set of k-word shingles and a sketch of ``registers`` values: the minimum of exponential
   variables over the set, truncated on the scale of powers of ``BASE``. Sketches of unions are elementwise maxima of the
   registers, and equal registers at one place are about as likely as the sets are alike.
2. Equal sets collapse to the smallest doc_id, with sums before the shuffle, so exact copies cost one row.
3. Bands of four registers are buckets. At a likeness of 0.8 a pair misses all 32 bands with probability 4.7e-8. In the
   buckets of the first ``FIRST_BANDS`` bands every member is paired with the smallest one: as many pairs as members. That
   connects most of a group of copies (at 0.95 all but one pair in a thousand meets there).
4. The likeness of a pair is estimated jointly from both sketches and sizes by maximum likelihood; pairs far below the
   threshold (4.5 standard deviations) go. The rest is verified exactly: |A and B| / |A or B| on the full sets.
5. Verified links give components. Buckets of any band that still hold several components are compared again, but only
   between different components and in cells of at most two blocks of ``BLOCK`` members or ``BLOCK_SHINGLES`` shingles:
   first by sketches; then the full sets of the members with a likely partner are multiplied as an incidence matrix,
   which gives every intersection of the cell exactly. A task returns nodes, then a star of links for each
   component of the cell, and never a pair for each two members: a family of texts that are nearly, but not quite, alike
   costs rows in proportion to its size. Members of the first component meet the others only. No link between bucket
   members stays untested unless its ends are already connected.

Defined cases: null and empty texts have the empty set, which is linked with nothing; with fewer than k words the whole
sequence is the one shingle; rows that share a doc_id form one document as far as links go; a null doc_id is linked
with nothing and kept; columns other than doc_id and text are ignored, whatever their names; an empty table gives an empty
result. Texts are used whole, in sketches piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import WordCodes, give_back, materialise, mix, odd_constants, rolling, split_words
from kindred.llm.components import components, stars

SHINGLE = 5
THRESHOLD = 80
REGISTERS = 128
ROWS = 4
BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 1
MARGIN = 0.16
BLOCK = 512
#: shingles of a block, with repeats; a block of longer texts has fewer members
BLOCK_SHINGLES = 1_000_000
GRID_ROWS = 1000
COLUMNS = 4096
FIRST_BANDS = 4
CELL = ["band", "key", "kind", "x", "y"]
SHINGLE_SEED, REGISTER_SEED = 21, 22


def shingle_set(text: bytes, k: int, cache: WordCodes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, ASCII letters in lower case."""
    codes = cache.of(split_words(text.lower()))
    n = len(codes)
    return np.unique(rolling(codes, k, SHINGLE_SEED) if n >= k else rolling(codes, n, SHINGLE_SEED + 100 + n) if n else codes)


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a = mix(hashes).sum(dtype=np.uint64)
    b = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


_A = (odd_constants(REGISTERS, REGISTER_SEED) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_B = (odd_constants(REGISTERS, REGISTER_SEED + 1) >> np.uint64(32)).astype(np.uint32)[:, None]


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set that is not empty, as 16-bit registers."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, x.shape[1], 2048):
        np.minimum(low, (x[:, at : at + 2048] * _A + _B).min(axis=1), out=low)
    exponential = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def joint_likeness(first: np.ndarray, second: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard likeness of pairs of sketches (rows) of sets of known sizes."""
    if len(first) > GRID_ROWS:
        parts = [slice(i, i + GRID_ROWS) for i in range(0, len(first), GRID_ROWS)]
        return np.concatenate([joint_likeness(first[x], second[x], n1[x], n2[x]) for x in parts])
    more = (first > second).sum(1)[:, None]
    less = (first < second).sum(1)[:, None]
    same = first.shape[1] - more - less
    n1, n2 = n1.astype(float)[:, None], n2.astype(float)[:, None]
    u, v = n1 / (n1 + n2), n2 / (n1 + n2)
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, 201)[None, :]
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    level = np.maximum(1 - up - down, 1e-12)
    score = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(level)
    return np.take_along_axis(j, score.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (key of the set) and the sketch, four registers to a number; null if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for begin in range(0, batch.num_rows, 2000):
                part = range(begin, min(begin + 2000, batch.num_rows))
                sizes, h1, h2, out = [], [], [], []
                for at in part:
                    hashes = shingle_set(texts[at].as_py() or b"", k, cache)
                    a, b = set_key(hashes)
                    sizes.append(len(hashes))
                    h1.append(a)
                    h2.append(b)
                    out.append(registers(hashes).view(np.int64) if len(hashes) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(part)), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()),
                     pa.array(h2, pa.int64()), pa.array(out, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "h1", "h2", "sketch"],
                )
        cache.clear()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_shingles bigint, h1 bigint, h2 bigint, sketch array<bigint>"
    )


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy().reshape(len(values), -1).view(np.uint16)


def _alike_sizes(n1, n2, threshold):
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * threshold


def estimated(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the threshold and whose estimate is not far below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                near = joint_likeness(
                    _matrix(part.column("s1")), _matrix(part.column("s2")),
                    part.column("n1").to_numpy(), part.column("n2").to_numpy(),
                )
                keep = pa.array(near >= threshold / 100 - MARGIN)
                yield pa.RecordBatch.from_arrays(
                    [part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"]
                )

    first = sets.select(F.col("node").alias("a"), F.col("n_shingles").alias("n1"), F.col("sketch").alias("s1"))
    second = sets.select(F.col("node").alias("b"), F.col("n_shingles").alias("n2"), F.col("sketch").alias("s2"))
    kind = sets.schema["node"].dataType.simpleString()
    return (
        pairs.join(first, "a").join(second, "b").filter(_alike_sizes(F.col("n1"), F.col("n2"), threshold))
        .mapInArrow(run, f"a {kind}, b {kind}")
    )


def shingles_of(docs: DataFrame, ids: DataFrame, sets: DataFrame, k: int) -> DataFrame:
    """node and its full set, as the bytes of sorted 64-bit hashes, for the nodes of ``ids``."""
    kind = sets.schema["node"].dataType.simpleString()
    wanted = sets.select("node", "h1", "h2").join(ids, "node")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCodes()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for begin in range(0, batch.num_rows, 1000):
                rows, out = [], []
                for at in range(begin, min(begin + 1000, batch.num_rows)):
                    hashes = shingle_set(texts[at].as_py() or b"", k, cache)
                    if set_key(hashes) == (batch.column(2)[at].as_py(), batch.column(3)[at].as_py()):
                        rows.append(at)
                        out.append(hashes.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.binary())],
                    names=["node", "shingles"],
                )
        cache.clear()
        give_back()

    return (
        docs.join(wanted, docs.doc_id == wanted.node).select("node", "text", "h1", "h2").dropDuplicates(["node", "text"])
        .mapInArrow(spell, f"node {kind}, shingles binary")
    )


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    kind = sets.schema["node"].dataType.simpleString()
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    full = shingles_of(docs, ids, sets, k)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column("x")[i].as_py(), np.uint64)
                y = np.frombuffer(batch.column("y")[i].as_py(), np.uint64)
                at = np.searchsorted(x, y)
                shared = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep[i] = 100 * shared >= threshold * (len(x) + len(y) - shared)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"]
            )

    return (
        pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(full.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .mapInArrow(test, f"a {kind}, b {kind}")
    )


def _cell_edges(keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(keys)]))


def _whole_cells(batches: Iterator[pa.RecordBatch], key: list[str], least: int) -> Iterator[pa.Table]:
    """Tables of whole cells, from batches in the order of the key, of ``least`` rows if there are as many."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held)
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in key], 1)
        end = int(np.flatnonzero((keys != keys[-1]).any(1)).max(initial=-1)) + 1
        if end:
            yield table.slice(0, end)
        held, size = table.slice(end).to_batches(), len(keys) - end
    if size:
        yield pa.Table.from_batches(held)


def stranger_cells(members: DataFrame, labels: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Cells (band, key, kind, x, y) with their nodes that have a likely partner of another component there.

    A cell holds one block of a bucket, or two blocks that meet. Each pair counts in the first bucket it shares only, and
    not if it was a star. What leaves the task is a row for each such node and never a pair.
    """
    labelled = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = (
        labelled.groupBy("band", "key")
        .agg(F.min_by("comp", "node").alias("home"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        .filter("low < high").select("band", "key", "home")
    )
    open_members = labelled.join(mixed, ["band", "key"]).join(sets.select("node", "n_shingles"), "node").withColumn(
        "at_home", F.col("comp") == F.col("home")
    )
    blocks = lambda side: F.ceil(F.greatest(
        F.count_if(side) / BLOCK, F.sum(F.when(side, F.col("n_shingles")).otherwise(0)) / BLOCK_SHINGLES
    )).cast("int")
    sizes = open_members.groupBy("band", "key").agg(
        blocks(F.col("at_home")).alias("homes"), blocks(~F.col("at_home")).alias("guests")
    )
    hashed = F.xxhash64("node")
    block = F.when(F.col("at_home"), F.pmod(hashed, "homes")).otherwise(F.pmod(hashed, "guests")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    b = F.col("block")
    cells = F.when(F.col("at_home"), F.transform(upto("guests"), lambda j: cell(1, j, b))).otherwise(
        F.concat(
            F.transform(upto("guests"), lambda j: cell(0, F.least(j, b), F.greatest(j, b))),
            F.transform(upto("homes"), lambda j: cell(1, b, j)),
        )
    )
    rows = (
        open_members.drop("n_shingles").join(sizes, ["band", "key"]).withColumn("block", block)
        .select(
            "band", "key", "node", "comp", "at_home", (F.col("node") == F.col("pivot")).alias("at_pivot"), "block",
            F.inline(cells),
        ).join(sets.select("node", "n_shingles", "sketch"), "node")
    )
    kind = sets.schema["node"].dataType.simpleString()
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(table: pa.Table) -> pa.Table:
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in CELL], 1)
        edges = _cell_edges(keys)
        sketch, size = _matrix(table.column("sketch")), table.column("n_shingles").to_numpy()
        bands = np.ascontiguousarray(sketch).view(np.int64)
        comp = np.unique(np.array(table.column("comp").to_pylist()), return_inverse=True)[1]
        at_pivot = np.array(table.column("at_pivot").to_pylist(), bool)
        home = np.array(table.column("at_home").to_pylist(), bool)
        block = table.column("block").to_numpy()
        likely = np.zeros(len(keys), bool)
        for lo, hi in zip(edges[:-1], edges[1:]):
            across = keys[lo, 2] == 1
            apart = keys[lo, 3] != keys[lo, 4]
            for i in range(lo, hi - 1):
                rest = np.arange(i + 1, hi)
                ok = comp[rest] != comp[i]
                if across:
                    ok &= home[rest] != home[i]
                elif apart:
                    ok &= block[rest] != block[i]
                if keys[lo, 0] < FIRST_BANDS:
                    ok &= ~(at_pivot[rest] | at_pivot[i])
                ok &= 100 * np.minimum(size[rest], size[i]) >= threshold * np.maximum(size[rest], size[i])
                rest = rest[ok]
                if not len(rest):
                    continue
                rest = rest[(bands[rest] == bands[i]).argmax(1) == keys[lo, 0]]
                rest = rest[(sketch[rest] == sketch[i]).mean(1) >= threshold / 100 - MARGIN - 0.05]
                if not len(rest) or likely[i] and likely[rest].all():
                    continue
                near = joint_likeness(
                    np.broadcast_to(sketch[i], (len(rest), sketch.shape[1])), sketch[rest],
                    np.full(len(rest), size[i]), size[rest],
                ) >= threshold / 100 - MARGIN
                likely[rest[near]] = True
                likely[i] |= near.any()
        keep = pa.array(likely)
        return table.select([*CELL, "node"]).filter(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches, CELL, 5000):
            yield from compare(table).to_batches()

    return (
        rows.repartition(n, *CELL).sortWithinPartitions(*CELL)
        .mapInArrow(run, f"band int, key bigint, kind int, x int, y int, node {kind}")
    )


def links_within(sets: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of sorted sets whose likeness reaches the threshold, from the product of their incidence matrix."""
    size = np.array([len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # the others are in one set and in no intersection
    column = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), size)[shared[at]]
    column = column[at[shared[at]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (begin, begin + COLUMNS)))
        there = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - begin)), np.float32)
        there[owner[part], column[part] - begin] = 1
        common += (there @ there.T).astype(np.int64)
    return np.nonzero(np.triu(100 * common >= threshold * (size[:, None] + size[None, :] - common), 1))


def stranger_links(docs: DataFrame, cells: DataFrame, sets: DataFrame, k: int, threshold: int) -> DataFrame:
    """Links (a, b) between nodes of a cell, exact on the full sets and thinned to a star for each component in the cell."""
    kind = sets.schema["node"].dataType.simpleString()
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = shingles_of(docs, cells.select("node").distinct(), sets, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches, CELL, 1000):
            edges = _cell_edges(np.stack([table.column(c).to_numpy().astype(np.int64) for c in CELL], 1))
            node, spelled = table.column("node").combine_chunks(), table.column("shingles").combine_chunks()
            first, second = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if hi - lo > 1:
                    a, b = links_within([np.frombuffer(spelled[i].as_buffer(), np.uint64) for i in range(lo, hi)], threshold)
                    if len(a):
                        a, b = stars(a, b)
                        first.append(a + lo)
                        second.append(b + lo)
            if first:
                yield pa.RecordBatch.from_arrays(
                    [node.take(pa.array(np.concatenate(first))), node.take(pa.array(np.concatenate(second)))], names=["a", "b"]
                )

    return (
        cells.join(full, "node").repartition(n, *CELL).sortWithinPartitions(*CELL).select(*CELL, "node", "shingles")
        .mapInArrow(run, f"a {kind}, b {kind}")
    )


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept."""
    base = materialise(sketches(docs, k), "sketches")
    sets = materialise(
        base.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles")
        .agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch")).filter("node is not null"),
        "sets",
    )
    bands = sets.select("node", F.posexplode("sketch").alias("band", "key"))
    buckets = bands.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
    # read back from storage, so that the join can split a hot bucket instead of keeping the aggregation's partitioning
    buckets = materialise(buckets.filter("pivot < last").drop("last"), "buckets")
    members = materialise(bands.join(buckets, ["band", "key"]), "members")
    stars = members.filter((F.col("band") < FIRST_BANDS) & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    near = materialise(estimated(stars, sets, threshold), "pairs")
    links = materialise(verified(docs, near, sets, k, threshold), "links")
    labels = components(links)
    cells = materialise(stranger_cells(members, labels, sets, threshold), "cells")
    if cells.limit(1).count():
        late = materialise(stranger_links(docs, cells, sets, k, threshold), "links")
        labels = components(links.unionByName(late))
    by_set = sets.select("h1", "h2", "n_shingles", "node").join(labels, "node", "left").select(
        "h1", "h2", "n_shingles", F.coalesce("comp", "node").alias("_comp")
    )
    return base.select("doc_id", "n_shingles", "h1", "h2").join(by_set, ["h1", "h2", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.coalesce("_comp", "doc_id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")) | F.col("doc_id").isNull())
