"""Near duplicates by SimHash and deletion-variant signatures.

1. A text becomes 64 bits: bit i is 1 where more than half of its shingle hashes have it. Equal fingerprints collapse to one row.
2. Fingerprints within three bits of each other, cut into two halves, have a half in which they differ by one bit at
   most. So each fingerprint is indexed under 64 variants: one half with one of its 32 bits taken out. Two such fingerprints
   share a variant, and an equality shuffle by variant brings them together; the full 64 bits are then compared.
3. A variant that more than ``RUN`` fingerprints share is not compared pair by pair. Its members go on to the next level, where
   the half that is still free is cut and indexed in the same way; a level costs 32, 16, 8, 4 and 2 variants a member
   and after the last one at most a few hundred different fingerprints can share a variant. Nothing is dropped and no task
   holds more than one batch and ``RUN`` members.
4. A link is taken up in one variant only, and the links of a batch are reduced to a star for each of their components before
   they leave the task, so a dense group costs rows in proportion to its size. Components of the stars are the classes.

Words are runs of other characters than space and \\x09 to \\x0D, with A-Z in lower case; shingles are ``k`` words joined by
a space, repeats included; with fewer words the whole sequence is the one shingle.

Defined cases: null and empty texts and texts without words have fingerprint 0 and are linked like any other; repeated rows
and rows that share a doc_id each get their row of the result; a null doc_id never names a class (a class of null ids only
has a null component_id); columns other than doc_id and text are ignored, whatever their names; an empty table gives
an empty result. Texts are used whole, and a long one is hashed in pieces of ``PIECE`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from kindred.llm.common import materialise
from kindred.llm.components import components, stars

SHINGLE = 3
RADIUS = 3
SEED = 42
RUN = 512
PIECE = 1 << 16
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: bytes, k: int = SHINGLE) -> int:
    """The fingerprint of a text as an unsigned number."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    n = max(len(words) - k + 1, 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        part = [words[at + i : at + PIECE + i] for i in range(k)] if len(words) >= k else [[w] for w in words]
        hashes = np.array([digest(b" ".join(shingle), SEED) for shingle in zip(*part)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((simhash(t.as_py() or b"", k) for t in texts), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def _segment(offset: Column, width: int) -> Column:
    """``width`` bits of fp, from bit ``offset`` up."""
    return F.call_function("shiftrightunsigned", F.col("fp"), offset).bitwiseAND(F.lit((1 << width) - 1))


def _without(bit: Column) -> Column:
    return F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))


def _first_half(h: int) -> Column:
    """The variants of half ``h``: one for each of its bits."""

    def variant(bit: Column) -> Column:
        pos = bit + 32 * h
        value = _segment(F.lit(32 * h), 32).bitwiseAND(_without(bit))
        return F.struct(
            (pos.cast("bigint") * F.lit(1 << 32) + value).alias("key"), pos.alias("pos"), F.lit(32 * (1 - h)).alias("free")
        )

    return F.transform(F.sequence(F.lit(0), F.lit(31)), variant)


def first_variants(sets: DataFrame) -> DataFrame:
    """key, pos (the bit taken out), free (first bit of the half that is not in the key) and fp: 64 rows a fingerprint."""
    return sets.select(F.inline(F.concat(_first_half(0), _first_half(1))), "fp")


def _next_half(h: int, half: int) -> Column:
    def variant(bit: Column) -> Column:
        value = _segment(F.col("free") + h * half, half).bitwiseAND(_without(bit))
        return F.struct(
            F.xxhash64("key", bit, F.lit(h), value).alias("key"), F.col("pos"), (F.col("free") + (1 - h) * half).alias("free")
        )

    return F.transform(F.sequence(F.lit(0), F.lit(half - 1)), variant)


def next_variants(members: DataFrame, width: int) -> DataFrame:
    """The same for members of a variant whose free segment of ``width`` bits is cut in two."""
    half = width // 2
    return members.select(F.inline(F.concat(_next_half(0, half), _next_half(1, half))), "fp")


def linked(key: np.ndarray, pos: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints of one run (equal keys stand together) within the radius, each in one of its runs only."""
    firsts, seconds = [], []
    at = np.arange(len(key))
    half = (pos // 32 * 32).astype(np.uint64)
    bit = np.uint64(1) << pos.astype(np.uint64)
    mask = np.uint64(0xFFFFFFFF)
    for step in range(1, len(key)):
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        if not len(at):
            break
        diff = fp[at] ^ fp[at + step]
        own = diff & (mask << half[at])
        other = np.bitwise_count(diff ^ own)
        # the half in the key: its differing bit is the one taken out, or it is equal and its first bit is
        here = (own == bit[at]) | ((own == 0) & (pos[at] % 32 == 0))
        once = (pos[at] < 32) | (other > 1)
        near = at[here & once & (diff != 0) & (np.bitwise_count(diff) <= RADIUS) & (pos[at] == pos[at + step])]
        firsts.append(near)
        seconds.append(near + step)
    a = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
    b = np.concatenate(seconds) if seconds else np.empty(0, np.int64)
    return fp[a], fp[b]


def compare_variants(variants: DataFrame, last: bool, run: int = RUN) -> DataFrame:
    """a, b: stars of links between members of a variant; key, pos, free, a (b null): members of variants over ``run``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        passing = None  # the key of a run that is passed on

        def out(a, b, key, pos, free):
            none = pa.nulls(len(a), pa.int64())
            if b is not None:
                column = [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none.cast(pa.int32()), none.cast(pa.int32())]
            else:
                column = [pa.array(a), none, pa.array(key), pa.array(pos.astype(np.int32)), pa.array(free.astype(np.int32))]
            return pa.RecordBatch.from_arrays(column, names=["a", "b", "key", "pos", "free"])

        def judged(rows):
            """Links of whole runs, and the members of those that are too large."""
            key = rows[0]
            edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            sizes = np.diff(edges)
            large = np.repeat((sizes > run) & (not last), sizes)
            if large.any():
                k, p, f, x = (c[large] for c in rows)
                yield out(x, None, k, p, f)
            small = ~large & np.repeat(sizes > 1, sizes)
            k, p, _, x = (c[small] for c in rows)
            a, b = linked(k, p, x.view(np.uint64))
            if len(a):
                yield out(*stars(a, b), None, None, None)

        for batch in batches:
            rows = [
                np.concatenate((old, batch.column(c).to_numpy().astype(np.int64)))
                for old, c in zip(held, ("key", "pos", "free", "fp"))
            ]
            if passing is not None:
                more = int(np.searchsorted(rows[0] != passing, True))
                if more:
                    yield out(rows[3][:more], None, *(c[:more] for c in rows[:3]))
                rows = [c[more:] for c in rows]
                if not len(rows[0]):
                    held = rows
                    continue
                passing = None
            key = rows[0]
            end = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1
            if end:
                yield from judged([c[:end] for c in rows])
            held = [c[end:] for c in rows]
            if len(held[0]) > run and not last:
                yield out(held[3], None, *held[:3])
                passing, held = held[0][-1], [c[:0] for c in held]
        if len(held[0]):
            yield from judged(held)

    n = int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        variants.select("key", "pos", "free", "fp").repartition(n, "key").sortWithinPartitions("key", "fp")
        .mapInArrow(compare, "a bigint, b bigint, key bigint, pos int, free int")
    )


def links(sets: DataFrame, run: int = RUN) -> DataFrame:
    """Stars (a, b) of the links between the different fingerprints fp of ``sets``."""
    variants, width, parts = first_variants(sets), 32, []
    while True:
        found = materialise(compare_variants(variants, width == 1, run), "variants")
        parts.append(found.filter("b is not null").select("a", "b"))
        large = found.filter("b is null")
        if width == 1 or not large.limit(1).count():
            break
        variants = next_variants(large.select("key", "pos", "free", F.col("a").alias("fp")), width)
        width //= 2
    stars = parts[0]
    for part in parts[1:]:
        stars = stars.unionByName(part)
    return stars.distinct()


def simhash_classes(docs: DataFrame, k: int = SHINGLE, run: int = RUN) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach, itself included."""
    prints = materialise(fingerprints(docs, k), "fingerprints")
    sets = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    labels = components(links(sets, run)).withColumnRenamed("node", "fp")
    classed = materialise(
        sets.join(labels, "fp", "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp")), "classes"
    )
    smallest = classed.groupBy("comp").agg(F.min("first").alias("component_id"))
    by_print = materialise(classed.join(smallest, "comp").select("fp", "component_id"), "classes")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")
