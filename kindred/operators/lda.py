"""Online variational Bayes for topics, as ``pyspark.ml``'s LDA has it, with the topics in slots of a table and not on the driver.

The topics' weights of ``SLOT`` terms are one row. A round asks the slots for the weights of the terms in its batch of captions, infers the
captions piece by piece and adds what they say to the slots when these are asked for the next round. The driver has numbers per
topic only. The start and the batches come from hashes of terms' numbers and rows, so both differ from what the estimator draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.operators import pieces
from kindred.operators.frames import top_k
from kindred.operators.grams import BUCKETS
from kindred.storage import forget, materialise

SLOT = 1 << 17
#: The estimator's defaults: share of captions in a batch, learning offset and decay, shape of the start.
RATE, TAU, KAPPA, SHAPE = 0.05, 1024.0, 0.51, 100.0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(*parts) -> np.ndarray:
    """One hash of integers (or arrays of them) in their order."""
    out = np.zeros(1, np.uint64)
    for p in parts:
        out = _mixed(out ^ np.asarray(p, np.int64).astype(np.uint64))
    return out


def uniform(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def gammas(keys: np.ndarray) -> np.ndarray:
    """A gamma variate of mean 1 and shape ``SHAPE`` for each key (Marsaglia and Tsang)."""
    out, left, d = np.empty(len(keys)), np.arange(len(keys)), SHAPE - 1 / 3
    attempt = 0
    while len(left):
        a, b, c = (uniform(hashed(keys[left].view(np.int64), attempt, i)) for i in range(3))
        x = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        v = (1 + x / math.sqrt(9 * d)) ** 3
        taken = (v > 0) & (np.log(c) < 0.5 * x * x + d - d * v + d * np.log(np.maximum(v, 1e-300)))
        out[left[taken]] = d * v[taken] / SHAPE
        left, attempt = left[~taken], attempt + 1
    return out


def times_drawn(keys: np.ndarray) -> np.ndarray:
    """How often a caption is in a batch that is drawn with replacement: Poisson of mean ``RATE``."""
    u, out, p, total = uniform(keys), np.zeros(len(keys), np.int32), math.exp(-RATE), math.exp(-RATE)
    for i in range(1, 20):
        out += u >= total
        p *= RATE / i
        total += p
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    less = sum(1 / (x + i) for i in range(8))
    y = x + 8
    z = 1 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - less


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    more = sum(1 / (x + i) ** 2 for i in range(8))
    y = x + 8
    z = 1 / (y * y)
    return 1 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z * (1 / 30 - z * 5 / 66)))) + more


def started(seed: int, k: int, ids: np.ndarray) -> np.ndarray:
    """The topics' first weights of the terms, a row per topic."""
    return np.array([gammas(hashed(seed, 1, j, ids)) for j in range(k)]).reshape(k, len(ids))


def infer(elog: np.ndarray, code: np.ndarray, counts: np.ndarray, lens: np.ndarray, times: np.ndarray, gamma: np.ndarray, alpha: np.ndarray):
    """Of captions with terms ``code``, one after the other: what the terms' topics gain, and the sum of the expected log shares."""
    k = len(alpha)
    shares = lambda g: np.exp(digamma(g) - digamma(g.sum(0)))
    doc, theta = np.repeat(np.arange(len(lens)), lens), shares(gamma)
    norm = (elog[:, code] * theta[:, doc]).sum(0) + 1e-100
    left, entry = np.arange(len(lens)), np.arange(len(code))
    while len(left):
        size, mine, often = lens[left], elog[:, code[entry]], counts[entry]
        begin, live = np.cumsum(size) - size, np.ones(len(left), bool)
        g, th, at = gamma[:, left], theta[:, left], norm[entry]
        while 2 * live.sum() > len(left):  # captions that are done keep their values until they are taken out
            now = th * np.add.reduceat(mine * (often / at), begin, axis=1) + alpha[:, None]
            th = np.where(live, shares(now), th)
            at = np.einsum("ke,ke->e", mine, np.repeat(th, size, axis=1)) + 1e-100
            change = np.abs(now - g).sum(0) / k
            g = np.where(live, now, g)
            live &= change > 1e-3
        gamma[:, left], theta[:, left], norm[entry] = g, th, at
        left, entry = left[live], entry[np.repeat(live, size)]
    weight = counts * times[doc] / norm
    gained = np.array([np.bincount(code, weights=theta[j, doc] * weight, minlength=elog.shape[1]) for j in range(k)]) * elog
    return gained, ((digamma(gamma) - digamma(gamma.sum(0))) * times).sum(1)


def _parts(base: DataFrame, told: DataFrame, offsets: dict[int, np.ndarray], rounds: int, seed: int) -> DataFrame:
    """``(_t, _part, ...)``: of each piece the captions that are in the batch of round t, their terms as numbers."""

    def use(row, piece, terms):
        where, what, often = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, bucket, ids, _, term, at, tf in terms:
            some = ids[term] > 0
            where, what, often = [*where, at[some]], [*what, (offsets[n][bucket] + ids - 1)[term[some]]], [*often, tf[some]]
        where, what, often = np.concatenate(where), np.concatenate(what), np.concatenate(often)
        order = np.argsort(where, kind="stable")
        where, what, often = where[order], what[order], often[order]
        rows = np.array(row["_at"], np.int64)
        lens = np.bincount(where, minlength=len(rows))
        out = []
        for t in range(rounds):
            times = times_drawn(hashed(seed, 2, t, rows))
            if not times.any():
                continue
            inside, docs = (times > 0)[where], np.flatnonzero((times > 0) & (lens > 0))
            ids, code = np.unique(what[inside], return_inverse=True)
            blobs = [np.diff(ids, prepend=0), code.astype(np.int32), often[inside].astype(np.int32), lens[docs].astype(np.int32), times[docs], rows[docs]]
            values = [t, row["_piece"], int(times.sum()), *map(pieces.squeeze, blobs)]
            out.append(pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, fields)], schema=fields))
        return out

    blobs = ["_ids", "_codes", "_counts", "_lens", "_times", "_rows"]
    fields = pa.schema([("_t", pa.int32()), ("_part", pa.int64()), ("_drawn", pa.int64()), *[(b, pa.binary()) for b in blobs]])
    return pieces.met(base, told, list(offsets), use, f"_t int, _part bigint, _drawn bigint, {', '.join(f'{b} binary' for b in blobs)}", ["_at"])


def _ids(data: bytes) -> np.ndarray:
    return np.cumsum(pieces.loose(data, np.int64))


def _asked(parts: DataFrame) -> DataFrame:
    """``(_slot, _part, _ids, _gains)``: which weights a part needs of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column("_part").to_pylist(), batch.column("_ids").to_pylist()):
                ids = _ids(data)
                at = pieces.starts(ids // SLOT)
                many = len(at) - 1
                out = [pa.array((ids // SLOT)[at[:-1]]), pa.array(np.full(many, part)), pieces.cut(at, pieces.steps((ids % SLOT).astype(np.int32), at))]
                yield pa.RecordBatch.from_arrays([*out, pa.nulls(many, pa.binary())], names=["_slot", "_part", "_ids", "_gains"])

    return parts.select("_part", "_ids").mapInArrow(run, "_slot bigint, _part bigint, _ids binary, _gains binary")


def _turned(state: DataFrame, told: DataFrame, size: int, k: int, seed: int, weight: float, scale: float) -> DataFrame:
    """``(_kind, _slot, _part, _weights, _sums)``: the slots (kind 0) after the gains in ``told``, and the weights it asks for (1)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        slot, data = left.column("_slot")[0].as_py(), left.column("_weights")[0].as_py()
        ids = np.arange(slot * SLOT, min((slot + 1) * SLOT, size))
        lam = started(seed, k, ids) if data is None else pieces.uncut(data, float).reshape(k, len(ids))
        asked, gained = [], np.zeros(lam.shape)
        for part, some, gains in zip(*[right.column(c).to_pylist() for c in ("_part", "_ids", "_gains")]):
            some = np.cumsum(pieces.uncut(some, np.int32))
            if gains is None:
                asked.append((part, some))
            else:
                gained[:, some] += pieces.uncut(gains, float).reshape(k, len(some))
        if weight:
            lam = (1 - weight) * lam + weight * (gained * scale + 1 / k)
        rows = [(0, slot, -1, _cell(lam), lam.sum(1).tolist()), *[(1, slot, part, _cell(lam[:, some]), None) for part, some in asked]]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), arrow)], schema=arrow)

    arrow = pa.schema([("_kind", pa.int32()), ("_slot", pa.int64()), ("_part", pa.int64()), ("_weights", pa.binary()), ("_sums", pa.list_(pa.float64()))])
    return state.groupBy("_slot").cogroup(told.groupBy("_slot")).applyInArrow(run, "_kind int, _slot bigint, _part bigint, _weights binary, _sums array<double>")


def _cell(values: np.ndarray) -> bytes:
    return pieces.cut(np.array([0, values.size]), np.ascontiguousarray(values).ravel())[0].as_py()


def _inferred(parts: DataFrame, weights: DataFrame, t: int, k: int, seed: int, sums: np.ndarray, alpha: np.ndarray) -> DataFrame:
    """``(_slot, _part, _ids, _gains, _facts)``: what each slot gains; in slot -1 the log shares, the captions with terms and all drawn."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        ids, kinds = _ids(row["_ids"]), {"_codes": np.int32, "_counts": np.int32, "_lens": np.int32, "_times": np.int32, "_rows": np.int64}
        code, counts, lens, times, rows = (pieces.loose(row[c], kind) for c, kind in kinds.items())
        at = pieces.starts(ids // SLOT)
        some = dict(zip(right.column("_slot").to_pylist(), right.column("_weights").to_pylist()))
        lam = np.concatenate([np.zeros((k, 0)), *[pieces.uncut(some[s], float).reshape(k, -1) for s in (ids // SLOT)[at[:-1]].tolist()]], axis=1)
        elog = np.exp(digamma(lam) - digamma(sums)[:, None])
        gamma = np.array([gammas(hashed(seed, 3, t, j, rows)) for j in range(k)]).reshape(k, len(rows))
        gained, logs = infer(elog, code, counts.astype(float), lens, times, gamma, alpha)
        local = (ids % SLOT).astype(np.int32)
        out = [(-1, row["_part"], None, None, [*logs.tolist(), float(times.sum()), float(row["_drawn"])])]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            out.append((int(ids[a]) // SLOT, row["_part"], _cell(np.diff(local[a:b], prepend=np.int32(0))), _cell(gained[:, a:b]), None))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), arrow)], schema=arrow)

    arrow = pa.schema([("_slot", pa.int64()), ("_part", pa.int64()), ("_ids", pa.binary()), ("_gains", pa.binary()), ("_facts", pa.list_(pa.float64()))])
    schema = "_slot bigint, _part bigint, _ids binary, _gains binary, _facts array<double>"
    return parts.groupBy("_part").cogroup(weights.select("_slot", "_part", "_weights").groupBy("_part")).applyInArrow(run, schema)


def _added(df: DataFrame, column: str) -> np.ndarray:
    """The sum of arrays of equal length."""
    rows = df.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r.v for r in rows])


def next_alpha(alpha: np.ndarray, logs: np.ndarray, many: float, weight: float) -> np.ndarray:
    """A Newton step for the prior of the shares, where it stays positive."""
    gradient = many * (logs / many - (digamma(alpha) - digamma(alpha.sum())))
    c, q = many * trigamma(alpha.sum()), -many * trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    moved = alpha - weight * (gradient - b) / q
    return moved if (moved > 0).all() else alpha


def numbered(told: DataFrame) -> tuple[int, dict[int, np.ndarray]]:
    """How many terms there are, and for each size the number of the first of each bucket."""
    rows = told.filter("_piece = -1").select("n", "_bucket", (F.octet_length("_dfs") / 4).cast("bigint").alias("m")).collect()
    many: dict[int, np.ndarray] = {}
    for r in rows:
        many.setdefault(r.n, np.zeros(BUCKETS, np.int64))[r._bucket] = r.m
    total, out = 0, {}
    for n in sorted(many):
        out[n] = total + np.cumsum(many[n]) - many[n]
        total += int(many[n].sum())
    return total, out


def fitted(base: DataFrame, told: DataFrame, k: int, rounds: int, seed: int) -> tuple[DataFrame, np.ndarray]:
    """The slots after the rounds and the topics' sums. ``base`` and ``told`` are those of :mod:`kindred.operators.pieces`."""
    spark = base.sparkSession
    size, offsets = numbered(told)
    docs = base.agg(F.sum("_many")).first()[0]
    parts = materialise(_parts(base, told, offsets, rounds, seed), "parts", ["_t"])
    none = spark.createDataFrame([], "_slot bigint, _part bigint, _ids binary, _gains binary")
    slots = spark.range(-(-size // SLOT)).select(F.col("id").alias("_slot"), F.lit(None).cast("binary").alias("_weights"))
    alpha, weight, done, gains, old, scale = np.full(k, 1 / k), 0.0, 0, none, [], docs / math.ceil(RATE * docs)
    for t in [*range(rounds), None]:
        now = parts.filter(F.col("_t") == t) if t is not None else parts.limit(0)
        turned = materialise(_turned(slots, gains.unionByName(_asked(now)) if t is not None else gains, size, k, seed, weight, scale), "topics", ["_kind"])
        for table in old:
            forget(table)
        state = turned.filter("_kind = 0")
        slots, gains, weight, old = state.select("_slot", "_weights"), none, 0.0, [turned]
        sums = _added(state, "_sums")
        if t is None:
            break
        found = materialise(_inferred(now, turned.filter("_kind = 1"), t, k, seed, sums, alpha), "gains")
        old.append(found)
        facts = _added(found.filter("_slot = -1"), "_facts")
        if not len(facts) or not facts[-1]:
            continue  # nothing was drawn: no round
        done += 1
        if not facts[-2]:
            continue
        weight = (TAU + done) ** -KAPPA
        alpha = next_alpha(alpha, facts[:k], facts[-2], weight)
        gains = found.filter("_slot >= 0").drop("_facts")
    forget(parts)
    slots.stored_at = turned.stored_at
    return slots, sums


def leading(slots: DataFrame, told: DataFrame, sums: np.ndarray, terms: int) -> list[tuple[int, int, str, float]]:
    """``(topic, rank, term, weight)`` of the leading terms."""
    k = len(sums)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, data in zip(batch.column("_slot").to_pylist(), batch.column("_weights").to_pylist()):
                lam = pieces.uncut(data, float).reshape(k, -1)
                for j in range(k):
                    order = np.argsort(-lam[j], kind="stable")[:terms]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), j, np.int32)), pa.array(order + slot * SLOT), pa.array(lam[j, order])], names=["topic", "id", "w"])

    rows = top_k(slots.select("_slot", "_weights").mapInArrow(best, "topic int, id bigint, w double"), terms, "w", ["id"], ["topic"]).collect()
    _, offsets = numbered(told)
    wanted: dict[tuple[int, int], list[int]] = {}
    for i in {r.id for r in rows}:
        n = max(n for n in offsets if offsets[n][0] <= i)
        bucket = int(np.searchsorted(offsets[n], i, "right")) - 1
        wanted.setdefault((n, bucket), []).append(i)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, bucket, data in zip(*[batch.column(c).to_pylist() for c in ("n", "_bucket", "_names")]):
                ids = wanted.get((n, bucket), [])
                words = data.split(pieces.END) if ids else []
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([words[i - int(offsets[n][bucket])].decode() for i in ids], pa.string())], names=["id", "term"])

    some = told.filter((F.col("_piece") == -1) & F.col("_bucket").isin([b for _, b in wanted]))
    names = {r.id: r.term for r in some.select("n", "_bucket", "_names").mapInArrow(named, "id bigint, term string").collect()}
    out = []
    for j in range(k):
        mine = sorted((r for r in rows if r.topic == j), key=lambda r: (-r.w, r.id))
        out += [(j, rank, names[r.id], float(r.w / sums[j])) for rank, r in enumerate(mine)]
    return out
