import random
import re

import numpy as np
import pytest

from kindred.llm import near_dedup as nd
from kindred.llm.common import WordCodes, two_columns
from kindred.llm.components import components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def brute(rows, k, threshold=80):
    sets = {i: shingles(t, k) for i, t in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(prose):
    rng = random.Random(5)
    rows = {}
    for i in range(60):
        rows[i] = prose(i, rng.choice([3, 30, 120, 250]))
    for i in range(60, 200):  # copies with a few words changed, some far enough to be strangers
        words = rows[rng.randrange(60)].split()
        for _ in range(rng.choice([0, 1, 1, 2, 6, 12])):
            words[rng.randrange(len(words))] = f"new{rng.random():.6f}"
        rows[i] = " ".join(words)
    shared = prose(999, 60)
    for i in range(200, 260):  # many documents around one passage
        rows[i] = prose(i, rng.choice([5, 12, 20, 60])) + " " + shared
    base = prose(1000, 200).split()
    for i in range(260, 330):  # a large group of near copies
        words = list(base)
        words[rng.randrange(200)] = f"w{i}"
        rows[i] = " ".join(words)
    rows[400], rows[401], rows[402], rows[403] = "", None, rows[0].upper(), "a b"
    rows[404], rows[405] = "a b", prose(77, 9000)
    rows[406], rows[407] = "a\x1cb c\x85d e f g", "É é A a B b"
    return list(rows.items())


@pytest.mark.parametrize("block, block_shingles, columns", [(512, 1_000_000, 4096), (3, 1_000_000, 7), (512, 400, 50)])
def test_components_equal_brute_force(make, prose, monkeypatch, block, block_shingles, columns):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", block_shingles)
    monkeypatch.setattr(nd, "COLUMNS", columns)
    rows = corpus(prose)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(two_columns(make(rows)), k=4).collect()}
    assert got == brute(rows, 4)


def test_kept_nulls_ties_and_empty(make):
    assert nd.near_duplicates(two_columns(make([]))).collect() == []
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, "a b c d e f"), (8, ""), (9, None)]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in nd.near_duplicates(two_columns(make(rows))).collect())
    assert got == [
        ("3", "3", True), ("3", "3", True), ("7", "3", False), ("8", "8", True), ("9", "9", True), ("None", "3", True),
    ]


def test_joint_estimate_is_close():
    rng = np.random.default_rng(1)
    for n, common in ((400, 400), (400, 300), (2000, 200), (50, 40)):
        pool = rng.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - common :])
        near = nd.joint_likeness(nd.registers(a)[None], nd.registers(b)[None], np.array([n]), np.array([n]))[0]
        assert abs(near - common / (2 * n - common)) < 0.17


def test_registers_merge():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64)) for _ in range(2))
    union = nd.registers(np.union1d(a, b))
    assert (union == np.maximum(nd.registers(a), nd.registers(b))).all()


def test_short_sequences_are_one_shingle():
    cache = WordCodes()
    assert len(nd.shingle_set(b"", 4, cache)) == 0 and len(nd.shingle_set(b"a b c", 4, cache)) == 1
    assert nd.shingle_set(b"A B", 4, cache).tolist() == nd.shingle_set(b"a b", 4, cache).tolist()
    assert nd.shingle_set(b"a b", 4, cache).tolist() != nd.shingle_set(b"b a", 4, cache).tolist()


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(200, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 200: 200}


def test_links_within_a_cell():
    rng = np.random.default_rng(3)
    pool = np.arange(1, 400, dtype=np.uint64)
    sets = [np.sort(rng.choice(pool[i % 5 * 60 : i % 5 * 60 + 70], rng.integers(1, 70), replace=False)) for i in range(80)]
    sets += [sets[0], pool, np.array([9_999], np.uint64)]
    want = []
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            n = len(np.intersect1d(x, sets[j]))
            if 100 * n >= 80 * (len(x) + len(sets[j]) - n):
                want.append((i, j))
    assert sorted(zip(*(a.tolist() for a in nd.links_within(sets, 80)))) == want
    assert len(nd.links_within([np.array([1], np.uint64), np.array([2], np.uint64)], 80)[0]) == 0


def test_family_of_strangers_costs_its_size(spark, make, prose, monkeypatch):
    """Texts with five private edits each: all of them alike, none of them linked."""
    written = {}
    plain = nd.materialise

    def counted(df, name):
        out = plain(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(nd, "materialise", counted)
    made = []
    for n in (150, 300):
        base, rng, rows = prose(1, 200).split(), random.Random(n), []
        for i in range(n):
            words = list(base)
            for at in rng.sample(range(200), 5):
                words[at] = f"w{i}x{at}"
            rows.append((i, " ".join(words)))
        written.clear()
        got = {r.doc_id: r.component_id for r in nd.near_duplicates(two_columns(make(rows)), k=4).collect()}
        assert got == {i: c for i, (_, c) in brute(rows, 4).items()}
        made.append(sum(sum(written.get(x, [])) for x in ("pairs", "cells", "links")))
    assert made[1] < 2.4 * made[0]
