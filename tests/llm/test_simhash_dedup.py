import random
import re

import numpy as np
import pytest
import xxhash

from kindred.llm import simhash_dedup


def brute_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """The smallest id reachable over links of at most three bits, for a list of (id, print)."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, x) in enumerate(prints):
        for j in range(i):
            if (x ^ prints[j][1]).bit_count() <= 3:
                label[root(i)] = root(j)
    groups = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            groups[root(i)] = min(doc, groups.get(root(i), doc))
    return [groups.get(root(i)) for i in range(len(prints))]


def test_equals_brute_force(make, prose):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randint(1, 90))) for i in range(150)]
    for i in range(120):  # near copies of long texts, some of them of each other
        words = (prose(900 + i % 4, 400) if i % 3 else rows[-1][1]).split(" ")
        words[rng.randrange(len(words))] = f"w{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000, None), (1999, ""), (1998, " \t\n"), (None, rows[0][1]), (None, prose(77, 50)), (7, prose(8, 60)), (7, prose(9, 60))]
    rows += [(1500 + i, rows[20][1].upper()) for i in range(30)] + [(1600, "a\x1cb c d"), (1601, prose(5, 70_000))]
    got = simhash_dedup.simhash_classes(make(rows, 3)).collect()
    prints = [(i, brute_print(t)) for i, t in rows]
    want = sorted((str(i), p, c) for (i, p), c in zip(prints, brute_classes(prints)) if c is not None or i is None)
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in got) == want
    assert len({c for _, _, c in want}) < len(want) - 100


@pytest.mark.parametrize("run", [512, 3])
def test_links_in_hot_variants(spark, run):
    """A dense ball, a cube and strangers that share a half: every level of variants gives the same classes."""
    rng = random.Random(run)
    base = rng.getrandbits(64)
    prints = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(120)}
    prints |= {base ^ (1 << 63) ^ (1 << 20) ^ (x << 40) for x in range(64)}
    prints |= {(base & 0xFFFFFFFF) | rng.getrandbits(32) << 32 for _ in range(60)}
    prints |= {(base & 0xFFFFFFFF00000000) | rng.getrandbits(32) for _ in range(60)}
    prints |= {x ^ 0b111 << rng.randrange(60) for x in rng.sample(sorted(prints), 40)}
    order = sorted(prints)
    signed = np.array(order, np.uint64).view(np.int64).tolist()
    sets = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    edges = [(a, b) for a, b in simhash_dedup.links(sets, run).collect()]
    assert all(((a ^ b) % 2**64).bit_count() <= 64 and a != b for a, b in edges)
    want = brute_classes(list(enumerate(order)))
    label = {x: x for x in signed}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        label[root(a)] = root(b)
    first = {}
    for i, x in enumerate(signed):
        first.setdefault(root(x), i)
    assert [first[root(x)] for x in signed] == want


def test_stars_grow_with_the_group(spark):
    """A cube of 2^11 fingerprints has 236,000 links; at most a row a member leaves a task."""
    prints = [x << 3 for x in range(1 << 11)]
    sets = spark.createDataFrame([(x,) for x in prints], "fp bigint")
    assert simhash_dedup.links(sets).count() < 40 * len(prints)


def test_empty_table(make):
    out = simhash_dedup.simhash_classes(make([]))
    assert out.columns == ["doc_id", "fp", "component_id"] and out.count() == 0
