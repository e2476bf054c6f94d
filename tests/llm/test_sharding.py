import zlib
from collections import Counter, defaultdict

from kindred.llm import sharding
from kindred.llm.common import two_columns


def test_every_row_once_gapless_and_balanced(make, prose):
    rows = [(i, prose(i % 700, 20 + i % 90)) for i in range(1500)] + [(9000 + i, "hot copy of a text") for i in range(600)]
    rows += [(20_000, ""), (20_001, None), (20_002, prose(1, 4000))]
    out = sharding.assign_shards(two_columns(make(rows)), shards=8, grain=64).collect()
    text = dict(rows)
    assert Counter(r.doc_id for r in out) == Counter(list(text))
    size, slots = Counter(), defaultdict(list)
    for r in out:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(size.values()) / 8
    assert max(size.values()) < 1.12 * mean and min(size.values()) > 0.88 * mean


def test_equal_texts_share_a_shard_unless_larger_than_one(make, prose):
    rows = [(i, prose(i // 3, 60)) for i in range(900)]
    out = sharding.assign_shards(two_columns(make(rows)), shards=6, grain=16).collect()
    place = {r.doc_id: r.shard for r in out}
    assert all(place[i] == place[i - i % 3] for i in range(900))
    hot = [(i, "one text") for i in range(600)]
    counts = Counter(r.shard for r in sharding.assign_shards(two_columns(make(hot)), shards=6).collect())
    assert len(counts) == 6 and max(counts.values()) < 1.3 * 100


def test_same_rows_same_shards(make, prose):
    rows = [(i, prose(i, 30)) for i in range(200)]
    runs = [
        {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(two_columns(make(x, p)), shards=5).collect()}
        for x, p in ((rows, 2), (rows[::-1], 5))
    ]
    assert runs[0] == runs[1]


def test_empty_table_nulls_and_repeated_rows(make):
    assert sharding.assign_shards(two_columns(make([]))).collect() == []
    out = sharding.assign_shards(two_columns(make([(None, "a"), (1, "a"), (1, "a")])), shards=2).collect()
    assert len(out) == 3 and len({(r.shard, r.slot) for r in out}) == 3


def test_packing_equals_brute_force():
    """Largest first, each item where the dot product with what is left is highest; in plain Python."""
    import random

    import pandas as pd

    rng = random.Random(2)
    for shards, n in ((3, 40), (5, 7), (4, 200)):
        items = [(rng.getrandbits(40), rng.randint(1, 900), rng.randint(0, 200), rng.randint(1, 30)) for _ in range(n)]
        total = [max(sum(x[d] for x in items), 1) for d in (1, 2, 3)]
        need = {x[0]: [x[d + 1] / total[d] * shards for d in range(3)] for x in items}
        left, place = [[1.0] * 3 for _ in range(shards)], {}
        for name in sorted(need, key=lambda i: (-max(need[i]), -sum(need[i]), i)):
            fits = [s for s in range(shards) if all(a >= b - 1e-9 for a, b in zip(left[s], need[name]))]
            if fits:
                best = max(fits, key=lambda s: (round(sum(a * b for a, b in zip(left[s], need[name])), 12), -s))
            else:
                best = max(range(shards), key=lambda s: (round(min(a - b for a, b in zip(left[s], need[name])), 12), -s))
            place[name] = best
            left[best] = [a - b for a, b in zip(left[best], need[name])]
        got = sharding.pack(pd.DataFrame(items, columns=["item", "bytes", "tokens", "rows"]), shards)
        assert dict(zip(got["item"].tolist(), got["shard"].tolist())) == place
