import re

from pyspark.sql import functions as F

from kindred.llm import decontamination as dc
from kindred.llm.common import two_columns

WORD = re.compile(r"[^\W_]+")


def shingles(words):
    return {tuple(words[i : i + 5]): sum(map(len, words[i : i + 5])) for i in range(max(len(words) - 4, 1))} if words else {}


def brute(docs, items):
    out = set()
    for i, text in docs:
        words = WORD.findall((text or "").lower())
        for j, item in items:
            own = WORD.findall((item or "").lower())
            want = shingles(own)
            if len(own) < 5:  # one shingle, which only a document of just these words has
                if own and words == own:
                    out.add((i, j))
                continue
            for at in range(len(words) if own else 0):
                have = shingles(words[at : at + len(own)])
                if sum(v for k, v in have.items() if k in want) >= 0.8 * sum({**have, **want}.values()):
                    out.add((i, j))
    return out


def test_equals_brute_force(make, prose, spark):
    items = [(i, prose(3000 + i, n)) for i, n in enumerate([3, 5, 6, 15, 30, 45, 60])] + [(7, ""), (8, None), (9, prose(3004, 30))]
    docs = [(i, prose(i, 60)) for i in range(10)]
    for i in range(10, 30):
        item = items[i % 7][1].split()
        if i % 4 == 1 and len(item) > 20:
            item[-1] = "changed"
        if i % 4 == 2:
            item = item[: max(len(item) // 2, 1)]
        if i % 4 == 3:
            item = [w.upper() + "!" for w in item]
        docs.append((i, " ".join([prose(100 + i, 25), *item, prose(200 + i, 40)])))
    docs += [(40, items[5][1]), (41, ""), (42, None), (43, " ".join([items[4][1]] * 300)), (44, docs[12][1]), (45, items[0][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    out = dc.leaks(two_columns(make(docs)), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in out} == brute(docs, items)
    assert len(out) == len({(r.doc_id, r.item_id) for r in out})
    assert all(r.likeness >= 0.8 and 0 <= r.distance <= dc.RADIUS for r in out)


def test_changed_passages_equal_brute_force(make, prose, spark):
    items = [(i, prose(4000 + i, n)) for i, n in enumerate([20, 30, 45, 60, 90])]
    docs, n = [], 0
    for _, text in items:
        w = text.split()
        k, h = len(w) // 6, len(w) // 2
        forms = [
            w[k:] + w[:k], w[h:] + w[:h], w[2 * h // 3 :] + w[: 2 * h // 3], w[:h] + ["new", "words"] + w[h:],
            w[:h] + w[h + 2 :], w[:k] + w[k + 1 :], w[1:] + ["put", "in"], w[:h] + w[:3] + w[h:], w[k : 2 * k] + w[:k] + w[2 * k :],
            w[:h] + prose(70, 2 * h).split() + w[h:],
        ]
        for form in forms:
            docs.append((n, " ".join([prose(5000 + n, 7 * (n % 9)), *form, prose(6000 + n, 5 * (n % 8))])))
            n += 1
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    out = dc.leaks(two_columns(make(docs)), benchmark).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in out} == want
    assert {(30, 3), (31, 3)} <= want  # the first words moved to the end, and halves swapped


def test_null_ids_are_reported(make, prose, spark):
    a, b = prose(1, 30), prose(2, 30)
    benchmark = spark.createDataFrame([(None, a), (2, b)], "item_id bigint, text string")
    docs = two_columns(make([(None, b), (None, f"x {a}"), (5, a), (6, prose(3, 50))]))
    out = dc.leaks(docs, benchmark)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(None, 2), (None, None), (5, None)}
    assert {r.doc_id for r in dc.contaminated(docs, benchmark).collect()} == {None, 5}


def test_empty_tables(make, spark):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert dc.leaks(two_columns(make([(1, "a b c d e f")])), nothing).collect() == []
    assert dc.leaks(two_columns(make([])), some).collect() == []
    assert dc.contaminated(two_columns(make([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x")])), some).collect() == [(1,)]


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rows = []
    import random

    rng = random.Random(2)
    for i in range(200):
        a = [rng.randint(0, 1) for _ in range(64)]
        b = list(a)
        for j in rng.sample(range(64), i % (dc.RADIUS + 1)):
            b[j] ^= 1
        rows.append(("".join(map(str, a)), "".join(map(str, b)), i % (dc.RADIUS + 1)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    agree = F.zip_with(dc.blocks(F.col("a")), dc.blocks(F.col("b")), lambda x, y: x == y)
    got = df.select("d", dc.hamming(F.col("a"), F.col("b")).alias("h"), F.array_contains(agree, True).alias("met")).collect()
    assert all(r.d == r.h and r.met for r in got)
