import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kindred.llm import ball_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
QUERY = "item_id bigint, text string, n int, rank string"


def split(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, queries, top):
    found = [(i, split(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(t for _, ts in found for t in set(ts))
    out = []
    for item, text in queries:
        scored = []
        for doc, ts in found:
            tf, score = Counter(ts), 0
            for t in split(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * tf[t] // (1000 * tf[t] + 12 * (75 + 25 * len(ts) * n_docs // n_terms)))
            if score > 0:
                scored.append((-score, -1 if doc is None else doc, doc))
        scored.sort(key=lambda x: x[:2])
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(scored[:top])]
    return sorted(out, key=repr)


def found(frame):
    assert frame.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(prose):
    rng = random.Random(5)
    rows = [(i, prose(i, rng.randint(1, 120))) for i in range(160)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # ties beyond the top
    rows += [(300, None), (301, ""), (302, " .,;\t"), (None, rows[4][1]), (5, rows[5][1]), (5, rows[5][1])]
    rows += [(303, "The THE the Straße straße ÉTÉ été x9 y"), (304, prose(7, 30_000)), (305, "1\x7f2_3[4]5")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def items(corpus, prose):
    rows = [(i, prose(i, 12)) for i in range(12)] + [(20, corpus[0][1]), (20, "the of"), (21, None), (22, "qqqq"), (23, "!")]
    return rows + [(None, "the"), (24, "straße ÉTÉ 1 2 3 4 5 x9"), (25, "the the the of")]


@pytest.mark.parametrize("top, tree, leaf, block", [(20, 4096, 32, 200_000), (3, 16, 2, 40), (1, 7, 1, 1)])
def test_equals_brute_force(spark, make, corpus, items, top, tree, leaf, block):
    queries = spark.createDataFrame([(i, t, 1, "x") for i, t in items], QUERY)
    got = ball_search.ranked_search(make(corpus, 3), queries, top, tree, leaf, block)
    assert found(got) == brute(corpus, items, top)


def test_empty_tables(spark, make, corpus, items):
    queries = spark.createDataFrame([(i, t, 1, "x") for i, t in items], QUERY)
    assert found(ball_search.ranked_search(make([]), queries)) == []
    assert found(ball_search.ranked_search(make([(1, None), (2, ".")]), queries)) == []
    assert found(ball_search.ranked_search(make(corpus), queries.limit(0))) == []


def test_bounds_hold_and_prune():
    """No score of a node's documents exceeds its bound, and clustered documents leave leaves unopened."""
    rng = np.random.default_rng(1)
    width, rows = 300, []
    for topic in range(10):
        words = rng.choice(width, 25, replace=False)
        for _ in range(64):
            ids = np.sort(rng.choice(words, 12, replace=False))
            rows.append((ids, rng.integers(1, 1_000_000, 12)))
    start = np.concatenate(([0], np.cumsum([len(i) for i, _ in rows])))
    sparse = ball_search.Rows(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), start)
    tree = ball_search.BallTree(sparse, width, leaf=8)
    assert sorted(np.concatenate([n for n, _ in tree.leaves.values()])) == list(range(len(rows)))
    opened = 0
    for q in range(20):
        ids, values = rows[q * 30]
        dense = np.zeros(width, np.int64)
        dense[ids] = values
        scores, bounds = sparse.dot(dense), tree.bounds(ids, values)
        for node, (number, _) in tree.leaves.items():
            assert scores[number].max() <= bounds[node]
        best = ball_search.Best(5)
        opened += ball_search.descend(tree, ids, values, dense, list(range(len(rows))), best)
        assert sorted(best.heap, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(scores)), reverse=True)[:5]
    assert opened < 20 * len(tree.leaves) / 2
