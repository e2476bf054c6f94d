import random
import re

import pytest

from kindred.llm import substring
from kindred.llm.common import two_columns


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    count = {}
    for _, ws in words:
        for j in range(len(ws) - window + 1):
            key = tuple(ws[j : j + window])
            count[key] = count.get(key, 0) + 1
    out = []
    for i, ws in words:
        gone = [False] * len(ws)
        for j in range(len(ws) - window + 1):
            if count[tuple(ws[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        out.append((i, len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)))
    return sorted(out, key=str)


def corpus(prose):
    rng = random.Random(3)
    passages = [prose(500 + i, n) for i, n in enumerate([34, 35, 36, 60, 200])]
    rows = []
    for i in range(60):
        parts = [prose(i, rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), prose(1000 + i, rng.randint(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(100, "x " * 200), (101, "x y " * 40), (102, ""), (103, None), (104, passages[1]), (105, prose(9, 5000))]
    rows += [(106, rows[5][1]), (106, rows[5][1]), (107, rows[6][1].upper()), (108, "a\tb\n" * 30 + "c\x0bd\x0ce\x1cf")]
    return rows


@pytest.mark.parametrize("window, limit", [(35, 50_000), (35, 2), (5, 50_000), (50, 3), (1, 50_000), (1, 2), (9, 4)])
def test_equals_brute_force(make, prose, window, limit):
    rows = corpus(prose)
    out = substring.drop_repeats(two_columns(make(rows)), window, limit, chunk=64)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=str) == brute(rows, window)


def test_empty_table_and_same_id_with_other_text(make, prose):
    assert substring.drop_repeats(two_columns(make([]))).collect() == []
    a, b = prose(1, 50), prose(2, 50)
    rows = [(1, a), (1, b), (2, a), (None, b), (None, None)]
    out = substring.drop_repeats(two_columns(make(rows)))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=str) == brute(rows, 35)


def test_rows_without_id_cost_their_number(spark, make, prose, monkeypatch):
    """Rows that share a (null) doc_id have lists of their own."""
    longest = []
    plain = substring._with_lists

    def measured(docs, rows, how, *columns):
        out = plain(docs, rows, how, *columns)
        longest.append(out.selectExpr(f"max(size({columns[0]}s))").first()[0])
        return out

    monkeypatch.setattr(substring, "_with_lists", measured)
    passage = prose(1, 60)
    rows = [(None, f"{prose(i + 10, 20)} {passage}") for i in range(200)] + [(None, passage)] * 100
    out = substring.drop_repeats(two_columns(make(rows)))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=str) == brute(rows, 35)
    assert max(x for x in longest if x is not None) <= 60
