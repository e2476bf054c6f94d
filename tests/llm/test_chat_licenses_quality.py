import re

import numpy as np

from kindred.llm import chat, licenses, quality
from kindred.llm.common import two_columns

TURNS = "conv_id bigint, turn int, role string, text string, n_turns int"


def conversations(spark):
    def turns(conv, *texts):
        return [(conv, i, "user" if i % 2 == 0 else "assistant", t, 99) for i, t in enumerate(texts)]

    rows = [
        *turns(1, "a"), *turns(2, "a", "b"), *turns(3, "a", "b", "c"), *turns(4, "a", "x"), *turns(5, "a", "b", "c"),
        *turns(6, "b"), *turns(7, None), *turns(8, "", "y"), *turns(9, "z" * 50_000), *turns(None, "q"),
        (10, 0, None, None, 99), (10, 0, None, None, 99), *turns(11, "b"), *turns(12, "a", "b", "c"),
    ]
    return spark.createDataFrame(rows, TURNS).repartition(3)


def test_snapshots_collapse(spark):
    got = {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in chat.chat_texts(conversations(spark)).collect()}
    assert set(got) == {3, 4, 6, 8, 9, 10, None}
    assert got[3][:2] == (3, 3) and got[6][:2] == (1, 2) and got[10][0] == 2
    assert got[4][2] == "<|user|>\na<|end|>\n<|assistant|>\nx<|end|>\n"
    assert chat.chat_texts(conversations(spark).limit(0)).collect() == []


def test_rows_without_conversation_are_their_own(spark):
    rows = [(None, 0, "user", f"t{i % 90}", 9) for i in range(100)] + [(1, 0, "user", "t50", 9), (2, 0, "user", "t6", 9), (2, 1, "assistant", "x", 9)]
    got = chat.chat_texts(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(r.conv_id for r in got if r.conv_id is not None) == [1, 2]
    loose = [r for r in got if r.conv_id is None]
    # texts 0 to 9 are there twice (a conversation of two equal turns), and conversation 1 stands for its copy
    assert sorted((r.rendered.count("<|end|>"), r.copies) for r in loose) == [(1, 1)] * 79 + [(2, 1)] * 10
    assert next(r.copies for r in got if r.conv_id == 1) == 2


def brute_licenses(text, templates, least=0.8):
    """Every place of every template in the whole text, with words as strings; then the winners."""
    def shingles(t):
        words = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else "?" for c in t or ""))
        return [tuple(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []

    doc, found = shingles(text), []
    for k, (name, i, t) in enumerate((n, i, t) for n, ts in templates.items() for i, t in enumerate(ts)):
        own = shingles(t)
        span, kinds = len(own) + len(own) // 4, set(own)
        telling = {s for s in kinds if any(w.isdigit() for w in s)}
        hits = []
        for at, s in enumerate(doc):
            if s in kinds:
                inside = doc[at : at + span]
                share = len(kinds & set(inside)) / len(kinds)
                if share >= least and telling <= set(inside):
                    hits.append((at, at + 1 + max(inside.index(x) for x in kinds & set(inside)), share))
        while hits:
            best = max((h for h in hits if h[0] < hits[0][1]), key=lambda h: (h[2], -h[0]))
            found.append((-best[2], -span, k, best[0], best[1], name, i))
            hits = [h for h in hits if h[0] >= best[1]]
    won = []
    for share, _, _, at, end, name, i in sorted(found):
        if all(end <= a or b <= at for a, b, *_ in won):
            won.append((at, end, name, i, round(-share, 6)))
    return sorted((name, i, at, share) for at, _, name, i, share in won)


def test_licenses_equal_brute_force(make, prose):
    some = {n: licenses.TEMPLATES[n] for n in ("MIT", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "BSD-2-Clause", "Apache-2.0")}
    some["empty"] = ["", "!?"]
    some["short"] = ["one", "two words"]
    rows = [(i, prose(i, 40)) for i in range(5)]
    for i, (name, texts) in enumerate(some.items()):
        for k, text in enumerate(texts):
            rows.append((100 + 20 * i + k, f"{prose(50 + i + k, 300)} {text.upper()} {prose(90 + i, 13 * i)}. Two words {text}"))
    long = some["MIT"][-1]
    rows += [(900, ""), (901, None), (902, long[:400]), (903, prose(7, 20_000) + " " + long + " " + prose(8, 9000))]
    rows += [(904, rows[6][1]), (904, rows[6][1]), (None, some["MIT"][0]), (905, (long + " ") * 3), (906, long.replace("software", "program"))]
    got = {}
    for r in licenses.license_matches(two_columns(make(rows)), some).collect():
        got.setdefault(str(r.doc_id), []).append((r.license, r.template, r.start, r.containment))
    want = {}
    for i, text in rows:
        want.setdefault(str(i), []).extend(brute_licenses(text, some))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items() if v}
    assert len(got["905"]) == 3
    assert licenses.license_matches(two_columns(make([]))).collect() == []


def test_versions_are_told_apart(make):
    lines = {
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        licenses.GNU_NOTICE.format("Affero General", "3"): "AGPL-3.0",
        licenses.GNU_NOTICE.format("General", "2"): "GPL-2.0",
        licenses.GNU_NOTICE.format("General", "3"): "GPL-3.0",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "Text under CC BY 4.0 here": "CC-BY-4.0",
        "Text under CC BY-SA 4.0 here": "CC-BY-SA-4.0",
        "See the Mozilla Public License 2.0 for terms": "MPL-2.0",
        "SPDX-License-Identifier: LGPL-2.1": "LGPL-2.1",
        "# SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
        "under the GNU General Public License, version 7": None,
        "licensed under the Apache License, Version 1.1": None,
    }
    rows = list(enumerate(lines))
    got = {}
    for r in licenses.license_matches(two_columns(make(rows))).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert {i: got.get(i) for i, _ in rows} == {i: None if lines[t] is None else [lines[t]] for i, t in rows}


def test_signatures_are_taken_in_pieces(monkeypatch):
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    whole = licenses._window_signatures(hashes, [8, 64])
    monkeypatch.setattr(licenses, "PIECE", 256)
    for stride, windows in licenses._window_signatures(hashes, [8, 64]).items():
        assert (windows == whole[stride]).all()
        for w in (0, 3, windows.shape[1] - 1):
            part = hashes[w * stride : (w + 2) * stride]
            assert (windows[:, w] == licenses._band_values(part).min(axis=1)).all()


def test_weak_labels_beat_their_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    rates = [0.9, 0.8, 0.7, 0.85, 0.75, 0.65, 0.9, 0.6]
    votes = np.stack([np.where(rng.random(len(truth)) < r, truth, ~truth) * 2 - 1 for r in rates], 1)
    votes[rng.random(votes.shape) < 0.3] = 0
    codes = (votes + 1) @ 3 ** np.arange(7, -1, -1)
    patterns, at, counts = np.unique(codes, return_inverse=True, return_counts=True)
    assert (quality.votes_of(patterns)[at] == votes).all()
    good = quality.expectation_maximisation(patterns, counts)[at] > 0.5
    assert (good == truth).mean() > 0.95


def test_quality_keeps_prose_and_rejects_junk(make, prose):
    rows = [(i, prose(i, 150)) for i in range(150)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in prose(500 + i, 90).split())) for i in range(25)]
    rows += [(300 + i, " ".join(w + "#$%&" for w in prose(600 + i, 90).split())) for i in range(25)]
    rows += [(400, ""), (401, None), (None, prose(1, 150)), (402, prose(2, 20_000)), (0, rows[0][1])]
    got = [(r.doc_id, r.kept) for r in quality.quality_scores(two_columns(make(rows))).collect()]
    assert len(got) == len(rows)
    prose_kept = [k for i, k in got if i is None or i < 200]
    junk_kept = [k for i, k in got if i is not None and 200 <= i < 402]
    assert np.mean(prose_kept) > 0.97 and np.mean(junk_kept) < 0.1
    assert quality.quality_scores(two_columns(make([]))).collect() == []


def test_scores_equal_a_plain_version(make, prose):
    """Votes, EM over all rows, fit and scores again without Spark, from the same sample rule."""
    rows = [(i, prose(i, 30 + i)) for i in range(60)] + [(100 + i, prose(i, 40).upper() + "!!! ###") for i in range(20)]
    rows += [(200, ""), (201, None), (7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1])]
    got = sorted((str(r.doc_id), r.p_labels, r.p_good, r.kept) for r in quality.quality_scores(two_columns(make(rows))).collect())
    texts = [(t or "").encode() for _, t in rows]
    codes = [quality.pattern(quality.facts(t, t.split())) if t.split() else None for t in texts]
    patterns, counts = np.unique([c for c in codes if c is not None], return_counts=True)
    posterior = dict(zip(patterns.tolist(), quality.expectation_maximisation(patterns, counts).tolist()))
    make_features = quality.Features(quality.DIMENSIONS)
    features = {t: make_features(t.split(), quality.facts(t, t.split())) for t in texts if t.split()}
    seen = sorted({(str(i), t) for (i, _), t in zip(rows, texts) if t.split()})  # a repeated row counts once
    w, b = quality.fit([features[t] for _, t in seen], np.array([posterior[codes[texts.index(t)]] for _, t in seen]), quality.DIMENSIONS)
    want = []
    for (i, _), t, c in zip(rows, texts, codes):
        at, value = features.get(t, (None, None))
        good = 0.0 if c is None else float(1 / (1 + np.exp(-((w.astype(np.float32)[at] * value).sum() + b))))
        want.append((str(i), 0.0 if c is None else posterior[c], good, good >= quality.THRESHOLD))
    assert [(i, k) for i, _, _, k in got] == [(i, k) for i, _, _, k in sorted(want)]
    assert np.allclose([x[1:3] for x in got], [x[1:3] for x in sorted(want)], atol=1e-5)
