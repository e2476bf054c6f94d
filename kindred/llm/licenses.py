"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies.

Templates are license lines, notices and SPDX tags. Words are runs of ASCII letters and digits in lower case; texts and templates
are sequences of shingles of ``SHINGLE`` words.

1. Windows. Templates fall into size classes by their number of words. The windows of a class are ``2 * stride`` words
   long and begin every ``stride`` words, where stride is a power of two, at least 8, that no template of the class
   exceeds. So every occurrence of a template lies whole in some window. Templates of more than half a stride make
   up about a quarter of the window's shingles, the shortest ones of the first class (three words) less than an eighth.
2. Bands. A window's MinHash signature has ``BANDS`` bands of one row. Where a template makes up a share j of a
   window, a band agrees with probability j (the window's minimum is among the template's shingles): all 96 bands miss
   with probability 1e-12 at j = 1/4 and 3e-6 at j = 1/8. A class has one sorted table of (band, value) keys in which all
   windows are looked up at once, after a filter by their low bits. Its size is bounded by ``MAX_TEMPLATES``, and it goes to every task.
3. Verification. A template that shares a band with windows is looked for in them, shingle by shingle: a place is a span of a
   quarter more shingles than the template has, that begins with one of its shingles and whose share of the template's shingles is at
   least ``least``. Shingles with a number in them (versions) must all be there. Of places of a template that overlap the one with
   the largest share counts, the first of equals; each further one is an occurrence of its own.
4. Of occurrences of different templates that overlap, the one with the largest share wins, then the longest, then the first
   in the table. So a notice of one version is not reported as another, as long as the table has it.

Everything happens inside a row, so there is no shuffle, and a template or a text that a third of all rows share is no
hot key. Signatures are taken in pieces of ``PIECE`` shingles, so memory does not grow with them.

Defined cases: null and empty texts match nothing; a null doc_id is carried along; templates of fewer words than a shingle are
one shingle; an empty template matches nothing; long texts are scanned whole; equal rows give equal results; columns other
than doc_id and text are ignored, whatever their names; an empty table gives an empty result. A license that the table lacks
gives no row, or that of a template that shares the words (but for numbers).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kindred.llm.common import WordCodes, odd_constants, rolling

SHINGLE = 3
BANDS = 96
CONTAINMENT = 0.8
MAX_TEMPLATES = 5_000
PIECE = 1 << 14
SEED = 31

# SPDX identifiers and the names under which texts speak of these licenses.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"],
    "MPL-1.1": ["Mozilla Public License, v. 1.1", "Mozilla Public License 1.1", "Mozilla Public License, version 1.1"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "Zlib": ["zlib License"],
    "Unlicense": ["The Unlicense", "released into the public domain under the Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0"],
    "CC-BY-3.0": ["Creative Commons Attribution 3.0", "CC BY 3.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0", "CC BY 4.0"],
    "CC-BY-SA-3.0": ["Creative Commons Attribution-ShareAlike 3.0", "CC BY-SA 3.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0", "CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "CC BY-NC-ND 4.0"],
}
# Sentences of notices.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance"
        " with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed"
        " on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held"
        " liable for any damages arising from the use of this software.",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
}
# How sentences name a license, and the notice that the GNU licenses share.
PHRASES = ("Licensed under the {}", "Released under the {}", "Licensed under {}", "This work is licensed under the {}", "licensed under a {} International License")
GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as"
    " published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
GNU = {"GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3")}


def default_templates() -> dict[str, list[str]]:
    """Per license: its names in each phrase, its SPDX tag, and its notices."""
    out = {}
    for license_, names in NAMES.items():
        texts = [name for name in names if len(re.findall("[A-Za-z0-9]+", name)) >= SHINGLE]
        texts += [p.format(name) for name in names for p in PHRASES if not p.endswith("International License") or name.startswith("Creative")]
        texts.append(f"SPDX-License-Identifier: {license_}")
        texts += NOTICES.get(license_, [])
        if license_ in GNU:
            texts.append(GNU_NOTICE.format(*GNU[license_]))
        out[license_] = texts
    return out


TEMPLATES = default_templates()

_WORD = re.compile(rb"[A-Za-z0-9]+")
_A = (odd_constants(BANDS, SEED + 1) >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
_B = (odd_constants(BANDS, SEED + 2) >> np.uint64(32)).astype(np.uint32)[:, None]
_BAND = (np.arange(BANDS, dtype=np.uint64) << np.uint64(32))[:, None]
#: low bits of a value that say, with a bit per band, whether the table can have it
FILTER = 14
_FILTER_BAND = (np.arange(BANDS, dtype=np.uint32) << np.uint32(FILTER))[:, None]


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _shingles(codes: np.ndarray) -> np.ndarray:
    """Hash of the shingle that begins at each word; a text shorter than a shingle is one."""
    n = len(codes)
    return rolling(codes, SHINGLE, SEED) if n >= SHINGLE else rolling(codes, n, SEED + n) if n else codes


def _band_values(hashes: np.ndarray) -> np.ndarray:
    """(BANDS, n): each shingle's value in each band; a set's signature is the minimum of its shingles' values."""
    return (hashes >> np.uint64(32)).astype(np.uint32)[None, :] * _A + _B


class TemplateIndex:
    """The templates, and the band table of each size class."""

    def __init__(self, templates: dict[str, list[str]]):
        cache = WordCodes()
        texts = [(name, i, t) for name, ts in templates.items() for i, t in enumerate(ts)]
        if len(texts) > MAX_TEMPLATES:
            raise ValueError(f"{len(texts)} templates are more than the {MAX_TEMPLATES} that are sent to every task")
        self.names, self.sets, self.known, self.spans, self.telling = [], [], [], [], []
        members = defaultdict(list)
        for name, i, text in texts:
            words = words_of(text.encode())
            if not words:
                continue
            shingles = _shingles(cache.of(words))
            number = [any(w.isdigit() for w in words[j : j + SHINGLE]) for j in range(len(shingles))]
            members[1 << int(max(len(words) + len(words) // 4, 8) - 1).bit_length()].append(len(self.names))
            self.names.append((name, i))
            self.sets.append(np.unique(shingles))
            self.spans.append(len(shingles) + len(shingles) // 4)
            self.known.append(frozenset(shingles.tolist()))
            self.telling.append(frozenset(shingles[number].tolist()))
        self.classes, self.filters = {}, {}
        self.stride_of = {t: stride for stride, own in members.items() for t in own}
        for stride, own in members.items():
            values = np.stack([_band_values(self.sets[t]).min(axis=1) for t in own], 1)
            self.filters[stride] = np.zeros(BANDS << FILTER, bool)
            self.filters[stride][(values & np.uint32((1 << FILTER) - 1)) + _FILTER_BAND] = True
            keys = values.astype(np.uint64) + _BAND
            order = np.argsort(keys.ravel(), kind="stable")
            self.classes[stride] = (keys.ravel()[order], np.tile(np.array(own), BANDS)[order])


def _window_signatures(hashes: np.ndarray, strides: list[int]) -> dict[int, np.ndarray]:
    """(BANDS, windows) for each stride: minima of stretches of the smallest stride, folded for the others."""
    stride = min(strides)
    step = PIECE // stride * stride
    low = np.concatenate(
        [
            np.minimum.reduceat(values := _band_values(hashes[at : at + step]), np.arange(0, values.shape[1], stride), axis=1)
            for at in range(0, len(hashes), step)
        ], axis=1,
    )
    out = {}
    for wanted in sorted(strides):
        while stride < wanted:
            if low.shape[1] % 2:
                low = np.concatenate((low, low[:, -1:]), axis=1)
            low, stride = np.minimum(low[:, ::2], low[:, 1::2]), 2 * stride
        out[wanted] = np.minimum(low, np.concatenate((low[:, 1:], low[:, -1:]), axis=1))
    return out


def candidates(hashes: np.ndarray, index: TemplateIndex) -> dict[int, np.ndarray]:
    """For each template that shares a band with a window: the first shingles of those windows."""
    found: dict[int, list] = defaultdict(list)
    for stride, windows in _window_signatures(hashes, sorted(index.classes)).items():
        keys, owner = index.classes[stride]
        likely = index.filters[stride][(windows & np.uint32((1 << FILTER) - 1)) + _FILTER_BAND]
        band, window = np.nonzero(likely)
        wanted = windows[band, window].astype(np.uint64) + _BAND[band, 0]
        low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        for k in np.flatnonzero(high > low).tolist():
            for t in owner[low[k] : high[k]].tolist():
                found[t].append(int(window[k]) * stride)
    return {t: np.unique(starts) for t, starts in found.items()}


def places(hashes: np.ndarray, t: int, index: TemplateIndex, least: float) -> list[tuple[float, int, int]]:
    """(share, first shingle, end) of the occurrences of a template in a run of shingles, from left to right."""
    own, span, telling = index.known[t], index.spans[t], index.telling[t]
    run = hashes.tolist()
    if len(own.intersection(run)) < least * len(own):
        return []
    hits: list[tuple[int, int, float]] = []
    for i in [i for i, h in enumerate(run) if h in own]:
        first: dict[int, int] = {}
        for j, h in enumerate(run[i : i + span]):
            if h in own:
                first.setdefault(h, j)
        share = len(first) / len(own)
        if share >= least and telling <= first.keys():
            hits.append((i, i + 1 + max(first.values()), share))
    out, k = [], 0
    while k < len(hits):
        first_end, best = hits[k][1], hits[k]
        for hit in hits[k:]:
            if hit[0] >= first_end:
                break
            if hit[2] > best[2]:
                best = hit
        out.append((best[2], best[0], best[1]))
        while k < len(hits) and hits[k][0] < best[1]:
            k += 1
    return out


def scan(codes: np.ndarray, index: TemplateIndex, least: float) -> list[tuple[int, float, int]]:
    """(template, share, first word) of the occurrences that win their place, by place."""
    hashes = _shingles(codes)
    if not len(hashes) or not index.classes:
        return []
    found = []
    for t, starts in candidates(hashes, index).items():
        reach = 2 * index.stride_of[t]
        cuts = np.flatnonzero(np.diff(starts) > reach) + 1  # windows that touch are one run
        for run in np.split(starts, cuts):
            begin, end = int(run[0]), int(run[-1]) + reach
            found += [(-share, -index.spans[t], t, begin + i, begin + to) for share, i, to in places(hashes[begin:end], t, index, least)]
    won: list[tuple[int, int, int, float]] = []  # apart from each other and in order
    for share, _, t, i, end in sorted(found):
        k = bisect_left(won, (i,))
        if (k == len(won) or end <= won[k][0]) and (k == 0 or won[k - 1][1] <= i):
            won.insert(k, (i, end, t, -share))
    return [(t, share, i) for i, _, t, share in won]


def license_matches(
    docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = CONTAINMENT
) -> DataFrame:
    """doc_id, license, template (its number), start (its first word), containment: a row per occurrence, for rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, index = WordCodes(), TemplateIndex(templates)
        for batch in batches:
            rows, out = [], []
            texts = batch.column(1).cast(pa.binary())
            for at in range(batch.num_rows):
                for t, share, start in scan(cache.of(words_of(texts[at].as_py() or b"")), index, least):
                    rows.append(at)
                    out.append((*index.names[t], start, round(share, 6)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.string()),
                 pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64())],
                names=["doc_id", "license", "template", "start", "containment"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, license string, template int, start bigint, containment double"
    )
