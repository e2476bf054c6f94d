"""Quality classifier from weak labels.

1. *Heuristic labellers* vote on every document: good (1), bad (-1) or nothing (0). They overlap and err.
2. *Expectation-maximisation* estimates how often each labeller gives each vote on good and on bad documents, without any true
   label (two latent classes, votes independent given the class). It runs over the table of distinct vote vectors with
   their counts over all documents: at most 3 ** len(LABELLERS) rows, however large the corpus is.
3. *A hashed linear scorer* (logistic regression over hashed words, word shapes and coarse statistics) is fitted to the
   posterior labels of a sample of about ``sample`` documents, chosen by a hash of doc_id and the text, and then scores every document. It also
   sees what no labeller looks at.

A document is kept if the scorer's probability of good is at least ``threshold``. Defined cases: null and empty texts
have no words and count as bad with probability 1, they are never scored; an empty table gives an empty result; texts are
read whole; equal texts score equally; a corpus on which no labeller votes bad is kept whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import give_back

SAMPLE = 8_000
DIMENSIONS = 1 << 15
THRESHOLD = 0.5

# Frequent function words of English, German, Spanish and French.
STOPWORDS = frozenset(
    b"the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which"
    b" der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie"
    b" de la que el en y a los se del las un por con no una su para es al lo como le les et un une des du dans qui pour"
    b" pas sur au avec ce il sont ou".split()
)

_UPPER, _LOWER, _DIGIT, _SPACE, _PLAIN, _SIGN = range(6)


def _byte_classes() -> np.ndarray:
    """Class of each byte of UTF-8; bytes beyond ASCII count as lower-case letters."""
    out = np.full(256, _LOWER, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = (
            _UPPER if c.isupper() else _LOWER if c.islower() else _DIGIT if c.isdigit() else _SPACE if c.isspace()
            else _PLAIN if c in ".,;:!?'\"()-" else _SIGN
        )
    return out


_CLASSES = _byte_classes()


@dataclass
class Facts:
    """What the labellers look at; shares are of words, letters or bytes."""

    words: int
    stop: float
    distinct: float
    upper: float
    signs: float
    length: float
    lines: float
    shouts: float


def facts(text: bytes, words: list[bytes]) -> Facts:
    n = max(len(words), 1)
    kinds = np.bincount(_CLASSES[np.frombuffer(text, np.uint8)], minlength=6)
    letters = max(int(kinds[_UPPER] + kinds[_LOWER]), 1)
    solid = max(len(text) - int(kinds[_SPACE]), 1)
    lines = [x for x in text.split(b"\n") if len(x) > 20]
    return Facts(
        words=len(words), stop=sum(map(STOPWORDS.__contains__, map(bytes.lower, words))) / n,
        distinct=len(set(words)) / n ** 0.85 if n > 1 else 1.0, upper=int(kinds[_UPPER]) / letters,
        signs=int(kinds[_SIGN]) / solid, length=solid / n, lines=len(set(lines)) / len(lines) if lines else 1.0,
        shouts=(text.count(b"!") + text.count(b"|")) / n,
    )


def _vote(bad: bool, good: bool) -> int:
    return -1 if bad else int(good)


LABELLERS = {
    "function words": lambda f: _vote(f.stop < 0.04, f.stop > 0.12),
    "variety": lambda f: _vote(f.words > 40 and f.distinct < 0.55, f.distinct > 0.9),
    "capitals": lambda f: _vote(f.upper > 0.3, f.upper < 0.1),
    "signs": lambda f: _vote(f.signs > 0.06, f.signs < 0.01),
    "word length": lambda f: _vote(f.length > 14 or f.length < 2, 3 < f.length < 9),
    "repeated lines": lambda f: _vote(f.lines < 0.7, f.lines > 0.95 and f.words > 80),
    "shouts and bars": lambda f: _vote(f.shouts > 0.25, f.shouts < 0.02),
    "size": lambda f: _vote(f.words < 4, f.words > 50),
}


def pattern(f: Facts) -> int:
    """All votes as one number, three values to a digit."""
    out = 0
    for vote in LABELLERS.values():
        out = out * 3 + vote(f) + 1
    return out


def votes_of(patterns: np.ndarray) -> np.ndarray:
    """The votes of patterns, one column per labeller."""
    n = len(LABELLERS)
    return patterns[:, None] // 3 ** np.arange(n - 1, -1, -1)[None, :] % 3 - 1


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior probability of good for each vote pattern."""
    votes = votes_of(patterns)
    one_hot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)
    weight = counts.astype(float)
    balance = votes.sum(1) - 2 * (votes == -1).sum(1)  # a bad vote weighs more than a good one to begin with
    good = 1 / (1 + np.exp(-(balance + 0.5)))
    # two pseudo-documents per cell that lean to each labeller's meaning keep the classes from changing places
    lean = np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]])
    for _ in range(rounds):
        mass = np.stack([weight * (1 - good), weight * good])
        cells = np.einsum("cp,plv->clv", mass, one_hot) + lean[:, None, :]
        rate = np.log(cells / cells.sum(2, keepdims=True))
        prior = np.log((mass.sum(1) + 1) / (weight.sum() + 2))
        score = np.einsum("plv,clv->pc", one_hot, rate) + prior
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good


_RUNS = re.compile(rb"([A-Z])[A-Z]*|([a-z\x80-\xff])[a-z\x80-\xff]*|([0-9])[0-9]*")


def shape(word: bytes) -> bytes:
    """Runs of capitals, small letters and digits as X, x and 0; signs stay."""
    return _RUNS.sub(lambda m: b"X" if m.group(1) else b"x" if m.group(2) else b"0", word)


class Features:
    """Hashed features of a text as (index, value), of unit length."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.known: dict[bytes, tuple[int, int]] = {}

    def index(self, kind: bytes, value: bytes) -> int:
        return xxhash.xxh3_64_intdigest(kind + value) % self.dimensions

    def word(self, word: bytes) -> tuple[int, int]:
        at = self.known.get(word)
        if at is None:
            if len(self.known) > 300_000:
                self.known.clear()
            at = self.known[word] = self.index(b"w", word.lower()), self.index(b"s", shape(word))
        return at

    def __call__(self, words: list[bytes], f: Facts) -> tuple[np.ndarray, np.ndarray]:
        at, times = np.unique(np.array([self.word(w) for w in words], np.int64).ravel(), return_counts=True)
        values = np.log1p(times)
        values /= np.sqrt((values**2).sum()) or 1.0
        steps = [
            (b"stop", f.stop * 20), (b"distinct", f.distinct * 10), (b"upper", f.upper * 10), (b"signs", f.signs * 50),
            (b"length", f.length), (b"lines", f.lines * 5), (b"shouts", f.shouts * 20), (b"size", np.log2(f.words + 1)),
        ]
        more = [self.index(b"f", name + b"%d" % min(int(x), 30)) for name, x in steps]
        return np.concatenate((at, more)), np.concatenate((values, np.full(len(more), 0.3)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, dimensions: int, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on soft labels (Adagrad on the whole sample, L2)."""
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    at, value = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
    w, b = np.zeros(dimensions), 0.0
    seen_w, seen_b = np.full(dimensions, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(owner, w[at] * value, len(rows)) + b
        error = (1 / (1 + np.exp(-z)) - good) / len(rows)
        step = np.bincount(at, error[owner] * value, dimensions) + 1e-6 * w
        seen_w += step**2
        seen_b += error.sum() ** 2
        w -= 0.5 * step / np.sqrt(seen_w)
        b -= 0.5 * error.sum() / np.sqrt(seen_b)
    return w, b


def vote_patterns(docs: DataFrame) -> DataFrame:
    """The vote pattern of every row; null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).cast(pa.binary()):
                text = text.as_py() or b""
                words = text.split()
                out.append(pattern(facts(text, words)) if words else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], names=["pattern"])

    return docs.select("text").mapInArrow(run, "pattern int")


def quality_scores(
    docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, p_labels (posterior of the votes), p_good (scorer) and kept, for rows (doc_id, text)."""
    table = vote_patterns(docs).filter("pattern is not null").groupBy("pattern").count().toPandas()
    patterns, counts = table["pattern"].to_numpy(np.int64), table["count"].to_numpy(np.int64)
    posterior = dict(zip(patterns.tolist(), expectation_maximisation(patterns, counts).tolist()))
    total = int(counts.sum())
    share = min(1.0, sample / total) if total else 1.0
    # different rows only: a row that is there many times is drawn or not, but counts once, so the sample stays bounded
    chosen = docs.withColumn("_h", F.xxhash64("doc_id", "text")).filter(
        F.pmod("_h", F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))
    ).dropDuplicates(["_h"])
    rows, good = [], []
    for row in _features(chosen, dimensions).toLocalIterator():
        rows.append((np.array(row["at"], np.int64), np.array(row["value"], float)))
        good.append(posterior[row["pattern"]])
    if rows:
        w, b = fit(rows, np.array(good), dimensions)
    else:
        w, b = np.zeros(dimensions), 1.0
    w = w.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(dimensions)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                labels, scores = [], []
                for text in part.column(1).cast(pa.binary()):
                    text = text.as_py() or b""
                    words = text.split()
                    if not words:
                        labels.append(0.0)
                        scores.append(0.0)
                        continue
                    f = facts(text, words)
                    at, value = make(words, f)
                    labels.append(posterior.get(pattern(f), 0.5))
                    scores.append(float(1 / (1 + np.exp(-((w[at] * value).sum() + b)))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(labels, pa.float64()), pa.array(scores, pa.float64())],
                    names=["doc_id", "p_labels", "p_good"],
                )
        make.known.clear()
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, p_labels double, p_good double")
    return out.withColumn("kept", F.col("p_good") >= threshold)


def _features(docs: DataFrame, dimensions: int) -> DataFrame:
    """pattern, at, value of documents with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features(dimensions)
        for batch in batches:
            codes, at, value = [], [], []
            for text in batch.column(0).cast(pa.binary()):
                text = text.as_py() or b""
                words = text.split()
                if words:
                    f = facts(text, words)
                    i, v = make(words, f)
                    codes.append(pattern(f))
                    at.append(i)
                    value.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(codes, pa.int32()), pa.array(at, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float64()))],
                names=["pattern", "at", "value"],
            )

    return docs.select("text").mapInArrow(run, "pattern int, at array<bigint>, value array<double>")
