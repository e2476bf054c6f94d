import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import bpe
from kindred.llm.common import two_columns
from kindred.llm.queries import vocabulary

VOCABULARY = vocabulary()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(VOCABULARY)


def texts():
    rng = random.Random(1)
    letters = list("ab'sré ñ  \n\t\x0b\x1c\x1f\x85\xa0​ 　１½²ªʰ中あ😀🇩🇪́!?.,09_") + ["<|endoftext|>", "'re", "<|endoftext"]
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    return [*out, "", None, "word " * 3000, "x" * 5000, "same", "same", "\n\n\n"]


@pytest.mark.parametrize("block", [4_000_000, 50])
def test_equals_the_library_and_round_trips(make, tokenizer, block):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in bpe.encode(two_columns(make(rows)), VOCABULARY, block_words=block).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        assert got[i].ids == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
        assert got[i].decoded == (text or "") and got[i].n_tokens == len(got[i].ids)


def test_decode_by_join(make, spark):
    rows = [(i, t) for i, t in enumerate(texts()[:20])]
    encoded = bpe.encode(two_columns(make(rows)), VOCABULARY)
    back = bpe.decode(encoded.select("doc_id", "ids"), bpe.pieces(spark, VOCABULARY)).collect()
    assert {r.doc_id: r.decoded for r in back} == dict(rows)


def test_ties_nulls_and_the_empty_table(make):
    assert bpe.encode(two_columns(make([])), VOCABULARY).collect() == []
    rows = bpe.encode(two_columns(make([(1, "a b"), (1, "a b"), (1, "c"), (None, "a")])), VOCABULARY).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in rows) == [("1", "a b"), ("1", "a b"), ("1", "c"), ("None", "a")]


def test_digests(make):
    import hashlib

    row = bpe.encode(two_columns(make([(1, "hello there")])), VOCABULARY, digests=True).first()
    full = bpe.encode(two_columns(make([(1, "hello there")])), VOCABULARY).first()
    assert row.ids == hashlib.sha256(np.array(full.ids, "<u4").tobytes()).hexdigest()


def test_varints():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**31 - 1])
    assert bpe.from_varints(np.frombuffer(bpe.to_varints(values), np.uint8)).tolist() == values.tolist()
    assert len(bpe.from_varints(np.zeros(0, np.uint8))) == 0 and bpe.to_varints(values[:0]) == b""
