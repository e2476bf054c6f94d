"""The pipeline against brute force on its own corpus: what each stage must drop, change and keep."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from kindred.llm.queries import QUERIES
from kindred.llm.secret_scan import redact, scan

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.fixture(scope="module")
def corpus(spark, make, prose, tmp_path_factory):
    rows = {i: prose(i, 120) for i in range(60)}
    rows[60] = rows[3] + " and"
    rows[61] = rows[4]
    rows[62] = prose(900, 40) + " " + prose(800, 30) + " " + prose(901, 60)  # holds the benchmark item
    rows[63] = prose(902, 100) + f' token = "{HEX}" ' + prose(903, 20)
    rows.update({100 + i: " ".join(w.upper() + "!!" for w in prose(700 + i, 90).split()) for i in range(12)})
    rows[200], rows[201] = "", None
    path = str(tmp_path_factory.mktemp("corpus"))
    make(list(rows.items())).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, prose(800, 30))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_run(spark, corpus):
    from tokenizers import Tokenizer

    from kindred.llm.queries import vocabulary

    path, rows = corpus
    tokenizer = Tokenizer.from_str(vocabulary())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    want = set(range(60)) | {63}  # junk, copies, the leak and empty texts are gone
    assert set(got) == want
    for i in want:
        base, extra, _, _ = scan(rows[i])
        text = redact(rows[i], [x[:2] for x in base] + [x[:2] for x in extra], "[SECRET]")
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert HEX in rows[63]


def test_stages_keep_the_columns(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, docs.limit(0), path).count() == 0, name


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
