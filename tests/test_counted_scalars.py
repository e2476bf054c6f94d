"""Corpus scalars from words that are counted whole equal those of parsed captions, and captions are parsed once."""

import pytest
from pyspark.sql import functions as F

from kindred.functions import tags as tg
from kindred.operators import stats
from kindred.operators.parsing import ensure_parsed

ODD = [
    ("en", "g1", "a/NOUN A/noun a/VERB  stray and/or/X\t/NOUN //x ///  b/"),
    ("en", "g1", "\x1fa/Adj\x1cc/straße d/ß e/ADP f/PRON\n/"),
    ("en", None, "İ/ADV ΑΣ/ADV ας/ADV /a/b/ADV 漢字/NOUN/ ﻿f/ADV"),
    ("en", "g2", None),
    ("en", "g2", ""),
    ("none", "g2", "no tags here / /x"),
    ("one", "g3", "x/VERB y/ADP"),
    (None, "g3", "x/VERB 9/9 9/9"),
    (None, None, "X/VERB"),
]
SCHEMA = "dataset string, motion_id string, pos_tags string"


def same(a, b, by):
    assert a.schema.simpleString() == b.schema.simpleString()
    found = {tuple(r[c] for c in by): r.asDict() for r in a.collect()}
    wanted = {tuple(r[c] for c in by): r.asDict() for r in b.collect()}
    assert found.keys() == wanted.keys()
    for key, row in wanted.items():
        assert found[key] == pytest.approx(row, abs=1e-9), key


@pytest.mark.parametrize("by", [[], ["dataset"]])
def test_counted_scalars_equal_parsed_ones(spark, by):
    df = spark.createDataFrame(ODD, SCHEMA)
    same(stats.corpus_scalars(df, by), stats.corpus_scalars(ensure_parsed(df), by), by)
    same(stats.caption_scalars(df, by, ["X", "", "ß", "SS"]), stats.caption_scalars(ensure_parsed(df), by, ["X", "", "ß", "SS"]), by)
    same(stats.corpus_scalars(df.limit(0), by), stats.corpus_scalars(ensure_parsed(df.limit(0)), by), by)


def test_tagged_words_come_apart_as_parsed(spark):
    df = ensure_parsed(spark.createDataFrame(ODD, SCHEMA)).withColumn("whole", tg.tagged_words(F.col("pos_tags")))
    out = df.select("tokens", "pos_list", F.transform("whole", tg.word_token).alias("tok"), F.transform("whole", tg.word_tag).alias("tag"))
    for r in out.collect():
        assert (r.tok, r.tag) == (r.tokens, r.pos_list)


def test_captions_are_parsed_once(spark, tmp_path):
    spark.createDataFrame(ODD, SCHEMA).write.parquet(str(tmp_path / "in"))
    found = stats.corpus_scalars(spark.read.parquet(str(tmp_path / "in")), ["dataset"])
    assert len(found.collect()) == 4
    text = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("regexp_extract_all") == 1 and "ReusedExchange" in text
