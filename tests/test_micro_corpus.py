"""Hand-derived values on eight captions with the default lexicons."""

import math

import pytest

from kindred.operators import actors, cues, curation, parsing, redundancy, richness, similarity, stats, tfidf


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def table(df, *keys):
    value = [c for c in df.columns if c not in keys][0]
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r[value] for r in df.collect()}


def test_parse_drops_and_keeps(micro):
    row = one(parsing.ensure_parsed(micro).filter("motion_id = '000003'"))
    assert [(x.tok, x.pos) for x in row["parsed_pos"]] == [("!!!", "PUNCT"), ("and/or", "CCONJ"), ("foo", "")]
    assert row["tokens"] == ["!!!", "and/or", "foo"]
    assert row["pos_list"] == ["PUNCT", "CCONJ", ""]


def test_parse_keeps_supplied_columns(spark, micro):
    own = micro.selectExpr("*", "array('x') as tokens", "array('NOUN') as pos_list")
    assert one(stats.vocab_table(own)) == {"token": "x", "cnt": 8}


def test_tokens_by_tag(micro):
    row = one(parsing.with_tokens_by_tag(micro).filter("caption_id = '000001:2'"))
    assert row["tokens_by_pos"]["NOUN"] == ["person", "hand"]
    assert row["tokens_by_pos"]["VERB"] == ["raise", "turn"]
    assert "ADP" not in row["tokens_by_pos"]


def test_null_tags_give_empty_arrays(spark):
    df = spark.createDataFrame([("g", None)], "motion_id string, pos_tags string")
    assert one(parsing.ensure_parsed(df))["tokens"] == []


def test_tag_mismatch(spark, micro):
    assert one(parsing.tag_mismatch(micro))["motion_id"] == "000003"
    odd = spark.createDataFrame(
        [(1, None, "a"), (2, None, None), (3, "", " "), (4, "a b", " x\ty ")],
        "id int, description string, pos_tags string",
    )
    assert sorted(r.id for r in parsing.tag_mismatch(odd).collect()) == [1, 2]


def test_corpus_scalars(micro):
    row = one(stats.corpus_scalars(micro))
    assert (row["num_captions"], row["num_motions"], row["vocab_size"]) == (8, 4, 23)
    assert row["avg_tokens"] == 4.375
    assert row["std_tokens"] == pytest.approx(2.133910, abs=1e-6)
    assert row["median_tokens"] == 4.0
    means = {k[5:]: v for k, v in row.items() if k.startswith("mean_")}
    assert means == {"VERB": 1.0, "NOUN": 1.0, "ADJ": 0.125, "ADV": 0.625, "ADP": 0.125, "PRON": 0.375}
    assert (row["captions_per_motion_mean"], row["captions_per_motion_median"]) == (2.0, 2.0)


def test_vocabulary(micro):
    vocab = table(stats.vocab_table(micro), "token")
    assert len(vocab) == 23 and sum(vocab.values()) == 35
    top = [(r.token, r.cnt) for r in stats.top_words(micro, 8).collect()]
    assert top == [("walk", 4), ("a", 3), ("man", 3), ("and", 2), ("forward", 2), ("jump", 2), ("slowly", 2), ("woman", 2)]


def test_pos_distribution(micro):
    assert table(stats.pos_distribution(micro), "pos") == {
        "NOUN": 8, "VERB": 8, "ADV": 5, "DET": 4, "PRON": 3, "CCONJ": 3, "ADJ": 1, "ADP": 1, "PUNCT": 1, "": 1,
    }


def test_cues(micro):
    rows = {r.caption_id: r for r in cues.with_cues(micro).collect()}
    hits = {k: (r.direction_hits, r.speed_hits, r.body_part_mentions) for k, r in rows.items()}
    assert hits == {
        "000001:0": (1, 1, 0), "000001:1": (1, 1, 0), "000001:2": (1, 0, 1), "000002:0": (0, 0, 0),
        "000002:1": (1, 0, 1), "000003:0": (0, 0, 0), "M00001:0": (0, 0, 0), "M00001:1": (0, 0, 0),
    }
    assert rows["M00001:0"].verbs == ["walk"]
    assert list(one(cues.cue_rates(micro)).values()) == [0.5, 0.25, 0.25]
    top = [(r.pos, r.token, r.cnt) for r in cues.top_by_tag(micro, 1).orderBy("pos").collect()]
    assert top == [("ADJ", "left", 1), ("ADV", "forward", 2), ("NOUN", "man", 3), ("VERB", "walk", 4)]


def test_actors(micro):
    labelled, summary = actors.actor_analysis(micro)
    got = {
        r.caption_id: ((r.noun_male, r.noun_female, r.noun_neutral), (r.pron_male, r.pron_female, r.pron_neutral), r.addressing_label)
        for r in labelled.collect()
    }
    assert got == {
        "000001:0": ((1, 0, 0), (0, 0, 0), "male_noun"),
        "000001:1": ((1, 0, 0), (0, 0, 0), "male_noun"),
        "000001:2": ((0, 0, 1), (0, 0, 1), "neutral_noun"),
        "000002:0": ((0, 0, 0), (0, 1, 0), "female_pron"),
        "000002:1": ((0, 1, 0), (0, 0, 0), "female_noun"),
        "000003:0": ((0, 0, 0), (0, 0, 0), "none"),
        "M00001:0": ((0, 0, 0), (0, 0, 1), "neutral_pron"),
        "M00001:1": ((1, 1, 0), (0, 0, 0), "male_noun"),
    }
    rates = {r.label: r.rate for r in summary["label_rates"].collect()}
    assert rates.pop("male_noun") == 0.375
    assert rates == dict.fromkeys(["female_noun", "female_pron", "neutral_noun", "neutral_pron", "none"], 0.125)
    shares = {r[0]: (r[1], r[2]) for r in summary["per_motion_summary"].collect()}
    assert shares["000001"] == pytest.approx((2 / 3, 1 / 3))
    assert (shares["000002"], shares["000003"], shares["M00001"]) == ((1, 0), (0, 0), (0.5, 0.5))
    assert [(r.token, r.cnt, r.category) for r in summary["top_actor_nouns"].collect()] == [
        ("man", 3, "male"), ("woman", 2, "female"), ("person", 1, "neutral"),
    ]
    assert [r[0] for r in actors.top_group_shares(summary["per_motion_summary"], 2).collect()] == ["000002", "000001"]


def test_redundancy(micro):
    assert one(redundancy.duplicate_rate(micro))["duplicate_rate"] == 0.125
    grams = redundancy.top_ngrams(micro).collect()
    two = sorted(((-r.cnt, r.ngram) for r in grams if r.n == 2))
    three = sorted(((-r.cnt, r.ngram) for r in grams if r.n == 3))
    assert two[:5] == [(-2, "a man"), (-2, "forward slowly"), (-2, "man walks"), (-2, "walks forward"), (-1, "a woman")]
    assert three[:3] == [(-2, "a man walks"), (-2, "man walks forward"), (-2, "walks forward slowly")]


def test_richness(micro):
    row = one(richness.lexical_richness(micro))
    want = {
        "TTR": 23 / 35, "distinct-1": 25 / 35, "distinct-2": 23 / 27, "distinct-3": 16 / 19,
        "mean_verbs_per_caption": 1.0, "conj_rate": 3 / 35,
    }
    assert row == pytest.approx(want)


def test_tfidf_vocabulary(micro):
    terms = tfidf.caption_terms(micro)
    n_docs = micro.groupBy().count().withColumnRenamed("count", "n_docs")
    idf = {r.term: (r.df, round(r.idf, 6)) for r in tfidf.vocabulary(terms, n_docs).collect()}
    assert idf.pop("man") == (3, 1.810930)
    assert set(idf) == {
        "and", "forward", "forward slowly", "jumps", "man walks", "slowly", "walk", "walks", "walks forward", "woman",
    }
    assert set(idf.values()) == {(2, 2.098612)}
    weights = tfidf.tfidf_weights(micro).collect()
    assert {r.caption_id for r in weights} == {c for c in
        ["000001:0", "000001:1", "000001:2", "000002:0", "000002:1", "M00001:0", "M00001:1"]}
    assert math.isclose(sum(r.w**2 for r in weights), 7.0)


def test_tfidf_similarity(micro):
    sims = similarity.tfidf_similarity(micro)
    got = {r.motion_id: (r.mean_intra_caption_sim, r.num_captions) for r in sims.collect()}
    assert got["000003"] == (None, 1)
    assert got["000001"] == (pytest.approx(0.333333, abs=1e-6), 3)
    assert got["000002"] == (pytest.approx(0.707107, abs=1e-6), 2)
    assert got["M00001"] == (pytest.approx(0.516768, abs=1e-6), 2)
    summary = one(similarity.similarity_summary(sims))
    assert summary["mean_of_means"] == pytest.approx(0.519069, abs=1e-6)
    assert summary["median_of_means"] == pytest.approx(0.516768, abs=1e-6)
    assert [r.motion_id for r in similarity.most_consistent(sims).collect()] == ["000002", "M00001", "000001", "000003"]
    assert [r.motion_id for r in similarity.least_consistent(sims).collect()] == ["000001", "M00001", "000002", "000003"]
    assert {r.motion_id for r in curation.bad_groups(sims, 0.6).collect()} == {"000001", "M00001"}
    assert {r.motion_id for r in curation.bad_groups(sims, 10).collect()} == {"000001", "M00001", "000002"}
    assert {r.threshold: r.num_bad for r in curation.threshold_counts(sims, [10, 0.6, 0.1]).collect()} == {10.0: 3, 0.6: 2, 0.1: 0}
