"""What the plans must look like, hot groups, and agreement between sections."""

import pytest

from kindred.plans.catalog import QUERIES
from kindred.operators import actors, cues, pairs, similarity, stats
from kindred.plans import tables as tb
from kindred.plans.report import analyse, report
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_group_sizes_read_only_the_key(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("source", "motion_id")
    text = plan(stats.captions_per_group(docs))
    assert "ReadSchema: struct<source:string>" in text
    assert "PushedFilters: [IsNotNull(source)]" in text


def test_top_k_per_key_is_cut_before_the_shuffle(spark):
    text = plan(cues.top_by_tag(tb.document_captions(spark, SF)))
    assert "WindowGroupLimit" in text and "Partial" in text
    assert "TakeOrderedAndProject" in plan(stats.top_words(tb.document_captions(spark, SF)))


def test_pair_candidates_are_cut_before_the_shuffle(spark):
    assert plan(pairs.same_group_pairs(tb.document_captions(spark, SF))).count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["stats", "cues", "actors"])
def test_row_local_and_aggregate_operators_have_no_python_and_no_cross_join(spark, name):
    df = tb.document_captions(spark, SF)
    frames = {
        "stats": lambda: stats.corpus_scalars(df),
        "cues": lambda: cues.cue_rates(df),
        "actors": lambda: actors.label_rates(actors.with_addressing(df)),
    }
    text = plan(frames[name]())
    assert "Python" not in text and "Cartesian" not in text and "BroadcastNestedLoop" not in text


def test_feature_operators_run_on_a_stream(spark, tmp_path, micro):
    source = str(tmp_path / "in")
    micro.write.parquet(source)
    stream = actors.with_addressing(cues.with_cues(spark.readStream.schema(micro.schema).parquet(source)))
    q = stream.select("caption_id", "direction_hits", "addressing_label").writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    batch = actors.with_addressing(cues.with_cues(micro)).select("caption_id", "direction_hits", "addressing_label")
    assert sorted(map(tuple, spark.table("hits").collect())) == sorted(map(tuple, batch.collect()))


def test_hot_group(spark):
    """A third of all captions in one group, a third of all texts equal."""
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.floor(F.col("id") / 4).cast("string")).alias("motion_id"),
        F.col("id").cast("string").alias("caption_id"),
        F.when(F.col("id") % 3 == 1, "same words here").otherwise(F.concat(F.lit("w"), F.col("id") % 50, F.lit(" x"), F.col("id") % 7)).alias("description"),
        F.lit("a/X").alias("pos_tags"),
    )
    sims = {r.motion_id: r for r in similarity.tfidf_similarity(df).collect()}
    assert sims["hot"].num_captions == 1000 and 0 < sims["hot"].mean_intra_caption_sim < 1
    got = pairs.same_group_pairs(df)
    assert got.filter("motion_id = 'hot'").count() == 100
    per_group = stats.captions_per_group(df).collect()[0]
    assert per_group.num_motions == len(sims)


def test_report(spark, micro):
    sections = analyse(micro)
    rows = {(r.section, r.metric): r.value for r in report(sections).collect()}
    assert rows["corpus_stats", "num_captions"] == 8
    assert rows["corpus_stats", "cnt: walk"] == 4
    assert rows["cues", "caption_rate_with_direction_cues"] == 0.5
    assert rows["actors", "rate: male_noun"] == 0.375
    assert rows["actors", "share_gendered_captions: 000001"] == pytest.approx(2 / 3)
    assert rows["redundancy", "duplicate_rate"] == 0.125
    assert rows["redundancy", "cnt: 2: a man"] == 2
    assert rows["similarity", "mean_of_means: tfidf"] == pytest.approx(0.519069, abs=1e-6)
    assert rows["similarity", "q50: tfidf"] == pytest.approx(0.516768, abs=1e-6)
    assert rows["richness", "TTR"] == round(23 / 35, 4)
    # The two sections count the same things.
    assert rows["corpus_stats", "mean_VERB"] == rows["richness", "mean_verbs_per_caption"]
    pos = sum(v for (s, m), v in rows.items() if s == "corpus_stats" and m.startswith("cnt: ") and m[5:].isupper())
    assert pos + rows["corpus_stats", "cnt: "] == rows["corpus_stats", "avg_tokens"] * 8


def test_report_per_corpus(spark, micro):
    two = micro.withColumn("dataset", F.lit("a")).unionByName(micro.withColumn("dataset", F.lit("b")))
    rows = report(analyse(two, by=["dataset"]), ["dataset"]).collect()
    single = {(r.section, r.metric): r.value for r in report(analyse(micro)).collect()}
    for name in ("a", "b"):
        # Sums are taken in another order, so equal up to rounding.
        got = {(r.section, r.metric): r.value for r in rows if r.dataset == name}
        assert set(got) == set(single)
        for metric, value in single.items():
            assert got[metric] is None if value is None else got[metric] == pytest.approx(value, rel=1e-12, abs=1e-12)


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="pos_tags"):
        analyse(spark.range(1))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_join_without_a_key(spark, name):
    text = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
