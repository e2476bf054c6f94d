"""The report from one scan says what the sections say on their own."""

import pytest
from pyspark.sql import functions as F

from kindred import storage
from kindred.operators import actors, cues, redundancy, stats
from kindred.plans import facts
from kindred.plans.backends import Precomputed
from kindred.plans.report import analyse, analyse_once, report


def plain(rows, digits=9):
    def cell(v):
        return f"{round(v, digits) + 0.0:.{digits}f}" if isinstance(v, float) else repr(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


def twice(micro):
    """Two corpora, one of them without a name, with a null group, a null text and a null tag string."""
    odd = micro.limit(2).withColumn("motion_id", F.lit(None).cast("string")).withColumn("description", F.lit(None).cast("string"))
    bare = micro.limit(1).withColumn("pos_tags", F.lit(None).cast("string"))
    a = micro.unionByName(odd).unionByName(bare).withColumn("dataset", F.lit("a"))
    return a.unionByName(micro.limit(5).withColumn("dataset", F.lit(None).cast("string")))


@pytest.mark.parametrize("by", [(), ("dataset",)])
def test_sections_are_those_of_the_operators(spark, micro, by):
    df = twice(micro)
    want, got = analyse(df, by=by), facts.sections(facts.stored_facts(facts.parsed_captions(df), by), by)
    for section, frames in got.items():
        for name, frame in frames.items():
            other = want[section][name].select(*frame.columns)
            assert frame.columns == want[section][name].columns
            assert plain(frame.collect()) == plain(other.collect()), (section, name)


def test_report_equals_the_lazy_one(spark, micro):
    df, by = twice(micro), ("dataset",)
    assert plain(report(analyse_once(df, by=by), by).collect()) == plain(report(analyse(df, by=by), by).collect())


def test_empty_corpus(spark, micro):
    empty = micro.limit(0)
    assert plain(report(analyse_once(empty)).collect()) == plain(report(analyse(empty)).collect())


def test_the_source_is_scanned_once(spark, tmp_path, micro):
    micro.write.parquet(f"{tmp_path}/captions")
    df = spark.read.parquet(f"{tmp_path}/captions")
    text = report(analyse_once(df))._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert f"{tmp_path}/captions" not in text and "FileScan" not in text.replace("Scan parquet", "")
    parsed = facts.parsed_captions(df)
    plan = facts.caption_facts(parsed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "partial_sum" in plan
    assert "Python" not in plan


def test_scratch_and_forget(spark, tmp_path):
    import os

    with storage.scratch(spark):
        inside = storage.materialise(spark.range(5), "x")
        assert inside.count() == 5
        place = inside.stored_at.removeprefix("file:")
        assert os.path.isdir(place)
    assert not os.path.isdir(place)
    kept = storage.materialise(spark.range(3).withColumn("k", F.col("id") % 2), "y", ["k"])
    assert kept.columns == ["id", "k"] and kept.filter("k = 1").count() == 1
    storage.forget(kept)
    assert not os.path.isdir(kept.stored_at.removeprefix("file:"))


def test_a_cluster_must_name_its_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_first_seen_ties(micro):
    by_key = [r.token for r in stats.top_words(micro, 40).collect()]
    seen = [(r.token, r.cnt) for r in stats.top_words(micro, 40, tie="first_seen").collect()]
    assert sorted(by_key) == sorted(t for t, _ in seen) and [c for _, c in seen] == sorted((c for _, c in seen), reverse=True)
    order, n = {}, 0
    for row in micro.orderBy("caption_id").collect():
        for word in row.pos_tags.split():
            head, slash, _ = word.rpartition("/")
            if slash and head:
                order.setdefault(head.lower(), n)
                n += 1
    assert [t for t, _ in seen] == [t for t, c in sorted(seen, key=lambda x: (-x[1], order[x[0]]))]
    tags = cues.top_by_tag(micro, 3, tie="first_seen").filter("pos = 'VERB'").collect()
    assert [r.token for r in sorted(tags, key=lambda r: -r.cnt)][0] == "walk"
    assert [r.ngram for r in redundancy.top_ngrams(micro, (2,), 2, tie="first_seen").collect()][0] == "a man"
    nouns = actors.top_actor_nouns(micro, 9, tie="first_seen").collect()
    assert [r.token for r in nouns][:1] == ["man"] and {r.category for r in nouns} <= {"male", "female", "neutral"}
    with pytest.raises(ValueError, match="tie"):
        stats.top_words(micro, 3, tie="last")


def test_vectors_of_a_part(spark):
    captions = spark.createDataFrame(
        [("a", "a:0", "x"), ("a", "a:1", "y"), ("a", "a:2", "z"), ("b", "b:0", "x")], "motion_id string, caption_id string, description string"
    )
    vectors = spark.createDataFrame([("a:0", [1.0, 0.0]), ("a:2", [1.0, 1.0]), ("zz", [1.0, 0.0])], "caption_id string, vec array<double>")
    some = Precomputed(vectors, 2, missing="count")
    assert [(r.motion_id, r.num_captions) for r in some.similarity(captions).collect()] == [("a", 2)]
    assert tuple(some.coverage(captions).first()) == (2, 2)
    with pytest.raises(Exception, match="not exactly one vector"):
        Precomputed(vectors, 2).similarity(captions).collect()
    with pytest.raises(ValueError, match="missing"):
        Precomputed(vectors, 2, missing="drop").similarity(captions)
