"""Every registered query equals its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from kindred.plans.catalog import QUERIES
from kindred.plans.oracles import ORACLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, entry.queries()[name], entry.oracle_sql()[name]) == ""


def test_curation_splits_the_groups(spark):
    n = {k: entry.queries()[k](spark, SF_DIR).count() for k in ("curated_anti", "pruned_semi", "deletion_manifest")}
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet").count()
    assert 0 < n["curated_anti"] < turns and 0 < n["pruned_semi"] < turns and n["deletion_manifest"] > 0
    assert len({r.status for r in entry.queries()["twin_status"](spark, SF_DIR).collect()}) >= 3


def test_every_query_but_the_iterative_ones_has_sql():
    assert set(QUERIES) - set(ORACLES) == {"kmeans_sizes", "topics"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_iterative_queries_run(spark):
    sizes = entry.queries()["kmeans_sizes"](spark, SF_DIR).collect()
    assert 1 <= len(sizes) <= 5 and all(r.cnt > 0 for r in sizes)
    topics = entry.queries()["topics"](spark, SF_DIR).collect()
    assert len(topics) == 36 and all(r.term for r in topics)


def test_entry(spark):
    assert entry.entry(spark).count() == 10
