import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

MICRO = [
    ("000001", 0, "A man walks forward slowly.", "a/DET man/NOUN walk/VERB forward/ADV slowly/ADV"),
    ("000001", 1, "a man walks forward, slowly", "a/DET man/NOUN walk/VERB forward/ADV slowly/ADV"),
    (
        "000001",
        2,
        "the person raises their left hand and then turns",
        "the/DET person/NOUN raise/VERB their/PRON left/ADJ hand/NOUN and/CCONJ then/ADV turn/VERB",
    ),
    ("000002", 0, "she jumps up", "she/PRON jump/VERB up/ADP"),
    ("000002", 1, "A woman jumps back", "A/DET woman/NOUN jump/VERB back/NOUN"),
    ("000003", 0, "!!!", "!!!/PUNCT stray and/or/CCONJ foo/ /NOUN"),
    ("M00001", 0, "they walk", "they/PRON Walk/verb"),
    ("M00001", 1, "man and woman walk", "man/NOUN and/CCONJ woman/NOUN walk/VERB"),
]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("kindred-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def micro(spark):
    rows = [(g, f"{g}:{n}", n, d, t, 0.0, 0.0) for g, n, d, t in MICRO]
    from kindred.schema import CAPTIONS

    return spark.createDataFrame(rows, CAPTIONS)
