"""Arrays read by byte range, and split lists written with commit and abort."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import curation
from kindred.sinks.split_lists import write_split_lists
from kindred.sources import npy, splits
from kindred.sources.arrays import read_arrays


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("arrays")
    rng = np.random.default_rng(2)
    np.save(path / "long.npy", rng.normal(size=(5000, 30)).astype(np.float32))
    np.save(path / "joints.npy", rng.normal(size=(40, 5, 3)))
    np.save(path / "fortran.npy", np.asfortranarray(rng.normal(size=(50, 7))))
    np.save(path / "big.npy", rng.normal(size=(9, 4)).astype(">f8"))
    np.save(path / "ints.npy", np.arange(12, dtype=np.int16).reshape(6, 2))
    np.save(path / "flat.npy", np.arange(3))
    np.save(path / "none.npy", np.zeros((0, 4)))
    np.save(path / "hollow.npy", np.zeros((3, 0)))
    (path / "notes.txt").write_text("x")
    return str(path)


def rows(df):
    return sorted((r.motion_id, r.ndim, r.n_frames, -1 if r.frame is None else r.frame, r.vec) for r in df.collect())


@pytest.mark.parametrize("split", [64 << 20, 10_000, 997])
@pytest.mark.parametrize("double", [False, True])
def test_ranges_equal_whole_files(spark, folder, split, double):
    assert rows(npy.scan_arrays(spark, folder, double, split)) == rows(read_arrays(spark, folder, double))


def test_a_long_recording_is_spread(spark, folder):
    df = npy.scan_arrays(spark, "file:" + folder, split_bytes=100_000).filter("motion_id = 'long'")
    tasks = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) >= 6 and sum(r["count"] for r in tasks) == 5000 and max(r["count"] for r in tasks) <= 1000


def test_only_wanted_files_are_opened(spark, folder, tmp_path):
    import shutil

    for name in ("big.npy", "ints.npy"):
        shutil.copy(f"{folder}/{name}", tmp_path)
    (tmp_path / "broken.npy").write_bytes(b"no array")
    wanted = npy.scan_arrays(spark, str(tmp_path), only=["big", "ints"])
    assert wanted.filter("motion_id = 'ints' AND frame > 3").count() == 2
    assert wanted.count() == 15 and npy.scan_arrays(spark, str(tmp_path), only=[]).count() == 0
    with pytest.raises(Exception, match="broken|magic|array"):
        npy.scan_arrays(spark, str(tmp_path)).count()


def test_objects_are_not_read(spark, tmp_path):
    np.save(tmp_path / "o.npy", np.array([[{}]], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="Python objects"):
        npy.scan_arrays(spark, str(tmp_path)).count()


def test_planned_ranges_cover_every_byte():
    files = [("b", 25), ("a", 3), ("c", 0), ("d", 10)]
    plan = npy.planned(files, 10)
    assert [sum(e - s for _, s, e in p) <= 10 for p in plan] == [True] * len(plan)
    for name, size in files:
        ranges = sorted((s, e) for p in plan for f, s, e in p if f == name)
        assert ranges[0][0] == 0 and ranges[-1][1] == size and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    assert npy.planned([], 10) == []


def test_lists_are_written_whole_and_read_back(spark, tmp_path):
    lines = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "val").otherwise("test").alias("split"),
        F.col("id").alias("line_no"), F.concat(F.lit(" é"), F.col("id").cast("string"), F.lit("\t")).alias("line"),
    ).repartition(7)
    out = f"{tmp_path}/lists"
    write_split_lists(lines, out)
    assert sorted(os.listdir(out)) == ["test.txt", "train.txt", "val.txt"]
    for i, name in enumerate(("train", "val", "test")):
        want = "".join(f" é{n}\t\n" for n in range(i, 3000, 3))
        with open(f"{out}/{name}.txt", encoding="utf-8", newline="") as file:
            assert file.read() == want
    back = splits.read_splits(spark, out, ("train.txt", "val.txt", "test.txt"))
    assert back.count() == 3000
    kept = curation.filter_split_lines(back, spark.createDataFrame([("é0",), ("é1",)], "motion_id string"))
    with pytest.raises(Exception, match="exists"):
        write_split_lists(kept, out)
    assert sorted(os.listdir(out)) == ["test.txt", "train.txt", "val.txt"]
    write_split_lists(kept, out, overwrite=True)
    assert splits.read_splits(spark, out, ("train.txt",)).orderBy("line_no").first().line == " é3\t"


def test_a_killed_task_leaves_nothing(spark, tmp_path):
    out = f"{tmp_path}/lists"

    @F.udf("string")
    def fail(n):
        if n == 1800:
            os._exit(1)
        return str(n)

    lines = spark.range(2000).select(F.lit("all").alias("split"), F.col("id").alias("line_no"), fail("id").alias("line"))
    with pytest.raises(Exception):
        write_split_lists(lines, out)
    assert not os.path.isdir(out) or os.listdir(out) == []
    write_split_lists(lines.withColumn("line", F.col("line_no").cast("string")), out)
    assert os.listdir(out) == ["all.txt"]


def test_an_empty_table_writes_no_list(spark, tmp_path):
    write_split_lists(spark.createDataFrame([], "split string, line_no bigint, line string"), f"{tmp_path}/none")
    assert not os.path.isdir(f"{tmp_path}/none") or os.listdir(f"{tmp_path}/none") == []
