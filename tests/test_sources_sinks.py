import numpy as np
import pytest

from kindred import sinks
from kindred.operators import curation
from kindred.sources import arrays, captions, splits


@pytest.fixture()
def caption_dir(tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    content = "a man#a/DET man/NOUN#0.0#0.0\r\n\r\nbad line\r\na#b#c#1#2\r\n x y#x/X y/Y#nan#1.5"
    (folder / "000001.txt").write_bytes(content.encode())
    (folder / "b.txt.txt").write_text("solo#solo/X#1#oops\n", encoding="utf-8")
    (folder / "notes.md").write_text("a#b#1#2\n")
    nested = folder / "deeper"
    nested.mkdir()
    (nested / "000009.txt").write_text("a#b#1#2\n")
    return str(folder)


def test_read_captions(spark, caption_dir):
    rows = {r.caption_id: r for r in captions.read_captions(spark, caption_dir).collect()}
    assert set(rows) == {"000001:0", "000001:4", "b:0"}
    assert rows["000001:0"].description == "a man" and rows["000001:0"].num1 == 0.0
    assert rows["000001:4"].description == "x y" and np.isnan(rows["000001:4"].num1)
    assert rows["b:0"].motion_id == "b" and rows["b:0"].num2 is None


def test_read_captions_failfast(spark, caption_dir):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        captions.read_captions(spark, caption_dir, mode="FAILFAST").collect()


def test_rejects(spark, caption_dir):
    lines = captions.raw_lines(spark, caption_dir)
    assert sorted((r.line, r.fields) for r in captions.rejected_lines(lines).collect()) == [
        ("a#b#c#1#2", 5),
        ("bad line", 1),
    ]


def test_splittable_read_gives_the_same_captions(spark, caption_dir):
    columns = ["motion_id", "description", "pos_tags", "num2"]
    whole = captions.read_captions(spark, caption_dir).select(columns)
    split = captions.read_captions(spark, caption_dir, whole_files=False)
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.select(columns).collect()))
    assert split.select("caption_id").distinct().count() == 3


def test_empty_directory(spark, tmp_path):
    got = captions.read_captions(spark, str(tmp_path))
    assert got.count() == 0 and "pos_tags" in got.columns


def test_corpora(spark, caption_dir):
    both = captions.read_corpora(spark, {"a": caption_dir, "b": caption_dir})
    assert {(r.dataset, r["count"]) for r in both.groupBy("dataset").count().collect()} == {("a", 3), ("b", 3)}


def test_splits_round_trip(spark, tmp_path):
    for name in ["all", "train", "val", "test", "train_val"]:
        (tmp_path / f"{name}.txt").write_text("000001\n 000002 \n000003\n000001\n")
    lines = splits.read_splits(spark, str(tmp_path))
    assert lines.count() == 20
    bad = spark.createDataFrame([("000002",)], "motion_id string")
    kept = curation.filter_split_lines(lines, bad)
    out = str(tmp_path / "curated")
    sinks.write_splits(kept, out)
    for name in ["all", "val"]:
        parts = sorted((tmp_path / "curated" / f"split={name}").glob("*.txt"))
        assert "".join(p.read_text() for p in parts).split("\n") == ["000001", "000003", "000001", ""]
    back = splits.read_splits(spark, out).orderBy("split", "line_no").collect()
    assert [(r.line_no, r.line) for r in back if r.split == "train_val"] == [(0, "000001"), (1, "000003"), (2, "000001")]
    assert len(back) == 15


def test_hidden_caption_files_fail(spark, tmp_path):
    for name in ("a.txt", "_b.txt", ".c.txt", "_d.md"):
        (tmp_path / name).write_text("x#y/NOUN#0#0\n")
    with pytest.raises(ValueError, match="_b.txt"):
        captions.read_captions(spark, str(tmp_path))


def test_manifest(spark, tmp_path):
    for folder, name in [("texts", "a.txt"), ("texts", "b.txt"), ("animations", "a.mp4")]:
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("x")
    files = splits.list_files(spark, {f: str(tmp_path / f) for f in ["texts", "animations"]})
    bad = spark.createDataFrame([("a",), ("c",)], "motion_id string")
    got = curation.deletion_manifest(bad, files, {"texts": ".txt", "animations": ".mp4"})
    assert {(r.motion_id, r.artefact, r.exists) for r in got.collect()} == {
        ("a", "texts", True), ("a", "animations", True), ("c", "texts", False), ("c", "animations", False),
    }


def test_similarity_csv(spark, tmp_path):
    sims = spark.createDataFrame(
        [("a", 0.9, 2), ("b", None, 1), ("c", 0.1, 3)],
        "motion_id string, mean_intra_caption_sim double, num_captions bigint",
    )
    out = str(tmp_path / "csv")
    sinks.write_similarity_csv(sims.coalesce(1), out, ordered=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert [x for x in text.splitlines() if "motion_id" not in x] == ["c,0.1,3", "a,0.9,2", 'b,"",1'] or [
        x for x in text.splitlines() if "motion_id" not in x
    ] == ["c,0.1,3", "a,0.9,2", "b,,1"]


def test_read_arrays(spark, tmp_path):
    np.save(tmp_path / "m1.npy", np.arange(8, dtype=np.float64).reshape(2, 4))
    np.save(tmp_path / "m2.npy", np.arange(12, dtype=np.float32).reshape(2, 2, 3))
    np.save(tmp_path / "m3.npy", np.arange(3))
    np.save(tmp_path / "m4.npy", np.zeros((0, 4)))
    rows = arrays.read_arrays(spark, str(tmp_path)).collect()
    got = {(r.motion_id, r.frame): (r.ndim, r.n_frames, r.vec) for r in rows}
    assert got == {
        ("m1", 0): (2, 2, [0, 1, 2, 3]), ("m1", 1): (2, 2, [4, 5, 6, 7]),
        ("m2", 0): (3, 2, [0, 1, 2, 3, 4, 5]), ("m2", 1): (3, 2, [6, 7, 8, 9, 10, 11]),
        ("m3", None): (1, 3, None), ("m4", None): (2, 0, None),
    }
