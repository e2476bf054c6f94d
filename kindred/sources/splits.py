"""Split lists (one id per line) and file listings."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kindred.lexicons import SPLIT_FILES


def read_splits(spark: SparkSession, path: str, files: Sequence[str] = SPLIT_FILES) -> DataFrame:
    """``(split, line_no, line)`` of the given list files. Lines keep their surrounding whitespace.

    A list ``all.txt`` may also be a folder ``split=all`` of part files, as the sink writes it; its lines are numbered
    over the parts in name order, and no task holds more than a part.
    """
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def place(file: str) -> str:
        folder = posixpath.join(path, "split=" + file.removesuffix(".txt"))
        return folder if system.exists(spark._jvm.org.apache.hadoop.fs.Path(folder)) else posixpath.join(path, file)

    folder = F.regexp_extract(F.col("_metadata.file_path"), "/split=([^/]+)/[^/]+$", 1)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    # recursive lookup keeps a folder's name from becoming a column of its own
    whole = spark.read.option("recursiveFileLookup", True).text([place(f) for f in files], wholetext=True).select(
        F.when(folder != "", folder).otherwise(name).alias("split"), name.alias("_part"),
        F.regexp_replace("value", "(\r\n|\r|\n)$", "").alias("value"),
    )
    lines = whole.filter(F.col("value") != "").select(
        "split", "_part", F.split("value", "\r\n|\r|\n", -1).alias("_lines")
    )
    before = Window.partitionBy("split").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lines.select("split", "_part", F.size("_lines").alias("_n")).select(
        "split", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return (
        lines.join(starts, ["split", "_part"])
        .select("split", "_start", F.posexplode("_lines").alias("_at", "line"))
        .select("split", (F.col("_start") + F.col("_at")).cast("int").alias("line_no"), "line")
    )


def list_files(spark: SparkSession, folders: Mapping[str, str]) -> DataFrame:
    """``(artefact, file_name, path)`` of the files in each folder; contents are not read."""
    parts = [
        spark.read.format("binaryFile")
        .load(folder)
        .select(
            F.lit(name).alias("artefact"), F.col("_metadata.file_name").alias("file_name"), "path"
        )
        for name, folder in folders.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
