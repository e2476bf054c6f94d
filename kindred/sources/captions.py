"""Scan directories of caption files: one ``.txt`` per group, one ``description#tags#num1#num2`` per line."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kindred import schema as S
from kindred.functions.text import strip

FIELDS = 4


def raw_lines(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """``(motion_id, line_no, line)`` of every line, stripped; the key is the file name without ``.txt``.

    Small files are packed many to a partition. ``whole_files=False`` reads splittable lines instead, for
    files beyond a task's memory; ``line_no`` is then the line's position within its split plus the split
    number, unique but not consecutive.
    """
    refuse_hidden(spark, path, ".txt")
    reader = spark.read.option("pathGlobFilter", "*.txt")
    key = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt", "").alias(S.GROUP)
    if whole_files:
        files = reader.text(path, wholetext=True).select(key, "value")
        lines = files.select(S.GROUP, F.posexplode(F.split("value", "\r\n|\r|\n")).alias(S.LINE, "line"))
    else:
        lines = reader.text(path).select(
            key, F.monotonically_increasing_id().alias(S.LINE), F.col("value").alias("line")
        )
    return lines.select(S.GROUP, S.LINE, strip(F.col("line")).alias("line"))


def refuse_hidden(spark: SparkSession, path: str, suffix: str) -> None:
    """Fail if the folder has files whose names start with ``_`` or ``.``, which Spark's scans leave out.

    A listing of names; no file is read.
    """
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if any(c in path for c in "*?[{") or not system.exists(folder):
        return
    names = [f.getPath().getName() for f in system.listStatus(folder) if f.isFile()]
    hidden = sorted(n for n in names if n.endswith(suffix) and n.startswith(("_", ".")))
    if hidden:
        raise ValueError(f"{path} has {len(hidden)} files that scans skip, rename them: {hidden[:10]}")


def _fields() -> Column:
    return F.split("line", "#", -1)


def parse_lines(lines: DataFrame, mode: str = "PERMISSIVE") -> DataFrame:
    """Keep lines of exactly four fields and type them.

    A number that does not parse becomes NULL, or fails the query with ``mode="FAILFAST"``.
    """

    def number(c: Column) -> Column:
        return c.cast("double") if mode.upper() == "FAILFAST" else c.try_cast("double")

    split = lines.withColumn("_f", _fields()).filter((F.col("line") != "") & (F.size("_f") == FIELDS))
    return split.select(
        S.GROUP,
        F.concat_ws(":", S.GROUP, F.col(S.LINE).cast("string")).alias(S.CAPTION),
        S.LINE,
        F.get("_f", F.lit(0)).alias(S.TEXT),
        F.get("_f", F.lit(1)).alias(S.TAGS),
        number(F.get("_f", F.lit(2))).alias("num1"),
        number(F.get("_f", F.lit(3))).alias("num2"),
    )


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The non-empty lines that :func:`parse_lines` skips, with their field count."""
    return (
        lines.filter(F.col("line") != "")
        .withColumn("fields", F.size(_fields()))
        .filter(F.col("fields") != FIELDS)
    )


def read_captions(
    spark: SparkSession, path: str, mode: str = "PERMISSIVE", whole_files: bool = True
) -> DataFrame:
    """The caption table of one directory (see :data:`kindred.schema.CAPTIONS`)."""
    return parse_lines(raw_lines(spark, path, whole_files), mode)


def read_corpora(spark: SparkSession, paths: Mapping[str, str], **options) -> DataFrame:
    """Several directories as one table with a ``dataset`` column; pass ``by=["dataset"]`` to the operators."""
    parts = [
        read_captions(spark, path, **options).withColumn("dataset", F.lit(name))
        for name, path in paths.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
