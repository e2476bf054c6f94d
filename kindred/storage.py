"""Tables written to the folder that all executors share: lineage is cut there, and they are read more than once.

The folder is ``spark.checkpoint.dir`` of the session (or the context's checkpoint folder). On a single machine a folder of
its own is made where none is set and removed at the end of the process; a cluster must name one.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="kindred-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is executed inside go when it ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str, partition_by: Sequence[str] = (), compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and lost executors cost no rerun."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.partitionBy(*partition_by).parquet(path, compression=compression)
    for paths in _scopes[-1:]:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def forget(table: DataFrame) -> None:
    """Delete a table of :func:`materialise` that nothing will read again."""
    _delete(table.sparkSession, table.stored_at)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside (and not in a scratch within) are deleted on leaving; write results elsewhere first."""
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            _delete(spark, path)
