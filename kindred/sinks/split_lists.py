"""Split lists under their own names, ``{split}.txt``, as a Spark data source with commit and abort.

Each task writes the lines of its partition to part files in a folder of the job that readers do not look at. Only when all
tasks are done are the parts of each list joined in order and moved to ``{split}.txt``; a failed or cancelled job leaves no list
and no parts. Parts are copied as streams, so a list of any length goes through memory in small pieces.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from kindred.sources.npy import file_system

COPY_BYTES = 4 << 20


@dataclass
class Written(WriterCommitMessage):
    """(split, first line number, file) of each part."""

    parts: list[tuple[str, int, str]] = field(default_factory=list)


class SplitListWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = f"_splits-{uuid.uuid4().hex}"

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        system, inside = file_system(self.path)
        return system, inside, posixpath.join(inside, self.job)

    def write(self, iterator: Iterator[Row]) -> Written:
        """Lines come in the order of (split, line_no)."""
        system, _, parts = self._folder()
        out, current, file = Written(), None, None
        try:
            for row in iterator:
                if current is None or row["split"] != current:
                    if file is not None:
                        file.close()
                    current, name = row["split"], posixpath.join(parts, uuid.uuid4().hex)
                    if not current or "/" in current:
                        raise ValueError(f"{current!r} is not the name of a list")
                    system.create_dir(parts, recursive=True)
                    file = system.open_output_stream(name)
                    out.parts.append((current, int(row["line_no"]), name))
                file.write(row["line"].encode() + b"\n")
        finally:
            if file is not None:
                file.close()
        return out

    def commit(self, messages) -> None:
        system, inside, parts = self._folder()
        lists: dict[str, list[tuple[int, str]]] = {}
        for message in messages:
            for split, first, name in message.parts if message is not None else ():
                lists.setdefault(split, []).append((first, name))
        system.create_dir(inside, recursive=True)
        ready = []
        for split, found in sorted(lists.items()):
            target = posixpath.join(inside, f"{split}.txt")
            if not self.overwrite and system.get_file_info(target).type != fs.FileType.NotFound:
                system.delete_dir(parts)
                raise FileExistsError(f"{target} exists")
            joined = posixpath.join(parts, f"{split}.joined")
            with system.open_output_stream(joined) as out:
                for _, name in sorted(found):
                    with system.open_input_stream(name) as part:
                        while chunk := part.read(COPY_BYTES):
                            out.write(chunk)
            ready.append((joined, target))
        for joined, target in ready:
            system.move(joined, target)
        if system.get_file_info(parts).type != fs.FileType.NotFound:
            system.delete_dir(parts)

    def abort(self, messages) -> None:
        system, _, parts = self._folder()
        if system.get_file_info(parts).type != fs.FileType.NotFound:
            system.delete_dir(parts)


class SplitListSink(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return "kindred_splits"

    def schema(self) -> str:
        return "split string, line_no bigint, line string"

    def writer(self, schema, overwrite: bool) -> SplitListWriter:
        return SplitListWriter(self.options["path"], overwrite)


def write_split_lists(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write ``(split, line_no, line)`` as ``{path}/{split}.txt``, lines in the order of their numbers.

    Lines are range-partitioned by (split, line number), so a long list is written by many tasks.
    """
    lines.sparkSession.dataSource.register(SplitListSink)
    (
        lines.select("split", F.col("line_no").cast("bigint").alias("line_no"), "line")
        .repartitionByRange("split", "line_no").sortWithinPartitions("split", "line_no")
        .write.format("kindred_splits").option("path", path).mode("overwrite" if overwrite else "append").save()
    )
