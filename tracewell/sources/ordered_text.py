"""A sink that writes sections of text, in order, to one file.

df.write.format("ordered_text").mode("append").save(file) takes df(part, n, section) in range partitions sorted by
(part, n). A task writes its sections to a file of its own, which it names anew each time it is run; the commit
puts together those of the tasks that succeeded, in order and piece by piece, and moves the result to
its name at the end, so that no reader sees half a report. The driver holds a few megabytes at a time. Stores are
those that pyarrow knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

_PIECE = 4 << 20


@dataclass
class _Written(WriterCommitMessage):
    first: tuple[int, int] | None
    path: str


class _Writer(DataSourceWriter):
    def __init__(self, file: str):
        self.file, self.run = file, uuid.uuid4().hex

    def _store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.file)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, path = self._store()
        folder = f"{path}.{self.run}"
        store.create_dir(folder, recursive=True)
        part, first, last = f"{folder}/{uuid.uuid4().hex}", None, None
        with store.open_output_stream(part) as out:
            for row in iterator:
                at = (row.part, row.n)
                if last is not None and at < last:
                    raise ValueError("sections must be sorted by part and n")
                first, last = first or at, at
                out.write(row.section.encode() + b"\n")
        return _Written(first, part)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = self._store()
        whole = f"{path}.{self.run}/whole"
        store.create_dir(f"{path}.{self.run}", recursive=True)
        with store.open_output_stream(whole) as out:
            for message in sorted((m for m in messages if m and m.first), key=lambda m: m.first):
                with store.open_input_stream(message.path) as source:
                    while piece := source.read(_PIECE):
                        out.write(piece)
        store.move(whole, path)
        store.delete_dir(f"{path}.{self.run}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, path = self._store()
        if store.get_file_info(f"{path}.{self.run}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{path}.{self.run}")


class OrderedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordered_text"

    def schema(self) -> str:
        return "part int, n long, section string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_sections(sections: DataFrame, file: str) -> None:
    """Writes sections(part, n, section) in the order of part and n to one file, each with a line end."""
    sections.sparkSession.dataSource.register(OrderedText)
    sections.select("part", "n", "section").repartitionByRange("part", "n").sortWithinPartitions("part", "n").write.format("ordered_text").mode("append").save(file)
