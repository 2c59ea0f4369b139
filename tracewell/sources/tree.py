"""Folders of files as a data source that reads archives as streams.

spark.read.format("file_tree").load(root) lists the files below a root and gives the rows of archives.unpack() for
each. A file is opened in its store and read in pieces, so neither it nor what it unpacks to has to fit in a row
or in memory. Files in refused places are not opened and leave a skip row; neither do files that can't be read
end the job. Stores are those that pyarrow knows (local paths, file, s3, gs, hdfs); for others, read_files() and
expand_archives() read files as rows.
"""

from __future__ import annotations

import hashlib
import re
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracewell.sources.archives import ROW_SCHEMA, Limits, Row, clean, in_batches, unpack
from tracewell.sources.files import REFUSED, expand_archives, read_files, split_refused

#: A task reads files of together so many bytes, or one larger one, and no more files than this.
TASK_BYTES, TASK_FILES = 64 << 20, 5000


@dataclass
class FileGroup(InputPartition):
    files: list[tuple[str, int]]


def grouped(files: list[tuple[str, int]]) -> list[FileGroup]:
    """Neighbouring files in groups for one task each."""
    out: list[FileGroup] = []
    room = 0
    for path, size in sorted(files):
        if not out or size > room or len(out[-1].files) >= TASK_FILES:
            out.append(FileGroup([]))
            room = TASK_BYTES
        out[-1].files.append((path, size))
        room -= size
    return out


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], limits: Limits):
        self.roots, self.limits = roots, limits

    def partitions(self) -> list[FileGroup]:
        """Lists paths and sizes only."""
        found: dict[str, int] = {}
        for root in self.roots:
            store, path = pafs.FileSystem.from_uri(root)
            top = store.get_file_info(path)
            if top.type == pafs.FileType.NotFound:
                raise FileNotFoundError(root)
            infos = [top] if top.is_file else store.get_file_info(pafs.FileSelector(path, recursive=True))
            prefix = root[: len(root.rstrip("/")) - len(path.rstrip("/"))] if root.rstrip("/").endswith(path.rstrip("/")) else ""
            found |= {prefix + info.path: info.size for info in infos if info.is_file}
        return grouped(list(found.items())) or [FileGroup([])]

    def _rows(self, group: FileGroup) -> Iterator[Row]:
        for path, size in group.files:
            refused = next((name for name, rx in REFUSED.items() if re.search(rx, path)), None)
            if refused:
                yield clean(path), "skip", None, f"refused location: {refused}"
                continue
            yield clean(path), "name", None, None
            try:
                store, inner = pafs.FileSystem.from_uri(path)
                source = store.open_input_file(inner)
            except (OSError, pa.ArrowException) as error:
                yield clean(path), "archive", None, None
                yield clean(path), "skip", None, clean(f"error ({type(error).__name__}: {error})")
                continue
            with source:
                yield from unpack(path, source, size, self.limits)

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        return in_batches(self._rows(partition))


class FileTree(DataSource):
    """Options: path, one root or several in lines; depth, member, total and ratio as in archives.Limits."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return ROW_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        given = {f.name: int(self.options[f.name]) for f in fields(Limits) if f.name in self.options}
        return _Reader(self.options["path"].split("\n"), Limits(**given))


def _known(root: str) -> bool:
    try:
        pafs.FileSystem.from_uri(root)
    except (pa.ArrowException, OSError):
        return False
    return True


def read_tree(spark: SparkSession, *roots: str, limits: Limits = Limits()) -> DataFrame:
    """path, what, content and reason of all files below the roots and of what they hold.

    Stores that pyarrow doesn't know are read by Spark, a file in a row.
    """
    if not all(map(_known, roots)):
        allowed, refused = split_refused(read_files(spark, *roots))
        empty = [F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("reason")]
        names = allowed.select("path", F.lit("name").alias("what"), *empty)
        return names.unionByName(refused.select("path", F.lit("skip").alias("what"), empty[0], "reason")).unionByName(expand_archives(allowed, limits))
    spark.dataSource.register(FileTree)
    options = {f.name: str(getattr(limits, f.name)) for f in fields(Limits)}
    return spark.read.format("file_tree").options(**options).load("\n".join(roots))


#: Bytes of a file that are held while its digest is taken.
_PIECE = 1 << 20


def file_digests(spark: SparkSession, *roots: str) -> DataFrame:
    """F3 with S1: path, length and sha256 of the files that read_files() gives, of any size.

    Spark lists them; a task reads a file in pieces, where a row would have to hold it whole (2 GB at most). SHA-256 is taken in order,
    so one task still reads all of a file. Stores that pyarrow doesn't know are read by Spark, a file in a row.
    """
    listed = read_files(spark, *roots)
    if not all(map(_known, roots)):
        return listed.select("path", "length", F.sha2("content", 256).alias("sha256"))

    def digest(path: str) -> str:
        # Spark's paths are not quoted, those of pyarrow are.
        store, inner = pafs.FileSystem.from_uri(urllib.parse.quote(re.sub("^file:/+", "file:///", path), safe=":/@"))
        found = hashlib.sha256()
        with store.open_input_stream(inner) as source:
            while piece := source.read(_PIECE):
                found.update(piece)
        return found.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(*(column.to_pylist() for column in batch.columns)):
                yield pa.RecordBatch.from_pydict({"path": [path], "length": pa.array([length], pa.int64()), "sha256": [digest(path)]})

    return listed.select("path", "length").mapInArrow(run, "path string, length long, sha256 string")
