"""Archives read as streams: what a file holds, member by member, in bounded memory.

A member of at most Limits.member bytes is held whole, one at each level of nesting; a larger one is
never held: an archive is read through the one around it, and of any other file only the head is kept.
What goes wrong ends as a skip row. Nothing that a file holds can end the task that reads it.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa

from tracewell.functions import patterns as P

#: path, what, content and reason of what is found in a file. what is file (to be scanned as it is), large (the
#: head of a file that is too large for that), archive (one that was looked into, or can't be), part or meta (of an
#: office file), name (a member, also one that can't be read) or skip. Each file has one row of the first three.
Row = tuple[str, str, bytes | None, str | None]
ROW_SCHEMA = "path string, what string, content binary, reason string"
_ARROW = pa.schema([("path", pa.string()), ("what", pa.string()), ("content", pa.binary()), ("reason", pa.string())])

#: Bytes at the start of a file by which its kind is told.
HEAD = 4096
_READ, _BUFFER = 1 << 20, 1 << 16
#: Rows go to Spark when they hold so many bytes, or there are so many of them.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000
#: No archive is stopped for its ratio below this.
RATIO_FLOOR = 256 << 20


@dataclass(frozen=True)
class Limits:
    """depth of nesting; bytes of a file that is held whole; bytes that one outer file may unpack to, in all and for each of its own."""

    depth: int = P.MAX_ARCHIVE_DEPTH
    member: int = P.MAX_TEXT_BYTES
    total: int = 1 << 40
    ratio: int = 1000


class _TooMuch(Exception):
    """An archive unpacks to more than its limits allow."""


class _Damaged(Exception):
    """A member can't be read; args are the name of the error."""


def clean(name: str) -> str:
    """A name that UTF-8 can hold: bytes of other encodings, which are read as surrogates, are replaced."""
    return re.sub("[\ud800-\udfff]", "\ufffd", name)


class _Meter(io.RawIOBase):
    """Passes on what it reads and counts it against the limits of the file, as often as it is read."""

    def __init__(self, source: BinaryIO, spend) -> None:
        self._source, self._spend = source, spend

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        got = self._source.read(len(into))
        into[: len(got)] = got
        self._spend(len(got))
        return len(got)

    def seek(self, to: int, whence: int = 0) -> int:
        try:
            return self._source.seek(to, whence)
        except ValueError as error:  # of files of pyarrow; the formats' readers expect what Python's files raise
            raise OSError(str(error)) from error

    def tell(self) -> int:
        return self._source.tell()


_SIGNS = sorted(((bytes.fromhex(sign), kind) for kind, sign in P.MAGIC if kind not in ("pdf", "image")), key=lambda x: -len(x[0]))
_DECOMPRESSORS = {"gzip": lambda source: gzip.GzipFile(fileobj=source), "bz2": bz2.BZ2File, "xz": lzma.LZMAFile}
_BROKEN_STREAM = (OSError, EOFError, lzma.LZMAError, zlib.error)


def archive_kind(head: bytes) -> str:
    found = next((kind for sign, kind in _SIGNS if head.startswith(sign)), None)
    return found or ("tar" if head[257:262] == b"ustar" else "raw")


class Unpacker:
    """What one outer file gives."""

    def __init__(self, path: str, size: int, limits: Limits):
        self.path, self.limits = clean(path), limits
        self.left = min(limits.total, max(RATIO_FLOOR, limits.ratio * size))

    def spend(self, n: int) -> None:
        self.left -= n
        if self.left < 0:
            raise _TooMuch

    def rows(self, source: BinaryIO) -> Iterator[Row]:
        try:
            yield from self.file(self.path, source, 0)
        except _TooMuch:
            yield self.path, "skip", None, P.UNPACKS_TOO_FAR
        except Exception as error:  # whatever the formats' readers have no name for
            yield self.path, "skip", None, clean(f"error ({type(error).__name__}: {error})")

    def file(self, path: str, source: BinaryIO, depth: int) -> Iterator[Row]:
        head = source.read(HEAD)
        source.seek(0)
        kind = archive_kind(head)
        if kind != "raw":
            yield path, "archive", None, None
        if kind.startswith("x:"):
            yield path, "skip", None, P.NO_ARCHIVE
        elif kind == "raw":
            content = self.held(source)
            yield (path, "large", head, None) if content is None else (path, "file", content, None)
        elif kind == "zip":
            yield from self.zip(path, source, depth)
        elif depth >= self.limits.depth:
            yield path, "skip", None, P.TOO_DEEP
        elif kind == "tar":
            yield from self.tar(path, source, depth)
        else:
            yield from self.stream(kind, path, source, depth)

    def held(self, source: BinaryIO) -> bytes | None:
        """All that is left of a source, or None if it is more than is held."""
        parts, size = [], 0
        while part := source.read(min(_READ, self.limits.member + 1 - size)):
            parts.append(part)
            size += len(part)
            if size > self.limits.member:
                return None
        return b"".join(parts)

    def member(self, path: str, source: BinaryIO, depth: int) -> Iterator[Row]:
        """A member is read before it is looked into, so that damage to it isn't taken for damage in it."""
        metered = _Meter(source, self.spend)
        try:
            content = self.held(metered)
        except _BROKEN_STREAM + (zipfile.BadZipFile, tarfile.TarError, NotImplementedError, RuntimeError) as error:
            raise _Damaged(type(error).__name__) from error
        if content is None:
            metered.seek(0)
            yield from self.file(path, io.BufferedReader(metered, _BUFFER), depth)
        else:
            yield from self.file(path, io.BytesIO(content), depth)

    def zip(self, path: str, source: BinaryIO, depth: int) -> Iterator[Row]:
        try:
            with zipfile.ZipFile(source) as archive:
                names = set(archive.namelist())
                office = next((kind for kind, marks in P.OFFICE_MARKS if names.issuperset(marks)), None)
                if office:
                    yield from self.office(path, archive, office)
                    return
                if depth >= self.limits.depth:
                    yield path, "skip", None, P.TOO_DEEP
                    return
                for info in archive.infolist():
                    inner = f"{path}!{clean(info.filename)}"
                    yield inner, "name", None, None
                    locked = info.flag_bits & 1
                    if not locked and not info.is_dir():
                        with archive.open(info) as opened:
                            yield from self.member(inner, opened, depth + 1)
        except _TooMuch:
            raise
        except _Damaged as error:
            yield path, "skip", None, f"unreadable zip ({error})"
        except Exception as error:
            yield path, "skip", None, f"unreadable zip ({type(error).__name__})"

    def office(self, path: str, archive: zipfile.ZipFile, kind: str) -> Iterator[Row]:
        """Parts with text, parts with authors, and pictures, which are files that no archive is looked for in."""
        for name in sorted(set(archive.namelist())):
            inner = f"{path}!{clean(name)}"
            authors = re.match(P.OFFICE_META, name) or (kind == "odf" and name == "meta.xml")
            picture = name.startswith(P.OFFICE_MEDIA) and name.lower().endswith(P.IMAGE_EXTENSIONS)
            if not (authors or picture or re.match(P.OFFICE_PARTS[kind], name)):
                continue
            with archive.open(name) as opened:
                if picture:
                    yield from self.member(inner, opened, self.limits.depth)
                    continue
                content = self.held(_Meter(opened, self.spend))
            if content is None:
                yield inner, "skip", None, P.TOO_LARGE
            else:
                yield inner, "meta" if authors else "part", content, None

    def tar(self, path: str, source: BinaryIO, depth: int) -> Iterator[Row]:
        """Members before a damaged place are found."""
        try:
            with tarfile.open(fileobj=source, mode="r:") as archive:
                yield from self.tar_members(path, archive, depth)
        except _Damaged as error:
            yield path, "skip", None, f"damaged tar ({error})"
        except (tarfile.TarError, OSError, EOFError) as error:
            yield path, "skip", None, f"damaged tar ({type(error).__name__})"

    def tar_members(self, path: str, archive: tarfile.TarFile, depth: int) -> Iterator[Row]:
        for info in archive:
            inner = f"{path}!{clean(info.name)}"
            yield inner, "name", None, None
            opened = archive.extractfile(info) if info.isfile() else None
            if opened:
                yield from self.member(inner, opened, depth + 1)
            archive.members.clear()  # which the reader keeps, and would be as long as the archive

    def stream(self, kind: str, path: str, source: BinaryIO, depth: int) -> Iterator[Row]:
        """A compressed tar, or one compressed file."""
        with _DECOMPRESSORS[kind](source) as plain:
            try:
                try:
                    archive = tarfile.open(fileobj=_Meter(plain, self.spend), mode="r:")
                except tarfile.TarError:
                    archive = None
                if archive:
                    with archive:
                        yield from self.tar_members(path, archive, depth)
                else:
                    plain.seek(0)
                    yield from self.member(f"{path}!<decompressed>", plain, depth + 1)
            except tarfile.TarError as error:
                yield path, "skip", None, f"damaged tar ({type(error).__name__})"
            except _Damaged as error:
                yield path, "skip", None, f"corrupt {kind} stream ({error})"
            except _BROKEN_STREAM as error:
                yield path, "skip", None, f"corrupt {kind} stream ({type(error).__name__})"


def unpack(path: str, source: BinaryIO, size: int, limits: Limits = Limits()) -> Iterator[Row]:
    """All rows of a file of so many bytes that source reads, which can seek."""
    return Unpacker(path, size, limits).rows(_Meter(source, lambda n: None))


def in_batches(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some megabytes, whatever their number."""
    held: list[Row] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2] or b"")
        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
