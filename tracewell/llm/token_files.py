"""Token files: documents in ascending doc_id order, one wavelet matrix per file.

A wavelet matrix keeps a sequence of ids as one plane of bits for each bit of the largest id. On
every plane the rows are stably parted by the next bit, so with the ranks of each plane, access,
counting and finding occurrences of an id take one step per plane and never decode the file.

File format, little-endian: the magic TWWM0002; a header of five unsigned 64-bit numbers (tokens,
planes, documents, bytes of the catalogue as it is and compressed); the CRC-32 of what follows up to
the blocks; the catalogue, compressed by zstd; for each block of each plane, from the highest bit
down, its compressed size and CRC-32 as unsigned 32-bit numbers; the blocks, each compressed by zstd
on its own. A block holds BLOCK_BITS bits, packed from the lowest bit of a byte up. The catalogue
holds each document's doc_id (signed 64-bit), number of ids (unsigned 64-bit) and whether it has a
doc_id (a byte), and for each plane the ones before each block (unsigned 64-bit). So a lookup reads
the catalogue and one or two blocks of each plane.

A folder of files has an index, a Parquet table of file names and their first positions among all
ids. What is returned is read from the folder alone.

Defined cases: null text is empty and holds only the end id; null doc_id rows come first; a very long
text stays in one file, which is then larger than others; repeated rows are stored as often as they
occur; an empty table writes no file and gives an empty result; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import fresh_path, written
from tracewell.llm.tokens import END_ID, encoder

MAGIC = b"TWWM0002"
#: Tokens after which a file is closed; bounds a task's memory.
FILE_TOKENS = 2_000_000
#: Bytes of text that a range of doc_ids is planned for.
RANGE_BYTES = 8 << 20
#: Ranges and reading tasks at most, however much text there is; beyond, files and tasks get more of it.
MOST_RANGES = 8192
RANGES_PER_BLOCK = 1024
BLOCK_BITS = 1 << 18
_BLOCK_BYTES = BLOCK_BITS // 8
_HEAD = struct.Struct("<5QI")


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def pack(ids: np.ndarray, sizes: np.ndarray, doc_ids: pa.Array) -> bytes:
    """A file's bytes: ids of all documents, each document's number of ids, and doc_ids."""
    codec = _codec()
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    kind = np.uint16 if planes <= 16 else np.uint32
    current, before, table, blocks = ids.astype(kind), [], [], []
    for level in range(planes - 1, -1, -1):
        bits = (current & kind(1 << level)).astype(bool)
        plane = np.packbits(bits, bitorder="little")
        plane = np.pad(plane, (0, -len(plane) % _BLOCK_BYTES)).reshape(-1, _BLOCK_BYTES)
        ones = np.bitwise_count(plane.view(np.uint64)).sum(axis=1, dtype=np.int64)
        before.append(np.concatenate(([0], np.cumsum(ones))))
        for block in plane:
            blocks.append(codec.compress(block.tobytes(), asbytes=True))
            table.append((len(blocks[-1]), zlib.crc32(blocks[-1])))
        parted, zeros = np.empty_like(current), len(current) - int(ones.sum())
        np.compress(~bits, current, out=parted[:zeros])
        np.compress(bits, current, out=parted[zeros:])
        current = parted
    named = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    keys = doc_ids.fill_null(0).to_numpy()
    catalogue = b"".join((keys.astype("<i8").tobytes(), sizes.astype("<u8").tobytes(), named.astype(np.uint8).tobytes(), np.array(before, "<u8").tobytes()))
    small = codec.compress(catalogue, asbytes=True)
    body = small + np.array(table, "<u4").reshape(-1, 2).tobytes()
    return MAGIC + _HEAD.pack(len(ids), planes, len(keys), len(catalogue), len(small), zlib.crc32(body)) + body + b"".join(blocks)


class WaveletMatrix:
    """Reads pack()'s bytes; answers from the planes, of which only the blocks that are asked for are decompressed."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        self.tokens, self.planes, self.documents, whole, small, crc = _HEAD.unpack_from(raw, 8)
        self.raw, at = raw, 8 + _HEAD.size
        self.per_plane = -(-self.tokens // BLOCK_BITS)
        entries = self.planes * self.per_plane
        body = memoryview(raw)[at : at + small + 8 * entries]
        if len(body) != small + 8 * entries or zlib.crc32(body) != crc:
            raise ValueError("token file is damaged")
        catalogue = _codec().decompress(body[:small], whole, asbytes=True)
        n = self.documents
        self.doc_ids = pa.array(np.frombuffer(catalogue, "<i8", n), mask=np.frombuffer(catalogue, np.uint8, n, 16 * n) == 0)
        self.firsts = np.concatenate(([0], np.cumsum(np.frombuffer(catalogue, "<u8", n, 8 * n).astype(np.int64))))
        self.before = np.frombuffer(catalogue, "<u8", self.planes * (self.per_plane + 1), 17 * n).astype(np.int64).reshape(self.planes, -1)
        self.zeros = self.tokens - self.before[:, -1]
        self.table = np.frombuffer(body, "<u4", 2 * entries, small).reshape(-1, 2)
        self.starts = at + len(body) + np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        self.blocks: dict[int, np.ndarray] = {}

    def _block(self, level: int, number: int) -> np.ndarray:
        """The 64-bit words of a block."""
        at = level * self.per_plane + number
        if at not in self.blocks:
            packed = self.raw[self.starts[at] : self.starts[at + 1]]
            if zlib.crc32(packed) != self.table[at, 1]:
                raise ValueError("token file is damaged")
            self.blocks[at] = np.frombuffer(_codec().decompress(packed, _BLOCK_BYTES, asbytes=True), "<u8")
        return self.blocks[at]

    def _ones(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position the ones before it on a plane, and its bit."""
        ones, bits = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        number = at // BLOCK_BITS
        for b in np.unique(number):
            mine = number == b
            ones[mine] = self.before[level, b]
            if b < self.per_plane:
                words = self._block(level, int(b))
                inner = at[mine] - b * BLOCK_BITS
                word, shift = words[inner >> 6], (inner & 63).astype(np.uint64)
                upto = np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
                ones[mine] += upto[inner >> 6] + np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
                bits[mine] = (word >> shift) & np.uint64(1)
        return ones, bits

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at positions."""
        at = np.asarray(at, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.tokens):
            raise IndexError("position outside the file")
        value = np.zeros(len(at), np.int64)
        for level in range(self.planes):
            ones, bits = self._ones(level, at)
            at = np.where(bits, self.zeros[level] + ones, at - ones)
            value = value << 1 | bits
        return value

    def _path(self, token: int, at: np.ndarray) -> np.ndarray:
        """Where the last plane's order has got to with the token's occurrences before positions."""
        for level in range(self.planes):
            ones, _ = self._ones(level, at)
            at = self.zeros[level] + ones if token >> (self.planes - 1 - level) & 1 else at - ones
        return at

    def rank(self, token: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of an id before positions."""
        at = np.asarray(at, np.int64)
        if token >> self.planes:
            return np.zeros(len(at), np.int64)
        found = self._path(token, np.concatenate(([0], at)))
        return found[1:] - found[0]

    def count(self, token: int) -> int:
        return int(self.rank(token, [self.tokens])[0])

    def _nth(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the nth (from 0) bits of that value on a plane."""
        out = np.zeros(len(nth), np.int64)
        counts = self.before[level] if bit else np.minimum(np.arange(self.per_plane + 1) * BLOCK_BITS, self.tokens) - self.before[level]
        number = np.searchsorted(counts, nth, "right") - 1
        for b in np.unique(number):
            mine = number == b
            words = self._block(level, int(b)) if bit else ~self._block(level, int(b))
            upto = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            inner = nth[mine] - counts[b]
            word = np.searchsorted(upto, inner, "right") - 1
            held = np.unpackbits(words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            place = (np.cumsum(held, axis=1) == (inner - upto[word] + 1)[:, None]).argmax(axis=1)
            out[mine] = b * BLOCK_BITS + word * 64 + place
        return out

    def select(self, token: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the nth (from 0) occurrences of an id."""
        nth = np.asarray(nth, np.int64)
        if len(nth) and not (0 <= nth.min() and nth.max() < self.count(token)):
            raise IndexError("no such occurrence")
        at = self._path(token, np.zeros(1, np.int64))[0] + nth
        for level in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - level) & 1
            at = self._nth(level, bit, at - self.zeros[level] if bit else at)
        return at

    def document_of(self, at: int) -> int:
        return int(np.searchsorted(self.firsts, at, "right")) - 1

    def all_ids(self) -> np.ndarray:
        """The whole sequence, by undoing the partings from the last plane up."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        values = np.zeros(self.tokens, kind)
        for level in range(self.planes - 1, -1, -1):
            words = [self._block(level, b) for b in range(self.per_plane)]
            bits = np.unpackbits(np.concatenate(words).view(np.uint8), count=self.tokens, bitorder="little").view(bool) if words else np.zeros(0, bool)
            zeros, before = self.zeros[level], np.empty(self.tokens, kind)
            before[~bits] = values[:zeros]
            before[bits] = values[zeros:] | kind(1 << (self.planes - 1 - level))
            values = before
        return values.astype("<u4")


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def write_file(folder: str, name: str, raw: bytes) -> None:
    """A retried task writes the same file again; no reader sees half of one."""
    files, path = _store(folder)
    files.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(raw)
    files.move(part, f"{path}/{name}")


def read_file(folder: str, name: str) -> bytes:
    files, path = _store(folder)
    with files.open_input_stream(f"{path}/{name}") as source:
        return source.read()


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, file_tokens: int = FILE_TOKENS) -> None:
    """Writes a folder of files and its index.

    Documents are range-partitioned by doc_id; a task reads its range in order and closes a file
    whenever it holds file_tokens. Files take their names from range and number, so a task that is
    run again writes the same files.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = plain.repartitionByRange(min(MOST_RANGES, max(1, -(-total // RANGE_BYTES))), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, part = TaskContext.get().partitionId(), 0
        encode = encoder(tokenizer)
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[pa.Array] = []
        tokens = 0

        def close() -> pa.RecordBatch:
            nonlocal part, tokens
            name = f"tokens-{where:06d}-{part:06d}.wm"
            write_file(folder, name, pack(np.concatenate(held), np.concatenate(lengths), pa.concat_arrays(names)))
            out = pa.RecordBatch.from_arrays([pa.array([where]), pa.array([part]), pa.array([name]), pa.array([tokens])], ["range", "part", "name", "tokens"])
            part, tokens = part + 1, 0
            held.clear(), lengths.clear(), names.clear()
            return out

        for batch in batches:
            for a, b, ids, firsts in encode.texts(batch.column("text")):
                row = 0
                while row < b - a:
                    end = int(np.searchsorted(firsts, firsts[row] + file_tokens - tokens))
                    end = min(max(end, row + 1), b - a)
                    held.append(ids[firsts[row] : firsts[end]])
                    lengths.append(np.diff(firsts[row : end + 1]))
                    names.append(batch.column("doc_id")[a + row : a + end])
                    tokens += int(firsts[end] - firsts[row])
                    row = end
                    if tokens >= file_tokens:
                        yield close()
        if tokens:
            yield close()

    files = written(ordered.mapInArrow(run, "range long, part long, name string, tokens long"), "token-files")
    # Positions before each file: within blocks of ranges, and of the blocks, so that no task sees all files.
    placed = files.withColumn("block", F.floor(F.col("range") / RANGES_PER_BLOCK))
    blocks = placed.groupBy("block").agg(F.sum("tokens").alias("_sum")).select("block", (F.sum("_sum").over(Window.orderBy("block")) - F.col("_sum")).alias("_offset"))
    inside = F.sum("tokens").over(Window.partitionBy("block").orderBy("range", "part")) - F.col("tokens")
    index = placed.withColumn("_inside", inside).join(blocks, "block").select("name", "tokens", (F.col("_offset") + F.col("_inside")).alias("first"))
    index.write.parquet(f"{folder}/index")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in a folder of token files: doc_id, start, n_tokens, ids_crc32, and from the planes
    n_end_ids, how often END_ID occurs in it, and end_at, the position of the last one among all ids."""
    index = spark.read.parquet(f"{folder}/index").select("name", "first")
    jobs = index.repartition(min(MOST_RANGES, max(1, index.count())), "name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist()):
                matrix = WaveletMatrix(read_file(folder, name))
                ids, firsts = matrix.all_ids(), matrix.firsts
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(firsts[:-1], firsts[1:])]
                ends = matrix.rank(END_ID, firsts)
                columns = [firsts[:-1] + first, np.diff(firsts), np.array(crcs, np.int64), np.diff(ends), matrix.select(END_ID, ends[1:] - 1) + first]
                yield pa.RecordBatch.from_arrays([matrix.doc_ids, *map(pa.array, columns)], ["doc_id", "start", "n_tokens", "ids_crc32", "n_end_ids", "end_at"])

    return jobs.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_end_ids long, end_at long")


def default_tokenizer() -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.json"))


def op10_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-store")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), folder)
    return read_token_files(spark, folder)
