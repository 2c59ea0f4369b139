"""Operator 13: lines that stand in many documents are dropped from all but the last of these.

Sharded minimal perfect hash: distinct line hashes are dealt into shards by their value, and each shard is
a file of its own: a minimal perfect hash, which gives each of its hashes a number without holding them,
and by that number arrays of fingerprints, of counts and, for lines that are found often, of the
largest document. Documents send the hashes of their long lines to the arrays, in ranges of (shard, document):
a task loads the shards of its range one after the other and probes them block by block. A line that stands
everywhere makes its shard span several ranges, each of which loads that file; no task gets all of its
documents, and no line or text is joined or sorted by line. What comes back are the hashes that a document loses.

The minimal perfect hash is a cascade of bit arrays: a hash that has its bit alone on a level is numbered
there by the bits before it, the others go on to the next, smaller level.

Defined cases: a null text is one empty line, as is an empty one. Documents are rows, also repeated ones and
those without doc_id, which counts as less than any other. All rows with the largest doc_id keep their lines,
each time they occur. An empty table gives an empty result, other columns are ignored. Hashes have 128 bits;
lines are taken as equal if their hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import fresh_path, written
from tracewell.llm.token_files import read_file, write_file

LEAST_CHARS, LEAST_DOCUMENTS = 40, 5
#: Hashes of a shard, about. A build task holds one shard, a probing task one file of it.
SHARD_HASHES = 1 << 18
#: Bits of a level for each hash that is left.
GAMMA = 2.0
MOST_COUNT = np.iinfo(np.uint16).max

_EDGE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_CONTINUED = bytes(range(0x80, 0xC0))
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def line_hash(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """128 bits of a line's key; None if the key is short."""
    if len(line) < least:
        return None
    key = line.strip(_EDGE)
    if len(key) < least or (len(key) < 4 * least and len(key.translate(None, _CONTINUED)) < least):
        return None
    return hashlib.blake2b(key.translate(_UPPER), digest_size=16).digest()


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (a + np.uint64(level + 1) * _MULTIPLY) ^ (b * _MULTIPLY)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Numbers distinct pairs of 64-bit values from 0 without gaps."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        self.before = np.concatenate(([0], ones))

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, parts = [], []
        while len(a):
            size = max(64, -(-int(GAMMA * len(a)) // 64) * 64)
            at = (_mixed(a, b, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each pair, -1 for some that were not among those built from; the rest of those get any number."""
        out = np.full(len(a), -1, np.int64)
        todo, base = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = base + (_mixed(a[todo], b[todo], level) % np.uint64(size)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = self.words[word]
            found = (held >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[found]] = self.before[word[found]] + below[found]
            todo = todo[~found]
            base += size
        return out


class LineShard:
    """The arrays of one shard, as stored in its file."""

    def __init__(self, hashes: PerfectHash, prints: np.ndarray, counts: np.ndarray, often: np.ndarray, last: np.ndarray):
        self.hashes, self.prints, self.counts, self.last = hashes, prints, counts, last
        #: Where lines that are found often have their largest document; those without any doc_id have none.
        self.often = often
        self.place = np.cumsum(often) - 1

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, n: np.ndarray, last: np.ndarray, known: np.ndarray, least: int) -> LineShard:
        hashes = PerfectHash.build(a, b)
        order = np.empty(len(a), np.int64)
        order[hashes.numbers(a, b)] = np.arange(len(a))
        often = ((n >= least) & known)[order]
        return cls(hashes, b[order].astype(np.uint32), np.minimum(n, MOST_COUNT)[order].astype(np.uint16), often, last[order][often])

    def to_bytes(self) -> bytes:
        sizes = np.array(self.hashes.sizes, "<u8")
        head = np.array([len(sizes), len(self.prints)], "<u8")
        return b"".join(x.tobytes() for x in (head, sizes, self.hashes.words, self.prints.astype("<u4"), self.counts.astype("<u2"), np.packbits(self.often), self.last.astype("<i8")))

    @classmethod
    def from_bytes(cls, raw: bytes) -> LineShard:
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        levels, n = map(int, take("<u8", 2))
        sizes = take("<u8", levels).astype(int).tolist()
        hashes = PerfectHash(sizes, take("<u8", sum(sizes) // 64))
        prints, counts = take("<u4", n), take("<u2", n)
        often = np.unpackbits(take("u1", -(-n // 8)), count=n).astype(bool)
        return cls(hashes, prints, counts, often, take("<i8", int(often.sum())))

    def lost(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, known: np.ndarray, least: int) -> np.ndarray:
        """Whether each (line, document) is one that loses the line; known tells which documents have a doc_id."""
        number = self.hashes.numbers(a, b)
        out = np.zeros(len(a), bool)
        at = np.flatnonzero(number >= 0)
        at = at[(self.prints[number[at]] == b[at].astype(np.uint32)) & (self.counts[number[at]] >= least) & self.often[number[at]]]
        out[at] = ~known[at] | (doc[at] != self.last[self.place[number[at]]])
        return out


def long_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, digest, a, b: the distinct hashes of the long lines of each row of docs(doc_id, digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], []
            for i, text in enumerate(batch.column("text")):
                raw = text.as_buffer() if text.is_valid else None
                if raw is None or raw.size < least:
                    continue
                found = {line_hash(line, least) for line in raw.to_pybytes().split(b"\n")}
                found.discard(None)
                rows += [i] * len(found)
                held += found
            ab = np.frombuffer(b"".join(held), ">i8").astype(np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("digest").take(at), pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["doc_id", "digest", "a", "b"])

    return docs.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest long, a long, b long")


def write_line_index(lines: DataFrame, folder: str, least: int = LEAST_DOCUMENTS) -> int:
    """Writes the shards of lines(doc_id, a, b) to a folder that all executors share; returns their number.

    Names follow from the shard's number, so a task that is run again writes the same files.
    """
    keys = written(lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")), "line-hashes")
    shards = max(1, -(-keys.count() // SHARD_HASHES))

    def build(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).to_numpy()
        last = table.column("last")
        shard = int(table.column("shard")[0].as_py())
        arrays = LineShard.build(column("a").view(np.uint64), column("b").view(np.uint64), column("n"), last.fill_null(0).to_numpy(), last.is_valid().to_numpy(), least)
        raw = arrays.to_bytes()
        write_file(folder, f"shard-{shard}", raw)
        return pa.table({"shard": pa.array([shard], pa.int64()), "hashes": pa.array([len(table)], pa.int64()), "bytes": pa.array([len(raw)], pa.int64())})

    built = keys.withColumn("shard", F.pmod("a", F.lit(shards))).groupBy("shard").applyInArrow(build, "shard long, hashes long, bytes long")
    built.write.parquet(f"{folder}/shards")
    return shards


def lost_lines(lines: DataFrame, folder: str, shards: int, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The rows of lines(doc_id, digest, a, b) whose document loses the line."""
    ranges = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.withColumn("shard", F.pmod("a", F.lit(shards)))
    order = ["shard", "digest", "a"]
    # No row is sorted by its line, so the ranges of a shard get like parts of a line that is in all documents.
    dealt = dealt.repartitionByRange(ranges, *order).sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, arrays = None, None
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            doc = batch.column("doc_id")
            known, ids = doc.is_valid().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
            a, b = batch.column("a").to_numpy().view(np.uint64), batch.column("b").to_numpy().view(np.uint64)
            lost = np.zeros(len(batch), bool)
            for first, end in zip(cuts := np.flatnonzero(np.diff(shard, prepend=-1)), [*cuts[1:], len(shard)]):
                if shard[first] != now:
                    now = shard[first]
                    arrays = LineShard.from_bytes(read_file(folder, f"shard-{now}"))
                part = slice(first, end)
                lost[part] = arrays.lost(a[part], b[part], ids[part], known[part], least)
            yield batch.filter(pa.array(lost)).select(["doc_id", "digest", "a", "b"])

    return dealt.select("doc_id", "digest", "a", "b", "shard").mapInArrow(run, "doc_id long, digest long, a long, b long")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines, dropped = [], [], []
        for text, lost in zip(batch.column("text"), batch.column("lost")):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            rows = raw.split(b"\n")
            keep = rows
            if lost.is_valid:
                gone = {x.as_py() for x in lost.values}
                keep = [row for row in rows if line_hash(row) not in gone]
            lines.append(len(rows))
            dropped.append(len(rows) - len(keep))
            texts.append(b"\n".join(keep) if dropped[-1] else raw)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept"])


def without_common_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept, the rest of the text in UTF-8, of each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    # Rows with one doc_id and one digest lose the same lines, as that depends on doc_id and line alone.
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", F.xxhash64("text"))
    lines = written(long_lines(plain), "long-lines")
    folder = fresh_path(spark, "line-index")
    lost = lost_lines(lines, folder, write_line_index(lines, folder))
    raw = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("a", "b")])
    by_row = lost.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.collect_set(raw).alias("lost"))
    joined = plain.join(by_row, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("doc_id", "text", "lost").mapInArrow(_without, "doc_id long, n_lines long, n_dropped long, kept binary")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_common_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""WITH l AS MATERIALIZED (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS MATERIALIZED (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> last AS lost FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256 FROM j GROUP BY doc_id"""
