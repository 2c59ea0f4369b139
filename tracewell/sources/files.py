"""Files as rows: reading, refusing, sniffing, decoding, and checks on names and sizes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewell.functions import patterns as P
from tracewell.functions import text as T
from tracewell.functions.tables import in_ranges, materialized
from tracewell.sources.archives import ROW_SCHEMA, Limits, Row, in_batches, unpack

REFUSED = {
    "/mnt/skills": r"(?:^|/)mnt/skills(?:/|$)",
    "/mnt/transcripts": r"(?:^|/)mnt/transcripts(?:/|$)",
    ".ssh": r"(?:^|/)\.ssh(?:/|$)",
    ".config": r"(?:^|/)\.config(?:/|$)",
    "credentials": r"(?:^|/)\.(?:aws|gnupg|kube|docker|azure)(?:/|$)",
}


def read_files(spark: SparkSession, *roots: str) -> DataFrame:
    """Path, modificationTime, length, content of every file below the roots."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots))


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "!"), -1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "[/!]"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(leaf(path), "/"), -1), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(leaf(path), "/"), -1), r"(?<=[^.])\.[^.]+$", ""))


def refusal(path: Column) -> Column:
    """The rule that refuses a location, or null."""
    return F.coalesce(*[F.when(path.rlike(rx), F.lit(name)) for name, rx in REFUSED.items()])


def split_refused(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that may be scanned, and the skip log(path, reason) of the others."""
    marked = files.withColumn("_refused", refusal(F.col("path")))
    skipped = marked.where("_refused IS NOT NULL").select("path", F.concat(F.lit("refused location: "), "_refused").alias("reason"))
    return marked.where("_refused IS NULL").drop("_refused"), skipped


def is_prose(path: Column) -> Column:
    """Prose by extension or by name."""
    return extension(path).isin(*P.PROSE_EXTENSIONS) | stem(path).isin(*P.PROSE_NAMES)


#: Values that are decoded at a time.
_DECODED = 64


@F.arrow_udf(StringType())
def _decode_other(contents: pa.Array) -> pa.Array:
    """A few values at a time, so that a batch is held as Arrow buffers only."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return raw.decode("utf-16" if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else "cp932")
        except UnicodeDecodeError:
            return None

    parts = [pa.array([one(raw.as_py()) for raw in contents[k : k + _DECODED]], pa.string()) for k in range(0, len(contents), _DECODED)]
    return pa.concat_arrays([pa.array([], pa.string()), *parts])


def decode_text(content: Column) -> Column:
    """S3: UTF-16 if marked so, no text if a NUL is among the first 8192 bytes, else UTF-8, else CP932; null if none fits.

    UTF-8 stays in the JVM; other bytes go to Python.
    """
    head = F.hex(F.substring(content, 1, 2))
    marked = head.isin("FFFE", "FEFF")
    binary = F.contains(F.substring(content, 1, 8192).cast("string"), F.lit("\x00"))
    plain = F.is_valid_utf8(content.cast("string"))
    # A Python function is run for every row, whatever branch it stands in, so all other rows send it null.
    other = _decode_other(F.when(marked | (~binary & ~plain), content))
    return F.when(marked, other).when(binary, None).when(plain, content.cast("string")).otherwise(other)


def sniff_kind(content: Column, path: Column) -> Column:
    """Pdf, image, zip, tar, gzip, bz2, xz, x:... or raw."""
    head = F.hex(F.substring(content, 1, 12))
    out = F.coalesce(
        *[F.when(head.startswith(prefix), F.lit(kind)) for kind, prefix in P.MAGIC],
        F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("image")),
        F.when(F.hex(F.substring(content, 258, 5)) == "7573746172", F.lit("tar")),
        F.when(extension(path).isin(*P.IMAGE_EXTENSIONS), F.lit("image")),
        F.lit("raw"),
    )
    return out


def expand_archives(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Path, what, content and reason of files, archive members, office parts, names and skips.

    Of files(path, content). An archive is opened by the task that holds it, member by member; no file ends the job.
    For files that are too large for a row see tree.read_tree().
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for batch in batches:
            for path, raw in zip(batch.column("path"), batch.column("content")):
                held = raw.as_buffer() if raw.is_valid else pa.py_buffer(b"")
                yield from unpack(path.as_py() or "", pa.BufferReader(held), held.size, limits)

    return files.select("path", "content").mapInArrow(lambda batches: in_batches(rows(batches)), ROW_SCHEMA)


def expand_named(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What expand_archives() gives of files(path, content), with their own names, and a skip row for each in a refused place.

    One pass, as files may be costly to make. The content of a refused file is not looked at.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
        for batch in batches:
            for path, refused, raw in zip(*(batch.column(c) for c in ("path", "refused", "content"))):
                if refused.is_valid:
                    yield path.as_py(), "skip", None, f"refused location: {refused.as_py()}"
                    continue
                yield path.as_py(), "name", None, None
                held = raw.as_buffer() if raw.is_valid else pa.py_buffer(b"")
                yield from unpack(path.as_py() or "", pa.BufferReader(held), held.size, limits)

    refused = refusal(F.col("path"))
    marked = files.select("path", refused.alias("refused"), F.when(refused.isNull(), F.col("content")).alias("content"))
    return marked.mapInArrow(lambda batches: in_batches(rows(batches)), ROW_SCHEMA)


def _utf8(content: Column) -> Column:
    """Text of bytes of which those that aren't UTF-8 become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def office_text(expanded: DataFrame) -> DataFrame:
    """Path and text of the parts of office files."""
    return expanded.where("what = 'part'").select("path", T.xml_to_text(_utf8(F.col("content"))).alias("text"))


def office_authors(expanded: DataFrame) -> DataFrame:
    """D11 for office files: path, tag, value."""
    xml = _utf8(F.col("content"))

    def named(tag: str) -> Column:
        values = F.regexp_extract_all(xml, F.lit(P.OFFICE_AUTHOR.format(tag=tag)), F.lit(1))
        return F.transform(values, lambda v: F.struct(F.lit(tag).alias("tag"), v.alias("value")))

    found = expanded.where("what = 'meta'").select("path", F.explode(F.concat(*map(named, P.OFFICE_AUTHOR_TAGS))).alias("m"))
    return found.select("path", "m.tag", T.stripped(T.unescape(F.col("m.value"))).alias("value")).where("value != ''")


def add_filenames(files: DataFrame) -> DataFrame:
    """The base name of each file as a line to scan."""
    name = F.element_at(F.split(F.rtrim(leaf(F.col("path")), F.lit("/")), "/"), -1)
    return files.select("path", F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("line"), F.lit("filename").alias("kind"), name.alias("text")).where("text != ''")


def size_flags(files: DataFrame) -> DataFrame:
    """Strict limits for download, text scan and upload."""
    n = F.col("length")
    return files.select("path", "length", (n > P.DOWNLOAD_LIMIT_BYTES).alias("over_download"), (n > P.MAX_TEXT_BYTES).alias("text_too_large"), (n > P.MAX_FILE_BYTES).alias("refused"))


def size_check(requested: DataFrame, files: DataFrame, blocked_paths: DataFrame) -> DataFrame:
    """A3: per requested root: exists, size, over the limit, blocked, and whether it may be uploaded.

    requested(root); files(root, path, length); blocked_paths(path). Missing roots stay as rows.
    """
    bad = blocked_paths.select("path", F.lit(True).alias("_bad")).distinct()
    sums = files.join(bad, "path", "left").groupBy("root").agg(
        F.sum("length").alias("size_bytes"), F.coalesce(F.bool_or("_bad"), F.lit(False)).alias("blocked")
    )
    out = requested.join(sums, "root", "left").withColumn("exists", F.col("size_bytes").isNotNull())
    size = F.coalesce("size_bytes", F.lit(0))
    return out.select(
        "root", "exists", size.alias("size_bytes"), F.when(F.col("exists"), T.human_size(size)).alias("size_human"),
        (size > P.DOWNLOAD_LIMIT_BYTES).alias("over_limit"), F.coalesce("blocked", F.lit(False)).alias("blocked"),
        (F.col("exists") & ~F.coalesce("blocked", F.lit(False))).alias("upload_allowed"),
    )


FINGERPRINT_BLOCK = 8192


def _entry_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bundle, at, block): runs of one bundle's sorted entries, each entry with its line end."""
    for batch in batches:
        rows, held, size = [], [], 0
        bundles, ats, entries = (batch.column(i).to_pylist() for i in range(3))
        for i, entry in enumerate(entries):
            held.append(entry.encode() + b"\n")
            size += len(held[-1])
            if size >= FINGERPRINT_BLOCK or i + 1 == len(entries) or bundles[i + 1] != bundles[i]:
                rows.append((bundles[i], ats[i], b"".join(held)))
                held, size = [], 0
        columns = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))], ["bundle", "at", "block"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running SHA-256 over the sorted blocks of each bundle."""
    started, bundle, digest = False, None, hashlib.sha256()
    done = lambda: pa.RecordBatch.from_arrays([pa.array([bundle], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["bundle", "fingerprint"])
    for batch in batches:
        for name, block in zip(batch.column(0), batch.column(1)):
            if started and name.as_py() != bundle:
                yield done()
                digest = hashlib.sha256()
            started, bundle = True, name.as_py()
            digest.update(block.as_py())
    if started:
        yield done()


def fingerprint(files: DataFrame) -> DataFrame:
    """A4: SHA-256 per bundle over its sorted entries path, size and time; entries only, never content.

    Entries are sorted over range partitions and joined to blocks; a digest takes the blocks of its
    bundle one after the other, so that no row or task holds a bundle.
    """
    entry = F.concat_ws("\x00", "path", F.col("length").cast("string"), F.col("mtime").cast("string"))
    sorted_ = in_ranges(files.select(F.col("bundle").cast("string").alias("bundle"), entry.alias("entry")), "bundle", "entry")
    blocks = materialized(sorted_.select("bundle", "_at", "entry").mapInArrow(_entry_blocks, "bundle string, at long, block binary"), "entries")
    dealt = blocks.repartition("bundle").sortWithinPartitions("bundle", "at").select("bundle", "block")
    return dealt.mapInArrow(_digests, "bundle string, fingerprint string")


def content_sha256(files: DataFrame) -> DataFrame:
    """F3."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def changed_files(now: DataFrame, scanned: DataFrame) -> DataFrame:
    """Files whose path, size and time the last scan has not seen."""
    same = [now[c].eqNullSafe(scanned[c]) for c in ("path", "length", "mtime")]
    return now.join(scanned, same[0] & same[1] & same[2], "left_anti")


def skip_summary(skipped: DataFrame, examples: int = P.MAX_SKIP_EXAMPLES) -> DataFrame:
    """A2: per reason the number of files and the first paths.

    First within a salt and then overall, so that one frequent reason is not sorted in one task.
    """
    counts = skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    salted = Window.partitionBy("reason", F.pmod(F.xxhash64("path"), F.lit(32))).orderBy("path")
    few = skipped.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= examples)
    top = few.withColumn("_n", F.row_number().over(Window.partitionBy("reason").orderBy("path"))).where(F.col("_n") <= examples)
    lists = top.groupBy("reason").agg(F.sort_array(F.collect_list("path")).alias("examples"))
    return counts.join(lists, "reason")
