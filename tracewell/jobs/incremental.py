"""J5 as a job: a scan that is kept and brought up to date by what has changed.

Kept are the files as they were scanned, every match with its place, and the findings. An update scans files
that are new or changed only; the matches of changed and removed files go, new ones come in, and findings are
counted again for the keys of either. All else is taken over. States are written tables in a folder, each
under a number of its own, so an update that fails leaves the last state as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.credentials import root_of
from tracewell.operators.findings import aggregate_findings, key_of
from tracewell.sources.files import changed_files

FILE = ("path", "length", "mtime")
FINDING = ("category", "key")


@dataclass
class ScanState:
    """files(path, length, mtime), matches as of detect() with root, and findings as of aggregate_findings() with seq."""

    folder: str
    number: int
    files: DataFrame
    matches: DataFrame
    findings: DataFrame


def load(spark: SparkSession, folder: str, number: int) -> ScanState:
    at = f"{folder}/{number:06d}"
    return ScanState(folder, number, *[spark.read.parquet(f"{at}/{name}") for name in ("files", "matches", "findings")])


def _keyed(matches: DataFrame) -> DataFrame:
    return matches.withColumn("key", key_of(F.col("category"), F.col("value")))


def first_scan(files: DataFrame, scan: Callable[[DataFrame], DataFrame], folder: str) -> ScanState:
    """The state after a scan of all files(path, length, mtime). scan gives the matches of such rows, as of detect()."""
    spark = files.sparkSession
    at = f"{folder}/{0:06d}"
    files.select(*FILE).write.mode("overwrite").parquet(f"{at}/files")
    kept = spark.read.parquet(f"{at}/files")
    scan(kept).withColumn("root", root_of(F.col("path"))).write.mode("overwrite").parquet(f"{at}/matches")
    aggregate_findings(spark.read.parquet(f"{at}/matches"), keep_seq=True).write.mode("overwrite").parquet(f"{at}/findings")
    return load(spark, folder, 0)


def update(state: ScanState, now: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> ScanState:
    """The state after files have become now(path, length, mtime). Equal to a first scan of now, but for the work.

    Paths are joined by shuffle on path, findings on their keys; what is scanned, inserted and counted again
    depends on the change, what is read and written again on the state.
    """
    spark, number = now.sparkSession, state.number + 1
    at = f"{state.folder}/{number:06d}"
    now = now.select(*FILE)
    now.write.mode("overwrite").parquet(f"{at}/files")
    now = spark.read.parquet(f"{at}/files")
    # Of files that are gone or not as they were, nothing is kept. Files whose names look like members of one
    # archive go together.
    root = root_of(F.col("path")).alias("root")
    gone = changed_files(state.files, now).select(root).union(changed_files(now, state.files).select(root)).distinct()
    gone.write.mode("overwrite").parquet(f"{at}/roots")
    gone = spark.read.parquet(f"{at}/roots")
    changed = now.withColumn("root", root).join(gone, "root", "left_semi").select(*FILE)
    scan(changed).withColumn("root", root).write.mode("overwrite").parquet(f"{at}/inserted")
    fresh = spark.read.parquet(f"{at}/inserted")
    left = state.matches.join(gone, "root", "left_anti")
    left.unionByName(fresh).write.mode("overwrite").parquet(f"{at}/matches")
    matches = spark.read.parquet(f"{at}/matches")
    deleted = state.matches.join(gone, "root", "left_semi")
    touched = _keyed(deleted).select(*FINDING).union(_keyed(fresh).select(*FINDING)).distinct()
    touched.write.mode("overwrite").parquet(f"{at}/touched")
    touched = spark.read.parquet(f"{at}/touched")
    again = aggregate_findings(_keyed(matches).join(touched, [*FINDING], "left_semi").drop("key"), keep_seq=True)
    state.findings.join(touched, [*FINDING], "left_anti").unionByName(again).write.mode("overwrite").parquet(f"{at}/findings")
    return load(spark, state.folder, number)
