"""Findings: matches gathered by value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import patterns as P

PLACE = ("path", "line", "page")


def union_matches(*streams: DataFrame) -> DataFrame:
    """Match streams one after the other."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


#: The scan goes through all files, then through texts of pictures, then through what a model reads.
PHASES = {"files": 0, "ocr": 1, "model": 2}
#: Within a file: its name, its metadata, its text.
_STEPS = {"filename": 0, "metadata": 1}


def seen_at(phase: str | Column, order: Column, path: Column, page: Column, line: Column, rule: Column, start: Column, step: Column | None = None) -> Column:
    """The place of a match in the order of the scan, in which findings are first seen.

    phase is a name or, as a Column, the kind of a line. order is the path, or where the model comes to it.
    """
    number = F.lit(PHASES[phase]) if isinstance(phase, str) else F.when(phase == "ocr", PHASES["ocr"]).otherwise(PHASES["files"])
    fields = {"phase": number, "order": order, "step": F.lit(len(_STEPS)) if step is None else step, "path": path, "page": F.coalesce(page, F.lit(0)), "line": F.coalesce(line, F.lit(0)), "rule": rule, "start": start}
    return F.struct(*[value.cast("string" if name in ("order", "path") else "int").alias(name) for name, value in fields.items()])


def step_of(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == name, F.lit(step)) for name, step in _STEPS.items()], F.lit(len(_STEPS)))


def key_of(category: Column, value: Column) -> Column:
    """Only addresses of mail are compared without case."""
    return F.when(category == "private_email", F.lower(value)).otherwise(value)


def distinct_places(matches: DataFrame) -> DataFrame:
    """One row for each place of a finding, with what was seen there first.

    Kind is not part of a place. The key is nearly unique, so a value that occurs everywhere is
    spread over all tasks and only counted afterwards.
    """
    keyed = matches.withColumn("key", key_of(F.col("category"), F.col("value")))
    first = F.min_by(F.struct("value", "kind", "context"), "seq").alias("first")
    return keyed.groupBy("category", "key", *PLACE).agg(
        first, F.min("seq").alias("seq"), F.max("score").alias("score"), F.collect_set("detector").alias("detectors")
    )


def findings_of(places: DataFrame, keep_seq: bool = False) -> DataFrame:
    """A1 of distinct_places()."""
    first = F.min(F.struct("seq", F.col("first.value").alias("value"))).alias("v")
    detectors = F.array_sort(F.array_distinct(F.flatten(F.collect_set("detectors")))).alias("detectors")
    found = places.groupBy("category", "key").agg(first, detectors, F.round(F.max("score"), 3).alias("score"), F.count(F.lit(1)).alias("occurrences"))
    return found.select("category", "key", "v.value", "detectors", "score", "occurrences", *(["v.seq"] if keep_seq else []))


def aggregate_findings(matches: DataFrame, keep_seq: bool = False) -> DataFrame:
    """A1: category, key, value as first seen, sorted detectors, score, and distinct places as occurrences."""
    return findings_of(distinct_places(matches), keep_seq)


def first_of(places: DataFrame, limit: int = P.MAX_LOCATIONS, salts: int = 32) -> DataFrame:
    """W1 of distinct_places(): taken per salt and then per finding, so that no task sorts all places of a hot value."""
    salted = places.withColumn("_salt", F.pmod(F.xxhash64("path", "line"), F.lit(salts)))
    some = Window.partitionBy("category", "key", "_salt").orderBy("seq")
    few = salted.withColumn("_n", F.row_number().over(some)).where(F.col("_n") <= limit)
    final = few.withColumn("nth", F.row_number().over(Window.partitionBy("category", "key").orderBy("seq"))).where(F.col("nth") <= limit)
    return final.select("category", "key", "nth", *PLACE, "first.kind", "first.context")


def first_locations(matches: DataFrame, limit: int = P.MAX_LOCATIONS) -> DataFrame:
    """The first places of each finding in scan order, with the first context at each."""
    return first_of(distinct_places(matches), limit)


def label_categories(findings: DataFrame) -> DataFrame:
    """The label of each category, the category itself if it has none."""
    rows = list(P.CATEGORY_LABELS.items())
    labels = findings.sparkSession.createDataFrame(rows, "category string, _label string")
    return findings.join(F.broadcast(labels), "category", "left").withColumn("category_label", F.coalesce("_label", "category")).drop("_label")


def sort_findings(findings: DataFrame) -> DataFrame:
    """By category, most occurrences first, then value."""
    return findings.orderBy("category", F.desc("occurrences"), "value")
