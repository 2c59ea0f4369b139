"""A finding folds into a longer one of its category that contains it and shares a place.

Order matters: longer findings come first, equal ones as first seen, and a host gains the places of
what it absorbs. In that order, a finding folds into the first host that contains it among the hosts
of the earlier findings at its places; the host of one that was not absorbed is itself. Rounds apply
this rule to all findings at once until nothing changes. As a host depends on earlier findings only,
what rests is the result of the pass one by one. Rounds join pairs of findings; places stay rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.tables import materialized, spread_join

PLACE = ("path", "line", "page")
FINDING = ["category", "key"]


def without_space(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"(?U)[\s\x1c-\x1f]", ""))


def _inside(norm: Column, host: Column) -> Column:
    return F.contains(host, norm) & (F.length(norm) > 0)


def containing_pairs(spots: DataFrame) -> DataFrame:
    """(category, key, host) of findings that share a place with an earlier one that contains them.

    spots(category, key, rank, norm, _place): rank orders findings, norm is the value without space.

    An equi-join on the place; containment is tested on its rows. A place is one line of at most
    20,000 scanned characters, which bounds the findings that meet there.
    """
    host = F.struct(F.col("rank").alias("rank"), F.col("key").alias("key"), F.col("norm").alias("norm")).alias("host")
    at = spots.select("category", "_place", host)
    met = spots.join(at, ["category", "_place"]).where((F.col("host.rank") < F.col("rank")) & _inside(F.col("norm"), F.col("host.norm")))
    return met.select("category", "key", "host").distinct()


def _later(spots: DataFrame, absorbed: DataFrame) -> DataFrame:
    """(category, key, norm, via) of findings that share a place with an earlier absorbed one, via."""
    at = spots.join(absorbed.select(*FINDING), FINDING, "left_semi").select("category", "_place", F.col("key").alias("via"), F.col("rank").alias("_via_rank"))
    return spots.join(at, ["category", "_place"]).where(F.col("_via_rank") < F.col("rank")).select(*FINDING, "norm", "via").distinct()


def _hosts(spots: DataFrame, pairs: DataFrame) -> DataFrame:
    """(category, key, host) of the findings that are absorbed."""
    hosts = materialized(pairs.groupBy(*FINDING).agg(F.min("host").alias("host")), "hosts")
    known, later = hosts.limit(0), None
    while True:
        new = materialized(_later(spots, hosts.join(known, FINDING, "left_anti")), "later")
        later = new if later is None else later.unionByName(new)
        known = known.select(*FINDING).union(hosts.select(*FINDING)).distinct()
        gone = hosts.select("category", F.col("key").alias("via"), F.col("host").alias("_host"))
        through = later.join(gone, ["category", "via"]).where(_inside(F.col("norm"), F.col("_host.norm"))).select(*FINDING, F.col("_host").alias("host"))
        direct = pairs.withColumn("via", F.col("host.key")).join(gone, ["category", "via"], "left_anti").select(*FINDING, "host")
        after = materialized(direct.unionByName(through).groupBy(*FINDING).agg(F.min("host").alias("host")), "hosts")
        was = hosts.select(*FINDING, F.col("host.key").alias("_was"))
        changed = after.join(was, FINDING, "full_outer").where(~F.col("host.key").eqNullSafe(F.col("_was")))
        hosts = after
        if changed.isEmpty():
            return hosts


def merge_overlapping(findings: DataFrame, places: DataFrame) -> DataFrame:
    """Merged findings(category, key, value, detectors, score, occurrences, absorbed).

    findings as of aggregate_findings() with seq or without; places(category, key, path, line, page).
    absorbed lists the keys that were folded in.
    """
    spot = F.concat_ws("\x00", F.col("path"), F.coalesce(F.col("line"), F.lit(-1)).cast("string"), F.coalesce(F.col("page"), F.lit(-1)).cast("string"))
    order = F.col("seq") if "seq" in findings.columns else F.col("key")
    rank = F.struct((-F.length("value")).alias("shorter"), order.alias("seen"), F.col("key").alias("key")).alias("rank")
    # Written, so that a join of a hot finding's places is split, and findings are counted once.
    base = materialized(findings.select(*FINDING, "value", "detectors", "score", "occurrences", rank, without_space(F.col("value")).alias("norm")), "findings")
    none = F.array().cast("array<string>")
    shown = [*FINDING, "value", "detectors", "score", "occurrences"]
    spots = materialized(places.select(*FINDING, spot.alias("_place")).distinct().join(base.select(*FINDING, "rank", "norm"), FINDING), "spots")
    pairs = materialized(containing_pairs(spots), "pairs")
    if pairs.isEmpty():
        return base.select(*shown, none.alias("absorbed"))
    folded = _hosts(spots, pairs).select(*FINDING, F.col("host.key").alias("home"))
    members = materialized(folded.unionByName(folded.select("category", F.col("home").alias("key"), "home").distinct()), "members")
    # Distinct first by place, then counted: a hot host's places are spread over all tasks.
    counts = spots.join(members, FINDING).select("category", "home", "_place").distinct().groupBy("category", "home").agg(F.count(F.lit(1)).alias("_count"))
    facts = members.join(base, FINDING).groupBy("category", "home").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("detectors")))).alias("_detectors"),
        F.max("score").alias("_score"),
        F.array_sort(F.collect_list(F.when(F.col("key") != F.col("home"), F.struct("rank", "key")))).alias("_absorbed"),
    )
    gained = facts.join(counts, ["category", "home"]).withColumnRenamed("home", "key")
    lost = folded.select(*FINDING)
    kept = base.join(lost, FINDING, "left_anti").join(gained, FINDING, "left")
    return kept.select(
        *FINDING, "value", F.coalesce("_detectors", "detectors").alias("detectors"), F.coalesce("_score", "score").alias("score"),
        F.coalesce("_count", "occurrences").alias("occurrences"), F.coalesce(F.col("_absorbed.key"), none).alias("absorbed"),
    )


def attach_locations(hits: DataFrame, locations: DataFrame, on: Sequence[str] = ("text",)) -> DataFrame:
    """Results found once for a distinct text go to every place of that text.

    A text that stands on a large part of all lines is dealt over several keys. locations is read twice.
    """
    return spread_join(hits, locations, list(on))
