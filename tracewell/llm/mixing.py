"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

A source's weight is a piecewise linear function of training time. Its integral is the source's
cumulative demand for words; inverting it at the point where a document comes up in its source's
stream gives the document's training position, by which the mix is range-sorted.

A source's stream is its documents in the order of a digest of doc_id and text, repeated until its
target is met; the document on which the target falls is taken whole or not at all, whichever is
nearer. Rows that are equal in digest are counted before anything is sorted and their places in the
stream are computed from their number; running sums go over about sqrt(rows) buckets of each source.
So neither a source with a third of all rows nor a row that is repeated as often is a single task.

Defined cases: null text has size 0 and takes nothing; a null source is a source of its own, the
last one; null doc_ids are told apart by their texts; very long texts are counted whole and never
sorted or summed with others, only their sizes are; repeated rows are interchangeable; an empty table
gives an empty result; other columns of the input are ignored (copies() hands them on), whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import column, written
from tracewell.llm.numbering import each_copy

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Relative weight over training time as (time, factor) knots; sources take the schedules in turn.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 0.5), (1.0, 1.5)),
    ((0.0, 0.5), (0.5, 1.5), (1.0, 0.5)),
)
WORD = r"[^\x20\x09-\x0D]+"


def targets(groups: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: source_size, n groups, weight and target.

    Shares of the total in proportion to weight; a target stops at max_repeats times its source's
    size and the excess is shared again. With sources in the order of size per weight, this is the
    level lam at which the sum of min(cap, lam * weight) is the total.
    """
    sources = groups.groupBy("_key").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy("_key")) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * max_repeats)
    by_fill = Window.orderBy(F.col("_cap") / F.col("weight"), "_key")
    everything = by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_open", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
        .withColumn("_lam", F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("weight"), F.col("_level"))).over(everything))
    )
    return levels.select(
        "_key", "_rank", "source_size", "n", "weight",
        F.round(F.coalesce(F.least(F.col("_cap").cast("double"), F.col("_lam") * F.col("weight")), F.col("_cap").cast("double")), 6).alias("target"),
    )


def _segments(knots: Sequence[tuple[float, float]]) -> Column:
    area = sum((t1 - t0) * (f0 + f1) / 2 for (t0, f0), (t1, f1) in zip(knots, knots[1:]))
    rows, before = [], 0.0
    for (t0, f0), (t1, f1) in zip(knots, knots[1:]):
        part = (t1 - t0) * (f0 + f1) / 2 / area
        rows.append(F.struct(*[F.lit(float(v)).alias(k) for k, v in (("t0", t0), ("slope", (f1 - f0) / area / (t1 - t0) / 2), ("f0", f0 / area), ("before", before), ("upto", before + part))]))
        before += part
    return F.array(*rows)


def training_time(share: Column, rank: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """The time at which a source has met this share (0 to 1) of its demand."""
    table = F.get(F.array(*[F.array(_segments(k)) for k in schedules]), (rank % len(schedules)).cast("int"))

    def solve(segments: Column) -> Column:
        s = F.coalesce(F.get(F.filter(segments, lambda x: share <= x["upto"]), F.lit(0)), F.element_at(segments, -1))
        rest = F.greatest(share - s["before"], F.lit(0.0))
        root = F.sqrt(F.greatest(s["f0"] * s["f0"] + 4 * s["slope"] * rest, F.lit(0.0)))
        return s["t0"] + F.coalesce(F.try_divide(2 * rest, s["f0"] + root), F.lit(0.0))

    return F.round(F.get(F.transform(table, solve), F.lit(0)), 9)


def _own(docs: DataFrame) -> list[Column]:
    """The source's key ("k..." sorts before "n", so the null source is last), doc_id, size and digest."""
    part = lambda c: F.coalesce(c, F.lit(""))
    digest = F.md5(F.encode(F.concat(part(F.col("doc_id").cast("string")), F.lit(" "), part(F.md5(F.encode("text", "UTF-8")))), "UTF-8"))
    return [
        F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), F.col("source"))).alias("_key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        digest.alias("_md5"),
    ]


def demand(groups: DataFrame, names: list[str], weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """For each group of equal rows, counted in _n: its source's facts, and where its first copy starts in the stream.

    names are the columns that tell groups apart, _key and _md5 first.
    """
    goal = written(targets(groups, weights, max_repeats), "mix-targets")
    share = F.conv(F.substring("_md5", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    dealt = groups.join(goal, "_key").withColumn("_bucket", F.floor(share * F.ceil(F.sqrt("n"))).cast("long"))
    words = F.col("size") * F.col("_n")
    sums = dealt.groupBy("_key", "_bucket").agg(F.sum(words).alias("_sum"))
    offsets = sums.select("_key", "_bucket", (F.sum("_sum").over(Window.partitionBy("_key").orderBy("_bucket")) - F.col("_sum")).alias("_offset"))
    inside = Window.partitionBy("_key", "_bucket").orderBy(*names[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_inside", F.sum(words).over(inside) - words).join(offsets, ["_key", "_bucket"])
    full = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    placed = placed.withColumn("_first", F.col("_offset") + F.col("_inside")).withColumn("_full", full)
    return placed.withColumn("_rest", F.col("target") - F.col("_full") * F.col("source_size"))


def _taken(rows: DataFrame) -> DataFrame:
    """Adds the place of each copy (_copy of its group) in the stream and the words that are taken of it."""
    start = F.col("_first") + F.col("_copy") * F.col("size")
    # Beyond the full passes the stream is taken up to _rest, to the nearest end of a document.
    more = (2 * (F.col("_rest") - start) >= F.col("size")) & (F.col("size") > 0)
    rows = rows.withColumn("_start", start).withColumn("_times", F.col("_full") + more.cast("int"))
    return rows.withColumn("taken", F.col("_times") * F.col("size"))


def _position(repeat: Column, schedules) -> Column:
    middle = repeat * F.col("source_size") + F.col("_start") + F.col("size") / F.lit(2)
    share = F.least(F.coalesce(F.try_divide(middle.cast("double"), F.col("target")), F.lit(0.0)), F.lit(1.0))
    return training_time(share, F.col("_rank"), schedules)


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """Every document with what the mix takes of it, range-sorted by its first training position."""
    names = ["_key", "_md5", "doc_id", "size"]
    groups = written(docs.select(*_own(docs)).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), "mix-sizes")
    rows = _taken(each_copy(written(demand(groups, names, weights, max_repeats), "mix-starts"), "_n", "_copy"))
    out = rows.withColumn("position", F.when(F.col("taken") > 0, _position(F.lit(0), schedules)))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """The mix itself: a row for each time a document is taken, in training order, with docs' columns."""
    own = docs.columns
    other = F.md5(F.encode(F.to_json(F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(own) if c != "text"])), "UTF-8"))
    names = ["_key", "_md5", "_other", "doc_id", "size"]
    keyed = docs.select(*_own(docs), other.alias("_other"), F.struct(*map(column, own)).alias("_doc"))
    groups = written(keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n")), "mix-sizes")
    rows = _taken(each_copy(written(demand(groups, names, weights, max_repeats), "mix-starts"), "_n", "_copy")).where("_times > 0")
    rows = rows.withColumn("_at", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1), lambda k: _position(k, schedules))))
    # One text of each group meets its places in the mix; a group's places are bounded by its copies.
    texts = keyed.select("_key", "_md5", "_other", "_doc").dropDuplicates(["_key", "_md5", "_other"])
    out = rows.select("_key", "_md5", "_other", "_at", "_copy").join(texts, ["_key", "_md5", "_other"])
    return out.orderBy("_at", "_md5", "_other", "_copy").select(*[F.col("_doc")[c].alias(c) for c in own])


def op3_curriculum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('k' || source, 'n') AS k, md5(coalesce(doc_id::varchar, '') || ' ' || coalesce(md5(text), '')) AS h,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size
  FROM documents),
src AS (SELECT k, sum(size)::BIGINT AS source_size, count(*) AS n, row_number() OVER (ORDER BY k) - 1 AS rnk FROM sized GROUP BY k),
w AS (SELECT *, (rnk % 3) + 1 AS weight, source_size * 3 AS cap FROM src),
lev AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
lam AS (SELECT max(level) AS lam FROM lev WHERE level <= cap / weight),
goal AS (SELECT k, rnk, source_size, round(coalesce(least(cap::DOUBLE, lam * weight), cap::DOUBLE), 6) AS target FROM w, lam),
s AS (
  SELECT doc_id, size, source_size, target, rnk,
         sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS f
  FROM sized JOIN goal USING (k)),
t AS (
  SELECT *, (f + CASE WHEN size > 0 AND 2 * (target - f * source_size - start) >= size THEN 1 ELSE 0 END) * size AS taken,
         CASE WHEN target > 0 THEN least(1, (start + size / 2) / target) ELSE 0 END AS u FROM s),
g AS (
  SELECT *, CASE rnk % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN CASE WHEN u <= 0.5 THEN 0 ELSE 0.5 END END::DOUBLE AS t0,
         CASE rnk % 3 WHEN 0 THEN 1.5 WHEN 1 THEN 0.5 ELSE CASE WHEN u <= 0.5 THEN 0.5 ELSE 1.5 END END::DOUBLE AS f0,
         CASE rnk % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.5 ELSE CASE WHEN u <= 0.5 THEN 1.0 ELSE -1.0 END END::DOUBLE AS a FROM t),
r AS (SELECT *, greatest(u - t0, 0) AS x FROM g)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN round(t0 + CASE WHEN x = 0 THEN 0 ELSE 2 * x / (f0 + sqrt(greatest(f0 * f0 + 4 * a * x, 0))) END, 9) END AS position
FROM r
"""
