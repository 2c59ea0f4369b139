"""Row numbers without gaps that depend on the rows' values only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import written

#: Copies of one row that a task writes out at a time.
STRETCH = 1 << 16


def each_copy(groups: DataFrame, copies: str, name: str) -> DataFrame:
    """A row for each of the copies that a group counts, numbered from 0 in column name.

    Groups beyond a stretch are dealt to all tasks stretch by stretch, so that no task or array holds
    a large group. groups is read twice and should be a written table.
    """
    n = F.col(copies)
    few = groups.where(n <= STRETCH).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    parts = groups.where(n > STRETCH).withColumn("_stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / STRETCH))))
    first = F.col("_stretch") * STRETCH
    many = parts.repartition(F.col("_stretch")).withColumn(name, F.explode(F.sequence(first, F.least(first + STRETCH, n) - 1))).drop("_stretch")
    return few.unionByName(many)


def number_rows(df: DataFrame, key: list[str], within: str | None = None) -> DataFrame:
    """Adds row, from 0, over the whole table or within each value of a column.

    df must hold nothing but key and within. Equal rows are counted before the shuffle. The n rows
    of a group are dealt into about sqrt(n) buckets by hash, so that neither the largest bucket nor
    a group's table of buckets grows faster than sqrt(n), however large one group is. A row that is
    repeated takes a stretch of numbers, which is written out in parts.
    """
    group = within or "_all"
    if not within:
        df = df.withColumn(group, F.lit(0))
    counted = written(df.groupBy(group, *key).agg(F.count(F.lit(1)).alias("_copies")), "row-groups")
    sizes = written(counted.groupBy(group).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_buckets")), "group-sizes")
    dealt = counted.join(sizes, group).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.col("_buckets")))
    sums = dealt.groupBy(group, "_bucket").agg(F.sum("_copies").alias("_rows"))
    offsets = sums.select(group, "_bucket", (F.sum("_rows").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_rows")).alias("_offset"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*[F.col(c).asc_nulls_first() for c in key])
    placed = dealt.withColumn("_before", F.sum("_copies").over(inside) - F.col("_copies")).join(offsets, [group, "_bucket"])
    start = F.col("_offset") + F.col("_before")
    keep = [within, *key] if within else key
    placed = written(placed.select(*keep, start.alias("_start"), "_copies"), "row-starts")
    return each_copy(placed, "_copies", "_copy").select(*keep, (F.col("_start") + F.col("_copy")).alias("row"))
