"""Cutting lineage by written tables in the folder that the cluster names, and deleting them."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Open scratch() blocks of this thread, each with the tables that were written in it.
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the setting is unset, as in tests on one machine, a folder of our own is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new path; lasting ones belong to the scratch() block around the innermost, if any."""
    path = f"{shared_dir(spark)}/tracewell-{name}-{uuid.uuid4().hex}"
    open_ = _SCOPES.get()[:-1] if lasting else _SCOPES.get()
    if open_:
        open_[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were written in it, but for lasting ones.

    A frame that reads them must be used up inside.
    """
    paths: list[str] = []
    before = _SCOPES.set((*_SCOPES.get(), paths))
    try:
        yield
    finally:
        _SCOPES.reset(before)
        for path in paths:
            delete(spark, path)


def materialized(df: DataFrame, name: str, lasting: bool = False, compression: str = "zstd") -> DataFrame:
    """df written to the shared folder and read again.

    The files outlive executors, so that no later stage has to redo the work before it.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name, lasting)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """df sorted over range partitions, with _at: partition in the upper bits, row in it in the lower 33.

    Spark joins small neighbouring ranges, so that their number follows the data.
    """
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """Adds n, from 1, in order: the row in its range partition and the counts of the partitions before."""
    part = F.shiftright("_at", 33).alias("_range")
    rows = materialized(in_ranges(df, *order), "ranges").withColumn("_range", part)
    # One row for each partition.
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_before"))
    return rows.join(F.broadcast(before), "_range").withColumn("n", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_range", "_before", "_at")


def running_total(df: DataFrame, value: Column, group: str, *order: str) -> DataFrame:
    """Adds total, the sum of value over the rows of the group up to this one, null-safe in group.

    Within range partitions, and from the sums of the partitions before, so that no task holds a group.
    """
    rows = materialized(in_ranges(df.withColumn("_value", value), group, *order), "ranges").withColumn("_range", F.shiftright("_at", 33))
    sums = rows.groupBy("_range", group).agg(F.sum("_value").alias("_sum"))
    before = sums.select(F.col("_range").alias("_r"), F.col(group).alias("_g"), (F.sum("_sum").over(Window.partitionBy(group).orderBy("_range")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy("_range", group).orderBy("_at"))
    joined = rows.withColumn("_inside", inside).join(before, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("total", F.col("_before") + F.col("_inside")).drop("_value", "_range", "_at", "_inside", "_before", "_r", "_g")


#: A key with more than a HEAVY-th of all rows is heavy; there are fewer than HEAVY of them.
HEAVY = 1000


def spread_join(few: DataFrame, many: DataFrame, on: list[str]) -> DataFrame:
    """few.join(many, on), where one key may have a large part of the rows of many.

    Keys of at least a HEAVY-th of the rows are found by count. Each is dealt over as many keys as its
    share of the partitions, and its rows in few are copied to all of them. many is read twice and should
    be a written table.
    """
    spark = many.sparkSession
    total = many.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = many.withColumn("_key", F.xxhash64(*on))
    counts = hashed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * HEAVY > total)
    heavy = counts.where(F.col("_n") * parts > total).select("_key", F.ceil(F.col("_n") * parts / total).cast("int").alias("_copies")).collect()
    if not heavy:
        return few.join(many, on)
    copies = F.broadcast(spark.createDataFrame(heavy, "_key long, _copies int"))
    salt = F.pmod(F.xxhash64(*many.columns), F.coalesce("_copies", F.lit(1)))
    dealt = hashed.join(copies, "_key", "left").withColumn("_salt", salt).drop("_key", "_copies")
    copied = few.withColumn("_key", F.xxhash64(*on)).join(copies, "_key", "left")
    copied = copied.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("_copies", F.lit(1)) - 1).cast("long")))).drop("_key", "_copies")
    return copied.join(dealt, [*on, "_salt"]).drop("_salt")
