"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import written

#: Links of a node that meet one copy of its label.
NODE_LINKS = 100_000


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of links(a, b).

    Each round a node takes the smallest label of its neighbours and then that label's own label,
    so that a chain of n links needs about log n rounds. Only links and labels are shuffled, and
    each round's labels are a written table. The label of a node with very many links is copied, so
    that its links are spread over tasks.
    """
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
    both = written(both, "links")
    copies = F.ceil(F.count(F.lit(1)) / NODE_LINKS)
    heavy = written(both.groupBy("b").agg(copies.alias("copies")).where("copies > 1"), "heavy-nodes")
    spread = not heavy.isEmpty()
    if spread:
        dealt = both.join(heavy, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), F.coalesce("copies", F.lit(1).cast("long"))))
        both = written(dealt.drop("copies"), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    if labels.isEmpty():
        return labels
    while True:
        known = labels.select(F.col("node").alias("b"), "component")
        if spread:
            known = known.join(heavy, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1)))
        met = both.join(known, ["b", "salt"] if spread else "b")
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("_near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_near").alias("_new"))
        jump = labels.select(F.col("node").alias("_new"), F.col("component").alias("_next"))
        moved = written(step.join(jump, "_new", "left").select("node", "_old", F.least("_new", F.coalesce("_next", "_new")).alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.where("component != _old").isEmpty():
            return spark.createDataFrame([], labels.schema).union(labels)
