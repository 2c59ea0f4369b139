"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey of customer, dealt over all cores.

    A row becomes several lines that patterns run on, while the file is so small that a million rows are read by one task.
    """
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return keys.repartition(2 * spark.sparkContext.defaultParallelism, "c_custkey")


def dealt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of documents, dealt over at least all cores, as one task may read a whole small table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.repartition(max(2 * spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()), "doc_id")


def doc_path() -> Column:
    return F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(doc_path().alias("path"), "text")


def _digits(value: Column, width: int) -> Column:
    return F.lpad((value % 10**width).cast("string"), width, "0")


def synthetic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six lines for each customer with values of every kind, some of them invalid; integer arithmetic only."""
    k = F.col("c_custkey").cast("long")
    word = lambda s: F.lit(s)
    texts = F.array(
        F.concat(word("tel +81 090-"), _digits(k, 4), word("-"), _digits(k * 7, 4)),
        F.concat(word("card 4111 "), _digits(k, 4), word(" "), _digits(k * 3, 4), word(" "), _digits(k * 11, 4)),
        F.concat(word("個人番号 "), _digits(k * 37, 4), word(" "), _digits(k * 5, 4), word(" "), _digits(k * 13, 4)),
        F.concat(word("普通預金 "), _digits(k * 13, 7)),
        F.concat(word("〒"), _digits(k, 3), word("-"), _digits(k * 17, 4), word(" 東京都千代田区"), (k % 30 + 1).cast("string"), word("丁目"), (k % 9 + 1).cast("string"), word(" 棟")),
        F.concat(word("mail User"), (k % 500).cast("string"), word("@corp"), (k % 7).cast("string"), F.when(k % 10 == 3, ".example.com").otherwise(".jp"), word(" end")),
    )
    rows = customers(spark, sf_dir).select(F.concat(word("cust/"), k.cast("string"), word(".csv")).alias("path"), F.posexplode(texts).alias("_i", "text"))
    return rows.select("path", F.lit(None).cast("int").alias("page"), (F.col("_i") + 1).alias("line"), F.lit("text").alias("kind"), "text")


#: The same in SQL: CTEs lines (of documents) and synth.
SQL_LINES = r"""
l0 AS (SELECT 'doc/' || doc_id || '.txt' AS path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
lines AS (SELECT path, line, text FROM l0 WHERE NOT regexp_matches(text, '^\s*$'))"""
SQL_SYNTH = r"""
s0 AS (SELECT c_custkey::BIGINT AS k, 'cust/' || c_custkey || '.csv' AS path FROM customer),
s1 AS (SELECT path, [
  'tel +81 090-' || lpad((k % 10000)::varchar, 4, '0') || '-' || lpad((k * 7 % 10000)::varchar, 4, '0'),
  'card 4111 ' || lpad((k % 10000)::varchar, 4, '0') || ' ' || lpad((k * 3 % 10000)::varchar, 4, '0') || ' ' || lpad((k * 11 % 10000)::varchar, 4, '0'),
  '個人番号 ' || lpad((k * 37 % 10000)::varchar, 4, '0') || ' ' || lpad((k * 5 % 10000)::varchar, 4, '0') || ' ' || lpad((k * 13 % 10000)::varchar, 4, '0'),
  '普通預金 ' || lpad((k * 13 % 10000000)::varchar, 7, '0'),
  '〒' || lpad((k % 1000)::varchar, 3, '0') || '-' || lpad((k * 17 % 10000)::varchar, 4, '0') || ' 東京都千代田区' || (k % 30 + 1) || '丁目' || (k % 9 + 1) || ' 棟',
  'mail User' || (k % 500) || '@corp' || (k % 7) || CASE WHEN k % 10 = 3 THEN '.example.com' ELSE '.jp' END || ' end'] AS t FROM s0),
synth AS (SELECT path, unnest(t) AS text, generate_subscripts(t, 1) AS line FROM s1)"""
