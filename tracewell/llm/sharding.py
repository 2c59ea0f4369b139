"""Sharding by a keyed permutation of row numbers.

Every row gets a global number from 0; a Feistel network over the next power of four, walked along
its cycle until it lands below the row count, permutes the numbers. Position p means shard
p mod shards and slot p div shards, so a row's place is computable from its number and a number
from a place, with no table of the shuffle.

Defined cases: null text has no bytes (size 1, CRC of nothing); null doc_id rows are numbered like
others; repeated rows are interchangeable and each gets a number of its own, in parts where they are
many; of a very long text only size and CRC are shuffled; an empty table gives an empty result; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import written
from tracewell.llm.numbering import number_rows

SHARDS = 8
ROUNDS = 6
SEED = 2024


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(0, 1 << 63, ROUNDS)]


def permute(rows: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at the given numbers."""
    half = max(1, math.ceil(max(n - 1, 1).bit_length() / 2))
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _keys(seed)
    out = np.asarray(rows).astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            x = out[todo]
            left, right = x >> shift, x & low
            for key in reversed(keys) if inverse else keys:
                if inverse:
                    left, right = right ^ (_round(left, key) & low), left
                else:
                    left, right = right, left ^ (_round(right, key) & low)
            x = (left << shift) | right
            out[todo] = x
            todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def place_of(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    return int(permute(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def position_column(row: Column, n: int, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return position(row)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row, position, shard, slot of every document; only ids and digests are shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    keys = written(keys, "shard-keys")
    n = keys.count()
    numbered = number_rows(keys, ["doc_id", "text_crc32", "size"])
    return (
        numbered.withColumn("position", position_column(F.col("row"), n, seed))
        .withColumn("shard", (F.col("position") % shards).cast("int"))
        .withColumn("slot", F.floor(F.col("position") / shards).cast("long"))
    )


def op8_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row", "position"
    )
