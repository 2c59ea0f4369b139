"""Quality classifier: logistic regression on hashed word n-grams, trained by
follow-the-regularised-leader updates and scored as sparse dot products.

N-grams of one and two words are taken over the words as they are and over their shapes (runs of
small letters, capitals, digits and each mark), so that forms of junk are known whatever the word;
a word that repeats the one before it counts as a shape of its own. A value is the root of the
n-gram's share, so that rows have length one.

Training takes at most SAMPLE labelled documents, one row for each doc_id, and each of SHARDS tasks
its own part of them.

Defined cases: null and empty texts have no n-grams and get the score of the bias; without labels
every score is 0.5; rows without doc_id are neither held out nor learned from; of several labels of
a document the smallest counts, and of several texts the least; very long texts are counted whole, by
one task each; repeated rows get equal scores and are learned from once; an empty table gives an
empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import buffers, row_chunks, written
from tracewell.llm.ftrl import train
from tracewell.llm.wordhash import mix, word_hashes, word_spans

BITS = 18
SAMPLE = 8000
SHARDS = 6
EPOCHS = 4
THRESHOLD = 0.3

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0x80:] = ord("a")
_REPEAT = np.uint64(0x5EED)


def rows_of(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and values of each row; the last bucket is the bias."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    shape = _SHAPE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    forms = word_hashes(shape[keep], upto[starts], upto[ends])
    again = np.zeros(len(words), bool)
    again[1:] = words[1:] == words[:-1]
    with np.errstate(over="ignore"):
        forms = np.where(again, _REPEAT, forms) + np.uint64(1)
        shift = np.uint64(64 - bits)
        singles = [mix(words * np.uint64(3)) >> shift, mix(forms * np.uint64(5)) >> shift]
        pairs = [mix(x[:-1] * np.uint64(7) + x[1:] * np.uint64(k)) >> shift for x, k in ((words, 11), (forms, 13))]
    bias = np.int64((1 << bits) - 1)
    for a, b in zip(first[:-1], first[1:]):
        found = np.concatenate([s[a:b] for s in singles] + [p[a : max(b - 1, a)] for p in pairs]).astype(np.int64)
        at, count = np.unique(found, return_counts=True)
        if len(at) and at[-1] == bias:
            at, count = at[:-1], count[:-1]
        yield np.append(at, bias), np.append(np.sqrt(count / max(len(found), 1)), 1.0)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    data, offsets = buffers(batch.column("text"))
    for a, b in row_chunks(offsets):
        yield a, b, list(rows_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by bucket, from labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("target")).withColumn("rank", F.xxhash64("doc_id", F.lit(1)))
    # At most sample rows of three numbers, whatever the size of labels.
    drawn = F.broadcast(written(known.orderBy("rank").limit(sample), "quality-sample"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, rows in _chunks(batch):
                lists = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays([batch.column("rank")[a:b], batch.column("target")[a:b], *lists], ["rank", "target", "at", "values"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(drawn, "doc_id").groupBy("rank", "target").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(vectors, "rank long, target int, at array<long>, values array<double>")
    rows = written(rows.withColumn("shard", F.pmod("rank", F.lit(shards)).cast("int")), "quality-rows")
    return train(rows, 1 << BITS, 1, epochs, alpha=1.0, l1=1e-3, l2=1e-3)[:, 0]


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for a, b, rows in _chunks(batch):
                z = np.array([float(w[at] @ values) for at, values in rows])
                p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("held_out")[a:b], pa.array(p), pa.array((p >= threshold).astype("int32"))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return plain.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
