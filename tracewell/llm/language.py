"""Language identification: TF-IDF over hashed character n-grams, sparse multinomial logistic
regression trained by follow-the-regularised-leader with elastic-net penalties, and a temperature
fitted on rows that training did not see.

Document frequencies count all learnable documents. The regression learns from a sample of at most
SAMPLE distinct texts, and each of SHARDS tasks from its own part of it; copies of a text count once
there, however many there are.

Defined cases: null text and text without a letter (as str.isalpha() has it) are "und" with score 0,
as is everything if there is nothing to learn from; very long texts are counted whole, by one task
each, in memory of a few times the text; rows without doc_id are neither held out nor learned from;
repeated rows get equal predictions and do not crowd out others of the sample; an empty table gives
an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import written
from tracewell.llm.ftrl import train

BITS = 15
ORDERS = 3
SAMPLE = 6000
SHARDS = 6
EPOCHS = 2
UNKNOWN = "und"
_HASH = (2654435761, 2246822519, 3266489917)


def ngram_counts(text: str, bits: int = BITS, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's n-grams, case folded, from 1 to orders characters, and how often each occurs."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.zeros(len(points), np.uint32)
    found = [np.zeros(0, np.uint32)]
    for k in range(orders):
        if len(points) <= k:
            break
        code = (code[: len(points) - k] * np.uint32(_HASH[0])) ^ (points[k:] * np.uint32(_HASH[1]))
        found.append((code + np.uint32(k)) * np.uint32(_HASH[2]) >> np.uint32(32 - bits))
    buckets = np.concatenate(found)
    if len(buckets) * 8 < 1 << bits:
        return np.unique(buckets, return_counts=True)
    counts = np.bincount(buckets, minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, n = ngram_counts(text)
        x = n * self.idf[at]
        return (x @ self.weights[at]) / (np.sqrt(x @ x) or 1.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        e = np.exp(z - z.max())
        k = int(e.argmax())
        return self.languages[k], float(e[k] / e.sum())


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of the least log loss, by narrowing a range of exponents."""
    if not len(target):
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(target)), target]).mean()) + 1e-4 * np.log(t) ** 2

    low, high = -4.0, 4.0
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, epochs: int = EPOCHS) -> Model:
    """Learns from text and non-null lang of documents that are not held out."""
    spark = docs.sparkSession
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    usable = usable.where(~held_out())

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = np.zeros(1 << BITS, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                seen[ngram_counts(text)[0]] += 1
            rows += len(pdf)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"at": np.append(at, -1).astype("int32"), "n": np.append(seen[at], rows)})

    counts = usable.select("text").mapInPandas(frequencies, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    rows = int(counts.loc[counts["at"] == -1, "n"].sum())
    idf = np.zeros(1 << BITS)
    counts = counts[counts["at"] >= 0]
    idf[counts["at"].to_numpy()] = np.log((1 + rows) / (1 + counts["n"].to_numpy())) + 1
    # Equal texts of a language have equal ranks, so a rank stands for all copies of a text.
    rank = F.xxhash64("text", "lang", F.lit(1))
    facts = usable.agg(F.collect_set("lang").alias("languages"), F.approx_count_distinct(rank, 0.02).alias("texts")).first()
    languages = sorted(facts["languages"])
    if not languages:
        return Model([], idf, np.zeros((1 << BITS, 0)))
    number = {name: k for k, name in enumerate(languages)}
    share = spark.sparkContext.broadcast((idf, number))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, number = share.value
        for pdf in batches:
            out = {"target": [], "at": [], "values": []}
            for text, lang in zip(pdf["text"], pdf["lang"]):
                at, n = ngram_counts(text)
                x = n * idf[at]
                out["target"].append(number[lang])
                out["at"].append(at.astype("int32"))
                out["values"].append((x / (np.sqrt(x @ x) or 1.0)).astype("float32"))
            yield pd.DataFrame({"rank": pdf["rank"], **out})

    part = min(1.0, 1.5 * sample / facts["texts"])
    near = usable.withColumn("rank", rank).where(F.pmod("rank", F.lit(1 << 30)) < int(part * (1 << 30)))
    # Ranks are chosen before texts and vectors are made: at most sample numbers.
    ranks = F.broadcast(written(near.select("rank").distinct().orderBy("rank").limit(sample), "language-sample"))
    texts = near.join(ranks, "rank").groupBy("rank").agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
    drawn = texts.select("rank", "text", "lang").mapInPandas(vectors, "rank long, target int, at array<int>, values array<float>")
    drawn = written(drawn.withColumn("shard", F.pmod("rank", F.lit(shards + 1)).cast("int")), "language-rows")
    weights = train(drawn.where(F.col("shard") < shards), 1 << BITS, len(languages), epochs, alpha=2.0, l1=1e-3, l2=1e-3)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = [np.asarray(v, float) @ weights[np.asarray(a)] for a, v in zip(pdf["at"], pdf["values"])]
            yield pd.DataFrame({"target": pdf["target"], "z": z})

    rest = drawn.where(F.col("shard") == shards).select("target", "at", "values").mapInPandas(held, "target int, z array<double>").toPandas()
    heat = temperature(np.array(rest["z"].tolist()), rest["target"].to_numpy()) if len(rest) else 1.0
    return Model(languages, idf, weights, heat)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            found = [own.predict(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return plain.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
