"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents and gaps are sorted by size and matched by sweeps. Documents of one length are
interchangeable, as are gaps of one size, so the sweeps go over runs (size, count, first number),
at most one for each length a document can have and one for each stretch of like gaps, whatever
the number of documents; only the rank of a document within its length is a pass over all of them.

A round:
1. Documents and gaps are dealt into RANGES ranges of sizes. In each range, a task of its own, a sweep
   from the largest size down gives each document its successor, the smallest gap at least as large.
   Where several documents want a gap, rank decides: the larger document, then the lower number.
2. What a document leaves of a gap is a gap again, in the same sweep where its size is still ahead.
3. Documents without a gap and gaps without a document go on to the sweep of FAN neighbouring ranges
   together, and so on up to all ranges. So a document takes a gap of its own range before a tighter one that
   another document of the range leaves in a lower one: placements differ from those of one sweep over
   everything, tightness hardly does (both are tested). The last sweep is over all that is left, so after a
   round no document that still seeks a gap fits into one that was there before sequences are opened.
4. Documents that found no gap open sequences, the largest first: all above half a sequence, else as
   many sequences as the total of the others needs. Their gaps and the other documents go into the next
   round.

Bounds: a step of a sweep uses up a run of documents or a run of gaps, and only the former splits a
run of gaps. So there are never more stretches of gaps than runs of documents and openings, at most
about twice the capacity, for any number of documents, rounds and ranges.

Defined cases: null text is empty and has only the end id; only documents longer than a sequence
are cut, into full sequences after a first piece that may be shorter; a very long text is encoded by
one task, in memory of a few times the text; repeated rows are packed as often as they occur; an
empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import give_back, scratch, written
from tracewell.llm.numbering import number_rows
from tracewell.llm.token_files import default_tokenizer
from tracewell.llm.tokens import crc32_of, encoder

CAPACITY = 2048
#: Rows of placements up to which they are broadcast; they depend on CAPACITY, not on the documents.
BROADCAST_ROWS = 1_000_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for a, b, ids, firsts in encode.texts(batch.column("text")):
                n = np.diff(firsts)
                count = -(-n // capacity)
                row = np.repeat(np.arange(b - a), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                lead = n - (count - 1) * capacity
                start = np.where(piece > 0, lead[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, lead[row])
                at = firsts[row] + start
                crcs = [crc32_of(ids[i : i + k]) for i, k in zip(at, length)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
                del ids
        # In the pipeline the next stage begins while the worker still waits.
        encode.forget()
        give_back()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


#: kind doc: n documents of a size, numbered from at. kind gap: n sequences with a room of that size from
#: bin on. kind put: the documents numbered from at go to the sequences from bin on, at offset.
_STATE = "kind string, size long, n long, at long, bin long, offset long, cell int"
RANGES = 16
FAN = 4

Run = tuple[str, int, int, int, int, int]


def sweep(runs: Iterable[Run], capacity: int) -> list[Run]:
    """Matches documents with gaps, from the largest size down; returns placements and what is left of both."""
    order = lambda kind, size, n, at, bin, offset: (-size, kind == "doc", at, bin, n)
    ahead = [(order(*r), r) for r in runs if r[0] != "put"]
    heapq.heapify(ahead)
    out = [r for r in runs if r[0] == "put"]
    gaps: list[tuple[int, int, int]] = []
    while ahead:
        kind, size, n, at, bin, _ = heapq.heappop(ahead)[1]
        if kind == "gap":
            gaps.append((size, n, bin))
        elif not gaps:
            out.append(("doc", size, n, at, 0, 0))
        else:
            room, held, first = gaps.pop()
            k = min(n, held)
            out.append(("put", size, k, at, first, capacity - room))
            rest = [("gap", room - size, k, 0, first, 0)] if room > size else []
            if held > k:
                gaps.append((room, held - k, first + k))
            if n > k:
                rest.append(("doc", size, n - k, at + k, 0, 0))
            for r in rest:
                heapq.heappush(ahead, (order(*r), r))
    return out + [("gap", size, n, 0, bin, 0) for size, n, bin in gaps]


def opened(runs: list[Run], bins: int, capacity: int) -> list[Run]:
    """Opens sequences, numbered from bins on, for the largest of the documents that found no gap."""
    docs = sorted((r for r in runs if r[0] == "doc"), key=lambda r: (-r[1], r[3]))
    out = [r for r in runs if r[0] != "doc"]
    large = sum(n for _, size, n, *_ in docs if 2 * size > capacity)
    need = large or -(-sum(size * n for _, size, n, *_ in docs) // capacity)
    for _, size, n, at, _, _ in docs:
        k = min(n, need)
        if k:
            out.append(("put", size, k, at, bins, 0))
            if size < capacity:
                out.append(("gap", capacity - size, k, 0, bins, 0))
        if n > k:
            out.append(("doc", size, n - k, at + k, 0, 0))
        need, bins = need - k, bins + k
    return out


def _swept(state: DataFrame, group: Column, capacity: int, bins: int | None = None) -> DataFrame:
    """A sweep for each group of ranges; with bins, the last one, documents without a gap open sequences."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = sweep(list(pdf[["kind", "size", "n", "at", "bin", "offset"]].itertuples(index=False, name=None)), capacity)
        if bins is not None:
            runs = opened(runs, bins, capacity)
        out = pd.DataFrame(runs, columns=["kind", "size", "n", "at", "bin", "offset"])
        out["cell"] = ((out["size"] - 1) * RANGES // capacity).astype("int32")
        return out

    return state.groupBy(group.alias("_group")).applyInPandas(run, _STATE)


def best_fit(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Placements for lengths(length, n): the rows of kind put. No pass over documents."""
    spark = lengths.sparkSession
    zero = F.lit(0).cast("long")
    cell = F.floor((F.col("length") - 1) * RANGES / capacity).cast("int")
    state = written(lengths.select(F.lit("doc").alias("kind"), F.col("length").alias("size"), "n", zero.alias("at"), zero.alias("bin"), zero.alias("offset"), cell.alias("cell")), "packing")
    puts, bins = [], 0
    facts = [F.count_if(F.col("kind") == "doc").alias("docs"), F.max(F.when(F.col("kind") == "put", F.col("bin") + F.col("n"))).alias("bins")]
    now = state.agg(*facts).first()
    while now["docs"]:
        ranges, step = state.where("kind != 'put'"), 1
        while step < RANGES:
            ranges = _swept(ranges, F.floor(F.col("cell") / step), capacity)
            step *= FAN
        state = written(_swept(ranges, F.lit(0), capacity, bins), "packing-round")
        puts.append(state.where("kind = 'put'"))
        now = state.agg(*facts).first()
        bins = max(bins, now["bins"] or 0)
    return functools.reduce(DataFrame.union, puts, state.where("kind = 'put'").limit(0))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    cut = written(pieces(docs, tokenizer, capacity), "pieces")
    ranked = number_rows(cut, ["doc_id", "piece", "start", "ids_crc32"], within="length")
    lengths = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    with scratch(docs.sparkSession):
        puts = best_fit(lengths, capacity).select("size", "at", (F.col("at") + F.col("n")).alias("upto"), "bin", "offset")
        puts = written(puts.coalesce(1), "placements", lasting=True)
    if puts.count() <= BROADCAST_ROWS:
        puts = F.broadcast(puts)
    found = ranked.join(puts, (F.col("length") == F.col("size")) & (F.col("row") >= F.col("at")) & (F.col("row") < F.col("upto")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("bin") + F.col("row") - F.col("at")).alias("sequence_id"), "offset")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
