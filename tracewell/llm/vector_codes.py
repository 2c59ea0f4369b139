"""Operator 11: product codes of vectors, with nearest entries found by a vector approximation file (VA-file).

A vector is cut into parts, and each part is coded by the number of the nearest entry of its position's
codebook. Entries are approximated: each coordinate lies in one of a few cells, so an entry is a short
row of cell numbers. For a part, the squared distances to the near and the far edge of each cell, by
coordinate, are two small tables; sums of looked up values bound the distance of every entry from below
and from above. Only entries whose lower bound does not exceed the least upper bound are refined by the
distance itself, in integers, so the filter never changes a result.

Codebooks are learned by rounds of assignment and exact integer means. A round is one pass over the
vectors; a task returns sums by part and entry, whose number is fixed, and Spark adds them up.

Defined cases: rows whose vector is null, empty, or holds null or non-finite components are dropped, and
so are vectors whose length isn't a multiple of the parts, is not that of the vector with the smallest
vec_id, or that have a component beyond which distances don't fit 64 bits (for 64 components, some 45,000
in size). Rows without vec_id are coded but start no codebook as long as there are enough others. Repeated
rows count each; ties in vec_id go by the vector. With fewer vectors than entries, codebooks are as short.
An empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Cells of a coordinate: 2 to the power of this.
CELL_BITS = 3
#: Parts that are worked on at a time.
BLOCK = 1 << 14
#: A label with more than a HEAVY-th of all rows is heavy; there are at most HEAVY such labels.
HEAVY = 10_000


class VaFile:
    """The entries of one codebook as rows of cell numbers, and the nearest of them for many parts."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        self.entries = entries.astype(np.int64)
        low, high = self.entries.min(axis=0), self.entries.max(axis=0)
        # Edges at even steps of a coordinate's range. The outer cells end at its least and greatest value.
        steps = np.arange((1 << bits) + 1)
        self.edges = low[:, None] + (high - low)[:, None] * steps // (1 << bits)
        inner = self.edges[:, 1:-1]
        self.cells = np.stack([np.searchsorted(inner[d], self.entries[:, d], "right") for d in range(inner.shape[0])], axis=1)
        self.refined = 0

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each part to each entry."""
        low = np.zeros((len(parts), len(self.entries)), np.int64)
        high = np.zeros_like(low)
        for d, edges in enumerate(self.edges):
            x = parts[:, d, None]
            left, right = edges[None, :-1] - x, x - edges[None, 1:]
            near = np.maximum(np.maximum(left, right), 0)
            far = np.maximum(np.abs(left), np.abs(right))
            low += (near * near)[:, self.cells[:, d]]
            high += (far * far)[:, self.cells[:, d]]
        return low, high

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest entry of each part, the lower one of equally near ones, and its squared distance."""
        which, distance = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        for at in range(0, len(parts), BLOCK):
            block = parts[at : at + BLOCK]
            low, high = self.bounds(block)
            row, entry = np.nonzero(low <= high.min(axis=1)[:, None])
            self.refined += len(row)
            gap = block[row] - self.entries[entry]
            exact = np.full(low.shape, np.iinfo(np.int64).max)
            exact[row, entry] = np.einsum("ij,ij->i", gap, gap)
            which[at : at + BLOCK] = exact.argmin(axis=1)
            distance[at : at + BLOCK] = exact.min(axis=1)
        return which, distance


def component_limit(size: int) -> int:
    """Components up to this size keep the distance of two vectors within 63 bits."""
    return int((2**63 / (4 * size)) ** 0.5) - 1


def kept_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, the integer components, of the rows of vectors(vec_id, embedding, label) that are coded."""
    component = lambda x: x.cast("double")
    odd = lambda x: x.isNull() | F.isnan(component(x)) | (F.abs(component(x)) > 1e12)
    whole = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & ~F.exists("embedding", odd))
    cut = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.transform("embedding", lambda x: F.floor(component(x) * scale).cast("long")).alias("v"))
    cut = written(cut, "vectors")
    first = cut.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    if first is None:
        return cut
    limit = component_limit(first[0])
    return cut.where((F.size("v") == first[0]) & ~F.exists("v", lambda x: F.abs(x) > limit))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _sums(kept: DataFrame, books: np.ndarray) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Number and componentwise sums of the parts nearest to each entry, by part and entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(book) for book in books]
        total = np.zeros((parts, entries, width), object)
        count = np.zeros((parts, entries), np.int64)
        for batch in batches:
            v = _matrix(batch.column("v"), parts * width)
            for p, file in enumerate(files):
                part = v[:, p * width : (p + 1) * width]
                which, _ = file.nearest(part)
                count[p] += np.bincount(which, minlength=entries)
                order = np.argsort(which, kind="stable")
                starts = np.flatnonzero(np.diff(which[order], prepend=-1))
                if len(starts):
                    total[p, which[order][starts]] += np.add.reduceat(part[order], starts, axis=0)
        p, e = np.nonzero(count)
        sums = pa.array([[str(x) for x in row] for row in total[p, e].tolist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), sums], ["part", "entry", "n", "sums"])

    found = kept.select("v").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    spread = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "sum"))
    added = spread.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"))
    out: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in added.collect():
        out.setdefault((r.part, r.entry), (r.n, [0] * width))[1][r.place] = int(r.sum)
    return out


def fit_codebooks(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, component) after rounds of assignment and means; None without vectors.

    They start as the parts of the first vectors by vec_id. An entry that no part is nearest to stays.
    What comes to the driver are the sums of parts x entries x components, whatever the number of vectors.
    """
    first = [r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
    if not first:
        return None
    books = np.array(first, np.int64).reshape(len(first), parts, -1).swapaxes(0, 1).copy()
    for _ in range(rounds):
        for (p, e), (n, sums) in _sums(kept, books).items():
            books[p, e] = [s // n for s in sums]
    return books


def encoded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""
    parts, entries, width = books.shape
    hexes = np.array([f"{i:02x}" for i in range(entries)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VaFile(book) for book in books]
        for batch in batches:
            v = _matrix(batch.column("v"), parts * width)
            found = [file.nearest(v[:, p * width : (p + 1) * width]) for p, file in enumerate(files)]
            code = np.zeros(len(v), "U0")
            for which, _ in found:
                code = np.char.add(code, hexes[which])
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds label_error, the sum of error over the rows of a label; nulls are one label.

    Rows of heavy labels look their sum up in a broadcast table, of at most HEAVY rows by definition; the
    others are joined on the label, of which no key then holds more than a HEAVY-th of the rows.
    """
    rows = written(coded, "coded")
    n = rows.count()
    sums = written(rows.groupBy(F.col("label").alias("_label")).agg(F.count(F.lit(1)).alias("_n"), F.sum("error").alias("label_error")), "label-sums")
    heavy = sums.where(F.col("_n") * HEAVY > n).drop("_n")
    same = F.col("label").eqNullSafe(F.col("_label"))
    found = rows.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), same, "left").drop("_label")
    rest = found.where("_heavy IS NULL").drop("label_error").join(sums.where(F.col("_n") * HEAVY <= n), same)
    keep = [*coded.columns, "label_error"]
    return found.where("_heavy").select(keep).unionByName(rest.select(keep))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    books = fit_codebooks(kept)
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = with_label_error(encoded(kept, books))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    width = "(len(v) // 8)"
    vector = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pt AS MATERIALIZED (SELECT vec_id, label, p, v[p * {width} + 1 : (p + 1) * {width}] AS x FROM k, range(8) r(p)),
b0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::INT AS e, x AS c FROM pt WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 16))"""
    steps = []
    for i in range(7):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, label, pt.p, min_by(e, (d, e)) AS e, min(d) AS d, any_value(x) AS x FROM (SELECT pt.*, b.e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM pt JOIN b{i} b USING (p)) pt GROUP BY vec_id, label, p)""")
        if i < 6:
            steps.append(f"""m{i} AS (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM a{i}) GROUP BY p, e, i),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN (SELECT p, e, list(CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END ORDER BY i) AS c FROM m{i} GROUP BY p, e) m USING (p, e))""")
    return vector + ",\n" + ",\n".join(steps) + """,
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a6 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b6) AS codebooks_sha256 FROM r"""


ORACLE_SQL = _oracle()
