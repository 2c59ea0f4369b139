"""Operator 12: how the words of a source differ from those of the other sources and of its language.

Integer-dictionary encoding: the kept terms of a language are sorted arrays, cut into chunks. A term's
number is found by searchsorted in its chunk, occurrences are added by bincount, and a (language, source)
group is a dense vector over each chunk. As numbers follow the UTF-8 order of the terms, ties go by number.

1. Terms are counted by (lang, source) over whole texts: a task cuts a stretch of texts in numpy and sends
   one row for each term and group of it, Spark adds up.
2. The counts are sorted by (lang, term) over range partitions. A task reads its range in order, keeps
   the terms that enough documents have, and closes a chunk whenever it is full. A term's rows are one for
   each source, so a chunk is bounded; it gets shorter as a language has more sources.
3. Each group meets each chunk of its language, also those it has no term of. Per chunk, shares and
   divergences are whole-number matrices; a chunk returns a sum for each pair of sources, which the result
   needs anyway, and each source's first terms, and Spark adds and ranks them.

All arithmetic is exact: shares come from long division in 64 bits, as good as up to 9e15 occurrences.

Defined cases: null text, lang or source is the empty string. A group without kept terms has the shares
that counts of 0 give; a language without kept terms gives pairs of value 0. A source alone in its language
has no pairs. Repeated rows count each. An empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import buffers, row_chunks, written
from tracewell.llm.wordhash import LOWER

LEAST_DOCUMENTS = 10
SHARE = 1_000_000_000
TOP_TERMS = 10
#: Terms of a chunk times sources of a language: what a task holds of dense counts.
CHUNK_CELLS = 1 << 20
CHUNK_TERMS = 4096
#: Bytes of text that are counted together.
STRETCH_BYTES = 4 << 20
#: Rows of counts that are made into chunks together, if a term has no more.
STRETCH_ROWS = 1 << 16
#: Bytes that a term is made of: letters of ASCII, and all bytes of other characters.
IN_TERM = np.zeros(256, bool)
IN_TERM[ord("A") : ord("Z") + 1] = IN_TERM[ord("a") : ord("z") + 1] = IN_TERM[0x80:] = True

_COUNTS = ["lang", "source", "term", "n", "docs"]


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct terms of rows of UTF-8 bytes, and (row, term, occurrences) of each that a row has."""
    inside = IN_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))) if len(data) else np.zeros(0, np.int64)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros((0, 3), np.int64)
    letters = np.concatenate(([0], np.cumsum(inside)))
    ends = np.append(letters[starts], letters[-1]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(LOWER[data[inside]].tobytes()))
    coded = words.dictionary_encode()
    rows = np.searchsorted(offsets, starts, "right") - 1
    size = len(coded.dictionary)
    key, n = np.unique(rows * size + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary, np.stack([key // size, key % size, n], axis=1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        names: dict[tuple[str, str], int] = {}
        group = np.array([names.setdefault((g["lang"], g["source"]), len(names)) for g in groups.to_pylist()], np.int64)
        langs, sources = pa.array([k[0] for k in names], pa.string()), pa.array([k[1] for k in names], pa.string())
        data, offsets = buffers(batch.column("text"))
        for a, b in row_chunks(offsets, STRETCH_BYTES):
            terms, found = terms_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if not len(found):
                continue
            key, place = np.unique(group[a:b][found[:, 0]] * len(terms) + found[:, 1], return_inverse=True)
            g, t = pa.array(key // len(terms)), pa.array(key % len(terms))
            n, docs = np.bincount(place, found[:, 2]).astype(np.int64), np.bincount(place)
            yield pa.RecordBatch.from_arrays([langs.take(g), sources.take(g), terms.take(t), pa.array(n), pa.array(docs)], _COUNTS)


def term_counts(docs: DataFrame) -> DataFrame:
    """n occurrences and docs documents of each term by lang and source, of docs(lang, source, text) without nulls."""
    found = docs.select("lang", "source", "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chunks(counts: DataFrame, least: int, length: int) -> DataFrame:
    """Dictionary chunks and vectors over them: chunk, lang, source, terms, counts.

    For each chunk one row without source holds its sorted terms and their counts in the language, and
    each source with any of them has a row with its counts. Chunks are numbered in the order of terms.
    """
    order = ["lang", "term"]
    ranges = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = counts.repartitionByRange(ranges, *order).sortWithinPartitions(*order, "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        held: list[pa.Table] = []
        size = 0

        def close(table: pa.Table) -> Iterator[pa.RecordBatch]:
            """The chunks of one language each that a stretch of whole terms makes."""
            nonlocal number
            table = table.combine_chunks()
            for lang in table.column("lang").unique().to_pylist():
                rows = table.filter(pc.equal(table.column("lang"), lang))
                coded = rows.column("term").combine_chunks().dictionary_encode()
                # Rows are sorted, so first sights are in the order of UTF-8.
                at, docs, n = coded.indices.to_numpy(), rows.column("docs").to_numpy(), rows.column("n").to_numpy()
                kept = np.flatnonzero(np.bincount(at, docs) >= least)
                sources = rows.column("source").combine_chunks().dictionary_encode()
                who = sources.indices.to_numpy()
                for first in range(0, len(kept), length):
                    ids = kept[first : first + length]
                    place = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
                    mine = ids[place] == at
                    dense = np.bincount(who[mine] * len(ids) + place[mine], n[mine], minlength=len(sources.dictionary) * len(ids)).astype(np.int64).reshape(-1, len(ids))
                    some = np.flatnonzero(dense.any(axis=1))
                    vectors = [dense.sum(axis=0), *dense[some]]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number] * len(vectors)), pa.array([lang] * len(vectors), pa.string()), pa.array([None, *sources.dictionary.take(pa.array(some)).to_pylist()], pa.string()),
                        pa.array([coded.dictionary.take(pa.array(ids)).to_pylist()] + [None] * len(some), pa.list_(pa.string())), pa.array([v.tolist() for v in vectors], pa.list_(pa.int64())),
                    ], ["chunk", "lang", "source", "terms", "counts"])
                    number += 1

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            held.append(table)
            size += len(table)
            if size >= STRETCH_ROWS:
                # All but the last term, whose rows may go on.
                whole = pa.concat_tables(held)
                last = whole.slice(len(whole) - 1).to_pylist()[0]
                open_ = pc.and_(pc.equal(whole.column("term"), last["term"]), pc.equal(whole.column("lang"), last["lang"]))
                cut = len(whole) - int(pc.sum(open_).as_py())
                yield from close(whole.slice(0, cut))
                held, size = [whole.slice(cut)], len(whole) - cut
        if held:
            yield from close(pa.concat_tables(held))

    return ordered.select(*_COUNTS).mapInArrow(run, "chunk long, lang string, source string, terms array<string>, counts array<long>")


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SHARE * (count + 2) / (total + 2 * terms)), by long division in steps of a thousand."""
    below = total + 2 * terms
    rest = counts + 2
    out = rest // below
    rest = rest % below
    step = 1000
    for _ in range(3):
        out = out * step + rest * step // below
        rest = rest * step % below
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


def _compare(table: pa.Table) -> pa.Table:
    """Of the vectors of one chunk: partial sums by pair of sources, and the first terms of each source."""
    sources = table.column("source").to_pylist()
    own = sources.index(None)
    who = [i for i in range(len(sources)) if i != own]
    terms = table.column("terms")[own].as_py()
    dense = np.zeros((len(sources), len(terms)), np.int64)
    for i, counts in enumerate(table.column("counts")):
        if counts.is_valid:
            dense[i] = counts.values.to_numpy()
    share = shares(dense, table.column("total").to_numpy()[:, None], table.column("n_terms")[own].as_py())
    lang, chunk = table.column("lang")[0].as_py(), table.column("chunk")[0].as_py()
    out: dict[str, list] = {c: [] for c in ("lang", "source", "part", "item", "value", "chunk", "id")}

    def add(source: str, part: str, items: list[str], values: list[int], ids: list[int]) -> None:
        for name, column in zip(out, ([lang] * len(items), [source] * len(items), [part] * len(items), items, values, [chunk] * len(items), ids)):
            out[name] += column

    order = sorted(who, key=lambda i: sources[i].encode())
    names, sorted_ = [sources[i] for i in order], share[order]
    for at, i in enumerate(order):
        # Each pair once; the sum is the same for both.
        if at:
            add(sources[i], "pair", names[:at], divergence(sorted_[:at], share[i]).sum(axis=1).tolist(), [0] * at)
        more = np.flatnonzero((dense[i] > 0) & (share[i] > share[own]))
        f = divergence(share[i][more], share[own][more])
        best = np.lexsort((more, -f))[:TOP_TERMS]
        add(sources[i], "term", [terms[k] for k in more[best]], f[best].tolist(), more[best].tolist())
    kinds = {"value": pa.int64(), "chunk": pa.int64(), "id": pa.int32()}
    return pa.table({c: pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()})


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part, item, value and rank of docs(lang, source, text)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    plain = docs.select(blank("lang"), blank("source"), blank("text"))
    groups = written(plain.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents")), "groups")
    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    counts = written(term_counts(plain), "term-counts")
    vectors = written(chunks(counts, least, max(16, min(CHUNK_TERMS, CHUNK_CELLS // most))), "chunks")
    sums = F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))
    totals = written(vectors.groupBy("lang", "source").agg(sums.alias("total"), F.sum(F.size("terms")).alias("n_terms")), "totals")
    # A vector for each group and chunk; the language itself is the one without source.
    facts = totals.where("source IS NULL").select("lang", F.col("total").alias("lang_total"), "n_terms")
    own = totals.where("source IS NOT NULL").select("lang", "source", "total")
    members = groups.select("lang", "source").join(own, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    grid = vectors.where("source IS NULL").select("chunk", "lang").join(members, "lang")
    dense = grid.join(vectors.where("source IS NOT NULL").drop("terms"), ["chunk", "lang", "source"], "left").withColumn("terms", F.lit(None).cast("array<string>"))
    head = vectors.where("source IS NULL").join(facts, "lang").withColumnRenamed("lang_total", "total")
    columns = ["chunk", "lang", "source", "terms", "counts", "total"]
    rows = dense.select(*columns, F.lit(None).cast("long").alias("n_terms")).unionByName(head.select(*columns, "n_terms"))
    parts = written(rows.groupBy("chunk").applyInArrow(_compare, "lang string, source string, part string, item string, value long, chunk long, id int"), "compared")

    sums_ = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    wordless = groups.select("lang", "source").join(facts.select("lang"), "lang", "left_anti")
    others = wordless.withColumnRenamed("source", "item").join(wordless, "lang").where("source > item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    half = sums_.unionByName(others)
    pairs = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # Spark keeps the first ranks of each task before it shuffles.
    by_id = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "chunk", "id")
    top = parts.where("part = 'term'").withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= TOP_TERMS)
    shown = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select("*", F.lit("pair").alias("part"), F.row_number().over(by_value).alias("rank")).select(shown).unionByName(top.select(shown))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, sum(n) AS t FROM c GROUP BY lang, source),
lt AS (SELECT lang, sum(t) AS t FROM t GROUP BY lang),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
s AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.t, 0) + 2 * v.v))::BIGINT AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)),
ls AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (lc.n + 2)) // (lt.t + 2 * v.v))::BIGINT AS q FROM lc JOIN lt USING (lang) JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tr AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM s JOIN ls USING (lang, term) WHERE n > 0 AND p > q),
al AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pr UNION ALL SELECT * FROM tr))
SELECT lang, source, part, item, value, rank::INT AS rank FROM al WHERE part = 'pair' OR rank <= 10"""
