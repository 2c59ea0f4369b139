"""Near-duplicate groups by min-max hashing over word shingles.

A document's set holds the hashes of its distinct shingles. Each permutation contributes both its
minimum and its maximum over the set, two unbiased values for one hash evaluation; bands of six
values (three permutations) select candidates, and links are confirmed on full sets.

1. Documents with equal sets form classes; only the class's smallest doc_id goes on.
2. Classes meet in buckets, one for each band. A small bucket gives its pairs; a larger one gives
   each member with the bucket's hub, and so no more pairs than members.
3. Pairs whose sizes allow a link are confirmed on full sets and joined into components.
4. Of larger buckets that aren't one component by then, members outside the hub's component are compared with
   the others block by block, if these are few. If they are many, the members meet again under exact prefix keys:
   with shingles in an order of rarity, similar sets share one of their first few, while pages of one template,
   which share what many share, don't. Pairs of other components under a key are confirmed on full
   sets, block by block where many meet. So no pair that met in any bucket is left out, and the work
   grows with the members, not with their square.

The number of bands follows from the threshold: a pair right at it stays apart in all of them with
a probability below MISS.

Hubs are spread: a bucket's members meet their hub's set in groups of HUB_MEMBERS, each with a copy
of it, so no join key grows with a bucket.

Defined cases: null or empty text and text without words have an empty set, linked with nothing;
fewer words than a shingle make one shingle; very long texts are hashed whole, and blocks are dealt
by shingles as well as by members; rows without doc_id are linked with nothing, have no component and
are kept; rows that repeat a doc_id are one document with a component of its own name, whose set for
confirming is the greatest of theirs; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import buffers, row_chunks, scratch, written
from tracewell.llm.components import connected_components
from tracewell.llm.wordhash import LOWER, mix, word_hashes, word_spans

ROWS = 6
MISS = 1e-7
#: Members up to which a bucket gives all its pairs; a larger one is linked over its hub.
SMALL_BUCKET = 12
#: Slots of the order of rarity, the step from one size class to the next, and members up to which a prefix key gives all its pairs.
SLOTS, CLASS_STEP, SMALL_KEY = 1 << 18, 1.04, 12
#: Comparisons of sets up to which unsettled buckets are compared at once, without keys: a bounded amount of work.
DIRECT = 50_000_000
#: Prefix keys that a task holds at a time.
KEYS = 1 << 17
#: Members, and shingles of members, that are compared with as many others in one task.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Members of a bucket that meet one copy of their hub's set.
HUB_MEMBERS = 4096
_PART = 4096


def band_count(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    factors = np.random.default_rng(size).integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
    count = max(len(words) - size + 1, 0)
    with np.errstate(over="ignore"):
        runs = np.zeros(count, np.uint64)
        for k in range(size):
            runs += words[k : k + count] * factors[k]
        runs = mix(runs)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                yield mix(np.array([np.sum(words[a:b] * factors[: b - a], dtype=np.uint64) + np.uint64(b - a)]))
            else:
                yield np.zeros(0, np.uint64)


class MinMax:
    """Band values of a set."""

    def __init__(self, bands: int, rows: int = ROWS):
        draw = np.random.default_rng(5)
        count = bands * rows // 2
        self.factor = (draw.integers(0, 1 << 32, count, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.shift = draw.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)[:, None]
        self.weight = draw.integers(0, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        self.band = draw.integers(0, 1 << 63, bands, dtype=np.uint64)
        self.bands, self.half = bands, rows // 2

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        low, high = None, None
        for i in range(0, len(short), _PART):
            permuted = self.factor * short[None, i : i + _PART] + self.shift
            a, b = permuted.min(axis=1), permuted.max(axis=1)
            low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        values = np.concatenate((low.reshape(self.bands, self.half), high.reshape(self.bands, self.half)), axis=1).astype(np.uint64)
        with np.errstate(over="ignore"):
            return mix((values * self.weight).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (null if empty) and bands of every document."""
    bands = band_count(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = MinMax(bands)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in row_chunks(offsets):
                n, digests, values = [], [], []
                for hashes in shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size):
                    n.append(len(hashes))
                    digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                    values.append(sign(hashes) if len(hashes) else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], pa.array(n, pa.int64()), pa.array(digests, pa.binary()), _lists(values)],
                    ["doc_id", "n_shingles", "set_hash", "bands"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """node and its shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in row_chunks(offsets):
                parts = list(shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size))
                yield pa.RecordBatch.from_arrays([batch.column("node")[a:b], _lists(parts)], ["node", "hashes"])

    return docs.mapInArrow(run, "node long, hashes array<long>")


def links_between(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of sets of which the shared part is at least percent of the union."""
    if not left or not right:
        return
    everything, codes = np.unique(np.concatenate(right), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum([len(r) for r in right])))[:-1]
    sizes = np.array([len(r) for r in right])
    mark = np.zeros(len(everything) + 1, np.int32)
    for i, own in enumerate(left):
        at = np.searchsorted(everything, own)
        at = at[(at < len(everything)) & (everything[np.minimum(at, len(everything) - 1)] == own)]
        if len(at) * 100 < percent * len(own):
            continue
        mark[at] = 1
        shared = np.add.reduceat(mark[codes], starts)
        mark[at] = 0
        for j in np.flatnonzero(100 * shared >= percent * (len(own) + sizes - shared)):
            yield i, int(j)


def _residue(percent: int):
    """Of the links between far members and others, those that join components in this block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        far, near = pdf[pdf["far"]], pdf[~pdf["far"]]
        as_sets = lambda part: [np.asarray(h, dtype=np.int64) for h in part["hashes"]]
        a, b = far["node"].to_numpy(), near["node"].to_numpy()
        home_a, home_b = far["own"].to_numpy(), near["own"].to_numpy()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)
            return x

        found = []
        for i, j in links_between(as_sets(far), as_sets(near), percent):
            x, y = root(int(home_a[i])), root(int(home_b[j]))
            if x != y:
                parent[x] = y
                found.append((a[i], b[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, spread: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b, salt) those whose full sets are similar. spread(node, copies): hubs with several copies of their set."""
    copies = sets.join(spread, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1)))
    one = copies.select(F.col("node").alias("a"), "salt", F.col("hashes").alias("_a"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(two, "b").join(one, ["a", "salt"]).where(100 * shared >= percent * (F.size("_a") + F.size("_b") - shared)).select("a", "b")


def rarity(sets: DataFrame) -> np.ndarray:
    """How many of sets(hashes) hold a shingle of each of SLOTS slots: an order in which what many share comes last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            values = batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            for a in range(0, len(values), KEYS):
                total += np.bincount((values[a : a + KEYS] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    found = sets.select("hashes").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def size_class(size: int) -> int:
    return math.floor(math.log(size) / math.log(CLASS_STEP) + 1e-9)


@functools.lru_cache(1 << 14)
def class_start(c: int) -> int:
    """The smallest size of a class or, if it has none, of the next."""
    low = max(int(CLASS_STEP**c) - 1, 1)
    while size_class(low) < c:
        low += 1
    return low


@functools.lru_cache(1 << 14)
def prefixes(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(class, class, shingles): for each pair of size classes in which a set of a size can have partners, how many of its
    first shingles, in any common order, are sure to hold one that each partner has among its own.

    Sets of s and t shingles that are similar share at least percent (s + t) / (100 + percent), so that they meet
    among the first s - that + 1 of one and t - that + 1 of the other. A class stands for its smallest size.
    """
    own, out = size_class(size), []
    least, most = -(-percent * size // 100), size * 100 // percent
    for c in range(size_class(least), size_class(most) + 1):
        other = max(class_start(c), least)
        if size_class(other) != c:  # no size belongs to it
            continue
        shared = -(-percent * (size + other) // (100 + percent))
        out.append((min(own, c), max(own, c), size - shared + 1))
    return out


def prefix_keys(rest: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """key, node, far, own: the shingles, by pair of size classes, among which rest(node, far, own, hashes) can meet partners."""
    shared = rest.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            rows, keys, held = [], [], 0

            def flush() -> pa.RecordBatch:
                at = pa.array(np.repeat(np.array([i for i, _ in rows], np.int64), [n for _, n in rows]))
                out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), *[batch.column(c).take(at) for c in ("node", "far", "own")]], ["key", "node", "far", "own"])
                rows.clear(), keys.clear()
                return out

            for i, hashes in enumerate(batch.column("hashes")):
                values = hashes.values.to_numpy(zero_copy_only=False).view(np.uint64)
                order = values[np.lexsort((values, counts[(values % np.uint64(SLOTS)).astype(np.int64)]))]
                for low, high, n in prefixes(len(order), percent):
                    with np.errstate(over="ignore"):
                        keys.append(mix(order[:n] + np.uint64((low << 16) + high) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64))
                    rows.append((i, n))
                    held += n
                    if held >= KEYS:
                        yield flush()
                        held = 0
            yield flush()

    return rest.select("node", "far", "own", "hashes").mapInArrow(run, "key long, node long, far boolean, own long")


def more_links(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, among placed(band, node, n, own, far), the members of buckets of which some are far.

    Similar sets meet under a prefix key; pages of one template, which share what many share, don't. Few meet under
    a key, and their pairs are confirmed on full sets. Those that meet many are compared in their buckets, block by
    block; a pair that is in no bucket together was not sought in the first place.
    """
    nodes = placed.groupBy("node").agg(F.max("far").alias("far"), F.min("own").alias("own"))
    nodes = written(nodes.join(sets, "node"), "unsettled-sets")
    keys = written(prefix_keys(nodes, rarity(nodes), percent), "prefix-keys")
    facts = keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("far").alias("n_far"), F.min("own").alias("_low"), F.max("own").alias("_high"), F.bit_xor(F.xxhash64("node")).alias("_a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("_b")
    )
    # Keys of the same members are one.
    facts = facts.where("n > 1 AND n_far > 0 AND _low < _high").groupBy("_a", "_b", "n", "n_far").agg(F.min("key").alias("key")).drop("_a", "_b")
    met = written(keys.join(facts, "key"), "prefix-members")
    listed = met.where(F.col("n") <= SMALL_KEY).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "far", "own"))).alias("_m"))
    inner = listed.select(F.posexplode("_m").alias("_i", "_x"), "_m").select("_x", F.explode(F.slice("_m", F.col("_i") + 2, SMALL_KEY)).alias("_y"))
    pairs = inner.where("(_x.far OR _y.far) AND _x.own != _y.own").select(F.col("_x.node").alias("a"), F.col("_y.node").alias("b"), F.lit(0).cast("long").alias("salt")).distinct()
    none = sets.select("node", F.lit(1).cast("long").alias("copies")).limit(0)
    links = written(_confirmed(written(pairs, "prefix-pairs"), sets, none, percent), "prefix-links")
    crowded = met.where(F.col("n") > SMALL_KEY).select("node").distinct()
    left = written(placed.join(crowded, "node", "left_semi"), "crowded")
    return written(links.union(compared(left, sets, percent)), "more-links")


def compared(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, by comparing in each bucket the far ones with all others, block by block."""
    sizes = placed.groupBy("band").agg(F.count_if("far").alias("n_far"), F.sum(F.when(F.col("far"), F.col("n"))).alias("s_far"), F.count(F.lit(1)).alias("n_near"), F.sum("n").alias("s_near"), F.min("own").alias("_low"), F.max("own").alias("_high"))
    blocks = lambda side: F.greatest(F.ceil(F.col(f"n_{side}") / BLOCK), F.ceil(F.col(f"s_{side}") / BLOCK_SHINGLES)).alias(f"{side}_blocks")
    rest = placed.join(written(sizes.where("n_far > 0 AND _low < _high").select("band", blocks("far"), blocks("near")), "open-buckets"), "band")
    own_far, own_near = F.pmod(F.xxhash64("node"), F.col("far_blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("near_blocks"))
    dealt = rest.where("far").select("band", "node", "own", F.lit(True).alias("far"), own_far.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("near_blocks") - 1)).alias("j"))
    dealt = dealt.union(rest.select("band", "node", "own", F.lit(False).alias("far"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("far_blocks") - 1)).alias("i"), own_near.alias("j")))
    found = dealt.join(sets, "node").groupBy("band", "i", "j").applyInPandas(_residue(percent), "a long, b long")
    return written(found.where("a != b").distinct(), "block-links")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    with scratch(docs.sparkSession):
        signed = written(signatures(docs, size, percent), "signatures", lasting=True)
        named = signed.where("doc_id IS NOT NULL AND set_hash IS NOT NULL")
        classes = written(named.groupBy("set_hash").agg(F.min("doc_id").alias("node")), "classes")
        nodes = named.join(classes.withColumnRenamed("node", "doc_id"), ["set_hash", "doc_id"]).dropDuplicates(["set_hash", "doc_id"])
        banded = written(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band")), "bands")

        order = F.struct(F.xxhash64("node").alias("rank"), F.col("node"))
        buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(order.alias("o"), F.col("n"))).alias("_hub")).where("members > 1")
        buckets = written(buckets.select("band", "members", F.col("_hub.o.node").alias("hub"), F.col("_hub.n").alias("hub_n")), "buckets")
        members = written(banded.join(buckets, "band"), "bucket-members")

        small, large = members.where(F.col("members") <= SMALL_BUCKET), members.where(F.col("members") > SMALL_BUCKET)
        listed = small.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("_m"))
        inner = listed.select(F.posexplode("_m").alias("_i", "_x"), "_m").select("_x", F.explode(F.slice("_m", F.col("_i") + 2, SMALL_BUCKET)).alias("_y"))
        pairs = inner.select(F.col("_x.node").alias("a"), F.col("_x.n").alias("na"), F.col("_y.node").alias("b"), F.col("_y.n").alias("nb"), F.lit(0).cast("long").alias("salt"))
        copies = F.ceil(F.col("members") / HUB_MEMBERS)
        stars = large.where("node != hub").select(
            F.col("hub").alias("a"), F.col("hub_n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"), F.pmod(F.xxhash64("node"), copies).alias("salt")
        )
        spread = buckets.groupBy(F.col("hub").alias("node")).agg(F.max(copies).alias("copies")).where("copies > 1")
        fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
        pairs = written(pairs.union(stars).where(fits).where("a != b").groupBy("a", "b").agg(F.min("salt").alias("salt")), "pairs")

        wanted = written(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(large.select("node")).distinct(), "wanted")
        texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(wanted, "node", "left_semi")
        sets = written(shingle_sets(texts, size).groupBy("node").agg(F.max("hashes").alias("hashes")), "sets")
        links = written(_confirmed(pairs, sets, spread, percent), "links")
        labels = connected_components(links)

        # Members of large buckets that did not get into the hub's component.
        label = lambda name, out: labels.select(F.col("node").alias(name), F.col("component").alias(out))
        placed = (
            large.join(label("node", "_own"), "node", "left")
            .join(label("hub", "_hub"), "hub", "left")
            .select("band", "node", "n", F.coalesce("_own", "node").alias("own"), (F.coalesce("_own", "node") != F.coalesce("_hub", "hub")).alias("far"))
        )
        placed = written(placed, "placed")
        unsettled = written(placed.groupBy("band").agg(F.max("far").alias("open")).where("open").select("band"), "open-buckets")
        if not unsettled.isEmpty():
            rest = written(placed.join(unsettled, "band"), "unsettled")
            work = rest.groupBy("band").agg((F.count_if("far") * F.count(F.lit(1))).alias("w")).agg(F.sum("w")).first()[0]
            more = (compared if work <= DIRECT else more_links)(rest, sets, percent)
            if not more.isEmpty():
                labels = connected_components(links.union(more))

        # A class's component; documents with equal sets share it.
        joined = written(
            classes.join(label("node", "_component"), "node", "left").select("set_hash", F.coalesce("_component", "node").alias("component_id")), "class-components", lasting=True
        )
    out = signed.select("doc_id", "n_shingles", "set_hash").join(joined, "set_hash", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with docs' columns.

    Of rows that repeat a doc_id and its text, one stays.
    """
    verdict = written(near_duplicates(docs, size, percent).select("doc_id", "kept"), "near-duplicates")
    dropped = verdict.where("NOT kept").select(F.col("doc_id").alias("_tracewell_dropped")).distinct()
    own = docs["doc_id"].cast("long")
    left = docs.join(dropped, own == F.col("_tracewell_dropped"), "left_anti")
    again = written(verdict.where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_tracewell_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "repeated-ids")
    if again.isEmpty():
        return left
    same = own == F.col("_tracewell_again")
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op5_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=85)
