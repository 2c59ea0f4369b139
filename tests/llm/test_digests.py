"""Vector codes, source audit and line dedup against brute-force versions, and on odd inputs."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import SCHEMA, lower, odd_rows
from tracewell.llm import line_dedup, source_audit, vector_codes

# Vector codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, part int, n int, v string"


def coded_plain(rows, parts=8, entries=16, rounds=6):
    """rows of (vec_id, embedding, label): vec_id, code, error, label_error of each kept one, and the digest."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    width = len(order[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        mine = collections.defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                mine[p, near(v, p)[1]].append(cut(v, p))
        for (p, k), found in mine.items():
            books[p][k] = [sum(x) // len(found) for x in zip(*found)]
    out, by_label = [], collections.Counter()
    for i, v, label in kept:
        found = [near(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, by_label[label]) for i, code, error, label in out], digest


def vectors(n, seed=1, size=16):
    draw = np.random.default_rng(seed)
    rows = [(i, draw.normal(0, 0.3, size).astype(np.float32).tolist(), int(draw.integers(3))) for i in range(n)]
    return [(i, v, None if i % 7 == 3 else label) for i, v, label in rows]


def run_codes(spark, rows, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(*r, "c", "e", 1, 2, "v") for r in rows], VECTORS).repartition(3).write.parquet(path + "/embeddings.parquet")
    return vector_codes.op11_vector_codes(spark, path).collect()


def test_codes_equal_brute_force_on_odd_rows(spark, tmp_path):
    rows = vectors(80)
    same = rows[9]
    rows += [same, same, (200, None, 1), (201, [], 1), (202, [None] * 16, 1), (203, [0.1] * 15 + [float("nan")], 1), (204, [0.1] * 15 + [float("-inf")], 1), (None, [0.2] * 16, 2), (205, [0.0] * 16, None), (206, [0.0] * 16, 0)]
    got = run_codes(spark, rows, tmp_path)
    want, digest = coded_plain(rows)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == sorted((str(i), *rest) for i, *rest in want)
    assert {r.codebooks_sha256 for r in got} == {digest}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_codes_of_few_vectors(spark, tmp_path, n):
    got = run_codes(spark, vectors(n), tmp_path)
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted(coded_plain(vectors(n))[0])


def test_vectors_that_do_not_fit_are_dropped(spark):
    rows = [(1, [0.5] * 16, 0), (2, [0.5] * 24, 0), (3, [0.5] * 15, 0), (4, [1e30] + [0.0] * 15, 0), (5, [0.25] * 16, 0)]
    kept = vector_codes.kept_vectors(spark.createDataFrame([(*r, "", "", 1, 1, "") for r in rows], VECTORS))
    assert sorted(r.vec_id for r in kept.collect()) == [1, 5]


def test_bounds_hold_and_few_candidates_are_refined():
    draw = np.random.default_rng(4)
    entries, parts = draw.integers(-2000, 2000, (64, 8)), draw.integers(-2500, 2500, (500, 8))
    file = vector_codes.VaFile(entries)
    low, high = file.bounds(parts)
    exact = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (low <= exact).all() and (exact <= high).all()
    which, distance = file.nearest(parts)
    assert (which == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert file.refined < 0.3 * exact.size
    same = vector_codes.VaFile(np.array([[3, 3], [1, 1], [1, 1]]))
    assert same.nearest(np.array([[1, 1], [2, 2]]))[0].tolist() == [1, 0]


def test_light_labels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "HEAVY", 2)
    rows = [(i, "c", i, label) for i, label in enumerate([1] * 8 + [2, 2, None, None, 3])]
    got = vector_codes.with_label_error(spark.createDataFrame(rows, "vec_id long, code string, error long, label int")).collect()
    sums = collections.Counter()
    for _, _, error, label in rows:
        sums[label] += error
    assert sorted((r.vec_id, r.label_error) for r in got) == [(i, sums[label]) for i, _, _, label in rows]


# Source audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited_plain(rows, least):
    """rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [collections.Counter(lower(t) for t in TERM.findall(text)) for text, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        mine = [(c, s) for c, (_, x, s) in zip(terms, rows) if x == lang]
        docs = collections.Counter(t for c, _ in mine for t in c)
        kept = sorted((t for t, n in docs.items() if n >= least), key=lambda t: t.encode())
        sources = sorted({s for _, s in mine}, key=lambda s: s.encode())
        counts = {s: collections.Counter() for s in [None, *sources]}
        for c, s in mine:
            for t in c:
                if docs[t] >= least:
                    counts[s][t] += c[t]
                    counts[None][t] += c[t]
        p = {s: [1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept] for s, c in counts.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in sources if o != s]
            top = [(f(a, b), t) for t, a, b in zip(kept, p[s], p[None]) if counts[s][t] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", top, 10)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(order)]
    return sorted(out)


def audited(df, least):
    return sorted(tuple(r) for r in source_audit.audit(df, least).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    assert audited(docs, 10) == audited_plain(rows, 10)


@pytest.mark.parametrize("least", [1, 3, 100])
def test_audit_of_odd_rows_in_short_chunks(spark, monkeypatch, least):
    monkeypatch.setattr(source_audit, "CHUNK_CELLS", 1)
    draw = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["É", "é", "日本", "ＡＢ", "\U0001f600", "\x7f", "a\x00b", "Ab", "aB"]
    rows = [(i, " ".join(draw.choices(words, k=draw.choice([0, 3, 40]))), draw.choice(["en", "fr", None, ""]), draw.choice(["s", "t", "日", None]), 1, *"abcdefg") for i in range(60)]
    rows += odd_rows() + [(1, None, "de", "only", 1, *"abcdefg"), (1, "", "it", "x", 1, *"abcdefg"), (1, "- 12", "it", "y", 1, *"abcdefg")]
    assert audited(spark.createDataFrame(rows, SCHEMA).repartition(3), least) == audited_plain([(r[1], r[2], r[3]) for r in rows], least)


def test_audit_of_an_empty_table(spark):
    assert audited(spark.createDataFrame([], SCHEMA), 10) == []


def test_chunks_hold_whole_terms_in_order(spark, monkeypatch):
    rows = [("en", f"s{i % 3}", f"t{i // 3:04d}", i + 1, 5) for i in range(900)]
    out = source_audit.chunks(spark.createDataFrame(rows, "lang string, source string, term string, n long, docs long"), 10, 16).collect()
    terms = [t for r in sorted((r for r in out if r.source is None), key=lambda r: r.chunk) for t in r.terms]
    assert terms == sorted(terms) and len(terms) == 300 and max(len(r.counts) for r in out) == 16
    assert sum(sum(r.counts) for r in out if r.source) == sum(range(1, 901))


def test_shares_by_long_division():
    draw = np.random.default_rng(2)
    n, total, v = draw.integers(0, 2**40, 200), draw.integers(2**40, 2**52, 200), 12345
    assert source_audit.shares(n, total, v).tolist() == [1 + 10**9 * (a + 2) // (b + 2 * v) for a, b in zip(n.tolist(), total.tolist())]


# Line dedup


def deduped_plain(rows):
    """rows of (doc_id, text)."""
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    holders = collections.defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = lambda k: len(holders[k]) >= 5 and any(x is not None for x in holders[k]) and i != max(x for x in holders[k] if x is not None)
        kept = [x for x in lines if not gone(key(x))]
        out.append((str(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def deduped(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in line_dedup.without_common_lines(df).collect())


def line_rows():
    draw = random.Random(9)
    common = [f"Line {k} " + draw.choice("abcé日") * draw.choice([30, 31, 32, 33, 34, 60]) for k in range(12)]
    rows = []
    for i in range(60):
        some = [draw.choice(["", " ", "\t\r"]) + (x.upper() if draw.random() < 0.3 else x) + draw.choice(["", " \v", "\f"]) for x in draw.choices(common, k=draw.choice([0, 1, 4, 9]))]
        rows.append((draw.choice([i, i, None, 7]), "\n".join([*some, f"own line of {i}" * 5, "", "short"]) + draw.choice(["", "\n"])))
    only_null = "a line that only rows without a doc_id hold, in six of them"
    return rows + [(None, only_null)] * 6 + [(99, common[0] + "\n" + common[0]), (99, common[0])]


@pytest.mark.parametrize("hashes", [4, 1 << 18])
def test_lines_equal_brute_force(spark, sf, monkeypatch, hashes):
    monkeypatch.setattr(line_dedup, "SHARD_HASHES", hashes)
    rows = line_rows() + [(r[0], r[1]) for r in odd_rows()] + [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    want = deduped_plain(rows)
    assert sum(n for _, _, n, _ in want) > 50
    assert deduped(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_lines_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert deduped(empty) == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    draw = np.random.default_rng(n)
    a, b = draw.integers(0, 2**63, (2, n), dtype=np.uint64)
    a[: n // 2] = a[0] if n else a[:0]  # equal first halves are told apart by the second
    made = line_dedup.PerfectHash.build(a, b)
    assert sorted(made.numbers(a, b).tolist()) == list(range(n))
    assert made.numbers(a, b ^ np.uint64(1)).max(initial=-1) < n


def test_shards_survive_being_stored():
    draw = np.random.default_rng(7)
    a, b = draw.integers(0, 2**63, (2, 3000), dtype=np.uint64)
    n, last, known = draw.integers(1, 100_000, 3000), draw.integers(-50, 50, 3000), draw.random(3000) < 0.8
    raw = line_dedup.LineShard.build(a, b, n, last, known, 5).to_bytes()
    shard = line_dedup.LineShard.from_bytes(raw)
    doc, with_id = draw.integers(-50, 50, 3000), draw.random(3000) < 0.9
    assert shard.lost(a, b, doc, with_id, 5).tolist() == [bool(c >= 5 and k and (not w or d != x)) for c, k, w, d, x in zip(n, known, with_id, doc, last)]
    # Hashes that are not in the shard are told by their fingerprints.
    other = draw.integers(0, 2**63, (2, 3000), dtype=np.uint64)
    assert not shard.lost(*other, doc, with_id, 5).any() and len(raw) < 3000 * 16


def test_plans_join_no_lines(spark, sf):
    out = line_dedup.without_common_lines(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = out._jdf.queryExecution().toString()
    assert plan.count("Join") and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_registered_queries_run(spark, sf):
    from tracewell.llm.queries import ORACLE_SQL, QUERIES

    for name, rows in (("op11_vector_codes", "embeddings"), ("op13_line_dedup", "documents")):
        assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{rows}.parquet").count() and name in ORACLE_SQL
    assert QUERIES["op12_source_audit"](spark, sf).where(F.col("rank") > 10).where("part = 'term'").isEmpty()
