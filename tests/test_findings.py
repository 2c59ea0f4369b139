import random

from pyspark.sql import functions as F

from tracewell.jobs import report
from tracewell.operators import detectors as D
from tracewell.operators import findings as G
from tracewell.operators import model
from tracewell.operators.merge import merge_overlapping

MATCH = "category string, value string, detector string, score double, path string, page int, line int, kind string, context string, seq struct<path:string,page:int,line:int,rule:int,start:int>"


def match(value, path="p", line=1, start=0, category="private_email", kind="text", context="c"):
    return (category, value, "regex", 1.0, path, None, line, kind, context, (path, 0, line or 0, 0, start))


def test_first_seen_value_and_places(spark):
    rows = [match("A@x.jp", line=1), match("a@x.jp", line=2), match("a@x.jp", line=2, start=5)]
    out = G.aggregate_findings(spark.createDataFrame(rows, MATCH)).collect()
    assert [(r.key, r.value, r.occurrences) for r in out] == [("a@x.jp", "A@x.jp", 2)]


def test_kind_is_no_part_of_a_place(spark):
    rows = [match("1", category="c", kind="ocr", context="first"), match("1", category="c", kind="metadata", context="second", start=9)]
    out = G.first_locations(spark.createDataFrame(rows, MATCH)).collect()
    assert [(r.nth, r.context) for r in out] == [(1, "first")]


def test_twenty_locations_of_twenty_five(spark):
    rows = [match("v", line=i, category="c") for i in range(1, 26)]
    df = spark.createDataFrame(rows, MATCH)
    assert G.aggregate_findings(df).first().occurrences == 25
    assert sorted(r.line for r in G.first_locations(df).collect()) == list(range(1, 21))


def greedy(found):
    """found: (key, places) in order of first sight."""
    kept = []
    for key, places in sorted(found, key=lambda f: -len(f[0])):
        home = next((k for k in kept if key in k[0] and k[1] & places), None)
        if home:
            home[1].update(places)
        else:
            kept.append((key, set(places)))
    return {(k, len(p)) for k, p in kept}


def merged(spark, found, category="c"):
    rows = [(category, k, k, ["regex"], 1.0, len(p), ("p", 0, 0, 0, i)) for i, (k, p) in enumerate(found)]
    findings = spark.createDataFrame(rows, "category string, key string, value string, detectors array<string>, score double, occurrences long, seq struct<path:string,page:int,line:int,rule:int,start:int>")
    places = spark.createDataFrame([(category, k, "p", x, None) for k, p in found for x in p], "category string, key string, path string, line int, page int")
    return {(r.value, r.occurrences) for r in merge_overlapping(findings, places).collect()}


def test_merge_goldens(spark):
    assert merged(spark, [("bcd", {1}), ("abcde", {1})]) == {("abcde", 1)}
    assert merged(spark, [("bcd", {1}), ("abcde", {2})]) == {("abcde", 1), ("bcd", 1)}
    assert merged(spark, [("xabcdx", {1}), ("abc", {1, 2}), ("bcd", {2})]) == {("xabcdx", 2)}


def test_merge_equals_the_greedy_pass(spark):
    draw = random.Random(4)
    for _ in range(4):
        found = {}
        for _ in range(25):
            found.setdefault("".join(draw.choice("ab") for _ in range(draw.randint(1, 6))), set()).update(draw.sample(range(12), 2))
        assert merged(spark, list(found.items())) == greedy(list(found.items()))


def test_merge_of_a_hot_value_holds_no_list_of_places(spark):
    lines, hot = 3000, "+81 3-1234-5678"
    found = [("c", hot, "p", i, None) for i in range(lines)] + [("c", "3-1234-5678", "p", i, None) for i in range(0, 2 * lines, 2)]
    found += [("c", f"n{i}", "p", i, None) for i in range(lines)]
    places = spark.createDataFrame(found, "category string, key string, path string, line int, page int")
    findings = places.groupBy("category", "key").agg(F.count("line").alias("occurrences"))
    findings = findings.withColumn("value", F.col("key")).withColumn("detectors", F.array(F.lit("regex"))).withColumn("score", F.lit(1.0))
    out = merge_overlapping(findings, places)
    assert "Pandas" not in out._jdf.queryExecution().toString()
    assert [(r.occurrences, r.absorbed) for r in out.where(F.col("key") == hot).collect()] == [(lines + lines // 2, ["3-1234-5678"])]
    # Of the others, n7 is in n70 to n79 and the like, but on another line.
    assert out.where(F.col("key") != hot).agg(F.count("key"), F.sum("occurrences")).first()[:] == (lines, lines)


def test_merge_follows_chains_of_absorbed_findings(spark):
    draw = random.Random(6)
    for _ in range(1):
        found = {"".join(draw.choice("ab") for _ in range(14)): {0, 1}}
        for _ in range(60):
            found.setdefault("".join(draw.choice("ab") for _ in range(draw.randint(1, 7))), set()).update(draw.sample(range(25), 2))
        assert merged(spark, list(found.items())) == greedy(list(found.items()))


def test_budget_equals_the_greedy_pass(spark):
    draw = random.Random(5)
    rows = [(f"b{i % 3}", draw.randint(0, 4), i, "x", draw.randint(0, 30)) for i in range(300)]
    out = model.apply_token_budget(spark.createDataFrame(rows, "bundle string, priority int, seq int, text string, tokens int"), 100)
    got = {(r.bundle, r.seq) for r in out.where("admitted").collect()}
    want = set()
    for b in ("b0", "b1", "b2"):
        left = 100
        for r in sorted((r for r in rows if r[0] == b), key=lambda r: (r[1], r[2])):
            if r[4] + 1 <= left:
                left -= r[4] + 1
                want.add((b, r[2]))
    assert got == want


def test_windows_keep_each_token_once(spark):
    out = model.token_windows(spark.createDataFrame([(1, 1536), (2, 1537), (3, 4000)], "doc_id long, n long")).collect()
    assert [sum(r.doc_id == d for r in out) for d in (1, 2, 3)] == [1, 2, 3]
    for d, n in ((1, 1536), (2, 1537), (3, 4000)):
        assert sorted(t for r in out if r.doc_id == d for t in range(r.keep_from, r.keep_to)) == list(range(n))


def test_spans_follow_legal_paths(spark):
    labels = ["O", "B-x", "I-x", "E-x", "S-x"]
    rows = [(1, 0, 0, 1, [0, 5, 0, 0, 1]), (1, 1, 2, 3, [0, 0, 5, 0, 0]), (1, 2, 4, 5, [4, 0, 0, 3, 0]), (1, 3, 6, 7, [5, 0, 0, 0, 0])]
    rows = [(d, p, a, b, [float(x) for x in v]) for d, p, a, b, v in rows]
    out = model.decode_spans(spark.createDataFrame(rows, "doc_id long, pos int, start int, end int, logits array<float>"), labels).collect()
    assert [(r.start, r.end, r.category) for r in out] == [(0, 5, "x")]


def test_known_counts_of_phones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    lines = report.lines_of(docs)
    matches = D.detect(lines, (D.JP_PHONE, D.INTL_PHONE))
    assert (matches.count(), G.aggregate_findings(matches).count(), report.scan(lines, (D.JP_PHONE, D.INTL_PHONE)).count()) == (7, 6, 5)


def test_report_is_written_and_rendered(spark, tmp_path):
    lines = spark.createDataFrame([("p.txt", None, 1, "text", "call 03-1234-5678 or a@b.jp")], "path string, page int, line int, kind string, text string")
    out = report.scan(lines)
    report.write_report(out, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    sections = [r.section for r in report.render_markdown(out).orderBy("n").collect()]
    assert sections[0].startswith("## 1. メールアドレス: a@b.jp") and "`p.txt L1` (text): " in sections[1]


def test_sections_are_numbered_without_a_window_over_a_category(spark):
    rows = [("secret" if i % 4 else "my_number", f"v{i:04d}", ["regex"], 1.0, i % 7 + 1, "label") for i in range(500)]
    found = spark.createDataFrame(rows, "category string, value string, detectors array<string>, score double, occurrences long, category_label string")
    found = found.withColumn("locations", F.array(F.struct(F.lit("p").alias("path"), F.lit(1).alias("line"), F.lit(None).cast("int").alias("page"), F.lit("text").alias("kind"), F.lit("c").alias("context"))))
    out = report.render_markdown(found)
    assert "windowspecdefinition(category" not in out._jdf.queryExecution().toString()
    got = [(r.n, r.section.split("\n")[0]) for r in out.orderBy("n").collect()]
    want = sorted(rows, key=lambda r: (r[0], -r[4], r[1]))
    assert got == [(i, f"## {i}. label: {r[1]}") for i, r in enumerate(want, 1)]


def test_locations_of_absorbed_findings_are_kept(spark):
    """+81 90-... at line 1; its short form there and at lines 2 to 30: one finding, twenty places, the host's first."""
    texts = ["+81 090-1234-5678"] + ["090-1234-5678"] * 29
    lines = spark.createDataFrame([("p", None, i, "text", t) for i, t in enumerate(texts, 1)], "path string, page int, line int, kind string, text string")
    (row,) = report.scan(lines, (D.JP_PHONE, D.INTL_PHONE)).collect()
    assert row.value == "+81 090-1234-5678" and row.occurrences == 30 and [x.line for x in row.locations] == list(range(1, 21))


def test_hot_bundles_are_in_no_single_window(spark):
    from tracewell.operators import images

    rows = [("hot" if i % 3 else None, f"i{i}", 200 + i * 7919 % 500, 300 + i % 100, i % 40 == 0, i * 31 % 50) for i in range(2000)]
    df = spark.createDataFrame(rows, "bundle string, path string, width int, height int, photo_like boolean, ocr_chars int")
    out = images.select_ocr_images(df)
    want = {}
    for b in ("hot", None):
        fit = sorted((r for r in rows if r[0] == b and min(r[2:4]) >= 120 and r[2] * r[3] >= 60_000), key=lambda r: (-r[2] * r[3], r[1]))
        want |= {r[1]: "selected" if k < 40 else "cap" for k, r in enumerate(fit)}
    assert {r.path: r.status for r in out.collect()} == {r[1]: want.get(r[1], "small") for r in rows}
    seen = images.visual_review(df).collect()
    for b in ("hot", None):
        fit = sorted((r for r in rows if r[0] == b and (r[4] or r[5] >= 10)), key=lambda r: (-r[4], -r[5], -r[2] * r[3], r[1]))
        got = sorted((r.nth, r.path, r.overflow) for r in seen if r.bundle == b)
        assert got == [(k, r[1], len(fit) - 20) for k, r in enumerate(fit[:20], 1)]
    lines = spark.createDataFrame([(b, i, "x" * (i % 7)) for b in ("hot", None) for i in range(700)], "bundle string, seq int, text string")
    starts, at = {(r.bundle, r.seq): (r.start, r.next) for r in model.line_starts(lines).collect()}, 0
    for i in range(700):
        assert starts["hot", i] == starts[None, i] == (at, at + i % 7 + 1)
        at += i % 7 + 1


def test_overlaps_scan_the_customers_once_on_all_cores(spark, sf, monkeypatch):
    """The file of customers is small and read by one task, but the patterns run on what its rows become."""
    from tracewell import queries
    from tracewell.functions import tables
    from tracewell.jobs import inputs
    from tracewell.operators import merge

    assert inputs.synthetic_lines(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    plans = []

    def written(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return tables.materialized(df, *args, **kwargs)

    monkeypatch.setattr(queries, "materialized", written)
    monkeypatch.setattr(merge, "materialized", written)
    out = queries.j1_merge_overlapping(spark, sf)
    assert out.count() == inputs.table(spark, sf, "customer").count()
    assert sum("c_custkey" in plan for plan in plans) == 1
