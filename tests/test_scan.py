"""Files that no scan may end on, streams, pictures, credentials, reports, kept scans and written tables."""

import gzip
import hashlib
import io
import json
import os
import random
import tarfile
import threading
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_files import tarred, zipped
from tracewell import queries
from tracewell.functions import patterns as P
from tracewell.functions.tables import fresh_path, scratch
from tracewell.jobs import gate, incremental, report
from tracewell.operators import credentials
from tracewell.operators import findings as G
from tracewell.operators.detectors import BANK, DETECTORS, detect
from tracewell.sources import archives, files, tree
from tracewell.sources.ordered_text import write_sections


def unpacked(raw, path="f", **limits):
    return list(archives.unpack(path, io.BytesIO(raw), len(raw), archives.Limits(**limits)))


def latin_tar():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", encoding="latin-1", format=tarfile.GNU_FORMAT) as t:
        for name in ("r\xe9sum\xe9.txt", "plain.txt"):
            info = tarfile.TarInfo(name)
            info.size = 16
            t.addfile(info, io.BytesIO("普通 1234567\n".encode()[:16].ljust(16)))
    return out.getvalue()


def scanned(spark, named, **more):
    return report.scan_files(spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "path string, content binary"), **more)


def test_bytes_and_names_that_are_not_utf8_end_nothing(spark):
    bad = zipped(word__document_dot_xml=b"<w:p>tel 03-1234-5678 caf\xe9</w:p>", docProps__core_dot_xml=b"<dc:creator>Ren\xe9 X</dc:creator>")
    out = scanned(spark, {"/d/bad.docx": bad, "/d/latin.tar": latin_tar(), "/d/ok.txt": "普通 7654321".encode()})
    assert {r.value for r in out.findings.collect()} == {"03-1234-5678", "Ren� X", "普通 1234567", "普通 7654321"}
    assert out.skipped.isEmpty()
    assert {r.path for r in out.findings.select(F.explode("locations.path").alias("path")).collect()} >= {"/d/latin.tar!r�sum�.txt"}


@pytest.mark.parametrize("seed", range(6))
def test_no_damage_ends_a_file(seed):
    draw = random.Random(seed)
    inner = zipped(a_dot_txt=b"x" * 3000, b_dot_txt=bytes(range(256)) * 20)
    for raw in (inner, tarred("", z_dot_zip=inner, t_dot_txt=b"t" * 900), tarred("gz", z_dot_zip=inner), tarred("xz", z_dot_zip=inner), gzip.compress(inner), zipped(word__document_dot_xml=b"<w:p>x</w:p>" * 99)):
        for _ in range(40):
            torn = bytearray(raw)
            for _ in range(draw.choice([1, 3, 30])):
                torn[draw.randrange(len(torn))] = draw.randrange(256)
            rows = unpacked(bytes(torn[: draw.choice([len(torn), draw.randrange(len(torn))])]))
            assert rows and all(isinstance(r[0], str) and r[0].encode() for r in rows)
            assert all(b.num_rows for b in archives.in_batches(iter(rows)))


def test_large_members_are_read_through_and_only_their_heads_kept():
    small = archives.Limits().member
    big = b"0123456789abcdef" * 40_000
    nested = zipped(big_dot_bin=big, note_dot_txt=b"in a zip that is not held whole" * 3, deep_dot_zip=zipped(x_dot_txt=b"deeper"))
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w", zipfile.ZIP_STORED) as z:
        z.writestr("n.zip", nested + b"")
    for outer in (stored.getvalue(), tarred("gz", n_dot_zip=nested), gzip.compress(nested)):
        rows = unpacked(outer, member=1000)
        found = {r[0].split("!")[-1]: r for r in rows if r[1] in ("file", "large")}
        assert found["big.bin"][1] == "large" and found["big.bin"][2] == big[: archives.HEAD]
        assert found["note.txt"][2] == b"in a zip that is not held whole" * 3 and found["x.txt"][2] == b"deeper"
        assert not [r for r in rows if r[1] == "skip"]
    assert small == P.MAX_TEXT_BYTES


def test_an_archive_that_unpacks_too_far_leaves_a_skip_row(monkeypatch):
    monkeypatch.setattr(archives, "RATIO_FLOOR", 1 << 20)
    bomb = gzip.compress(b"x" * (40 << 20))
    # What is never held costs no more than the limit of a member; reading it through would.
    assert [r[1] for r in unpacked(bomb, ratio=10, member=1 << 16)] == ["archive", "large"]
    for outer in (bomb, zipped(in_dot_gz=bomb, b_dot_txt=b"later")):
        assert unpacked(outer, ratio=10, member=1 << 26)[-1] == ("f", "skip", None, P.UNPACKS_TOO_FAR)
    assert unpacked(zipped(a_dot_txt=b"1" * 5000), total=4000)[-1][3] == P.UNPACKS_TOO_FAR


def test_every_file_that_is_looked_into_has_one_row():
    inner = zipped(a_dot_txt=b"a", e_dot_7z=b"7z\xbc\xaf\x27\x1c..", t_dot_gz=gzip.compress(b"one"))
    rows = unpacked(tarred("bz2", z_dot_zip=inner, b_dot_txt=b"b"))
    opened = [r[0] for r in rows if r[1] in ("file", "large", "archive")]
    assert len(opened) == len(set(opened)) == 7


def put(folder, named):
    for name, raw in named.items():
        os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
        with open(f"{folder}/{name}", "wb") as out:
            out.write(raw)


def test_a_tree_gives_what_its_files_give(spark, tmp_path):
    named = {"a.txt": b"tel 03-1234-5678", "sub/in.zip": zipped(n_dot_txt="普通預金 1234567".encode(), z_dot_zip=zipped(m_dot_md=b"x@y.jp")), ".ssh/id": b"tel 03-9999-8888", "sub/bad.zip": b"PK\x03\x04..."}
    put(str(tmp_path), named)
    out = tree.read_tree(spark, str(tmp_path))
    by_rows = files.expand_archives(files.split_refused(files.read_files(spark, str(tmp_path)))[0])
    plain = lambda rows: sorted((r.path.removeprefix("file:").removeprefix(str(tmp_path)), r.what, bytes(r.content or b""), r.reason or "") for r in rows)
    top = {(f"/{n}", "name", b"", "") for n in named if "ssh" not in n}
    assert set(plain(out.collect())) == set(plain(by_rows.collect())) | top | {("/.ssh/id", "skip", b"", "refused location: .ssh")}
    scan = report.scan_tree(spark, str(tmp_path))
    assert {r.value for r in scan.findings.collect()} == {"03-1234-5678", "普通預金 1234567", "x@y.jp"}
    assert scan.summary.first().files_seen == 6
    with pytest.raises(Exception, match="FileNotFound"):
        tree.read_tree(spark, str(tmp_path / "none")).count()


def test_files_are_grouped_by_bytes():
    groups = tree.grouped([(f"p{i:03d}", 10 << 20) for i in range(20)] + [("q", 1 << 40), ("r", 1)])
    assert sum(len(g.files) for g in groups) == 22 and [("q", 1 << 40)] in [g.files for g in groups]
    assert max(sum(s for _, s in g.files) for g in groups if ("q", 1 << 40) not in g.files) <= tree.TASK_BYTES


# Pictures, phases and credentials

META = "path string, tag string, value string, gps struct<lat array<double>, lat_ref string, lon array<double>, lon_ref string>"
PNG = b"\x89PNG\r\n\x1a\n.."


def test_pictures_take_part_in_the_scan(spark):
    named = {f"/p/{i:02d}.png": PNG for i in range(45)} | {"/p/small.png": PNG, "/p/t.txt": b"tel 03-5555-6666"}
    sizes = [(p, 300 + i, 400, i == 3) for i, p in enumerate(named) if p.endswith("png") and "small" not in p] + [("/p/small.png", 100, 100, False)]
    here = ([35.0, 30.0, 0.0], "N", [139.0, 45.0, 0.0], "E")
    meta = [("/p/00.png", "Artist", " Ann B ", here), ("/p/44.png", "ImageDescription", "tel 03-5555-6666 here", None), ("/p/none.png", "Artist", "not scanned", None)]
    texts = lambda chosen: chosen.select("path", F.when(F.col("path") == "/p/44.png", "tel 03-5555-6666 read").when(F.col("path") == "/p/10.png", "a long text of it").otherwise("abc").alias("text"))
    pictures = report.Pictures(spark.createDataFrame(sizes, "path string, width int, height int, photo_like boolean"), spark.createDataFrame(meta, META), texts)
    out = scanned(spark, named, pictures=pictures)
    found = {(r.category, r.value): r for r in out.findings.collect()}
    assert set(found) == {("private_phone", "03-5555-6666"), ("metadata_person", "Ann B"), ("location_gps", "35.500000, 139.750000")}
    # Line 1 of the description and of what is read in the picture are one place, and files come before reading.
    phone = found["private_phone", "03-5555-6666"]
    assert phone.occurrences == 2 and [(x.path, x.kind) for x in phone.locations] == [("/p/44.png", "metadata"), ("/p/t.txt", "text")]
    facts = out.summary.first()
    assert (facts.images_total, facts.images_ocr, facts.images_skipped_small, facts.images_skipped_cap) == (46, 2, 1, 5)
    assert [(r.path, r.nth) for r in out.review.orderBy("nth").collect()] == [("/p/03.png", 1), ("/p/44.png", 2), ("/p/10.png", 3)]
    blind = scanned(spark, named, pictures=report.Pictures(pictures.sizes))
    assert blind.summary.first().images_ocr == 0 and blind.review.count() == 20 and blind.review.first().overflow == 25


def test_pages_of_documents_take_part_in_the_scan(spark):
    named = {"/d/a.pdf": b"%PDF-1.4", "/d/b.pdf": b"%PDF-1.7", "/d/c.pdf": b"%PDF-1.4", "/d/n.zip": zipped(e_dot_pdf=b"%PDF-1.4 x"), "/d/z.bin": b"\0"}
    texts = {"/d/a.pdf": ("first page\n\nwith 普通預金 1234567\f  \f\nthird 03-1234-5678", " Ann B "), "/d/b.pdf": ("too short", None), "/d/n.zip!e.pdf": ("a page of a document in an archive, x@y.jp\f", "")}
    read = lambda paths: paths.join(spark.createDataFrame([(p, *t) for p, t in texts.items()], "path string, text string, author string"), "path")
    out = scanned(spark, named, documents=report.Documents(read))
    got = {(r.category, r.value, x.path, x.page, x.line, x.kind) for r in out.findings.collect() for x in r.locations}
    assert got == {
        ("account_number", "普通預金 1234567", "/d/a.pdf", 1, 3, "pdf"), ("private_phone", "03-1234-5678", "/d/a.pdf", 3, 2, "pdf"),
        ("private_email", "x@y.jp", "/d/n.zip!e.pdf", 1, 1, "pdf"), ("metadata_person", "Ann B", "/d/a.pdf", None, None, "metadata"),
    }
    assert {r.path: r.reason for r in out.skipped.collect()} == {"/d/b.pdf": P.NO_PDF_TEXT, "/d/c.pdf": P.NO_PDF_TEXT, "/d/z.bin": P.BINARY}


@pytest.mark.parametrize("order", range(3))
def test_phases_come_before_lines(spark, order):
    rows = [("p.png", None, 1, "ocr", "tel 03-1234-5678 in ocr"), ("p.png", None, 1, "metadata", "tel 03-1234-5678 in metadata"), ("a/090-1234-5678.txt", None, 1, "text", "090-1234-5678 in text"), ("a/090-1234-5678.txt", None, None, "filename", "090-1234-5678.txt")]
    random.Random(order).shuffle(rows)
    lines = spark.createDataFrame(rows, "path string, page int, line int, kind string, text string").repartition(3)
    got = {r.key: (r.kind, r.context) for r in G.first_locations(detect(lines)).where("nth = 1").collect()}
    assert got == {"03-1234-5678": ("metadata", "tel 03-1234-5678 in metadata"), "090-1234-5678": ("filename", "090-1234-5678.txt")}


def test_credentials_in_any_depth_block_their_root(spark):
    closed = tarred("gz", z_dot_zip=zipped(e_dot_7z=b"7z\xbc\xaf\x27\x1c.."))
    named = {
        "/r/token.zip": zipped(a_dot_txt=b'token = "11acdfb36bb72224148e6160f674b4be45601bff"'), "/r/name.zip": zipped(d__x_dot_zip=zipped(_dot_env=b"A=1")), "/r/closed.tgz": closed,
        "/r/torn.zip": zipped(a_dot_txt=b"x" * 99)[:60], "/r/fine.zip": zipped(a_dot_txt=b"nothing"), "/r/store.jks": b"\0", "/r/pic.png": PNG,
    }
    out = scanned(spark, named)
    assert {(r.root, r.rule) for r in out.credentials.collect()} == {("/r/token.zip", "assigned_secret"), ("/r/name.zip", "credential_file"), ("/r/closed.tgz", "uninspectable"), ("/r/torn.zip", "uninspectable"), ("/r/store.jks", "credential_file")}
    requested = spark.createDataFrame([(k,) for k in [*named, "/r/missing"]], "root string")
    own = spark.createDataFrame([(k, k, len(v)) for k, v in named.items()], "root string, path string, length long")
    checked = {r.root: (r.exists, r.blocked, r.upload_allowed) for r in files.size_check(requested, own, credentials.blocked_roots(out.credentials)).collect()}
    assert {k for k, v in checked.items() if v[2]} == {"/r/fine.zip", "/r/pic.png"} and checked["/r/missing"] == (False, False, False)


# Reports


def sample(spark, **more):
    named = {f"/d/{i:02d}.txt": f"普通預金 {i % 9:07d} and\ttab\nuser{i}@x.jp \"quoted\"".encode() for i in range(30)} | {"/d/z.bin": b"\0\1", "/d/e.7z": b"7z\xbc\xaf\x27\x1c"}
    return scanned(spark, named, **more)


def test_the_json_report_is_one_object(spark, tmp_path):
    scan = sample(spark)
    report.write_json(scan, str(tmp_path / "r.json"), "abc")
    with open(tmp_path / "r.json", encoding="utf-8") as source:
        got = json.load(source)
    rows = scan.findings.collect()
    assert got["findings_count"] == len(got["findings"]) == len(rows) == 39 and not got["ok"] and got["fingerprint"] == "abc" and got["files_seen"] == 32
    assert [(f["category"], f["value"], f["occurrences"]) for f in got["findings"]] == [(r.category, r.value, r.occurrences) for r in rows]
    assert got["findings"][0]["locations"][0].keys() == {"path", "kind", "line", "context"} and got["findings"][0]["category_ja"] == "口座番号・カード番号等"
    assert got["not_scanned"] == {"binary (not PII-scanned)": {"count": 1, "examples": ["/d/z.bin"]}, "uninspectable archive": {"count": 1, "examples": ["/d/e.7z"]}}
    assert got["model"] == {"used": False, "reason": "disabled", "tokens_processed": 0, "token_budget": 0, "not_model_scanned": []} and got["ocr"]["images_total"] == 0
    assert os.listdir(tmp_path) == ["r.json"]


def test_the_markdown_report_is_one_file_in_order(spark, tmp_path):
    scan = sample(spark)
    report.write_markdown(scan, str(tmp_path / "r.md"))
    with open(tmp_path / "r.md", encoding="utf-8") as source:
        lines = source.read().split("\n")
    assert lines[:6] == ["# PII report", "", "- findings: 39", "- model: NOT used disabled", "- OCR: unavailable (0 image(s) with text)", ""]
    heads = [x for x in lines if x.startswith("## ")]
    assert heads == [f"## {i}. {r.category_label}: {r.value}" for i, r in enumerate(scan.findings.collect(), 1)] + ["## Not PII-scanned"]
    assert lines[-3:] == ["- binary (not PII-scanned): 1 (e.g. /d/z.bin)", "- uninspectable archive: 1 (e.g. /d/e.7z)", ""]
    assert "- `/d/00.txt L1` (text): 普通預金 0000000 and tab" in lines


def test_an_empty_report(spark, tmp_path):
    scan = scanned(spark, {"/d/a.txt": b"nothing"})
    report.write_json(scan, str(tmp_path / "r.json"))
    with open(tmp_path / "r.json") as source:
        got = json.load(source)
    assert got["ok"] and got["findings"] == [] and got["not_scanned"] == {} and got["images_for_visual_review"] == []
    report.write_markdown(scan, str(tmp_path / "r.md"))
    assert "Not PII" not in (tmp_path / "r.md").read_text()


def test_sections_of_many_tasks_are_in_order_and_a_failed_write_leaves_nothing(spark, tmp_path):
    rows = spark.range(5000).selectExpr("CAST(id % 3 AS int) AS part", "id AS n", "concat('s', id % 3, ' ', id) AS section").repartition(7)
    write_sections(rows, str(tmp_path / "out.txt"))
    got = (tmp_path / "out.txt").read_text().split("\n")[:-1]
    assert got == [f"s{p} {i}" for p in range(3) for i in range(5000) if i % 3 == p]
    bad = rows.withColumn("section", F.when(F.col("n") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("section")))
    with pytest.raises(Exception, match="broken"):
        write_sections(bad, str(tmp_path / "bad.txt"))
    assert os.listdir(tmp_path) == ["out.txt"]


def test_a_model_takes_part_in_the_report(spark, tmp_path):
    def words():
        import re

        return lambda texts: [[(int(m.group()[0].isupper()), m.start(), m.end()) for m in re.finditer(r"\S+", t)] for t in texts]

    def people():
        import numpy as np

        return lambda ids: np.where(np.asarray(ids)[:, None] == 1, [0.0, 0, 0, 0, 6], [6.0, 0, 0, 0, 0])

    labels = ["O", "B-private_person", "I-private_person", "E-private_person", "S-private_person"]
    named = {"/d/a.txt": b"here is Ann\nand tel 03-1234-5678", "/d/b.py": b"# author Ann\nx = 1"}
    scan = scanned(spark, named, model=report.Model(words, people, labels, budget=9))
    found = {r.value: (r.detectors, r.occurrences) for r in scan.findings.collect()}
    assert found == {"Ann": (["model"], 1), "03-1234-5678": (["regex"], 1)}
    facts = scan.model.first()
    assert facts.used and facts.tokens_processed == 8 and facts.not_model_scanned == ["/d/b.py"] and facts.reason == "token budget exceeded: about 4 tokens were checked by regex only"
    none = scanned(spark, {"/d/x.py": b"x = 1"}, model=report.Model(words, people, labels))
    assert (none.model.first().used, none.model.first().reason) == (False, gate.NO_MODEL_NEEDED)


# Kept scans and the gate


def test_updates_equal_full_scans(spark, tmp_path):
    draw = random.Random(11)
    mail = lambda: f"user{draw.randrange(6)}@{draw.choice(['X', 'x'])}.jp"
    texts = {f"f{i}": [mail() for _ in range(draw.randrange(5))] for i in range(25)} | {"in.zip!odd": [mail()], "in.zip": [mail()]}
    times = dict.fromkeys(texts, 1)
    table = lambda: spark.createDataFrame([(p, len(t), times[p]) for p, t in texts.items()], "path string, length long, mtime long")
    scans = []

    def scan(changed):
        now = {r.path for r in changed.collect()}
        scans.append(now)
        rows = [(p, None, i + 1, "text", x) for p in now for i, x in enumerate(texts[p])]
        return detect(spark.createDataFrame(rows, "path string, page int, line int, kind string, text string"), DETECTORS)

    state = incremental.first_scan(table(), scan, str(tmp_path / "state"))
    for step in range(4):
        touched = draw.sample([p for p in texts if "!" not in p], 4) + (["in.zip!odd"] if step == 1 else [])
        for p in touched[:3] + touched[4:]:
            texts[p] = [mail() for _ in range(draw.randrange(4))]
            times[p] += 1
        texts.pop(touched[3])
        texts[f"new{step}"] = [mail()]
        times[f"new{step}"] = 1
        state = incremental.update(state, table(), scan)
        want = G.aggregate_findings(scan(table()), keep_seq=True)
        assert sorted(map(str, state.findings.collect())) == sorted(map(str, want.collect()))
        assert state.files.count() == len(texts) and len(scans[-2]) <= 7
    again = incremental.load(spark, state.folder, state.number)
    assert again.findings.count() == state.findings.count() and incremental.update(again, table(), scan).findings.count() == state.findings.count()
    assert scans[-1] == set()


def test_the_gate_takes_the_latest_report(spark):
    shape = "bundle string, created timestamp, fingerprint string, findings_count long, visual_images int, model_used boolean, model_reason string, not_model_scanned array<string>, reviewed boolean"
    at = lambda d: __import__("datetime").datetime(2026, 1, d)
    rows = [("a", at(1), "f", 0, 0, True, None, [], False), ("a", at(2), "f", 3, 0, True, None, [], False), ("b", at(3), "old", 0, 0, True, None, [], False), ("b", at(1), "f", 0, 0, True, None, [], False)]
    rows += [("c", at(1), "f", 2, 0, True, None, [], False), ("c", at(1), "f", 2, 0, True, None, [], True), ("d", None, "x", 0, 0, True, None, [], False), ("d", at(1), "f", 0, 0, True, None, [], None), (None, at(1), "f", 0, 1, True, None, ["p"], False)]
    current = spark.createDataFrame([(b, "f") for b in ("a", "b", "c", "d", "e", None)], "bundle string, fingerprint string")
    got = {r.bundle: (r.status, r.reasons) for r in gate.release_gate(spark.createDataFrame(rows, shape), current).collect()}
    assert got == {"a": ("needs review", ["3 finding(s)"]), "b": ("mismatched", []), "c": ("ok", ["2 finding(s)"]), "d": ("ok", []), "e": ("missing", None), None: ("needs review", ["1 image(s) for visual review", "token budget exceeded"])}


# Written tables


def exists(path):
    return os.path.exists(path.removeprefix("file://"))


def test_scratch_blocks_delete_their_own_tables(spark):
    def table(name, lasting=False):
        path = fresh_path(spark, name, lasting)
        spark.range(1).write.parquet(path)
        return path

    with scratch(spark):
        first = table("first")
        with scratch(spark):
            pass
        with scratch(spark):
            kept, gone = table("kept", lasting=True), table("gone")
        assert exists(kept) and not exists(gone)
        second = table("second")

        def other():
            with scratch(spark):
                table("other")

        thread = threading.Thread(target=other)
        thread.start()
        thread.join()
        assert exists(first) and exists(second)
    assert not (exists(first) or exists(second) or exists(kept))


def test_ranges_follow_the_data(spark):
    from tracewell.functions.tables import numbered, running_total

    rows = spark.createDataFrame([("a" if i % 3 else None, i, i % 7) for i in range(500)], "g string, i long, v long").repartition(5)
    got = running_total(rows, F.col("v"), "g", "i").collect()
    for g in ("a", None):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.i):
            total += r.v
            assert r.total == total
    assert [r.n for r in numbered(rows, F.col("i")).orderBy("i").collect()] == list(range(1, 501))


def test_scan_reports_no_pattern_of_one_rule_for_another(spark):
    assert scanned(spark, {"/d/a.txt": "普通預金 1234567 〒150-0041".encode()}, detectors=(BANK,)).findings.count() == 1


def test_files_are_made_once_for_their_scan(spark):
    """Names, refused places and contents are rows of one pass over the files."""
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pd.DataFrame({"path": [f"/data/{'.ssh/' if i == 3 else ''}{i}.txt" for i in pdf["id"]], "content": [b"token = abcdefgh" if i != 2 else None for i in pdf["id"]]})

    out = report.expanded_files(spark.range(5).mapInPandas(make, "path string, content binary")).collect()
    assert made.value == 5
    names = {f"/data/{i}.txt" for i in (0, 1, 2, 4)}
    assert {r.path for r in out if r.what == "name"} == names == {r.path for r in out if r.what == "file"}
    assert {bytes(r.content) for r in out if r.what == "file"} == {b"token = abcdefgh", b""}
    assert [(r.path, r.content, r.reason) for r in out if r.what == "skip"] == [("/data/.ssh/3.txt", None, "refused location: .ssh")]


def test_digests_of_files_that_no_row_holds(spark, tmp_path):
    """Spark puts no file over its limit into a row; digests are taken in pieces, of the files that Spark lists, whatever their names."""
    held = {"big": b"x" * 3_000_000, "a b%20#c?é.txt": b"1", "sub/@=+": b"2"}
    for name, raw in {**held, "_hidden": b"3", ".dot": b"4"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    limit = "spark.sql.sources.binaryFile.maxLength"
    listed = {(os.path.basename(r.path), r.length, r.sha256) for r in files.read_files(spark, str(tmp_path)).select("path", "length", F.sha2("content", 256).alias("sha256")).collect()}
    spark.conf.set(limit, 1_000_000)
    try:
        found = {(r.name, r.length, r.sha256) for r in queries.s1_read_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(limit)
    assert found == listed == {(os.path.basename(name), len(raw), hashlib.sha256(raw).hexdigest()) for name, raw in held.items()}


def test_whole_lines_are_scanned_for_reports_and_files(spark, tmp_path):
    """A value behind the 20,000th character of its line is found by the three queries that scan files, by others as before."""
    text = "a" * 25_000 + " mail late@corp.jp end"
    spark.createDataFrame([(7, text), (6, "mail soon@corp.jp end")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    both = {"late@corp.jp", "soon@corp.jp"}
    with scratch(spark):
        assert {r.value for r in queries.s10_write_report(spark, str(tmp_path)).collect()} == both
        assert {f"メールアドレス: {x}" for x in both} == {r.line.split(". ", 1)[1] for r in queries.s11_write_markdown(spark, str(tmp_path)).collect() if r.line.startswith("## ")}
        assert {r.name for r in queries.wl4_scan_files(spark, str(tmp_path)).where("what = 'finding'").collect()} >= both
    lines = report.lines_of(spark.createDataFrame([("x", text)], "path string, text string"))
    assert detect(lines).isEmpty() and detect(lines, chars=None).count() == 1
