import bz2
import glob
import gzip
import hashlib
import io
import os
import tarfile
import zipfile

from pyspark.sql import functions as F

from tracewell.jobs import gate
from tracewell.operators import credentials
from tracewell.sources import files


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), data)
    return out.getvalue()


def tarred(mode, **members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=f"w:{mode}") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name.replace("_dot_", "."))
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def expand(spark, **named):
    rows = [(k.replace("_dot_", "."), bytearray(v)) for k, v in named.items()]
    return files.expand_archives(spark.createDataFrame(rows, "path string, content binary"))


def test_archives(spark):
    inner = zipped(a_dot_txt=b"hello")
    deep = b"x"
    for _ in range(5):
        deep = zipped(n_dot_zip=deep)
    out = expand(spark, t_dot_tgz=tarred("gz", z_dot_zip=inner), deep_dot_zip=deep, bad_dot_zip=inner[:20], one_dot_gz=gzip.compress(b"plain"), two_dot_bz2=bz2.compress(b"more"), cut_dot_gz=gzip.compress(b"x" * 5000)[:30]).collect()
    content = {r.path: bytes(r.content) for r in out if r.what == "file"}
    assert content["t.tgz!z.zip!a.txt"] == b"hello"
    assert content["one.gz!<decompressed>"] == b"plain" and content["two.bz2!<decompressed>"] == b"more"
    skips = {r.path: r.reason for r in out if r.what == "skip"}
    assert skips["deep.zip!n.zip!n.zip!n.zip!n.zip"] == "archive nesting too deep"
    assert skips["bad.zip"] == "unreadable zip (BadZipFile)" and skips["cut.gz"].startswith("corrupt gzip stream")


def test_damaged_and_closed_files_leave_a_skip_row(spark):
    good = zipped(a_dot_txt=b"tel 03-1234-5678 " * 40)
    torn = bytearray(good)
    torn[60:80] = b"\xff" * 20
    stored = io.BytesIO()
    with zipfile.ZipFile(stored, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x.txt", b"abc" * 500)
        z.writestr("y.txt", b"def" * 500)
    deflated = bytearray(stored.getvalue())
    deflated[36:44] = b"\x07" * 8
    locked = bytearray(good)
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(mark) + at] |= 1
    gz = bytearray(gzip.compress(b"plain" * 100))
    gz[15] ^= 0xFF
    half = tarred("", a_dot_txt=b"one", b_dot_txt=b"two")[:1500]
    named = {"t.zip": torn, "d.zip": deflated, "l.zip": locked, "g.gz": gz, "s.7z": b"7z\xbc\xaf\x27\x1c...", "r.rar": b"Rar!\x1a\x07..", "z.zst": b"\x28\xb5\x2f\xfd..", "h.tgz": gzip.compress(half)}
    rows = [(k, bytearray(v)) for k, v in named.items()]
    out = files.expand_archives(spark.createDataFrame(rows, "path string, content binary")).collect()
    skips = {r.path: r.reason for r in out if r.what == "skip"}
    assert skips["t.zip"].startswith("unreadable zip") and skips["g.gz"].startswith("corrupt gzip stream")
    assert skips["d.zip"].startswith(("error (", "unreadable zip")) and {skips[x] for x in ("s.7z", "r.rar", "z.zst")} == {"uninspectable archive"}
    assert {r.path for r in out if r.path.startswith("l.zip") and r.what != "archive"} == {"l.zip!a.txt"} and not any(r.content for r in out if r.path.startswith("l.zip"))
    assert [bytes(r.content) for r in out if r.path == "h.tgz!a.txt" and r.what == "file"] == [b"one"]


def test_scan_of_files(spark):
    from tracewell.jobs.report import render_head, render_skipped, scan_files

    body = "<w:p>call 03-1234-5678 &eacute;</w:p>"
    docx = zipped(word__document_dot_xml=body, docProps__core_dot_xml="<dc:creator>Ann &#66;.</dc:creator>", word__media__p_dot_png=b"\x89PNG\r\n\x1a\n..")
    inner = zipped(notes_dot_txt="mail a@b.jp\n普通預金 1234567".encode(), d_dot_docx=docx)
    named = {
        "/data/in.zip": inner, "/data/090-1234-5678.txt": b"nothing", "/home/u/.ssh/id": b"tel 03-1111-2222", "/data/x.svg": b"<svg><text>&#43;81 90-1234-5678</text></svg>",
        "/data/b.bin": b"\x00\x01", "/data/c.pdf": b"%PDF-1.4", "/data/bad.zip": inner[:40], "/data/e.7z": b"7z\xbc\xaf\x27\x1c",
    }
    out = scan_files(spark.createDataFrame([(k, bytearray(v)) for k, v in named.items()], "path string, content binary"))
    found = {(r.category, r.value, r.locations[0].path, r.locations[0].kind) for r in out.findings.collect()}
    assert found == {
        ("private_phone", "03-1234-5678", "/data/in.zip!d.docx!word/document.xml", "office"), ("private_email", "a@b.jp", "/data/in.zip!notes.txt", "text"),
        ("account_number", "普通預金 1234567", "/data/in.zip!notes.txt", "text"), ("private_phone", "090-1234-5678", "/data/090-1234-5678.txt", "filename"),
        ("private_phone", "+81 90-1234-5678", "/data/x.svg", "text"), ("metadata_person", "Ann B.", "/data/in.zip!d.docx!docProps/core.xml", "metadata"),
    }
    skips = {r.path: r.reason for r in out.skipped.collect()}
    assert skips == {
        "/home/u/.ssh/id": "refused location: .ssh", "/data/b.bin": "binary (not PII-scanned)", "/data/c.pdf": "PDF without text layer (no OCR available)",
        "/data/bad.zip": "unreadable zip (BadZipFile)", "/data/e.7z": "uninspectable archive",
    }
    assert {r.path for r in out.images.collect()} == {"/data/in.zip!d.docx!word/media/p.png"}
    facts = out.summary.first()
    # Seven files that are not refused, and the three that archives and office files hold, d.docx among them.
    assert (facts.files_seen, facts.findings_count, facts.ok) == (10, 6, False) and len(facts.first_skipped) == 5
    assert render_head(out.summary).first().section.startswith("# PII report\n\n- findings: 6\n- model: NOT used\n")
    assert "- binary (not PII-scanned): 1 (e.g. /data/b.bin)" in {r.section for r in render_skipped(out.skipped).collect()}


def test_office_files(spark):
    body = "<w:p>one &amp; two</w:p><w:p>three</w:p>"
    docx = zipped(word__document_dot_xml=body, docProps__core_dot_xml="<dc:creator>Ann &lt;B&gt;</dc:creator>")
    sheet = zipped(xl__workbook_dot_xml="<x/>", xl__sharedStrings_dot_xml="<si><t>a</t></si><si><t>b</t></si>")
    odf = zipped(content_dot_xml="<text:p>p</text:p>", mimetype="m", meta_dot_xml="<meta:initial-creator>Eve</meta:initial-creator>")
    out = expand(spark, d_dot_docx=docx, s_dot_xlsx=sheet, o_dot_odt=odf)
    texts = {r.path: r.text for r in files.office_text(out).collect()}
    assert texts["d.docx!word/document.xml"] == "one & two\nthree\n" and texts["s.xlsx!xl/sharedStrings.xml"] == "a\nb\n"
    assert {(r.tag, r.value) for r in files.office_authors(out).collect()} == {("dc:creator", "Ann <B>"), ("meta:initial-creator", "Eve")}


def test_decoding(spark):
    cases = [("é日".encode(), "é日"), ("é".encode("utf-16"), "é"), ("日本".encode("cp932"), "日本"), (b"a\0b", None), (b"\x81", None), (b"", "")]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, content binary")
    got = dict(rows.select("i", files.decode_text(F.col("content"))).collect())
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_reading_and_sniffing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.png").write_bytes(b"x")
    (tmp_path / "c.tar").write_bytes(tarred("", f=b"1"))
    found = files.read_files(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in found.select("path", files.sniff_kind(F.col("content"), F.col("path")).alias("kind")).collect()}
    assert kinds == {"a.pdf": "pdf", "b.png": "image", "c.tar": "tar"}
    small = found.select("path", "length")
    assert small.count() == 3


def test_entities_like_python(spark):
    import html

    from tracewell.functions import text as T

    texts = ["a &amp;lt; b", "&eacute;&#233;&#xE9;&notit;&#x80;&nosuch; & &", "none", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.unescape(F.col("t")).alias("u")).collect()
    assert all(r.u == (html.unescape(r.t) if r.t is not None else None) for r in rows)


def test_only_one_space_between_characters_goes(spark):
    from tracewell.functions import text as T

    rows = spark.createDataFrame([("東 京 都  渋\n谷 a",)], "t string")
    assert rows.select(T.cjk_despace(F.col("t"))).first()[0] == "東京都  渋谷 a"


def test_limits_are_strict(spark):
    rows = spark.createDataFrame([("a", 30_000_000), ("b", 30_000_001)], "path string, length long")
    assert [r.over_download for r in files.size_flags(rows).orderBy("path").collect()] == [False, True]


def test_credentials_are_masked(spark):
    token = "11acdfb36bb72224148e6160f674b4be45601bff"
    lines = spark.createDataFrame([("p", 1, f'token = "{token}"'), ("p", 2, "nothing")], "path string, line int, text string")
    hits = credentials.credential_hits(lines).collect()
    assert [h.rule for h in hits] == ["assigned_secret"] and token not in hits[0].detail and hits[0].detail.startswith("toke***")
    named = spark.createDataFrame([("x/.env",), ("x/auth.json",), ("x/readme.md",)], "path string")
    assert {r.path for r in credentials.refused_files(named).collect()} == {"x/.env", "x/auth.json"}


def test_expiry_and_requests(spark):
    import base64

    good = "h." + base64.urlsafe_b64encode(b'{"d_expiry":"2026-10-12"}').decode().rstrip("=") + ".s"
    rows = spark.createDataFrame([(1, good), (2, "garbage"), (3, None), (4, "a.b!.c")], "i int, jwt string")
    got = dict(rows.select("i", gate.expiry_date(F.col("jwt"), F.lit(7), F.to_date(F.lit("2026-01-01")))).collect())
    assert got == {1: "2026-10-12", 2: "2026-01-08", 3: "2026-01-08", 4: "2026-01-08"}
    schema = "id long, url string, lifetime int, dlkey string, delkey string, chunk_mb int"
    asks = [(1, None, 8, "1", None, 1), (2, None, 7, "12345", None, 1), (3, None, 7, "1", "ab1", 1), (4, "https://12.share.example/0101-abc", 7, "1", "ab12", 100), (5, None, None, None, None, None)]
    out = {r.id: (r.error, r.file_id) for r in gate.validate_share_requests(spark.createDataFrame(asks, schema)).collect()}
    assert out[4] == (None, "0101-abc") and all(out[i][0] for i in (1, 2, 3, 5))


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    from tracewell.jobs.report import lines_of
    from tracewell.operators.detectors import detect
    from tracewell.streaming.detection import write_matches

    rows = spark.createDataFrame([("a", "tel 03-1234-5678\nx@y.jp"), ("b", "none")], "path string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    write_matches(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert {r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {r.value for r in detect(lines_of(rows)).collect()}


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_fingerprint_holds_no_bundle_in_a_row(spark):
    rows = [("big" if i % 3 else None if i % 2 else "små", f"p{i * 7919 % 3001}", i, None if i % 50 == 0 else i) for i in range(3000)]
    out = files.fingerprint(spark.createDataFrame(rows, "bundle string, path string, length long, mtime long"))
    assert "collect_list" not in out._jdf.queryExecution().toString()
    want = {}
    for bundle, *entry in rows:
        want.setdefault(bundle, []).append("\x00".join(str(x) for x in entry if x is not None))
    want = {b: hashlib.sha256(("\n".join(sorted(e)) + "\n").encode()).hexdigest() for b, e in want.items()}
    assert {r.bundle: r.fingerprint for r in out.collect()} == want


def test_only_other_encodings_go_to_python(spark, tmp_path):
    """Of UTF-8, binary and UTF-16 files, the function in Python gets the last; texts are right over several of its steps."""
    kinds = [b"caf\xc3\xa9 %d", b"\0 %d", None, "表 %d".encode("cp932"), b"\x81 %d"]
    raws = [kinds[i % 5] % i if kinds[i % 5] else f"é{i}".encode("utf-16") for i in range(700)]
    want = [[f"café {i}", None, f"é{i}", f"表 {i}", None][i % 5] for i in range(700)]
    df = spark.createDataFrame(list(enumerate(raws)), "i int, content binary").coalesce(1)
    assert [r.t for r in df.select("i", files.decode_text(F.col("content")).alias("t")).orderBy("i").collect()] == want
    # What Python gets is null but for the others, so a function that notes what it gets sees no other.
    seen = str(tmp_path)

    @F.udf("string")
    def noting(raw):
        with open(f"{seen}/{os.getpid()}", "a") as out:
            out.write(f"{raw is None}\n")

    held, files._decode_other = files._decode_other, noting
    try:
        df.select(files.decode_text(F.col("content"))).collect()
    finally:
        files._decode_other = held
    noted = [x for p in glob.glob(f"{seen}/*") for x in open(p).read().split()]
    assert noted.count("False") == 3 * 140 and noted.count("True") == 2 * 140
