"""Registered queries of the library, one per operator, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.functions import text as T
from tracewell.functions.tables import fresh_path, materialized
from tracewell.jobs import gate, incremental, report
from tracewell.jobs.inputs import SQL_LINES, SQL_SYNTH, customers, dealt_documents, doc_path, document_texts, synthetic_lines, table
from tracewell.operators import credentials, detectors, findings, images, merge, model
from tracewell.sources import files, tree

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return report.lines_of(document_texts(spark, d))


def _all_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).unionByName(synthetic_lines(spark, d))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: bundle, path, length, mtime."""
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("bundle"), doc_path().alias("path"), (F.octet_length("text").cast("long") * F.when(i % 97 == 0, 40_000).otherwise(1)).cast("long").alias("length"), (i * 1000 + 7).alias("mtime"), "text"
    )


FILES_SQL = "f AS (SELECT doc_id, source AS bundle, 'doc/' || doc_id || '.txt' AS path, (strlen(text) * CASE WHEN doc_id % 97 = 0 THEN 40000 ELSE 1 END)::BIGINT AS length, doc_id * 1000 + 7 AS mtime, text FROM documents)"


# Sources


@query()
def s1_read_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of the tables themselves with their digests; tests/ compares with what was written."""
    return tree.file_digests(spark, d).select(files.basename(F.col("path")).alias("name"), "length", "sha256")


@query()
def s1_read_tree(spark: SparkSession, d: str) -> DataFrame:
    """The files of the tables as the data source lists and reads them, with digests of those that are held whole."""
    found = tree.read_tree(spark, d).where("what != 'name'")
    return found.select(files.basename(F.col("path")).alias("name"), "what", F.sha2("content", 256).alias("sha256"), "reason")


@query(f"""WITH p AS (SELECT doc_id, CASE doc_id % 20 WHEN 0 THEN '/home/u/.ssh/' WHEN 1 THEN '/mnt/skills/' WHEN 2 THEN '/home/u/.config/' ELSE '/data/' END || doc_id AS path FROM documents)
SELECT path, 'refused location: ' || CASE doc_id % 20 WHEN 0 THEN '.ssh' WHEN 1 THEN '/mnt/skills' ELSE '.config' END AS reason FROM p WHERE doc_id % 20 < 3""")
def s2_split_refused(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 20
    head = F.when(m == 0, "/home/u/.ssh/").when(m == 1, "/mnt/skills/").when(m == 2, "/home/u/.config/").otherwise("/data/")
    return files.split_refused(table(spark, d, "documents").select(F.concat(head, F.col("doc_id").cast("string")).alias("path")))[1]


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN text END AS text FROM documents")
def s3_decode_text(spark: SparkSession, d: str) -> DataFrame:
    raw, m = F.encode("text", "UTF-8"), F.col("doc_id") % 3
    content = F.when(m == 0, raw).when(m == 1, F.encode("text", "UTF-16")).otherwise(F.concat(F.unhex(F.lit("00")), raw))
    return table(spark, d, "documents").select("doc_id", files.decode_text(content).alias("text"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'zip' WHEN 3 THEN 'gzip' WHEN 4 THEN 'x:7z'
  ELSE CASE WHEN text LIKE '\\%PDF%' ESCAPE '\\' THEN 'pdf' WHEN regexp_matches(text, '^(BM|GIF8[79]a)') THEN 'image' WHEN text LIKE 'BZh%' THEN 'bz2' ELSE 'raw' END END AS kind FROM documents""".replace("\\\\", "\\"))
def s4_sniff_kind(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 6
    head = F.when(m == 0, "25504446").when(m == 1, "FFD8FF").when(m == 2, "504B0304").when(m == 3, "1F8B").when(m == 4, "377ABCAF271C").otherwise("")
    return table(spark, d, "documents").select("doc_id", files.sniff_kind(F.concat(F.unhex(head), F.encode("text", "UTF-8")), doc_path()).alias("kind"))


def _archives(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files(path, content): archives of several members and levels, some cut short, and other kinds that can't be read.

    Each holds its document as a text with some lines after it; every third one an archive (a compressed tar or a
    zip) with two more files, of which the second of every fifteenth is an archive that can't be looked into; every
    tenth one a file that is a credential by its name.
    """
    import gzip
    import io
    import tarfile
    import zipfile

    import pandas as pd

    def zipped(members):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, raw in members.items():
                z.writestr(name, raw)
        return held.getvalue()

    def tarred(members):
        held = io.BytesIO()
        with tarfile.open(fileobj=held, mode="w") as t:
            for name, raw in members.items():
                info = tarfile.TarInfo(name)
                info.size = len(raw)
                t.addfile(info, io.BytesIO(raw))
        return gzip.compress(held.getvalue(), mtime=0)

    def one(i, text):
        secret = f'\npassword = "hunter{i}xyz"' if i % 9 == 0 else ""
        members = {f"{i}.txt": f"{text or ''}\n普通預金 {i * 13 % 10**7:07d}{secret}".encode()}
        if i % 3 == 0:
            inner = {f"deep/{i}.md": f"mail User{i % 500}@corp{i % 7}.jp end\n\ntel +81 090-{i % 10**4:04d}-{i * 7 % 10**4:04d}".encode(), f"deep/{i}.x": b"7z\xbc\xaf\x27\x1c" if i % 15 == 0 else b"\0"}
            members["in"] = tarred(inner) if i % 2 else zipped(inner)
        if i % 10 == 0:
            members["conf/.env"] = b"A=1"
        return zipped(members)

    def packed(batches):
        for pdf in batches:
            raws = [one(i, text) for i, text in zip(pdf["doc_id"], pdf["text"])]
            out = [{1: raw[:-30], 2: b"7z\xbc\xaf\x27\x1c" + raw, 3: b"\0" + raw, 4: b"%PDF-" + raw}.get(i % 25, raw) for i, raw in zip(pdf["doc_id"], raws)]
            yield pd.DataFrame({"path": [f"/data/{'.ssh/' if i % 25 == 5 else ''}{i}.zip" for i in pdf["doc_id"]], "content": out})

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(packed, "path string, content binary")


#: k: the archives; me: the members that hold text (path, text) of those that can be read.
ARCHIVES_SQL = """k AS (SELECT doc_id, doc_id % 25 AS m, '/data/' || CASE WHEN doc_id % 25 = 5 THEN '.ssh/' ELSE '' END || doc_id || '.zip' AS path, coalesce(text, '') AS text FROM documents),
me AS (SELECT doc_id, path || '!' || doc_id || '.txt' AS path, text || chr(10) || '普通預金 ' || lpad((doc_id * 13 % 10000000)::varchar, 7, '0') || CASE WHEN doc_id % 9 = 0 THEN chr(10) || 'password = "hunter' || doc_id || 'xyz"' ELSE '' END AS text FROM k WHERE m = 0 OR m > 4
UNION ALL SELECT doc_id, path || '!in!deep/' || doc_id || '.md', 'mail User' || doc_id % 500 || '@corp' || doc_id % 7 || '.jp end' || chr(10) || chr(10) || 'tel +81 090-' || lpad((doc_id % 10000)::varchar, 4, '0') || '-' || lpad((doc_id * 7 % 10000)::varchar, 4, '0') FROM k WHERE (m = 0 OR m > 4) AND doc_id % 3 = 0
UNION ALL SELECT doc_id, path || '!conf/.env', 'A=1' FROM k WHERE (m = 0 OR m > 4) AND doc_id % 10 = 0)"""


@query(f"""WITH {ARCHIVES_SQL}, r AS (SELECT * FROM k WHERE m = 0 OR m > 4)
SELECT path, 'skip' AS what, NULL AS sha256, CASE m WHEN 1 THEN 'unreadable zip (BadZipFile)' ELSE 'uninspectable archive' END AS reason FROM k WHERE m IN (1, 2)
UNION ALL SELECT path, 'archive', NULL, NULL FROM k WHERE m NOT IN (3, 4)
UNION ALL SELECT path, 'name', NULL, NULL FROM me UNION ALL SELECT path, 'file', sha256(text), NULL FROM me
UNION ALL SELECT path || '!in', unnest(['name', 'archive']), NULL, NULL FROM r WHERE doc_id % 3 = 0
UNION ALL SELECT path || '!in!deep/' || doc_id || '.x', 'name', NULL, NULL FROM r WHERE doc_id % 3 = 0
UNION ALL SELECT path || '!in!deep/' || doc_id || '.x', 'file', sha256(chr(0)), NULL FROM r WHERE doc_id % 3 = 0 AND doc_id % 15 > 0
UNION ALL SELECT path || '!in!deep/' || doc_id || '.x', 'archive', NULL, NULL FROM r WHERE doc_id % 15 = 0
UNION ALL SELECT path || '!in!deep/' || doc_id || '.x', 'skip', NULL, 'uninspectable archive' FROM r WHERE doc_id % 15 = 0""")
def s5_expand_archives(spark: SparkSession, d: str) -> DataFrame:
    """Members come out whole; damaged archives and kinds that can't be opened leave skip rows. Files that are no archive are not listed."""
    out = files.expand_archives(_archives(spark, d)).where("what != 'file' OR path LIKE '%!%'")
    return out.select("path", "what", F.sha2("content", 256).alias("sha256"), "reason")


@query("""WITH p AS (SELECT doc_id, replace(text, chr(10), chr(12)) AS t FROM documents WHERE length(trim(text, ' ' || chr(10) || chr(12) || chr(9))) >= 20),
q AS (SELECT doc_id, unnest(string_split(t, chr(12))) AS text, generate_subscripts(string_split(t, chr(12)), 1) AS page FROM p)
SELECT doc_id, page::INT AS page, text FROM q WHERE NOT regexp_matches(text, '^\\s*$')""".replace("\\\\", "\\"))
def s7_split_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.translate("text", "\n", "\f").alias("text"))
    return T.split_pages(docs, "doc_id").select("doc_id", "page", "text")


@query(f"WITH {SQL_LINES} SELECT path, line::INT AS line, text FROM lines")
def s8_to_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("path", "line", "text")


@query("SELECT 'a/b!c/doc ' || doc_id || '.txt' AS path, 'filename' AS kind, 'doc ' || doc_id || '.txt' AS text FROM documents")
def s9_add_filenames(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "documents").select(F.concat(F.lit("a/b!c/doc "), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return files.add_filenames(named).select("path", "kind", "text")


@query(r"""WITH x AS (SELECT 'd' || doc_id || '!word/document.xml' AS path, '<w:p>' || replace(text, chr(10), '</w:p><w:p>') || '</w:p>' AS t FROM documents)
SELECT path, replace(replace(replace(replace(replace(replace(regexp_replace(replace(t, '</w:p>', chr(10)), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS text FROM x""")
def s6_office_text(spark: SparkSession, d: str) -> DataFrame:
    xml = F.concat(F.lit("<w:p>"), F.replace("text", F.lit("\n"), F.lit("</w:p><w:p>")), F.lit("</w:p>"))
    parts = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("!word/document.xml")).alias("path"), F.lit("part").alias("what"), F.encode(xml, "UTF-8").alias("content"))
    return files.office_text(parts)


# Filters


@query("SELECT doc_id, CASE doc_id % 5 WHEN 4 THEN FALSE ELSE TRUE END AS prose FROM documents")
def p1_is_prose(spark: SparkSession, d: str) -> DataFrame:
    m, i = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    path = F.when(m == 0, F.concat(i, F.lit(".MD"))).when(m == 1, F.concat(F.lit("x/"), i, F.lit("/README"))).when(m == 2, F.concat(F.lit("z!"), i, F.lit(".html"))).when(m == 3, F.lit("LICENSE.bin")).otherwise(F.concat(i, F.lit(".py")))
    return table(spark, d, "documents").select("doc_id", files.is_prose(path).alias("prose"))


@query(rf"""WITH {SQL_LINES}
SELECT path, line::INT AS line FROM lines WHERE length(text) <= 2000 AND (substring(path, 5) LIKE '%0.txt' OR regexp_matches(text,
  '@|[0-9]{{2,4}}[-\s][0-9]{{2,4}}[-\s][0-9]{{3,4}}|(^|[^\pL\pN_])[A-Z][a-z]+ [A-Z][a-z]+($|[^\pL\pN_])|(?i:name|address|addr|phone|tel|mobile|e-?mail|birth|dob|author|copyright|contact|owner|street|city|zip|postal|customer)'))""")
def p2_model_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose number ends in 0 are prose, the others code."""
    as_code = F.when(F.col("path").rlike(r"0\.txt$"), F.col("path")).otherwise(F.replace("path", F.lit(".txt"), F.lit(".py")))
    lines = _lines(spark, d).withColumn("path", as_code)
    return model.model_candidates(lines).select(F.replace("path", F.lit(".py"), F.lit(".txt")).alias("path"), "line")


@query("SELECT c_custkey, regexp_matches(c_name || '.txt', ' |[A-Z][a-z]+[_.-][A-Z][a-z]+') AS human FROM customer")
def p3_human_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", model.human_filename(F.concat("c_name", F.lit(".txt"))).alias("human"))


@query(f"WITH {FILES_SQL} SELECT path, length, length > 30000000 AS over_download, length > 52428800 AS text_too_large, length > 322122547200 AS refused FROM f")
def p4_size_flags(spark: SparkSession, d: str) -> DataFrame:
    return files.size_flags(_files(spark, d))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("id"),
        F.concat(F.lit("src"), (k % 25).cast("string")).alias("bundle"),
        F.when(k % 7 == 0, "ftp://x").otherwise(F.concat(F.lit("https://"), (k % 200).cast("string"), F.lit(".share.example/0101-ab"), k.cast("string"))).alias("url"),
        F.when(k % 11 == 0, 8).otherwise(7).cast("int").alias("lifetime"),
        F.when(k % 13 == 0, "12345").otherwise(F.concat(F.lit("k"), (k % 100).cast("string"))).alias("dlkey"),
        F.when(k % 17 == 0, "ab1").otherwise("ab12").alias("delkey"),
        F.when(k % 19 == 0, 101).otherwise(100).cast("int").alias("chunk_mb"),
    )


REQUESTS_SQL = """r AS (SELECT o_orderkey AS id, 'src' || (o_orderkey % 25) AS bundle,
  CASE WHEN o_orderkey % 7 = 0 THEN 'ftp://x' ELSE 'https://' || (o_orderkey % 200) || '.share.example/0101-ab' || o_orderkey END AS url,
  CASE WHEN o_orderkey % 13 = 0 THEN 'dlkey must be 1-4 letters or digits' WHEN o_orderkey % 11 = 0 THEN 'lifetime must be one of (3, 5, 7, 14, 30, 60, 100)'
       WHEN o_orderkey % 19 = 0 THEN 'chunk_mb must be between 1 and 100' WHEN o_orderkey % 7 = 0 THEN 'url is not a share link' WHEN o_orderkey % 17 = 0 THEN 'delkey must be 4 letters or digits' END AS error
  FROM orders)"""


@query(f"WITH {REQUESTS_SQL} SELECT id, error, CASE WHEN id % 7 <> 0 THEN (id % 200) || '.share.example' END AS server, CASE WHEN id % 7 <> 0 THEN '0101-ab' || id END AS file_id FROM r")
def p5_validate_share_requests(spark: SparkSession, d: str) -> DataFrame:
    return gate.validate_share_requests(_requests(spark, d)).select("id", "error", "server", "file_id")


@query("SELECT o_orderkey, value FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN ' x ' WHEN 1 THEN '--' ELSE o_orderpriority END AS value, (o_orderkey % 100) / 100.0 AS score FROM orders) WHERE score >= 0.6 AND length(trim(value)) >= 2 AND value <> '--'")
def p6_accept_spans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, " x ").when(k % 4 == 1, "--").otherwise(F.col("o_orderpriority"))
    return model.accept_spans(table(spark, d, "orders").select("o_orderkey", value.alias("value"), ((k % 100) / 100).alias("score"))).select("o_orderkey", "value")


# Detectors


def _detected(spark: SparkSession, d: str, *rules: detectors.Detector) -> DataFrame:
    return detectors.detect(_all_lines(spark, d), rules).select("category", "path", "line", "value")


def _found_sql(pattern: str, category: str, valid: str = "TRUE", group: int = 0, where: str = "TRUE") -> str:
    return rf"""WITH {SQL_LINES}, {SQL_SYNTH}, a AS (SELECT path, line, left(text, 20000) AS text FROM lines UNION ALL SELECT path, line, text FROM synth),
m AS (SELECT path, line, text, unnest(regexp_extract_all(text, '{pattern}', {group})) AS value FROM a WHERE {where}),
n AS (SELECT path, line, text, value AS raw, trim(regexp_replace(value, '\s+', ' ', 'g'), ' ,;:()<>[]{{}}"''`') AS value, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM m)
SELECT '{category}' AS category, path, line::INT AS line, value FROM n WHERE {valid}"""


_LUHN = "(list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(digits, (length(digits) + 1 - i)::INT, 1)::INT ELSE (2 * substr(digits, (length(digits) + 1 - i)::INT, 1)::INT) // 10 + (2 * substr(digits, (length(digits) + 1 - i)::INT, 1)::INT) % 10 END)) % 10 = 0)"
_MAIL = r"(?:^|[^\pL\pN_.%+-])([A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,24})(?:$|[^\pL\pN_-])"


@query(_found_sql(_MAIL, "private_email", r"NOT regexp_matches(raw, '@([A-Za-z0-9_\-]+\.)*(example\.(com|org|net)|example|test|invalid|localhost)$')", 1))
def d1_email(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d, detectors.email())


@query(_found_sql(_MAIL, "private_email", "TRUE", 1))
def d1_email_all_domains(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d, detectors.email(ignored=None))


@query(_found_sql(r"(?:^|[^0-9\-])(0[0-9]{1,4}-[0-9]{1,4}-[0-9]{3,4}|0[5789]0[0-9]{8}|\(0[0-9]{1,4}\)\s?[0-9]{1,4}-[0-9]{4})(?:$|[^0-9\-])", "private_phone", "length(digits) BETWEEN 10 AND 15", 1))
def d2_jp_phone(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d, detectors.JP_PHONE)


@query(_found_sql(r"(?:^|[^\pL\pN_+])(\+[0-9]{1,3}[\s\-]?\(?[0-9]{1,4}\)?(?:[\s\-]?[0-9]{2,4}){2,4})(?:$|[^0-9])", "private_phone", "length(digits) BETWEEN 10 AND 15", 1))
def d3_intl_phone(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d, detectors.INTL_PHONE)


@query(_found_sql(r"〒\s?[0-9]{3}-?[0-9]{4}", "private_address"))
def d4_postal_code(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d, detectors.POSTAL)


def _address_lines(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in every prefecture, with all kinds of block numbers, some with none."""
    k = F.col("c_custkey").cast("long")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))
    text = F.concat(F.lit("所在地 "), pick(P.PREFECTURES.split("|"), k), pick(ADDRESS_TOWNS, F.floor(k / 7)), F.lit("本町"), pick(ADDRESS_BLOCKS, F.floor(k / 3)), F.lit(" 終"))
    return customers(spark, d).select(F.concat(F.lit("addr/"), k.cast("string")).alias("path"), F.lit(None).cast("int").alias("page"), F.lit(1).alias("line"), F.lit("text").alias("kind"), text.alias("text"))


ADDRESS_TOWNS = ("中央区", "北市", "港町", "東村", "西郡南町", "丘")
ADDRESS_BLOCKS = ("1丁目2-3", "一丁目２番３号", "12番地", "５－６－７", "3ー4", "十番", "", "名", "七丁目8-9号")
_list = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: What the rule takes of each block: a chome, a ban or numbers joined by a hyphen, then up to two more numbers.
ADDRESS_FOUND = ("1丁目2-3", "一丁目２", "12番地", "５－６－７", "3ー4", "十番", None, None, "七丁目8-9号")


@query(f"""WITH a AS (SELECT 'addr/' || c_custkey AS path, {_list(P.PREFECTURES.split("|"))}[c_custkey % 47 + 1] || {_list(ADDRESS_TOWNS)}[c_custkey // 7 % 6 + 1] || '本町' AS head, {_list(ADDRESS_FOUND).replace("'None'", "NULL")}[c_custkey // 3 % 9 + 1] AS block FROM customer)
SELECT 'private_address' AS category, path, 1 AS line, head || block AS value FROM a WHERE block IS NOT NULL""")
def d5_address(spark: SparkSession, d: str) -> DataFrame:
    return detectors.detect(_address_lines(spark, d), (detectors.ADDRESS,)).select("category", "path", "line", "value")


_MY = " + ".join(f"substr(digits, {11 - k}, 1)::INT * {k + 2 if k <= 5 else k - 4}" for k in range(11))


@query(_found_sql(r"[0-9]{4} [0-9]{4} [0-9]{4}", "my_number", f"CASE WHEN ({_MY}) % 11 <= 1 THEN 0 ELSE 11 - ({_MY}) % 11 END = substr(digits, 12, 1)::INT", where="contains(text, '個人番号')"))
def d6_my_number(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d, detectors.MY_NUMBER)


_CARD = r"(?:^|[^0-9])((?:[0-9]{4}[ \-]){3}[0-9]{1,7}|[0-9]{14,16})(?:$|[^0-9])"
_CARD_OK = f"length(digits) IN (14, 15, 16, 19) AND {_LUHN} AND regexp_matches(digits, '^(4|5[1-5]|2[2-7]|3[47]|35|36|38|6)')"


@query(_found_sql(_CARD, "account_number", _CARD_OK + " AND (regexp_matches(raw, '[^0-9]') OR regexp_matches(text, '(?i)card|credit|visa|master|amex|jcb'))", 1))
def d7_card(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d, detectors.card())


# Bare digits as whole runs, since two of them may share the space between them.
@query(_found_sql(r"[0-9]+", "account_number", "length(raw) BETWEEN 14 AND 16 AND " + _CARD_OK) + " UNION ALL " + _found_sql(r"(?:^|[^0-9])((?:[0-9]{4}[ \-]){3}[0-9]{1,7})(?:$|[^0-9])", "account_number", _CARD_OK, 1).replace("WITH ", "SELECT * FROM (WITH ", 1) + ")")
def d7_card_any_context(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d, detectors.card(require_context=False))


BANK_WORDS = ("口座番号", "普通預金", "当座預金", "普通", "当座", "貯蓄")
BANK_MARKS = (" ", ":", "：No.", " No ", "")
BANK_NUMBERS = ("1234567", "７６５４３２１", "12345678", "123456")


@query(rf"""WITH a AS (SELECT 'bank/' || c_custkey AS path, '振込先 ' || {_list(BANK_WORDS)}[c_custkey % 6 + 1] || {_list(BANK_MARKS)}[c_custkey // 6 % 5 + 1] || {_list(BANK_NUMBERS)}[c_custkey // 30 % 4 + 1] || ' ' AS text FROM customer)
SELECT 'account_number' AS category, path, 1 AS line, unnest(regexp_extract_all(text, '((?:口座番号|普通預金|当座預金|普通|当座) *[:：]? *(?:No[.]? *)?[0-9０-９]{{7}})[^0-9０-９]', 1)) AS value FROM a""")
def d8_bank_account(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("long")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), (at % len(values)).cast("int"))
    text = F.concat(F.lit("振込先 "), pick(BANK_WORDS, k), pick(BANK_MARKS, F.floor(k / 6)), pick(BANK_NUMBERS, F.floor(k / 30)), F.lit(" "))
    lines = customers(spark, d).select(F.concat(F.lit("bank/"), k.cast("string")).alias("path"), F.lit(None).cast("int").alias("page"), F.lit(1).alias("line"), F.lit("text").alias("kind"), text.alias("text"))
    return detectors.detect(lines, (detectors.BANK,)).select("category", "path", "line", "value")


def _credential_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents' lines and, for each customer, a token of each public format."""
    k = F.col("c_custkey").cast("string")
    fill = lambda n: F.rpad(F.concat(k, F.lit("Q")), n, "7")
    texts = F.array(
        F.concat(F.lit("id AKIA"), F.rpad(k, 16, "Z"), F.lit(" end")), F.lit("-----BEGIN RSA PRIVATE KEY-----"), F.concat(F.lit("ghp_"), fill(36)), F.concat(F.lit("xoxb-"), fill(12)),
        F.concat(F.lit("AIza"), fill(35), F.lit(" ")), F.concat(F.lit("sk_live_"), fill(16)), F.concat(F.lit("eyJ"), fill(10), F.lit("."), fill(10), F.lit("."), fill(10)), F.concat(F.lit('Password: "'), fill(8), F.lit('"')),
    )
    own = customers(spark, d).select(F.concat(F.lit("cred/"), k).alias("path"), F.posexplode(texts).alias("_i", "text")).select("path", (F.col("_i") + 1).alias("line"), "text")
    return _lines(spark, d).select("path", "line", "text").unionByName(own)


# What each customer's tokens are by their formats: rule, first characters, length. In documents, assignments are the only kind.
@query(rf"""WITH {SQL_LINES}, t AS (SELECT unnest([{{'line': 1, 'rule': 'aws_access_key', 'head': 'AKIA', 'n': 20}}, {{'line': 2, 'rule': 'private_key', 'head': '----', 'n': 31}}, {{'line': 3, 'rule': 'github_token', 'head': 'ghp_', 'n': 40}}, {{'line': 4, 'rule': 'slack_token', 'head': 'xoxb', 'n': 17}},
  {{'line': 5, 'rule': 'google_api_key', 'head': 'AIza', 'n': 39}}, {{'line': 6, 'rule': 'stripe_key', 'head': 'sk_l', 'n': 24}}, {{'line': 7, 'rule': 'json_web_token', 'head': 'eyJ' , 'n': 35}}, {{'line': 8, 'rule': 'assigned_secret', 'head': 'Pass', 'n': 19}}]) AS x),
m AS (SELECT path, line, unnest(regexp_extract_all(text, '(?i:api_?key|passw(?:or)?d|secret|token)[''"]?[ ]?[=:][ ]?[''"]?[0-9A-Za-z=._/+-]{{8,}}')) AS v FROM lines)
SELECT path, line::INT AS line, 'assigned_secret' AS rule, left(v, 4) || repeat('*', length(v) - 4) AS detail FROM m
UNION ALL SELECT 'cred/' || c_custkey, x.line, x.rule, CASE x.line WHEN 7 THEN 'eyJ' || left(c_custkey::varchar, 1) ELSE x.head END || repeat('*', x.n - 4) FROM customer, t""")
def d9_credentials(spark: SparkSession, d: str) -> DataFrame:
    return credentials.credential_hits(_credential_lines(spark, d))


@query("SELECT path, 'credential_file' AS rule, string_split(path, '/')[-1] AS detail FROM (SELECT 'h/' || doc_id || '/' || ['.env', '.env.local', 'auth.json', 'id_rsa', 'key.PEM', 'readme.md', 'my.envelope', 'store.jks'][doc_id % 8 + 1] AS path FROM documents) WHERE NOT regexp_matches(path, 'md$|envelope$')")
def d9_refused_files(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, (".env", ".env.local", "auth.json", "id_rsa", "key.PEM", "readme.md", "my.envelope", "store.jks")))
    i = F.col("doc_id")
    path = F.concat(F.lit("h/"), i.cast("string"), F.lit("/"), F.get(names, (i % 8).cast("int")))
    return credentials.refused_files(table(spark, d, "documents").select(path.alias("path"))).select("path", "rule", "detail")


def _image_meta(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    dms = lambda a, b, c: F.array(a.cast("double"), b.cast("double"), c.cast("double"))
    gps = F.struct(dms(k % 90, k % 60, k % 50).alias("lat"), F.when(k % 2 == 0, "S").otherwise("N").alias("lat_ref"), F.when(k % 5 > 0, dms(k % 180, k % 31, k % 17)).alias("lon"), F.when(k % 3 == 0, "W").otherwise("E").alias("lon_ref"))
    tag = F.when(k % 4 == 0, "Artist").when(k % 4 == 1, "Copyright").when(k % 4 == 2, "ImageDescription").otherwise("author")
    return table(spark, d, "orders").select(F.concat(F.lit("img/"), k.cast("string"), F.lit(".jpg")).alias("path"), gps.alias("gps"), tag.alias("tag"), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("value"))


@query("""WITH o AS (SELECT 'img/' || o_orderkey || '.jpg' AS path, (o_orderkey % 90 + (o_orderkey % 60)::DOUBLE / 60 + (o_orderkey % 50)::DOUBLE / 3600) * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END AS lat,
  (o_orderkey % 180 + (o_orderkey % 31)::DOUBLE / 60 + (o_orderkey % 17)::DOUBLE / 3600) * CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END AS lon FROM orders WHERE o_orderkey % 5 > 0)
SELECT path, 'location_gps' AS category, printf('%.6f, %.6f', lat, lon) AS value FROM o""")
def d10_image_gps(spark: SparkSession, d: str) -> DataFrame:
    return images.gps_findings(_image_meta(spark, d)).select("path", "category", "value")


@query("""WITH o AS (SELECT 'img/' || o_orderkey || '.jpg' AS path, CASE o_orderkey % 4 WHEN 0 THEN 'Artist' WHEN 1 THEN 'Copyright' WHEN 2 THEN 'ImageDescription' ELSE 'author' END AS tag, o_orderpriority AS value FROM orders)
SELECT path, 'metadata_person' AS category, value, tag || ' = ' || value AS context FROM o WHERE tag <> 'ImageDescription'""")
def d11_author_metadata(spark: SparkSession, d: str) -> DataFrame:
    return images.author_metadata(_image_meta(spark, d))


@query("SELECT 'img/' || o_orderkey || '.jpg' AS path, 1 AS line, 'metadata' AS kind, o_orderpriority AS text FROM orders WHERE o_orderkey % 4 = 2")
def d11_metadata_lines(spark: SparkSession, d: str) -> DataFrame:
    return images.metadata_lines(_image_meta(spark, d)).select("path", "line", "kind", "text")


@query("""SELECT o_orderkey, nullif(trim(trim(regexp_replace('(' || o_orderpriority || ' ;) ', '\\s+', ' ', 'g')), ',;:()<>[]{}"''`'), '') AS value FROM orders""".replace("\\\\", "\\"))
def d12_normalize_value(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.normalize_value(F.concat(F.lit("("), "o_orderpriority", F.lit(" ;) "))).alias("value"))


@query("""SELECT doc_id, CASE WHEN s - 40 > 0 THEN '…' ELSE '' END || replace(substring(text, (greatest(s - 40, 0) + 1)::INT, (least(s + 45, length(text)) - greatest(s - 40, 0))::INT), chr(9), ' ') || CASE WHEN s + 45 < length(text) THEN '…' ELSE '' END AS context
FROM (SELECT doc_id, text, least(doc_id % 200, greatest(length(text) - 5, 0)) AS s FROM documents)""")
def d13_context(spark: SparkSession, d: str) -> DataFrame:
    at = F.least(F.col("doc_id") % 200, F.greatest(F.length("text") - 5, F.lit(0))).cast("int")
    return table(spark, d, "documents").select("doc_id", T.context(F.col("text"), at, at + 5).alias("context"))


# Joins


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return detectors.detect(_all_lines(spark, d), (detectors.email(), detectors.JP_PHONE, detectors.INTL_PHONE, detectors.BANK))


@query(rf"""WITH {SQL_SYNTH}, t AS (SELECT path, line, substr(text, 5) AS host FROM synth WHERE line = 1), g AS (SELECT host, count(*) AS n FROM t GROUP BY host)
SELECT 'private_phone' AS category, host AS value, n::BIGINT AS occurrences, [substr(host, 5)] AS absorbed FROM g""")
def j1_merge_overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Each synthetic number is found in its domestic and its international form; the first folds into the second."""
    lines = synthetic_lines(spark, d)
    matches = detectors.detect(lines, (detectors.JP_PHONE, detectors.INTL_PHONE))
    # Written, so that lines are scanned once.
    places = materialized(findings.distinct_places(matches), "places")
    found = findings.findings_of(places, keep_seq=True)
    return merge.merge_overlapping(found, places.select("category", "key", *findings.PLACE)).select("category", "value", "occurrences", "absorbed")


@query(f"WITH {SQL_LINES}, h AS (SELECT DISTINCT text, length(text) AS n FROM lines) SELECT path, line::INT AS line, n::INT AS n FROM lines JOIN h USING (text)")
def j2_attach_locations(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    plain = lines.select("path", "line", "text")
    hits = plain.select("text").distinct().withColumn("n", F.length("text"))
    return merge.attach_locations(hits, plain).select("path", "line", "n")


@query(f"""WITH {SQL_LINES}, b AS (SELECT path AS bundle, line, text, sum(length(text) + 1) OVER (PARTITION BY path ORDER BY line) - length(text) - 1 AS st FROM lines),
sp AS (SELECT bundle, max(st + length(text)) // 2 AS a FROM b GROUP BY bundle)
SELECT bundle, line::BIGINT AS seq, (a - st)::BIGINT AS line_start, least(length(text), a + 8 - st)::BIGINT AS line_end FROM sp JOIN b USING (bundle) WHERE a >= st AND a < st + length(text) + 1""")
def j3_offsets_to_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).select(F.col("path").alias("bundle"), F.col("line").cast("long").alias("seq"), "text")
    starts = materialized(model.line_starts(lines), "starts")
    middle = starts.groupBy("bundle").agg(F.floor(F.max(F.col("start") + F.col("length")) / 2).alias("start"))
    spans = middle.withColumn("end", F.col("start") + 8)
    return model.offsets_to_lines(spans, lines, starts=starts).select("bundle", "seq", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


def _reports(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Up to three reports of each bundle, at different times, some without time; the latest is not the last in any other order."""
    k, v = F.col("o_orderkey"), F.col("v")
    orders = table(spark, d, "orders")
    current = orders.select(F.concat(F.lit("b"), k.cast("string")).alias("bundle"), k.cast("string").alias("fingerprint"))
    each = orders.where(k % 9 > 0).withColumn("v", F.explode(F.sequence(F.lit(0), (k % 3).cast("int"))))
    n = k + v
    reports = each.select(
        F.concat(F.lit("b"), k.cast("string")).alias("bundle"), F.when((k % 7 > 0) | (v > 0), F.timestamp_seconds((k * 5 + v * 7) % 11 * 1000 + v)).alias("created"),
        F.when(n % 8 == 0, "x").otherwise(k.cast("string")).alias("fingerprint"), (n % 3).cast("long").alias("findings_count"), (n % 2).cast("int").alias("visual_images"),
        (n % 5 > 0).alias("model_used"), F.when(n % 10 == 0, gate.NO_MODEL_NEEDED).otherwise("off").alias("model_reason"), F.when(n % 4 == 0, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")).alias("not_model_scanned"), (n % 6 == 1).alias("reviewed"),
    )
    return reports, current


@query("""WITH e AS (SELECT o_orderkey AS k, unnest(range(0, o_orderkey % 3 + 1)) AS v FROM orders WHERE o_orderkey % 9 > 0),
t AS (SELECT k, k + v AS n, CASE WHEN k % 7 > 0 OR v > 0 THEN (k * 5 + v * 7) % 11 * 1000 + v END AS ts FROM e),
l AS (SELECT k, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts DESC NULLS LAST) AS r FROM t) WHERE r = 1),
r AS (SELECT *, list_filter([CASE WHEN n % 3 > 0 THEN (n % 3) || ' finding(s)' END, CASE WHEN n % 2 > 0 THEN (n % 2) || ' image(s) for visual review' END,
  CASE WHEN n % 5 = 0 AND n % 10 <> 0 THEN 'model not used (off)' WHEN n % 4 = 0 THEN 'token budget exceeded' END], lambda x: x IS NOT NULL) AS reasons FROM l)
SELECT 'b' || o_orderkey AS bundle, CASE WHEN n IS NULL THEN 'missing' WHEN n % 8 = 0 THEN 'mismatched' WHEN len(reasons) > 0 AND n % 6 <> 1 THEN 'needs review' ELSE 'ok' END AS status, array_to_string(reasons, ', ') AS reasons FROM orders LEFT JOIN r ON k = o_orderkey""")
def j4_release_gate(spark: SparkSession, d: str) -> DataFrame:
    reports, current = _reports(spark, d)
    return gate.release_gate(reports, current).withColumn("reasons", F.array_join("reasons", ", "))


@query(f"WITH {FILES_SQL} SELECT path, length, mtime FROM f WHERE doc_id % 10 = 3 OR doc_id % 7 = 0")
def j5_changed_files(spark: SparkSession, d: str) -> DataFrame:
    now = _files(spark, d).select("doc_id", "path", "length", "mtime")
    seen = now.where("doc_id % 10 != 3").withColumn("length", F.when(F.col("doc_id") % 7 == 0, F.col("length") + 1).otherwise(F.col("length")))
    return files.changed_files(now.drop("doc_id"), seen.drop("doc_id"))


@query(rf"""WITH {SQL_LINES}, {SQL_SYNTH}, al AS (SELECT path, line, left(text, 20000) AS text FROM lines UNION ALL SELECT path, line, text FROM synth WHERE substring(path, 6, length(path) - 9)::BIGINT % 5 > 0),
v AS (SELECT 'account_number' AS category, path, line, unnest(regexp_extract_all(text, '普通預金 [0-9]{{7}}')) AS value FROM al UNION ALL SELECT 'private_email', path, line, unnest(regexp_extract_all(text, '@MAIL@', 1)) FROM al),
w AS (SELECT category, CASE category WHEN 'private_email' THEN lower(value) ELSE value END AS key, path, line FROM v WHERE NOT regexp_matches(value, '@([A-Za-z0-9_\-]+\.)*example\.(com|org|net)$'))
SELECT category, key, count(DISTINCT (path, line)) AS occurrences FROM w GROUP BY category, key""".replace("@MAIL@", _MAIL))
def j5_incremental_scan(spark: SparkSession, d: str) -> DataFrame:
    """A scan that is kept, after a fifth of the synthetic files has gone and every seventh has changed from what it was at first."""
    lines, synth = _lines(spark, d), synthetic_lines(spark, d)
    n = F.regexp_extract("path", "[0-9]+", 0).cast("long")
    first = synth.withColumn("text", F.when(n % 7 == 0, F.concat(F.lit("old@mail.jp "), "text")).otherwise(F.col("text")))
    now = lines.unionByName(synth.where(n % 5 > 0))
    was = lines.unionByName(first)
    listed = lambda x: x.groupBy("path").agg(F.sum(F.octet_length("text")).alias("length"), F.lit(1).cast("long").alias("mtime"))
    scan = lambda x: lambda some: detectors.detect(x.join(some.select("path"), "path", "left_semi"), (detectors.email(), detectors.BANK))
    state = incremental.first_scan(listed(was), scan(was), fresh_path(spark, "scan-state"))
    return incremental.update(state, listed(now), scan(now)).findings.select("category", "key", "occurrences")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'private_phone' WHEN 1 THEN 'secret' ELSE 'other' END AS category, CASE o_orderkey % 3 WHEN 0 THEN '電話番号' WHEN 1 THEN '秘密情報の疑い' ELSE 'other' END AS category_label FROM orders")
def j6_label_categories(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("o_orderkey") % 3
    return findings.label_categories(table(spark, d, "orders").select("o_orderkey", F.when(m == 0, "private_phone").when(m == 1, "secret").otherwise("other").alias("category")))


# Aggregations


_FOUND = rf"""{SQL_LINES}, {SQL_SYNTH},
al AS (SELECT path, line, left(text, 20000) AS text FROM lines UNION ALL SELECT path, line, text FROM synth),
bank AS (SELECT 'account_number' AS category, unnest(regexp_extract_all(text, '普通預金 [0-9]{{7}}')) AS value, path, line FROM al),
mail AS (SELECT 'private_email' AS category, unnest(regexp_extract_all(text, '{_MAIL}', 1)) AS value, path, line FROM al),
fm AS (SELECT * FROM bank UNION ALL SELECT * FROM mail WHERE NOT regexp_matches(value, '@([A-Za-z0-9_\-]+\.)*example\.com$')),
keyed AS (SELECT *, CASE category WHEN 'private_email' THEN lower(value) ELSE value END AS key FROM fm)"""


def _bank_and_mail(spark: SparkSession, d: str) -> DataFrame:
    return detectors.detect(_all_lines(spark, d), (detectors.email(), detectors.BANK))


@query(f"WITH {_FOUND} SELECT category, key, arg_min(value, path || chr(0) || lpad(line::varchar, 9, '0')) AS value, 1.0::DOUBLE AS score, count(DISTINCT (path, line)) AS occurrences FROM keyed GROUP BY category, key")
def a1_aggregate_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.aggregate_findings(_bank_and_mail(spark, d)).select("category", "key", "value", "score", "occurrences")


@query("""WITH s AS (SELECT 'doc/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE 'reason ' || (doc_id % 40) END AS reason FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY path) AS n FROM s)
SELECT reason, count(*) AS n, array_to_string(list(path ORDER BY path) FILTER (n <= 10), ' ') AS examples FROM r GROUP BY reason""")
def a2_skip_summary(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id")
    skipped = table(spark, d, "documents").select(doc_path().alias("path"), F.when(m % 3 == 0, "hot").otherwise(F.concat(F.lit("reason "), (m % 40).cast("string"))).alias("reason"))
    return files.skip_summary(skipped).withColumn("examples", F.array_join("examples", " "))


def _roots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = _files(spark, d).select(F.col("bundle").alias("root"), "path", "length")
    requested = own.select("root").union(table(spark, d, "nation").select(F.concat(F.lit("none"), F.col("n_nationkey").cast("string")))).distinct()
    return requested, own, credentials.credential_hits(_lines(spark, d)).select("path")


@query(rf"""WITH {FILES_SQL}, {SQL_LINES}, bad AS (SELECT DISTINCT path FROM lines WHERE regexp_matches(text, '(?i:password|passwd|secret|token|api_?key)["'']? ?[:=] ?["'']?[A-Za-z0-9+/_.=\-]{{8,}}|\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\b')),
g AS (SELECT bundle AS root, sum(length)::BIGINT AS size_bytes, bool_or(path IN (SELECT path FROM bad)) AS blocked FROM f GROUP BY bundle),
q AS (SELECT root FROM g UNION SELECT 'none' || n_nationkey FROM nation)
SELECT root, size_bytes IS NOT NULL AS "exists", coalesce(size_bytes, 0) AS size_bytes, coalesce(size_bytes, 0) > 30000000 AS over_limit, coalesce(blocked, FALSE) AS blocked, size_bytes IS NOT NULL AND NOT coalesce(blocked, FALSE) AS upload_allowed FROM q LEFT JOIN g USING (root)""")
def a3_size_check(spark: SparkSession, d: str) -> DataFrame:
    return files.size_check(*_roots(spark, d)).drop("size_human")


@query(f"WITH {FILES_SQL}, e AS (SELECT bundle, path || chr(0) || length || chr(0) || mtime AS e FROM f) SELECT bundle, sha256(string_agg(e, chr(10) ORDER BY e) || chr(10)) AS fingerprint FROM e GROUP BY bundle")
def a4_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return files.fingerprint(_files(spark, d))


@query(f"WITH {SQL_LINES}, t AS (SELECT regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, path || chr(0) || lpad(line::varchar, 9, '0') AS seq FROM lines) SELECT text, min(seq) AS seq, count(*) AS n_places FROM t GROUP BY text".replace("\\\\", "\\"))
def a5_distinct_lines(spark: SparkSession, d: str) -> DataFrame:
    seq = F.concat("path", F.lit("\x00"), F.lpad(F.col("line").cast("string"), 9, "0"))
    return model.distinct_lines(_lines(spark, d).withColumn("seq", seq))


@query(f"""WITH {_FOUND} SELECT (SELECT count(*) FROM documents) AS files_seen, count(DISTINCT (category, key)) AS findings_count, count(DISTINCT (category, key, path, line)) AS occurrences, count(*) = 0 AS ok,
  (SELECT array_to_string(list(p ORDER BY p), ' ') FROM (SELECT '/home/u/.ssh/' || doc_id AS p FROM documents WHERE doc_id % 20 = 0 ORDER BY p LIMIT 50)) AS first_skipped,
  (SELECT count(*) FROM lineitem) AS images_total, (SELECT count(*) FROM j WHERE status = 'selected' AND ocr_chars >= 4) AS images_ocr, (SELECT count(*) FROM j WHERE status = 'small') AS images_skipped_small, (SELECT count(*) FROM j WHERE status = 'cap') AS images_skipped_cap,
  (SELECT coalesce(sum(cost), 0) FROM o WHERE admitted)::BIGINT AS tokens_processed, (SELECT coalesce(sum(cost), 0) FROM o WHERE NOT admitted)::BIGINT AS tokens_over FROM keyed""".replace("WITH ", "WITH RECURSIVE @IMAGES@, @BUDGET@, ", 1))
def a6_scan_summary(spark: SparkSession, d: str) -> DataFrame:
    found = findings.aggregate_findings(_bank_and_mail(spark, d))
    i = F.col("doc_id")
    path = F.concat(F.when(i % 20 == 0, "/home/u/.ssh/").otherwise("/data/"), i.cast("string"))
    all_files = table(spark, d, "documents").select(path.alias("path"))
    _, skipped = files.split_refused(all_files)
    out = report.scan_summary(all_files, found, skipped, images.select_ocr_images(_images(spark, d)), model.apply_token_budget(_budget_lines(spark, d), 20_000))
    return out.withColumn("first_skipped", F.array_join("first_skipped", " "))


# Windows and order


@query(f"""WITH {_FOUND}, p AS (SELECT DISTINCT category, key, path, line FROM keyed), r AS (SELECT *, row_number() OVER (PARTITION BY category, key ORDER BY path, line) AS nth FROM p)
SELECT category, key, nth::INT AS nth, path, line::INT AS line FROM r WHERE nth <= 20""")
def w1_first_locations(spark: SparkSession, d: str) -> DataFrame:
    return findings.first_locations(_bank_and_mail(spark, d)).select("category", "key", "nth", "path", "line")


def _images(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("s"), (k % 100).cast("string")).alias("bundle"), F.concat(F.lit("i"), k.cast("string")).alias("path"), (k % 977 + 10).cast("int").alias("width"), (k % 613 + 10).cast("int").alias("height"),
        (k % 37 == 0).alias("photo_like"), (k % 23).cast("int").alias("ocr_chars"),
    )


_IMAGES = """i AS (SELECT 's' || ((l_orderkey * 8 + l_linenumber) % 100) AS bundle, 'i' || (l_orderkey * 8 + l_linenumber) AS path, (l_orderkey * 8 + l_linenumber) % 977 + 10 AS width, (l_orderkey * 8 + l_linenumber) % 613 + 10 AS height,
 (l_orderkey * 8 + l_linenumber) % 37 = 0 AS photo_like, (l_orderkey * 8 + l_linenumber) % 23 AS ocr_chars FROM lineitem)"""


@query(f"""WITH {_IMAGES}, j AS (SELECT *, least(width, height) < 120 OR width * height < 60000 AS small FROM i)
SELECT bundle, path, CASE WHEN small THEN 'small' WHEN row_number() OVER (PARTITION BY bundle, small ORDER BY width * height DESC, path) <= 40 THEN 'selected' ELSE 'cap' END AS status FROM j""")
def w2_select_ocr_images(spark: SparkSession, d: str) -> DataFrame:
    return images.select_ocr_images(_images(spark, d)).select("bundle", "path", "status")


@query(f"""WITH {_IMAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY bundle ORDER BY photo_like DESC, ocr_chars DESC, width * height DESC, path) AS nth, count(*) OVER (PARTITION BY bundle) AS n FROM i WHERE photo_like OR ocr_chars >= 10)
SELECT bundle, path, nth::INT AS nth, greatest(n - 20, 0)::BIGINT AS overflow FROM r WHERE nth <= 20""")
def w3_visual_review(spark: SparkSession, d: str) -> DataFrame:
    return images.visual_review(_images(spark, d)).select("bundle", "path", "nth", "overflow")


def _budget_lines(spark: SparkSession, d: str) -> DataFrame:
    """Costs are words, not a model's tokens."""
    i = F.col("doc_id")
    return table(spark, d, "documents").select(F.col("source").alias("bundle"), (i % 5).cast("int").alias("priority"), i.alias("seq"), "text", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("tokens"))


BUDGET_SQL = """b AS (SELECT source AS bundle, (doc_id % 5)::INT AS priority, doc_id AS seq, (length(text) - length(replace(text, ' ', '')))::INT AS tokens, length(text) - length(replace(text, ' ', '')) + 1 AS cost,
  row_number() OVER (PARTITION BY source ORDER BY doc_id % 5, doc_id) AS n FROM documents),
g AS (SELECT bundle, n, cost <= 20000 AS admitted, CASE WHEN cost <= 20000 THEN 20000 - cost ELSE 20000 END AS rest FROM b WHERE n = 1
  UNION ALL SELECT b.bundle, b.n, b.cost <= g.rest, CASE WHEN b.cost <= g.rest THEN g.rest - b.cost ELSE g.rest END FROM g JOIN b ON b.bundle IS NOT DISTINCT FROM g.bundle AND b.n = g.n + 1),
o AS (SELECT b.*, g.admitted FROM b JOIN g ON b.bundle IS NOT DISTINCT FROM g.bundle AND b.n = g.n)"""
ORACLE_SQL["a6_scan_summary"] = ORACLE_SQL["a6_scan_summary"].replace("@BUDGET@", BUDGET_SQL).replace("@IMAGES@", _IMAGES + """,
j AS (SELECT *, CASE WHEN small THEN 'small' WHEN row_number() OVER (PARTITION BY bundle, small ORDER BY width * height DESC, path) <= 40 THEN 'selected' ELSE 'cap' END AS status FROM (SELECT *, least(width, height) < 120 OR width * height < 60000 AS small FROM i))""")


@query(f"WITH RECURSIVE {BUDGET_SQL} SELECT bundle, priority, seq, tokens, admitted FROM o")
def w4_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return model.apply_token_budget(_budget_lines(spark, d), 20_000).select("bundle", "priority", "seq", "tokens", "admitted")


@query("""WITH n AS (SELECT doc_id, n_chars AS n, ceil(greatest(n_chars - 1536, 0) / 1280.0)::BIGINT AS last FROM documents WHERE n_chars > 0), w AS (SELECT doc_id, n, last, unnest(range(0, last + 1)) AS "window" FROM n)
SELECT doc_id, "window", "window" * 1280 AS start, least("window" * 1280 + 1536, n) AS "end", "window" * 1280 + CASE WHEN "window" > 0 THEN 128 ELSE 0 END AS keep_from, least("window" * 1280 + 1536, n) - CASE WHEN "window" < last THEN 128 ELSE 0 END AS keep_to FROM w""")
def w5_token_windows(spark: SparkSession, d: str) -> DataFrame:
    return model.token_windows(table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("n"))).drop("n")


@query(f"""WITH {_FOUND} SELECT category, key, count(DISTINCT (path, line)) AS occurrences FROM keyed GROUP BY category, key""")
def w6_sort_findings(spark: SparkSession, d: str) -> DataFrame:
    return findings.sort_findings(findings.aggregate_findings(_bank_and_mail(spark, d))).select("category", "key", "occurrences")


@query(rf"""WITH {_FOUND} SELECT category, path, line::INT AS line, value FROM keyed UNION ALL SELECT 'metadata_person', 'img/' || o_orderkey || '.jpg', NULL, o_orderpriority FROM orders WHERE o_orderkey % 4 <> 2""")
def u1_union_matches(spark: SparkSession, d: str) -> DataFrame:
    return findings.union_matches(_bank_and_mail(spark, d), images.author_metadata(_image_meta(spark, d))).select("category", "path", "line", "value")


@query(rf"""WITH {_FOUND}, m AS (SELECT category, key, 'regex' AS detector FROM keyed UNION ALL SELECT category, key, 'model' FROM keyed WHERE line % 2 = 0)
SELECT category, key, array_to_string(list_sort(list_distinct(list(detector))), ',') AS detectors FROM m GROUP BY category, key""")
def u2_union_detectors(spark: SparkSession, d: str) -> DataFrame:
    one = _bank_and_mail(spark, d)
    both = findings.union_matches(one, one.where("line % 2 = 0").withColumn("detector", F.lit("model")))
    return findings.aggregate_findings(both).select("category", "key", F.array_join("detectors", ",").alias("detectors"))


@query(f"""WITH {SQL_SYNTH} SELECT DISTINCT 'private_phone' AS category, substr(text, 9) AS key, substr(text, 5) AS host_key FROM synth WHERE line = 1""")
def u3_places_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Findings that share a place with a longer one that contains them, by an equi-join on the place."""
    matches = detectors.detect(synthetic_lines(spark, d), (detectors.JP_PHONE, detectors.INTL_PHONE))
    spot = F.concat_ws("/", "path", F.col("line").cast("string")).alias("_place")
    value = F.col("first.value")
    rank = F.struct((-F.length(value)).alias("shorter"), F.col("key").alias("key")).alias("rank")
    spots = findings.distinct_places(matches).select("category", "key", rank, merge.without_space(value).alias("norm"), spot)
    return merge.containing_pairs(spots).select("category", "key", F.col("host.key").alias("host_key"))


# Scalar functions


@query("""SELECT o_orderkey, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN printf('%.1f KB', n / 1e3) WHEN n < 1000000000 THEN printf('%.1f MB', n / 1e6) ELSE printf('%.1f GB', n / 1e9) END AS size
FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 7 END)::BIGINT AS n FROM orders)""")
def f1_human_size(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    return table(spark, d, "orders").select("o_orderkey", T.human_size(k * k * F.when(k % 3 == 0, 1).otherwise(7)).alias("size"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2026-10-12' ELSE strftime(o_orderdate::DATE + 7, '%Y-%m-%d') END AS expires_on FROM orders")
def f2_expiry_date(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    payload = F.translate(F.rtrim(F.base64(F.encode(F.lit('{"d_expiry":"2026-10-12"}'), "UTF-8")), F.lit("=")), "+/", "-_")
    jwt = F.when(k % 3 == 0, F.concat(F.lit("h."), payload, F.lit(".s"))).when(k % 3 == 1, "garbage")
    return table(spark, d, "orders").select("o_orderkey", gate.expiry_date(jwt, F.lit(7), F.col("o_orderdate").cast("date")).alias("expires_on"))


@query("SELECT 'doc/' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents")
def f3_content_sha256(spark: SparkSession, d: str) -> DataFrame:
    return files.content_sha256(document_texts(spark, d).withColumn("content", F.encode("text", "UTF-8")))


@query(f"WITH {SQL_SYNTH} SELECT path, line::INT AS line, '住所' || text || '  終' AS text FROM synth WHERE line = 4")
def f4_cjk_despace(spark: SparkSession, d: str) -> DataFrame:
    lines = synthetic_lines(spark, d).where("line = 4")
    return lines.select("path", "line", T.cjk_despace(F.concat(F.lit("住 所 "), "text", F.lit("  終"))).alias("text"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(replace(replace(replace(html, '</row>', chr(10)), '</si>', chr(10)), '</c>', chr(9)), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS text FROM pages""")
def f5_xml_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.xml_to_text(F.col("html")).alias("text"))


# Model


def _word_scorer():
    """A deterministic stand-in for a model: capitalised words score as names."""
    import re

    name, other = [0.0, 0.0, 0.0, 0.0, 4.0], [4.0, 0.0, 0.0, 0.0, 0.0]

    def score(texts: list[str]) -> list[list[tuple[int, int, list[float]]]]:
        return [[(*m.span(), name if m[0][0].isupper() else other) for m in re.finditer(r"\S+", t or "")] for t in texts]

    return score


def _word_arrays():
    """_word_scorer() in arrays."""
    import re

    import numpy as np

    logits = np.array([[4, 0, 0, 0, 0], [0, 0, 0, 0, 4]], np.float32)

    def score(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        found = [np.fromiter((x for m in re.finditer(r"\S+", t or "") for x in (*m.span(), m[0][0].isupper())), np.int32).reshape(-1, 3) for t in texts]
        return [(x[:, 0], x[:, 1], logits[x[:, 2]]) for x in found]

    return score


LABELS = ["O", "B-private_person", "I-private_person", "E-private_person", "S-private_person"]


_TOKENS = r"""p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\s*[^\s]+')) AS w, generate_subscripts(regexp_extract_all(text, '\s*[^\s]+'), 1) AS i FROM documents),
q AS (SELECT doc_id, i, regexp_replace(w, '^\s+', '') AS w, sum(length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM p)"""


@query(f"""WITH {_TOKENS} SELECT doc_id, (i - 1)::INT AS pos, (upto - length(w))::INT AS start, upto::INT AS "end", CASE WHEN upper(w[1]) = w[1] AND lower(w[1]) <> w[1] THEN 4.0 ELSE 0.0 END::DOUBLE AS name FROM q""")
def m1_score_tokens(spark: SparkSession, d: str) -> DataFrame:
    scored = model.score_tokens(table(spark, d, "documents"), _word_scorer)
    return scored.select("doc_id", "pos", "start", "end", F.get("logits", F.lit(4)).cast("double").alias("name"))


@query(f"""WITH {_TOKENS} SELECT doc_id, 'private_person' AS category, (upto - length(w))::INT AS start, upto::INT AS "end", round(exp(4) / (exp(4) + 4), 6) AS score FROM q WHERE upper(w[1]) = w[1] AND lower(w[1]) <> w[1]""")
def m2_decode_spans(spark: SparkSession, d: str) -> DataFrame:
    scored = model.score_blocks(dealt_documents(spark, d), _word_arrays)
    return model.decode_blocks(scored, LABELS).withColumn("score", F.round("score", 6))


# Workloads


_JP = r"(?:^|[^0-9\-])(0[0-9]{1,4}-[0-9]{1,4}-[0-9]{3,4}|0[5789]0[0-9]{8}|\(0[0-9]{1,4}\)\s?[0-9]{1,4}-[0-9]{4})(?:$|[^0-9\-])"
_INTL = r"(?:^|[^\pL\pN_+])(\+[0-9]{1,3}[\s\-]?\(?[0-9]{1,4}\)?(?:[\s\-]?[0-9]{2,4}){2,4})(?:$|[^0-9])"
_EXAMPLE = r"@([A-Za-z0-9_\-]+\.)*(example\.(com|org|net)|example|test|invalid|localhost)$"


@query(rf"""WITH {SQL_LINES}, al AS (SELECT path, line, left(text, 20000) AS text FROM lines),
raws AS (SELECT 'private_phone' AS category, path, line, unnest(regexp_extract_all(text, '{_JP}', 1)) AS raw, text FROM al
  UNION ALL SELECT 'private_phone', path, line, unnest(regexp_extract_all(text, '{_INTL}', 1)), text FROM al
  UNION ALL SELECT 'private_email', path, line, unnest(regexp_extract_all(text, '{_MAIL}', 1)), text FROM al
  UNION ALL SELECT 'account_number', path, line, unnest(regexp_extract_all(text, '{_CARD}', 1)), text FROM al),
n AS (SELECT category, path, line, text, raw, trim(regexp_replace(raw, '\s+', ' ', 'g'), ' ,;:()<>[]{{}}"''`') AS value, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM raws),
ok AS (SELECT category, path, line, value, CASE category WHEN 'private_email' THEN lower(value) ELSE value END AS key FROM n WHERE CASE category WHEN 'private_phone' THEN length(digits) BETWEEN 10 AND 15
  WHEN 'private_email' THEN NOT regexp_matches(raw, '{_EXAMPLE}') ELSE {_CARD_OK} AND (regexp_matches(raw, '[^0-9]') OR regexp_matches(text, '(?i)card|credit|visa|master|amex|jcb')) END),
pl AS (SELECT DISTINCT category, key, path, line FROM ok),
ho AS (SELECT a.category, a.key, arg_max(b.key, length(b.key)) AS host FROM pl a JOIN pl b ON a.category = b.category AND a.path = b.path AND a.line = b.line
  AND length(b.key) > length(a.key) AND contains(replace(b.key, ' ', ''), replace(a.key, ' ', '')) GROUP BY a.category, a.key),
ro AS (SELECT DISTINCT pl.category, coalesce(ho.host, pl.key) AS key, path, line FROM pl LEFT JOIN ho USING (category, key)),
na AS (SELECT category, key, arg_min(value, path || chr(0) || lpad(line::varchar, 9, '0')) AS value FROM ok GROUP BY category, key)
SELECT category, CASE category WHEN 'private_phone' THEN '電話番号' WHEN 'private_email' THEN 'メールアドレス' ELSE '口座番号・カード番号等' END AS category_label, any_value(value) AS value, 'regex' AS detectors, 1.0::DOUBLE AS score, count(*) AS occurrences, least(count(*), 20)::INT AS n_locations
FROM ro JOIN na USING (category, key) GROUP BY category, key""")
def wl1_pii_report(spark: SparkSession, d: str) -> DataFrame:
    """The report over all documents; their texts hold no other kinds of values that the rules take."""
    out = report.scan(_lines(spark, d))
    return out.select("category", "category_label", "value", F.array_join("detectors", ",").alias("detectors"), "score", "occurrences", F.size("locations").alias("n_locations"))


def _merged_sql(lines: str) -> str:
    """CTEs pl(category, key, path, line) of distinct places and ro, the same after merging, of a CTE al(path, line, text)."""
    return rf"""{lines},
raws AS (SELECT 'private_phone' AS category, path, line, unnest(regexp_extract_all(text, '{_JP}', 1)) AS raw, text FROM al
  UNION ALL SELECT 'private_phone', path, line, unnest(regexp_extract_all(text, '{_INTL}', 1)), text FROM al
  UNION ALL SELECT 'private_email', path, line, unnest(regexp_extract_all(text, '{_MAIL}', 1)), text FROM al
  UNION ALL SELECT 'bank', path, line, unnest(regexp_extract_all(text, '普通預金 [0-9]{{7}}')), text FROM al
  UNION ALL SELECT 'account_number', path, line, unnest(regexp_extract_all(text, '{_CARD}', 1)), text FROM al),
n AS (SELECT category, path, line, text, raw, trim(regexp_replace(raw, '\s+', ' ', 'g'), ' ,;:()<>[]{{}}"''`') AS value, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM raws),
ok AS (SELECT CASE category WHEN 'bank' THEN 'account_number' ELSE category END AS category, path, line, value, CASE category WHEN 'private_email' THEN lower(value) ELSE value END AS key FROM n WHERE CASE category WHEN 'private_phone' THEN length(digits) BETWEEN 10 AND 15
  WHEN 'private_email' THEN NOT regexp_matches(raw, '{_EXAMPLE}') WHEN 'bank' THEN TRUE ELSE {_CARD_OK} AND (regexp_matches(raw, '[^0-9]') OR regexp_matches(text, '(?i)card|credit|visa|master|amex|jcb')) END),
pl AS (SELECT DISTINCT category, key, path, line FROM ok),
ho AS (SELECT a.category, a.key, arg_max(b.key, length(b.key)) AS host FROM pl a JOIN pl b ON a.category = b.category AND a.path = b.path AND a.line = b.line
  AND length(b.key) > length(a.key) AND contains(replace(b.key, ' ', ''), replace(a.key, ' ', '')) GROUP BY a.category, a.key),
ro AS (SELECT DISTINCT pl.category, coalesce(ho.host, pl.key) AS key, path, line FROM pl LEFT JOIN ho USING (category, key)),
na AS (SELECT category, key, arg_min(value, path || chr(0) || lpad(line::varchar, 9, '0')) AS value FROM ok GROUP BY category, key)"""


_ARCHIVE_LINES = rf"""{ARCHIVES_SQL}, r AS (SELECT * FROM k WHERE m = 0 OR m > 5),
al AS (SELECT path, line, left(text, 20000) AS text FROM (SELECT path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM me WHERE doc_id % 25 <> 5)),
sk AS (SELECT CASE m WHEN 1 THEN 'unreadable zip (BadZipFile)' WHEN 2 THEN 'uninspectable archive' WHEN 3 THEN 'binary (not PII-scanned)' WHEN 4 THEN 'PDF without text layer (no OCR available)' ELSE 'refused location: .ssh' END AS reason, path FROM k WHERE m BETWEEN 1 AND 5
  UNION ALL SELECT CASE WHEN doc_id % 15 = 0 THEN 'uninspectable archive' ELSE 'binary (not PII-scanned)' END, path || '!in!deep/' || doc_id || '.x' FROM r WHERE doc_id % 3 = 0),
cr AS (SELECT split_part(path, '!', 1) AS root, 'assigned_secret' AS rule FROM (SELECT path, unnest(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']? ?[:=] ?["'']?[A-Za-z0-9+/_.=\-]{{8,}}')) FROM al)
  UNION ALL SELECT split_part(path, '!', 1), 'aws_access_key' FROM (SELECT path, unnest(regexp_extract_all(text, '\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\b')) FROM al)
  UNION ALL SELECT path, 'credential_file' FROM r WHERE doc_id % 10 = 0 UNION ALL SELECT split_part(path, '!', 1), 'uninspectable' FROM sk WHERE regexp_matches(reason, '^un'))"""


@query(rf"""WITH {_merged_sql(_ARCHIVE_LINES)}
SELECT 'finding' AS what, value AS name, count(*) AS n FROM ro JOIN na USING (category, key) GROUP BY category, key, value
UNION ALL SELECT 'skip', reason, count(*) FROM sk GROUP BY reason
UNION ALL SELECT 'credential', root || ' ' || rule, count(*) FROM cr GROUP BY root, rule
UNION ALL SELECT 'files', 'seen', (SELECT count(*) FROM k WHERE m <> 5) + (SELECT count(*) FROM me WHERE doc_id % 25 <> 5) + 2 * (SELECT count(*) FROM r WHERE doc_id % 3 = 0)""")
def wl4_scan_files(spark: SparkSession, d: str) -> DataFrame:
    """The scan of all of each line of files with all detectors: archives made of all documents, some damaged, closed, binary or in a refused place."""
    out = report.scan_files(_archives(spark, d), chars=None)
    found = out.findings.select(F.lit("finding").alias("what"), F.col("value").alias("name"), F.col("occurrences").alias("n"))
    skips = files.skip_summary(out.skipped).select(F.lit("skip").alias("what"), F.col("reason").alias("name"), "n")
    hits = out.credentials.groupBy("root", "rule").agg(F.count(F.lit(1)).alias("n")).select(F.lit("credential").alias("what"), F.concat("root", F.lit(" "), "rule").alias("name"), "n")
    seen = out.summary.select(F.lit("files").alias("what"), F.lit("seen").alias("name"), F.col("files_seen").alias("n"))
    return found.unionByName(skips).unionByName(hits).unionByName(seen)


def _cased_words():
    """Words as tokens, with id 1 if they begin with a capital; the empty line before a document is a token too."""
    import re

    return lambda texts: [[(int(m.group()[0].isupper()), m.start(), m.end()) for m in re.finditer(r"\S+|^\n", t)] for t in texts]


def _name_model():
    """A deterministic stand-in for a model, whose logits depend on a word and its neighbours: runs of capitalised words are names."""
    import numpy as np

    def score(ids):
        big = np.concatenate(([False], np.asarray(ids) == 1, [False]))
        before, mine, after = big[:-2], big[1:-1], big[2:]
        label = np.where(mine, np.where(before, np.where(after, 2, 3), np.where(after, 1, 4)), 0)
        return 4.0 * np.eye(len(LABELS))[label]

    return score


MODEL_BUDGET = 3000


@query(rf"""WITH RECURSIVE {SQL_LINES}, ln AS MATERIALIZED (SELECT d.source AS bundle, CASE WHEN d.doc_id % 10 = 0 THEN path ELSE 'doc/' || d.doc_id || '.py' END AS path, d.doc_id % 10 = 0 AS prose, line, l.text FROM lines l JOIN documents d ON l.path = 'doc/' || d.doc_id || '.txt' WHERE length(l.text) <= 2000 AND (d.doc_id % 10 = 0 OR regexp_matches(l.text,
  '@|[0-9]{{2,4}}[-\s][0-9]{{2,4}}[-\s][0-9]{{3,4}}|(^|[^\pL\pN_])[A-Z][a-z]+ [A-Z][a-z]+($|[^\pL\pN_])|(?i:name|address|addr|phone|tel|mobile|e-?mail|birth|dob|author|copyright|contact|owner|street|city|zip|postal|customer)'))),
st AS MATERIALIZED (SELECT *, path || chr(1) || lpad(line::varchar, 10, '0') AS seq, CASE WHEN prose THEN path ELSE '' END AS doc, CASE WHEN prose THEN text ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS t FROM ln),
en AS (SELECT bundle, 3 AS priority, doc, seq, t FROM st WHERE prose UNION ALL SELECT bundle, 4, '', min(seq), t FROM st WHERE NOT prose GROUP BY bundle, t),
co AS MATERIALIZED (SELECT *, len(regexp_extract_all(t, '[^\s]+')) + 1 AS cost, row_number() OVER (PARTITION BY bundle ORDER BY priority, seq) AS n FROM en),
g AS (SELECT bundle, n, cost <= {MODEL_BUDGET} AS admitted, CASE WHEN cost <= {MODEL_BUDGET} THEN {MODEL_BUDGET} - cost ELSE {MODEL_BUDGET} END AS rest FROM co WHERE n = 1
  UNION ALL SELECT co.bundle, co.n, co.cost <= g.rest, CASE WHEN co.cost <= g.rest THEN g.rest - co.cost ELSE g.rest END FROM g JOIN co ON co.bundle IS NOT DISTINCT FROM g.bundle AND co.n = g.n + 1),
us AS MATERIALIZED (SELECT co.*, g.admitted FROM co JOIN g ON co.bundle IS NOT DISTINCT FROM g.bundle AND co.n = g.n),
w0 AS (SELECT bundle, priority, doc, seq, t, unnest(regexp_extract_all(t, '[^\s]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\s]+'), 1) AS i FROM us WHERE admitted),
w1 AS (SELECT *, upper(w[1]) = w[1] AND lower(w[1]) <> w[1] AS cap FROM w0),
w2 AS (SELECT *, cap AND NOT coalesce(lag(cap) OVER (PARTITION BY bundle, priority, doc ORDER BY seq, i), FALSE) AS first FROM w1),
w3 AS (SELECT *, sum(first::INT) OVER (PARTITION BY bundle, priority, doc ORDER BY seq, i) AS run FROM w2),
sp AS (SELECT bundle, priority, doc, run, string_agg(w, ' ' ORDER BY seq, i) AS raw, min(seq) AS seq, arg_min(t, seq) AS t FROM w3 WHERE cap GROUP BY bundle, priority, doc, run),
va AS (SELECT *, trim(raw, ' ,;:()<>[]{{}}"''`「」『』、。，．・') AS value FROM sp WHERE length(raw) >= 2 AND regexp_matches(raw, '[\pL\pN_]')),
pl AS (SELECT va.value, st.path, st.line FROM va JOIN st ON va.bundle IS NOT DISTINCT FROM st.bundle AND va.t = st.t AND NOT st.prose WHERE va.priority = 4 UNION ALL SELECT value, st.path, st.line FROM va JOIN st ON va.seq = st.seq WHERE va.priority = 3)
SELECT 'finding' AS what, value AS name, count(DISTINCT (path, line)) AS n FROM pl WHERE value <> '' GROUP BY value
UNION ALL SELECT CASE WHEN admitted THEN 'tokens' ELSE 'over' END, bundle, sum(cost)::BIGINT FROM us GROUP BY bundle, admitted""")
def wl5_model_stage(spark: SparkSession, d: str) -> DataFrame:
    """The model's part of the scan, from lines to findings; every tenth document is prose, the others are code, sources are bundles."""
    docs = table(spark, d, "documents").select("source", doc_path().alias("_path"))
    lines = _lines(spark, d).join(docs, F.col("path") == F.col("_path")).drop("_path").withColumnRenamed("source", "bundle")
    as_code = F.when(F.col("path").rlike(r"0\.txt$"), F.col("path")).otherwise(F.replace("path", F.lit(".txt"), F.lit(".py")))
    stage = model.model_stage(lines.withColumn("path", as_code), _cased_words, _name_model, LABELS, MODEL_BUDGET)
    found = findings.aggregate_findings(stage.matches).select(F.lit("finding").alias("what"), F.col("value").alias("name"), F.col("occurrences").alias("n"))
    used = stage.used.groupBy("bundle", "admitted").agg(F.sum(F.col("tokens") + 1).alias("n"))
    return found.unionByName(used.select(F.when(F.col("admitted"), "tokens").otherwise("over").alias("what"), F.col("bundle").alias("name"), "n"))


@query(rf"""WITH i AS (SELECT doc_id AS k, '/p/' || doc_id || '.png' AS path, doc_id % 977 + 10 AS w, doc_id * 7 % 613 + 10 AS h, doc_id % 37 = 0 AS photo, '普通預金 ' || lpad((doc_id % 100)::varchar, 7, '0') AS text FROM documents),
j AS (SELECT *, least(w, h) < 120 OR w * h < 60000 AS small FROM i),
s AS (SELECT *, CASE WHEN small THEN 'small' WHEN row_number() OVER (PARTITION BY small ORDER BY w * h DESC, path) <= 40 THEN 'selected' ELSE 'cap' END AS status FROM j),
m AS (SELECT 'account_number' AS category, path, 1 AS line, text AS value, 'ocr' AS kind FROM s WHERE status = 'selected' UNION ALL SELECT 'account_number', path, 1, text, 'metadata' FROM s WHERE k % 3 = 0 UNION ALL SELECT 'metadata_person', path, 0, 'Name ' || k % 50, 'metadata' FROM s WHERE k % 3 = 1
  UNION ALL SELECT 'location_gps', path, 0, printf('%.6f, %.6f', k % 90 + 0.5, -(k % 180 + 0.25)), 'metadata' FROM s WHERE k % 5 = 0),
f AS (SELECT category, value, path, line, min(kind) AS kind FROM m GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY category, value ORDER BY kind = 'ocr', path, line) AS nth FROM f),
v AS (SELECT path, row_number() OVER (ORDER BY photo DESC, status = 'selected' DESC, w * h DESC, path) AS nth FROM s WHERE photo OR status = 'selected')
SELECT 'finding' AS what, value AS name, count(*) AS n, arg_min(kind, nth) AS kind FROM o GROUP BY category, value UNION ALL SELECT 'status', status, count(*), NULL FROM s GROUP BY status UNION ALL SELECT 'review', path, nth, NULL FROM v WHERE nth <= 20
UNION ALL SELECT 'overflow', NULL, greatest(count(*) - 20, 0), NULL FROM v UNION ALL SELECT 'read', NULL, count(*), NULL FROM s WHERE status = 'selected'""")
def wl7_pictures(spark: SparkSession, d: str) -> DataFrame:
    """The scan of pictures, one for each document: positions, authors, descriptions, and the texts of those that are read."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select(i, F.concat(F.lit("/p/"), i.cast("string"), F.lit(".png")).alias("path"), F.concat(F.lit("普通預金 "), F.lpad((i % 100).cast("string"), 7, "0")).alias("text"))
    sizes = docs.select("path", (i % 977 + 10).cast("int").alias("width"), (i * 7 % 613 + 10).cast("int").alias("height"), (i % 37 == 0).alias("photo_like"))
    dms = lambda degrees, minutes: F.array(degrees.cast("double"), F.lit(minutes), F.lit(0.0))
    gps = F.when(i % 5 == 0, F.struct(dms(i % 90, 30.0).alias("lat"), F.lit("N").alias("lat_ref"), dms(i % 180, 15.0).alias("lon"), F.lit("W").alias("lon_ref")))
    tag = F.when(i % 3 == 0, "ImageDescription").when(i % 3 == 1, "Artist").otherwise("Software")
    meta = docs.select("path", tag.alias("tag"), F.when(i % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Name "), (i % 50).cast("string"))).alias("value"), gps.alias("gps"))
    texts = docs.select("path", F.concat("text", F.lit(" is read")).alias("text"))
    content = F.unhex(F.lit("89504E470D0A1A0A"))
    out = report.scan_files(docs.select("path", content.alias("content")), pictures=report.Pictures(sizes, meta, lambda chosen: texts.join(chosen, "path")))
    row = lambda frame, what, name, n, kind=None: frame.select(F.lit(what).alias("what"), (F.lit(None).cast("string") if name is None else F.col(name)).alias("name"), n.cast("long").alias("n"), (F.lit(None).cast("string") if kind is None else kind).alias("kind"))
    found = row(out.findings, "finding", "value", F.col("occurrences"), F.get("locations", F.lit(0))["kind"])
    status = row(out.images.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "status", F.col("n"))
    review = row(out.review, "review", "path", F.col("nth"))
    more = row(out.review.agg(F.coalesce(F.max("overflow"), F.lit(0)).alias("n")), "overflow", None, F.col("n"))
    return found.unionByName(status).unionByName(review).unionByName(more).unionByName(row(out.summary, "read", None, F.col("images_ocr")))


@query(rf"""WITH k AS (SELECT '/d/' || doc_id || '.pdf' AS path, doc_id, '普通預金 ' || lpad((doc_id % 300)::varchar, 7, '0') || chr(10) || replace(text, chr(10), chr(12)) AS t FROM documents WHERE doc_id % 7 > 0),
h AS (SELECT *, length(trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 20 AS held FROM k),
p AS (SELECT path, doc_id, unnest(string_split(t, chr(12))) AS text, generate_subscripts(string_split(t, chr(12)), 1) AS page FROM h WHERE held),
l AS (SELECT path, page, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM p),
v AS (SELECT path, page, line, unnest(regexp_extract_all(left(text, 20000), '普通預金 [0-9]{{7}}')) AS value FROM l),
o AS (SELECT value, count(DISTINCT (path, page, line)) AS n, arg_min(page, (path, page, line)) AS page FROM v GROUP BY value)
SELECT 'finding' AS what, value AS name, n, page::INT AS page FROM o UNION ALL SELECT 'finding', 'Author ' || doc_id % 20, count(*), 0 FROM k GROUP BY doc_id % 20
UNION ALL SELECT 'skip', '{P.NO_PDF_TEXT}', (SELECT count(*) FROM documents) - (SELECT count(*) FROM h WHERE held), 0""")
def wl8_document_pages(spark: SparkSession, d: str) -> DataFrame:
    """The scan of PDF files, one for each document, whose pages and authors a reader gives; every seventh has no text."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").select(i, F.concat(F.lit("/d/"), i.cast("string"), F.lit(".pdf")).alias("path"), "text")
    bank = F.concat(F.lit("普通預金 "), F.lpad((i % 300).cast("string"), 7, "0"), F.lit("\n"), F.translate("text", "\n", "\f"))
    texts = docs.where(i % 7 > 0).select("path", bank.alias("text"), F.concat(F.lit(" Author "), (i % 20).cast("string")).alias("author"))
    out = report.scan_files(docs.select("path", F.encode(F.lit("%PDF-1.4"), "UTF-8").alias("content")), (detectors.BANK,), documents=report.Documents(lambda paths: texts.join(paths, "path")))
    found = out.findings.select(F.lit("finding").alias("what"), F.col("value").alias("name"), F.col("occurrences").alias("n"), F.coalesce(F.get("locations", F.lit(0))["page"], F.lit(0)).alias("page"))
    return found.unionByName(files.skip_summary(out.skipped).select(F.lit("skip").alias("what"), F.col("reason").alias("name"), "n", F.lit(0).alias("page")))


_REPORT_SQL = rf"""{SQL_LINES}, {SQL_SYNTH}, al AS (SELECT path, line, left(text, 20000) AS text FROM lines UNION ALL SELECT path, line, text FROM synth)"""
_RANKED_SQL = rf"""{_merged_sql(_REPORT_SQL)}, an AS (SELECT category, key, value FROM na WHERE TRUE), fi AS (SELECT category, CASE category WHEN 'private_phone' THEN '電話番号' WHEN 'private_email' THEN 'メールアドレス' ELSE '口座番号・カード番号等' END AS label, value, count(*) AS n FROM ro JOIN an USING (category, key) GROUP BY category, key, value),
ra AS (SELECT *, row_number() OVER (ORDER BY category, n DESC, encode(value)) AS i FROM fi)"""


def _file_scan(spark: SparkSession, d: str) -> report.FileScan:
    """The scan of documents and synthetic texts as files, of all of each line."""
    synth = synthetic_lines(spark, d).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("t")).select("path", F.array_join("t.text", "\n").alias("text"))
    texts = document_texts(spark, d).unionByName(synth)
    rules = (detectors.email(), detectors.JP_PHONE, detectors.INTL_PHONE, detectors.card(), detectors.BANK)
    return report.scan_files(texts.select("path", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), rules, chars=None)


@query(f"WITH {_RANKED_SQL} SELECT i::BIGINT AS i, category, label AS category_ja, value, n AS occurrences, least(n, 20)::INT AS n_locations FROM ra")
def s10_write_report(spark: SparkSession, d: str) -> DataFrame:
    """The findings of the JSON report of all files, read back from the file, a line for each; i is the place in the file."""
    file = fresh_path(spark, "report") + "/report.json"
    report.write_json(_file_scan(spark, d), file)
    shape = "category string, category_ja string, value string, occurrences long, locations array<struct<path:string,line:int>>"
    # One file, so its lines are numbered by their order in it.
    lines = spark.read.text(file, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("i", "line"))
    found = lines.select(F.col("i").cast("long").alias("i"), F.from_json(F.ltrim(F.col("line"), F.lit(",")), shape).alias("f")).where("f.category IS NOT NULL")
    return found.select("i", *[F.col(f"f.{c}") for c in ("category", "category_ja", "value", "occurrences")], F.size("f.locations").alias("n_locations"))


@query(f"""WITH {_RANKED_SQL} SELECT '## ' || i || '. ' || label || ': ' || value AS line, 1::BIGINT AS n FROM ra
UNION ALL SELECT 'detectors: regex / score 1.0 / ' || n || ' occurrence(s)', count(*) FROM ra GROUP BY n
UNION ALL SELECT 'places', sum(least(n, 20))::BIGINT FROM ra UNION ALL SELECT '# PII report', 1 UNION ALL SELECT '- findings: ' || count(*), 1 FROM ra UNION ALL SELECT '- model: NOT used disabled', 1 UNION ALL SELECT '- OCR: unavailable (0 image(s) with text)', 1
UNION ALL SELECT '', count(*) + 2 FROM ra""")
def s11_write_markdown(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the Markdown report of all files, read back from the file and counted; lines of places are counted together."""
    file = fresh_path(spark, "report") + "/report.md"
    report.write_markdown(_file_scan(spark, d), file)
    place = F.when(F.col("value").startswith("- `"), "places").otherwise(F.col("value"))
    return spark.read.text(file).groupBy(place.alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query()
def s11_render_markdown(spark: SparkSession, d: str) -> DataFrame:
    return report.render_markdown(report.scan(_lines(spark, d)))


def phones(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: telephone numbers of all documents, merged and ranked."""
    return report.scan(_lines(spark, d), (detectors.JP_PHONE, detectors.INTL_PHONE)).select("category", "value", "detectors", "score", "occurrences")


@query(rf"""WITH {_ARCHIVE_LINES}, g AS (SELECT coalesce(source, '') AS root, sum(strlen(coalesce(k.text, '')) + 1000000)::BIGINT AS n, bool_or(path IN (SELECT root FROM cr)) AS blocked FROM k JOIN documents USING (doc_id) GROUP BY ALL)
SELECT root, n AS size_bytes, n > 30000000 AS over_limit, TRUE AS "exists", blocked, NOT blocked AS upload_allowed FROM g UNION ALL SELECT 'none' || n_nationkey, 0, FALSE, FALSE, FALSE, FALSE FROM nation""")
def wl2_archive_check(spark: SparkSession, d: str) -> DataFrame:
    """The share check of bundles of archives: a hit, a name or an archive that can't be looked into, in whatever depth, blocks the bundle."""
    hits = credentials.blocked_roots(report.check_credentials(report.expanded_files(_archives(spark, d))))
    i = F.col("doc_id")
    path = F.concat(F.lit("/data/"), F.when(i % 25 == 5, ".ssh/").otherwise(""), i.cast("string"), F.lit(".zip"))
    own = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("root"), path.alias("path"), (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1_000_000).alias("length"))
    requested = own.select("root").union(table(spark, d, "nation").select(F.concat(F.lit("none"), F.col("n_nationkey").cast("string")))).distinct()
    return files.size_check(requested, own, hits).drop("size_human")


@query(rf"""WITH {FILES_SQL}, {SQL_LINES}, bad AS (SELECT DISTINCT path FROM lines WHERE regexp_matches(text, '(?i:password|passwd|secret|token|api_?key)["'']? ?[:=] ?["'']?[A-Za-z0-9+/_.=\-]{{8,}}|\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\b')),
g AS (SELECT bundle, sum(length)::BIGINT AS n, bool_or(path IN (SELECT path FROM bad)) AS blocked FROM f GROUP BY bundle)
SELECT count(*) + (SELECT count(*) FROM nation) AS roots, bool_or(n > 30000000) AS any_over_limit, count(*) FILTER (NOT blocked) AS allowed, FALSE AS upload_allowed FROM g""")
def wl2_share_check(spark: SparkSession, d: str) -> DataFrame:
    """The share check over all requested roots; missing roots refuse it."""
    checked = files.size_check(*_roots(spark, d))
    return checked.agg(F.count(F.lit(1)).alias("roots"), F.bool_or("over_limit").alias("any_over_limit"), F.count_if("upload_allowed").alias("allowed"), F.bool_and("upload_allowed").alias("upload_allowed"))


@query(f"""WITH {FILES_SQL}, {SQL_LINES}, {REQUESTS_SQL}, bad AS (SELECT DISTINCT path FROM lines WHERE regexp_matches(text, '(?i:password|passwd|secret|token|api_?key)["'']? ?[:=] ?["'']?[A-Za-z0-9+/_.=\\-]{{8,}}|\\b(?:AKIA|ASIA)[A-Z0-9]{{16}}\\b')),
g AS (SELECT bundle, sum(length)::BIGINT AS size_bytes, bool_or(path IN (SELECT path FROM bad)) AS blocked FROM f GROUP BY bundle)
SELECT id, bundle, coalesce(error, CASE WHEN size_bytes IS NULL THEN 'missing file' WHEN bundle LIKE '%1' THEN 'report missing' WHEN bundle LIKE '%2' THEN 'report mismatched' WHEN bundle LIKE '%3' THEN 'report needs review' WHEN blocked THEN 'secrets found' END) AS refusal, coalesce(size_bytes, 0) AS size_bytes FROM r LEFT JOIN g USING (bundle)""".replace("\\\\", "\\"))
def wl3_share_records(spark: SparkSession, d: str) -> DataFrame:
    sizes = files.size_check(*_roots(spark, d)).withColumnRenamed("root", "bundle").select("bundle", "exists", "blocked", "size_bytes")
    # Two reports of each bundle but those that end with 1: the later one is of other files for 2, and has findings for 3.
    prints = materialized(files.fingerprint(_files(spark, d)), "fingerprints")
    ends = lambda digit: F.col("bundle").endswith(digit)
    each = prints.where(~ends("1")).withColumn("v", F.explode(F.array(F.lit(1), F.lit(0))))
    later = F.col("v") == 1
    reports = each.select(
        "bundle", F.timestamp_seconds("v").alias("created"), F.when(ends("2") == later, "other").otherwise(F.col("fingerprint")).alias("fingerprint"),
        F.when((ends("3") == later), 2).otherwise(0).cast("long").alias("findings_count"), F.lit(0).alias("visual_images"), F.lit(True).alias("model_used"), F.lit("").alias("model_reason"), F.array().cast("array<string>").alias("not_model_scanned"), F.lit(False).alias("reviewed"),
    )
    status = gate.release_gate(reports, prints).select("bundle", "status")
    requests = _requests(spark, d).withColumn("jwt", F.lit(None).cast("string")).withColumn("today", F.to_date(F.lit("2026-01-01")))
    return gate.share_records(requests, status, sizes).select("id", "bundle", "refusal", "size_bytes")
