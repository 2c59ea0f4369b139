"""The report: lines to matches to findings, merged, ranked, summed up and written (WL1, A6, S10, S11)."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.functions import text as T
from tracewell.functions.tables import materialized, numbered
from tracewell.jobs.gate import NO_MODEL_NEEDED
from tracewell.operators import findings as G
from tracewell.operators.credentials import file_hits
from tracewell.operators.detectors import DETECTORS, Detector, detect
from tracewell.operators.images import author_metadata, gps_findings, metadata_lines, select_ocr_images, visual_review
from tracewell.operators.merge import merge_overlapping
from tracewell.operators.model import Model as ModelOf
from tracewell.operators.model import ModelStage, Tokenizer, model_stage, not_model_scanned
from tracewell.sources.archives import Limits
from tracewell.sources.files import add_filenames, decode_text, expand_named, extension, office_authors, office_text, skip_summary, sniff_kind
from tracewell.sources.ordered_text import write_sections
from tracewell.sources.tree import read_tree


def lines_of(texts: DataFrame) -> DataFrame:
    """Lines to scan of texts(path, text)."""
    return T.to_lines(texts, "path").select("path", F.lit(None).cast("int").alias("page"), "line", F.lit("text").alias("kind"), "text")


def first_places(places: DataFrame, merged: DataFrame, limit: int = P.MAX_LOCATIONS) -> DataFrame:
    """category, key and locations: the first places of each merged finding, its own before those of what it absorbed.

    Each finding brings at most limit places, so what meets here is bounded by the findings.
    """
    own = G.first_of(places, limit)
    members = merged.select("category", F.col("key").alias("home"), F.posexplode(F.concat(F.array("key"), "absorbed")).alias("_order", "key"))
    joined = own.join(members, ["category", "key"])
    spot = F.struct(*G.PLACE)
    once = joined.groupBy("category", "home", spot.alias("_spot")).agg(F.min(F.struct("_order", "nth", "kind", "context")).alias("_f"))
    rank = F.row_number().over(Window.partitionBy("category", "home").orderBy("_f._order", "_f.nth"))
    few = once.withColumn("nth", rank).where(F.col("nth") <= limit)
    where = F.sort_array(F.collect_list(F.struct("nth", *[F.col(f"_spot.{c}").alias(c) for c in G.PLACE], "_f.kind", "_f.context"))).alias("locations")
    return few.groupBy("category", F.col("home").alias("key")).agg(where)


def report_of(matches: DataFrame, observed: Observation | None = None) -> DataFrame:
    """Merged findings of matches, with their first locations and category labels, ranked.

    matches is read once, for the distinct places of findings, which are few beside it and written.
    """
    places = materialized(G.distinct_places(matches), "places")
    found = G.findings_of(places, keep_seq=True)
    merged = materialized(merge_overlapping(found, places.select("category", "key", *G.PLACE)), "merged")
    out = G.label_categories(merged.join(first_places(places, merged), ["category", "key"], "left"))
    if observed is not None:
        out = materialized(out.observe(observed, F.count(F.lit(1)).alias("findings_count"), F.sum("occurrences").alias("occurrences")), "findings")
    return G.sort_findings(out)


def scan(lines: DataFrame, detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """The report on lines. Matches are few beside lines; written once, so that lines are scanned once."""
    return report_of(materialized(detect(lines, detectors), "matches"))


@dataclass
class Model:
    """A model for the stage of model_stage(), with its labels."""

    make_tokenizer: Callable[[], Tokenizer]
    make_model: Callable[[], ModelOf]
    labels: list[str]
    budget: int = P.TOKEN_BUDGET


@dataclass
class Pictures:
    """What is known of pictures: sizes(path, width, height, photo_like), meta(path, tag, value, gps) and read, which
    gives (path, text) for rows of paths; without it, pictures are not read."""

    sizes: DataFrame
    meta: DataFrame | None = None
    read: Callable[[DataFrame], DataFrame] | None = None


@dataclass
class Documents:
    """How PDF files are read: read gives (path, text, author) for rows of paths, text with a form feed after each page."""

    read: Callable[[DataFrame], DataFrame]


@dataclass
class FileScan:
    """What a scan of files gives.

    findings are ranked; skipped(path, reason) is what was not scanned; images(path, status, ocr_chars) all pictures;
    review those to look at, and overflow there; credentials(root, path, line, rule, detail) block the root;
    model(used, reason, tokens_processed, token_budget, not_model_scanned) and summary are one row.
    """

    findings: DataFrame
    skipped: DataFrame
    images: DataFrame
    review: DataFrame
    credentials: DataFrame
    model: DataFrame
    summary: DataFrame
    pictures_read: bool = False


def _read(expanded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of expanded files: texts(path, text), skipped(path, reason) and images(path)."""
    seen = expanded.where("what IN ('file', 'large')").withColumn("_kind", sniff_kind(F.col("content"), F.col("path")))
    large = F.col("what") == "large"
    # Pictures, PDF and large files are not decoded.
    plain = F.when((F.col("_kind") != "pdf") & (F.col("_kind") != "image") & ~large, F.col("content"))
    read = seen.select("path", "_kind", large.alias("_large"), decode_text(plain).alias("text"))
    reason = F.when(F.col("_kind") == "pdf", P.NO_PDF_TEXT).when(F.col("_kind") == "image", None).when(F.col("_large"), P.TOO_LARGE).when(F.col("text").isNull(), P.BINARY)
    read = materialized(read.select("path", "_kind", "text", reason.alias("reason")), "texts")
    images = read.where("_kind = 'image'").select("path")
    drawing = read.where("reason IS NULL AND _kind != 'image'")
    text = F.when(extension(F.col("path")) == ".svg", T.xml_to_text(F.when(extension(F.col("path")) == ".svg", F.col("text")))).otherwise(F.col("text"))
    return drawing.select("path", text.alias("text")), read.where("reason IS NOT NULL").select("path", "reason"), images


def _metadata_matches(found: DataFrame) -> DataFrame:
    """Match rows of found(path, category, value, context)."""
    nothing = F.lit(None).cast("int")
    value = T.normalize_value(F.col("value"))
    seq = G.seen_at("files", F.col("path"), F.col("path"), nothing, nothing, F.lit(0), F.lit(0), G.step_of(F.lit("metadata")))
    return found.select(
        "category", value.alias("value"), F.lit("metadata").alias("detector"), F.lit(1.0).alias("score"), "path",
        nothing.alias("page"), nothing.alias("line"), F.lit("metadata").alias("kind"), "context", seq.alias("seq"),
    ).where("value IS NOT NULL")


def _people(authors: DataFrame) -> DataFrame:
    """Match rows of authors(path, tag, value) of office files."""
    return _metadata_matches(authors.select("path", F.lit("metadata_person").alias("category"), "value", F.concat("tag", F.lit(" = "), F.col("value")).alias("context")))


def _look_at(images: DataFrame, pictures: Pictures | None) -> tuple[DataFrame, DataFrame, list[DataFrame], list[DataFrame]]:
    """images with status and ocr_chars, those for review, and the lines and matches that pictures give.

    A picture of unknown size is small. Which pictures are read is chosen by size over all of them.
    """
    # All pictures of a scan are one bundle.
    rows = images.select(F.lit("scan").alias("bundle"), "path")
    if pictures is None:
        sized = rows.select("*", F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit(False).alias("photo_like"))
    else:
        facts = pictures.sizes.groupBy("path").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.max("photo_like").alias("photo_like"))
        sized = rows.join(facts, "path", "left").select("bundle", "path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("width", "height")], F.coalesce("photo_like", F.lit(False)).alias("photo_like"))
    lines, matches = [], []
    can_read = pictures is not None and pictures.read is not None
    chosen = materialized(select_ocr_images(sized) if can_read else sized.withColumn("status", F.lit(None).cast("string")), "pictures")
    if pictures is not None and pictures.meta is not None:
        meta = pictures.meta.join(images.distinct(), "path", "left_semi")
        lines.append(metadata_lines(meta.select("path", "tag", "value")))
        matches.append(_metadata_matches(author_metadata(meta).select("path", "category", "value", "context")))
        if "gps" in meta.columns:
            matches.append(_metadata_matches(gps_findings(meta.select("path", "gps").distinct()).select("path", "category", "value", "context")))
    chars = F.length(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]", ""))
    if can_read:
        texts = materialized(pictures.read(chosen.where("status = 'selected'").select("path")), "picture-texts")
        some = texts.where(chars >= P.MIN_OCR_CHARS)
        lines.append(T.to_lines(some, "path").select("path", F.lit(None).cast("int").alias("page"), "line", F.lit("ocr").alias("kind"), "text"))
        counts = texts.groupBy(F.col("path").alias("_path")).agg(F.max(chars).alias("ocr_chars"))
        chosen = materialized(chosen.join(counts, F.col("path") == F.col("_path"), "left").withColumn("ocr_chars", F.coalesce("ocr_chars", F.lit(0))).drop("_path"), "pictures")
    else:
        chosen = chosen.withColumn("ocr_chars", F.lit(0))
    return chosen, visual_review(chosen, can_read), lines, matches


def _pages(unread: DataFrame, documents: Documents) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines and author matches of the PDF files among unread(path, reason), and what stays unread.

    A text of under 20 characters is none; lines are numbered in their page.
    """
    of_pdf = F.col("reason") == P.NO_PDF_TEXT
    texts = materialized(documents.read(unread.where(of_pdf).select("path")).select("path", "text", "author"), "pdf-texts")
    pages = materialized(T.split_pages(texts, "path"), "pages")
    lines = T.to_lines(pages, "path", "page").select("path", "page", "line", F.lit("pdf").alias("kind"), "text")
    author = T.stripped(F.col("author"))
    people = texts.where(author != "").select("path", F.lit("metadata_person").alias("category"), author.alias("value"), F.concat(F.lit("PDF Author = "), author).alias("context"))
    left = unread.where(~of_pdf).unionByName(unread.where(of_pdf).join(pages.select("path").distinct(), "path", "left_anti"))
    return lines, _metadata_matches(people), left


def scan_files(files: DataFrame, detectors: Sequence[Detector] = DETECTORS, extra_lines: DataFrame | None = None, extra_matches: DataFrame | None = None, pictures: Pictures | None = None, model: Model | None = None, documents: Documents | None = None, limits: Limits = Limits(), chars: int | None = P.MAX_SCANNED_CHARS) -> FileScan:
    """The whole scan of files(path, content): refused places, names, archives, office files, texts, pictures, credentials,
    a model if there is one, findings and skips.

    extra_lines are lines of other origin, extra_matches are match rows. Each file that can't be scanned, wholly or
    from some place on, leaves a row in skipped; a damaged one never ends the job. chars is what detectors read of
    each line, None all of it.
    """
    return scan_expanded(expanded_files(files, limits), detectors, extra_lines, extra_matches, pictures, model, documents, chars)


def expanded_files(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """What files(path, content) hold, with their own names and refused places, like the rows of tree.read_tree()."""
    return expand_named(files, limits)


def check_credentials(expanded: DataFrame) -> DataFrame:
    """D9 alone, of what files hold: the hits that block their root, without the rest of the scan."""
    expanded = materialized(expanded, "expanded")
    texts, unread, _ = _read(expanded)
    return _credentials(lines_of(texts).unionByName(_office_lines(expanded)), expanded, expanded.where("what = 'skip'").select("path", "reason").unionByName(unread))


def _credentials(lines: DataFrame, expanded: DataFrame, skipped: DataFrame) -> DataFrame:
    return file_hits(lines.select("path", "line", "text"), expanded.where("what = 'name'").select("path"), skipped)


def _office_lines(expanded: DataFrame) -> DataFrame:
    return T.to_lines(office_text(expanded), "path").select("path", F.lit(None).cast("int").alias("page"), "line", F.lit("office").alias("kind"), "text")


def scan_tree(spark: SparkSession, *roots: str, detectors: Sequence[Detector] = DETECTORS, pictures: Pictures | None = None, model: Model | None = None, documents: Documents | None = None, limits: Limits = Limits(), chars: int | None = P.MAX_SCANNED_CHARS) -> FileScan:
    """The scan of all files below roots, which are read as streams by tree.read_tree(): no file has to fit in a row."""
    return scan_expanded(read_tree(spark, *roots, limits=limits), detectors, pictures=pictures, model=model, documents=documents, chars=chars)


def scan_expanded(expanded: DataFrame, detectors: Sequence[Detector] = DETECTORS, extra_lines: DataFrame | None = None, extra_matches: DataFrame | None = None, pictures: Pictures | None = None, model: Model | None = None, documents: Documents | None = None, chars: int | None = P.MAX_SCANNED_CHARS) -> FileScan:
    """The scan of what files hold, path, what, content and reason as of unpack(). Counts are observed while tables are written."""
    opened, counted = Observation(), Observation()
    expanded = materialized(expanded.observe(opened, F.count_if(F.col("what").isin("file", "large", "archive")).alias("files_seen")), "expanded")
    texts, unread, images = _read(expanded)
    paths = expanded.where("what = 'name'").select("path")
    office, plain = _office_lines(expanded), lines_of(texts)
    chosen, review, seen, known = _look_at(images, pictures)
    if documents is not None:
        pages, people, unread = _pages(unread, documents)
        seen, known = [*seen, pages], [*known, people]
    lines = functools.reduce(DataFrame.unionByName, [plain, office, add_filenames(paths), *seen, *([extra_lines] if extra_lines is not None else [])])
    matches = functools.reduce(DataFrame.unionByName, [detect(lines, detectors, chars), _people(office_authors(expanded)), *known, *([extra_matches] if extra_matches is not None else [])])
    skipped = materialized(expanded.where("what = 'skip'").select("path", "reason").unionByName(unread), "skipped")
    credentials = materialized(_credentials(plain.unionByName(office), expanded, skipped), "credentials")
    facts = {"used": False, "reason": "disabled", "tokens_processed": 0, "token_budget": model.budget if model else 0, "not_model_scanned": []}
    if model:
        asked = lines.withColumn("bundle", F.lit(None).cast("string"))
        stage = model_stage(asked, model.make_tokenizer, model.make_model, model.labels, model.budget)
        matches = matches.unionByName(stage.matches.drop("bundle"))
        facts |= _model_facts(stage)
    found = report_of(materialized(matches, "matches"), counted)
    first = skipped.select("path").orderBy("path").limit(50).collect()
    status = F.col("status")
    looked = chosen.agg(
        F.count(F.lit(1)).alias("images_total"), F.count_if((status == "selected") & (F.col("ocr_chars") >= P.MIN_OCR_CHARS)).alias("images_ocr"),
        F.count_if(status == "small").alias("images_skipped_small"), F.count_if(status == "cap").alias("images_skipped_cap"),
    ).first()
    totals = counted.get
    row = (opened.get["files_seen"], totals["findings_count"], totals["occurrences"] or 0, [r.path for r in first], *looked, facts["tokens_processed"], totals["findings_count"] == 0)
    shape = "files_seen long, findings_count long, occurrences long, first_skipped array<string>, images_total long, images_ocr long, images_skipped_small long, images_skipped_cap long, tokens_processed long, ok boolean"
    spark = expanded.sparkSession
    model_row = spark.createDataFrame([tuple(facts.values())], "used boolean, reason string, tokens_processed long, token_budget long, not_model_scanned array<string>")
    can_read = pictures is not None and pictures.read is not None
    return FileScan(found, skipped, chosen.select("path", "status", "ocr_chars"), review, credentials, model_row, spark.createDataFrame([row], shape), can_read)


def _model_facts(stage: ModelStage) -> dict:
    """What the report says of the model: whether it was needed, what it took, and what was over its budget."""
    cost = (F.col("tokens") + 1).cast("long")
    n, used = stage.used.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("admitted"), cost)), F.lit(0))).first()
    if not n:
        return {"used": False, "reason": NO_MODEL_NEEDED}
    over = not_model_scanned(stage).first()
    reason = f"token budget exceeded: about {over.tokens_over} tokens were checked by regex only" if over else ""
    return {"used": True, "reason": reason, "tokens_processed": used, "not_model_scanned": list(over.not_model_scanned) if over else []}


def scan_summary(files: DataFrame, findings: DataFrame, skipped: DataFrame, images: DataFrame | None = None, budgeted: DataFrame | None = None) -> DataFrame:
    """One row of counts; ok means no findings.

    images(status, ocr_chars) as of select_ocr_images() adds the counts of reading pictures, budgeted(tokens, admitted)
    as of apply_token_budget() the tokens that a model took and those over its budget.
    """
    frames = [
        files.agg(F.count(F.lit(1)).alias("files_seen")),
        findings.agg(F.count(F.lit(1)).alias("findings_count"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences")),
        skipped.select("path").orderBy("path").limit(50).agg(F.sort_array(F.collect_list("path")).alias("first_skipped")),
    ]
    if images is not None:
        status = F.col("status")
        frames.append(images.agg(
            F.count(F.lit(1)).alias("images_total"), F.count_if((status == "selected") & (F.col("ocr_chars") >= 4)).alias("images_ocr"),
            F.count_if(status == "small").alias("images_skipped_small"), F.count_if(status == "cap").alias("images_skipped_cap"),
        ))
    if budgeted is not None:
        cost = (F.col("tokens") + 1).cast("long")
        frames.append(budgeted.agg(F.coalesce(F.sum(F.when(F.col("admitted"), cost)), F.lit(0)).alias("tokens_processed"), F.coalesce(F.sum(F.when(~F.col("admitted"), cost)), F.lit(0)).alias("tokens_over")))
    # Frames of one row each.
    return functools.reduce(DataFrame.crossJoin, frames).withColumn("ok", F.col("findings_count") == 0)


def render_head(summary: DataFrame, ocr_available: bool = False, model_used: bool = False) -> DataFrame:
    """The head of the report."""
    pictures = F.col("images_ocr") if "images_ocr" in summary.columns else F.lit(0)
    lines = [
        F.lit("# PII report"), F.lit(""), F.format_string("- findings: %d", "findings_count"), F.lit(f"- model: {'used' if model_used else 'NOT used'}"),
        F.concat(F.lit(f"- OCR: {'available' if ocr_available else 'unavailable'} ("), pictures.cast("string"), F.lit(" image(s) with text)")), F.lit(""),
    ]
    return summary.select(F.array_join(F.array(*lines), "\n").alias("section"))


def render_skipped(skipped: DataFrame) -> DataFrame:
    """A line for each reason why something was not scanned, with three examples."""
    few = F.array_join(F.slice("examples", 1, 3), ", ")
    return skip_summary(skipped).select("reason", F.format_string("- %s: %d (e.g. %s)", F.col("reason"), F.col("n"), few).alias("section"))


def write_report(findings: DataFrame, path: str) -> None:
    """S10 as tables: JSON lines, one folder for each category."""
    findings.write.partitionBy("category").json(path)


def render_markdown(findings: DataFrame) -> DataFrame:
    """The section of each finding of scan(), numbered in rank order.

    Numbers come from counts per range partition, not from a sort in one task.
    """
    spot = lambda x: F.concat(
        F.lit("- `"), x["path"], F.coalesce(F.concat(F.lit(" p."), x["page"].cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit(" L"), x["line"].cast("string")), F.lit("")), F.lit("` ("), x["kind"], F.lit("): "), x["context"],
    )
    head = F.format_string("%s: %s", "category_label", "value")
    facts = F.format_string("detectors: %s / score %s / %d occurrence(s)", F.array_join("detectors", ", "), F.col("score").cast("string"), "occurrences")
    rows = numbered(findings, F.col("category"), F.desc("occurrences"), F.col("value"))
    lines = F.concat(F.array(F.concat(F.lit("## "), F.col("n").cast("string"), F.lit(". "), head), facts), F.transform("locations", spot), F.array(F.lit("")))
    return rows.select("n", F.array_join(lines, "\n").alias("section"))


def _ordered(part: int, rows: DataFrame, n: Column, section: Column) -> DataFrame:
    return rows.select(F.lit(part).alias("part"), n.cast("long").alias("n"), section.alias("section"))


def write_markdown(scan: FileScan, file: str) -> None:
    """The report as one Markdown file: head, a section for each finding in order, and what was not scanned."""
    facts = scan.model.crossJoin(scan.summary.select("findings_count", "images_ocr"))  # rows of one each
    model = F.concat(F.when(F.col("used"), "used").otherwise("NOT used"), F.lit(" "), F.col("reason"))
    ocr = F.format_string(f"- OCR: {'available' if scan.pictures_read else 'unavailable'} (%d image(s) with text)", "images_ocr")
    head = F.array_join(F.array(F.lit("# PII report"), F.lit(""), F.format_string("- findings: %d", "findings_count"), F.concat(F.lit("- model: "), model), ocr, F.lit("")), "\n")
    skips = numbered(render_skipped(scan.skipped), F.col("reason"))
    title = F.when(F.col("n") == 1, F.lit("## Not PII-scanned\n")).otherwise("")
    parts = [_ordered(0, facts, F.lit(0), head), _ordered(1, render_markdown(scan.findings), F.col("n"), F.col("section")), _ordered(2, skips, F.col("n"), F.concat(title, "section"))]
    write_sections(functools.reduce(DataFrame.unionByName, parts), file)


def _entry(part: int, rows: DataFrame, section: Column) -> DataFrame:
    """Elements of a list or an object, from the second on after a comma."""
    return _ordered(part, rows, F.col("n"), F.concat(F.when(F.col("n") > 1, ",").otherwise(""), section))


def write_json(scan: FileScan, file: str, fingerprint: str | None = None) -> None:
    """The report as one JSON object, with a line for each finding, so that it also reads line by line."""
    one = scan.model.select(F.to_json(F.struct("used", "reason", "tokens_processed", "token_budget", "not_model_scanned")).alias("_model")).crossJoin(scan.summary)
    ocr = F.to_json(F.struct(F.lit(scan.pictures_read).alias("available"), "images_total", "images_ocr", "images_skipped_small", "images_skipped_cap"))
    head = F.concat(
        F.lit('{"ok": '), F.col("ok").cast("string"), F.lit(f', "fingerprint": {json.dumps(fingerprint)}, "files_seen": '), F.col("files_seen").cast("string"), F.lit(', "model": '), "_model",
        F.lit(', "ocr": '), ocr, F.lit(', "findings_count": '), F.col("findings_count").cast("string"), F.lit(', "findings": ['),
    )
    findings = numbered(scan.findings, F.col("category"), F.desc("occurrences"), F.col("value"))
    places = F.transform("locations", lambda x: F.struct(*[x[c].alias(c) for c in ("path", "kind", "page", "line", "context")]))
    found = F.to_json(F.struct("category", F.col("category_label").alias("category_ja"), "value", "detectors", "score", "occurrences", places.alias("locations")))
    review = scan.review.withColumnRenamed("nth", "n")
    shown = F.to_json(F.struct("path", F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")).alias("size"), "photo_like", "ocr_chars"))
    more = scan.review.agg(F.coalesce(F.max("overflow"), F.lit(0)).alias("more"))
    skips = numbered(skip_summary(scan.skipped).withColumnRenamed("n", "skipped"), F.col("reason"))
    # A name in an object: the reason as a JSON string.
    name = F.regexp_extract(F.to_json(F.struct(F.col("reason").alias("r"))), r'^\{"r":([\s\S]*)\}$', 1)
    skip = F.concat(name, F.lit(": "), F.to_json(F.struct(F.col("skipped").alias("count"), "examples")))
    parts = [
        _ordered(0, one, F.lit(0), head), _entry(1, findings, found),
        _ordered(2, more, F.lit(0), F.lit('], "images_for_visual_review": [')), _entry(3, review, shown),
        _ordered(4, more, F.lit(0), F.concat(F.lit('], "images_not_visually_listed": '), F.col("more").cast("string"), F.lit(', "not_scanned": {'))),
        _entry(5, skips, skip), _ordered(6, more, F.lit(0), F.lit("}}")),
    ]
    write_sections(functools.reduce(DataFrame.unionByName, parts), file)
