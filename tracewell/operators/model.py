"""The stage of a pluggable token-classification model: what it reads, its budget, its windows, its spans.

The admitted lines of a bundle are one logical text, each document after an empty line. Tokenizers and models
are the caller's: a tokenizer gives (id, start, end) of the tokens of a line with its line end, a model the logits of
a sequence of ids. Nothing here holds a bundle: lines, tokens, windows and blocks are rows, and positions are running totals.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.functions import text as T
from tracewell.functions.tables import materialized, running_total
from tracewell.operators.blocks import best_spans, lists, moves, row_slices
from tracewell.operators.findings import seen_at
from tracewell.operators.merge import attach_locations
from tracewell.sources.files import is_prose


def model_worthy(text: Column) -> Column:
    """text.rlike(P.MODEL_WORTHY), of which each part is looked for alone and the pattern only run on lines with letters of odd case.

    The small letters of a line are bound to a name, so that they are made once.
    """
    has = lambda line, words: reduce(or_, [F.contains(line, F.lit(word)) for word in words])
    words = F.get(F.transform(F.array(F.lower(text)), lambda low: has(low, P.MODEL_WORDS)), F.lit(0))
    near, names = P.MODEL_NAMES
    return words | F.contains(text, F.lit("@")) | text.rlike(P.MODEL_MARKS) | (text.rlike(near) & text.rlike(names)) | (has(text, P.ODD_CASE) & text.rlike(P.MODEL_WORTHY))


def model_candidates(lines: DataFrame) -> DataFrame:
    """Every line of prose and other lines that could carry personal data, none over 2000 characters."""
    short = F.length("text") <= P.MAX_MODEL_LINE_CHARS
    prose = is_prose(F.col("path"))
    return lines.where(short & (prose | model_worthy(F.col("text")))).withColumn("prose", prose)


def human_filename(name: Column) -> Column:
    """P3."""
    return name.rlike(P.HUMAN_FILENAME)


def distinct_lines(lines: DataFrame, *within: str) -> DataFrame:
    """A5: each distinct trimmed text once, with its first seq and its number of places."""
    return lines.groupBy(*within, T.stripped(F.col("text")).alias("text")).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n_places"))


def apply_token_budget(lines: DataFrame, budget: int = P.TOKEN_BUDGET, salts: int = 32) -> DataFrame:
    """lines(bundle, priority, seq, text, tokens) with admitted; a line that does not fit is skipped, later ones may.

    What is left of the budget never grows, so of the lines of one cost only the first budget // cost
    can be admitted. That prunes each bundle to a number of lines that depends on the budget alone,
    by rank within a salt and then within the cost, before the greedy pass.
    """
    order = [F.col("priority"), F.col("seq")]
    priced = lines.withColumn("_cost", F.col("tokens") + 1)
    most = F.floor(F.lit(budget) / F.col("_cost"))
    salted = Window.partitionBy("bundle", "_cost", F.pmod(F.xxhash64("seq"), F.lit(salts))).orderBy(*order)
    few = priced.where(F.col("_cost") <= budget).withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= most)
    few = few.withColumn("_n", F.row_number().over(Window.partitionBy("bundle", "_cost").orderBy(*order))).where(F.col("_n") <= most)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        # Not by pandas, which takes strings as equal that are up to a NUL.
        pdf = pdf.iloc[sorted(range(len(pdf)), key=list(zip(pdf["priority"], pdf["seq"])).__getitem__)]
        left, taken = budget, []
        for cost in pdf["_cost"]:
            taken.append(cost <= left)
            left -= cost if taken[-1] else 0
        return pdf.loc[taken, ["bundle", "priority", "seq"]]

    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    chosen = few.select("bundle", "priority", "seq", "_cost").groupBy("bundle").applyInPandas(greedy, ", ".join(f"{c} {kinds[c]}" for c in ("bundle", "priority", "seq")))
    chosen = chosen.select(F.lit(True).alias("_in"), *[F.col(c).alias(f"_{c}") for c in ("bundle", "priority", "seq")])
    out = lines.join(chosen, (F.col("seq") == F.col("_seq")) & (F.col("priority") == F.col("_priority")) & F.col("bundle").eqNullSafe(F.col("_bundle")), "left")
    return out.select(*lines.columns, F.coalesce("_in", F.lit(False)).alias("admitted"))


def token_windows(documents: DataFrame, size: int = P.MODEL_WINDOW, overlap: int = P.MODEL_CONTEXT) -> DataFrame:
    """Windows (start, end) over documents(doc_id, n) and the part (keep_from, keep_to) that each decides."""
    step = size - 2 * overlap
    last = F.ceil(F.greatest(F.col("n") - size, F.lit(0)) / step)
    rows = documents.where("n > 0").withColumn("last", last).withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last").cast("long"))))
    start = F.col("window") * step
    end = F.least(start + size, F.col("n"))
    return rows.select(
        "doc_id", "n", "window", start.alias("start"), end.alias("end"),
        F.when(F.col("window") > 0, start + overlap).otherwise(start).alias("keep_from"), F.when(F.col("window") < F.col("last"), end - overlap).otherwise(end).alias("keep_to"),
    )


Scorer = Callable[[list[str]], list[list[tuple[int, int, list[float]]]]]
#: The same in arrays: starts, ends and logits (token, label) of the tokens of each text.
ArrayScorer = Callable[[list[str]], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]
#: (id, start, end) of the tokens of each text.
Tokenizer = Callable[[list[str]], list[list[tuple[int, int, int]]]]
#: Logits (token, label) of a sequence of ids.
Model = Callable[[np.ndarray], np.ndarray]
#: Characters of the texts that are scored at once, and tokens that leave a task at once.
SCORED_CHARS, SCORED_ROWS = 1 << 16, 4096


def score_tokens(lines: DataFrame, make_scorer: Callable[[], Scorer]) -> DataFrame:
    """M1 for single texts: token scores of lines(doc_id, text) by a caller's model, made once per task.

    The scorer gets a few texts and returns, for each, (start, end, logits) of its tokens. A task holds
    the tokens of at most SCORED_CHARS characters, or of one text, and gives them on SCORED_ROWS at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            for part in row_slices([len(t or "") for t in pdf["text"]], SCORED_CHARS):
                texts = pdf.iloc[part]
                rows = ((doc, pos, a, b, logits) for doc, tokens in zip(texts["doc_id"], scorer(list(texts["text"]))) for pos, (a, b, logits) in enumerate(tokens))
                while some := list(itertools.islice(rows, SCORED_ROWS)):
                    yield pd.DataFrame(some, columns=["doc_id", "pos", "start", "end", "logits"])

    return lines.select("doc_id", "text").mapInPandas(run, "doc_id long, pos int, start int, end int, logits array<float>")


def score_blocks(lines: DataFrame, make_scorer: Callable[[], ArrayScorer], block: int = P.MODEL_WINDOW) -> DataFrame:
    """The tokens of score_tokens() as the blocks of best_spans(), which need no shuffle, as a task has all tokens of a text.

    doc_id is a key. A task holds the tokens of at most SCORED_CHARS characters, or of one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = make_scorer()
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for part in row_slices([len(t or "") for t in texts], SCORED_CHARS):
                found = scorer(texts[part])
                n = np.array([len(x[0]) for x in found], np.int64)
                if not n.sum():
                    continue
                starts, ends, logits = (np.concatenate([x[i] for x in found]) for i in range(3))
                counts = -(-n // block)
                of = np.repeat(np.arange(len(n)), counts)
                number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                sizes = np.minimum(n[of] - number * block, block)
                columns = [docs.take(pa.array(of + part.start)), pa.array(number), *(lists(x.astype(np.int32), sizes) for x in (starts, ends)), lists(logits.astype(np.float32).ravel(), sizes * logits.shape[1]), pa.array(n[of] <= block)]
                yield pa.RecordBatch.from_arrays(columns, ["bundle", "block", "starts", "ends", "logits", "alone"])

    return lines.select("doc_id", "text").mapInArrow(run, "bundle long, block long, starts array<int>, ends array<int>, logits array<float>, alone boolean")


def count_tokens(lines: DataFrame, make_tokenizer: Callable[[], Tokenizer]) -> DataFrame:
    """Adds tokens, the number of tokens of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = make_tokenizer()
        for pdf in batches:
            yield pdf.assign(tokens=[len(x) for x in tokenizer(list(pdf["text"]))])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema.fields)
    return lines.mapInPandas(run, f"{fields}, tokens long")


def tokens_of(placed: DataFrame, make_tokenizer: Callable[[], Tokenizer]) -> DataFrame:
    """bundle, first, ids, starts, ends of the tokens of each row of placed(bundle, start, text).

    first is the position of its first token in the bundle's sequence; starts and ends are offsets in the bundle's text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = make_tokenizer()
        for pdf in batches:
            found = [np.array(x, np.int64).reshape(-1, 3) for x in tokenizer(list(pdf["text"]))]
            at = pdf["start"].to_numpy()
            yield pd.DataFrame({
                "bundle": pdf["bundle"], "at": at, "n": [len(x) for x in found], "ids": [x[:, 0] for x in found],
                "starts": [x[:, 1] + a for x, a in zip(found, at)], "ends": [x[:, 2] + a for x, a in zip(found, at)],
            })

    kind = placed.schema["bundle"].dataType.simpleString()
    rows = placed.select("bundle", "start", "text").mapInPandas(run, f"bundle {kind}, at long, n long, ids array<long>, starts array<long>, ends array<long>")
    return running_total(rows.where("n > 0"), F.col("n"), "bundle", "at").select("bundle", (F.col("total") - F.col("n")).alias("first"), "ids", "starts", "ends")


def score_windows(tokens: DataFrame, make_model: Callable[[], Model], size: int = P.MODEL_WINDOW, overlap: int = P.MODEL_CONTEXT) -> DataFrame:
    """M1 with W5: blocks(bundle, block, starts, ends, logits) of the sequences of tokens_of().

    Each window of a sequence is scored in a group of its own, with the tokens around those that it decides. A
    row of tokens goes to the windows that it overlaps; the model is made once per task. Blocks are the kept
    parts of windows, and together hold each token once. tokens is read twice and should be a written table.
    """
    lengths = tokens.groupBy(F.col("bundle").alias("doc_id")).agg(F.max(F.col("first") + F.size("ids")).alias("n"))
    windows = token_windows(lengths, size, overlap).withColumnRenamed("doc_id", "_bundle").withColumnRenamed("window", "_window")
    step = size - 2 * overlap
    upto = F.col("first") + F.size("ids")
    low = F.greatest(F.floor((F.col("first") - size) / step) + 1, F.lit(0))
    dealt = tokens.withColumn("window", F.explode(F.sequence(low, F.greatest(low, F.floor((upto - 1) / step)))))
    met = dealt.join(windows, F.col("bundle").eqNullSafe(F.col("_bundle")) & (F.col("window") == F.col("_window")))
    met = met.where((F.col("first") < F.col("end")) & (upto > F.col("start")))
    held: list[Model] = []

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        if not held:
            held.append(make_model())
        pdf = pdf.sort_values("first")
        base = int(pdf["first"].iloc[0])
        ids, starts, ends = (np.concatenate(list(pdf[c])) for c in ("ids", "starts", "ends"))
        a, b, keep, to = (int(pdf[c].iloc[0]) for c in ("start", "end", "keep_from", "keep_to"))
        logits = np.asarray(held[0](ids[a - base : b - base]), np.float32)[keep - a : to - a]
        kept = slice(keep - base, to - base)
        return pd.DataFrame({"bundle": pdf["bundle"].iloc[:1].tolist(), "block": pdf["window"].iloc[:1].tolist(), "starts": [starts[kept]], "ends": [ends[kept]], "logits": [logits.ravel()]})

    kind = tokens.schema["bundle"].dataType.simpleString()
    return met.select("bundle", "window", "first", "ids", "starts", "ends", "start", "end", "keep_from", "keep_to").groupBy("bundle", "window").applyInPandas(
        score, f"bundle {kind}, block long, starts array<long>, ends array<long>, logits array<float>"
    )


def best_path(logp: np.ndarray, labels: list[str]) -> list[int]:
    """The most likely legal path over BIOES labels, in one pass over a short sequence."""
    move = moves(labels)
    none = labels.index("O")
    score, back = move[none] + logp[0], []
    for row in logp[1:]:
        steps = score[:, None] + move
        back.append(steps.argmax(axis=0))
        score = steps.max(axis=0) + row
    path = [int((score + move[:, none]).argmax())]
    for pointers in reversed(back):
        path.append(int(pointers[path[-1]]))
    return path[::-1]


def decode_spans(token_scores: DataFrame, labels: list[str], block: int = P.MODEL_WINDOW) -> DataFrame:
    """M2: doc_id, category, start, end, score of the spans of token_scores(doc_id, pos, start, end, logits).

    A document of any length is cut into blocks of tokens; see blocks.best_spans().
    """
    token = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "logits"))).alias("t")
    rows = token_scores.groupBy(F.col("doc_id").alias("bundle"), F.floor(F.col("pos") / block).alias("block")).agg(token)
    return decode_blocks(rows.select("bundle", "block", F.col("t.start").alias("starts"), F.col("t.end").alias("ends"), F.flatten("t.logits").alias("logits")), labels)


def decode_blocks(blocks: DataFrame, labels: list[str]) -> DataFrame:
    """decode_spans() of score_blocks()."""
    found = best_spans(materialized(blocks, "blocks"), labels)
    return found.select(F.col("bundle").alias("doc_id"), "category", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "score")


def accept_spans(spans: DataFrame) -> DataFrame:
    """Spans with a value that are sure enough and have a word character."""
    value = T.stripped(F.col("value"))
    return spans.where((F.col("score") >= P.MIN_SPAN_SCORE) & (F.length(value) >= 2) & value.rlike(f"[{P.WORD}぀-ヿ㐀-鿿]"))


def line_starts(lines: DataFrame) -> DataFrame:
    """bundle, seq, length, start and next of lines(bundle, seq, text) joined by line ends; texts are not moved."""
    short = lines.select("bundle", "seq", F.length("text").cast("long").alias("length"))
    placed = running_total(short, F.col("length") + 1, "bundle", "seq")
    return placed.select("bundle", "seq", "length", (F.col("total") - F.col("length") - 1).alias("start"), F.col("total").alias("next"))


def _in_lines(spans: DataFrame, starts: DataFrame, last: Column, bucket: int) -> DataFrame:
    """Spans with the lines of starts(bundle, seq, length, start, next) that they meet up to an offset.

    An equi-join on the bundle and the bucket; a line is listed in each bucket it covers, a span in each up to last.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    placed = starts.select(F.col("bundle").alias("_bundle"), "seq", "length", F.col("start").alias("_from"), F.col("next").alias("_next"))
    listed = placed.withColumn("_b", buckets(F.col("_from"), F.col("_next") - 1))
    asked = spans.withColumn("_bucket", buckets(F.col("start"), last))
    met = asked.join(listed, F.col("bundle").eqNullSafe(F.col("_bundle")) & (F.col("_bucket") == F.col("_b")))
    # A span and a line that share several buckets meet in the first of them.
    first = F.floor(F.greatest(F.col("start"), F.col("_from")) / bucket) == F.col("_bucket")
    return met.where(first & (F.col("_next") > F.col("start")) & (F.col("_from") <= last)).drop("_b", "_bucket", "_bundle")


def offsets_to_lines(spans: DataFrame, lines: DataFrame, bucket: int = 65536, starts: DataFrame | None = None) -> DataFrame:
    """Each span with its line and its offsets there; it belongs to the line it starts in and ends with it at the latest.

    starts is line_starts(lines), if the caller has it. Texts join at the end, by line.
    """
    found = _in_lines(spans, line_starts(lines) if starts is None else starts, F.col("start"), bucket)
    texts = lines.select(F.col("bundle").alias("_bundle"), F.col("seq").alias("_seq"), "text")
    joined = found.join(texts, F.col("bundle").eqNullSafe(F.col("_bundle")) & (F.col("seq") == F.col("_seq")))
    low = F.col("start") - F.col("_from")
    return joined.select(*spans.columns, "seq", "text", low.alias("line_start"), F.least(F.col("length"), F.col("end") - F.col("_from")).alias("line_end"))


def span_values(spans: DataFrame, placed: DataFrame, bucket: int = 65536) -> DataFrame:
    """Spans with value, the text that they cover over all lines, and with line_start, line_end, seq and text of the first.

    placed(bundle, seq, text, length, start, next) are the lines of a bundle's text. A row is added up for
    each span, of the few lines that it covers.
    """
    texts = placed.select(F.col("bundle").alias("_b2"), F.col("seq").alias("_seq"), "text")
    met = _in_lines(spans, placed, F.col("end") - 1, bucket)
    met = met.join(texts, F.col("bundle").eqNullSafe(F.col("_b2")) & (F.col("seq") == F.col("_seq"))).drop("_b2", "_seq")
    low, high = F.greatest(F.col("start") - F.col("_from"), F.lit(0)), F.least(F.col("length"), F.col("end") - F.col("_from"))
    part = F.substring("text", (low + 1).cast("int"), (high - low).cast("int"))
    row = F.struct("_from", part.alias("part"), "seq", "text", low.alias("line_start"), high.alias("line_end"))
    whole = met.groupBy(*spans.columns).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    first = F.get("_rows", F.lit(0))
    return whole.select(*spans.columns, F.array_join(F.col("_rows.part"), "\n").alias("value"), *[first[c].alias(c) for c in ("seq", "text", "line_start", "line_end")])


@dataclass
class ModelStage:
    """matches: rows like those of detect(). used: the lines that the model read or that were over its budget, with
    bundle, path, tokens and admitted, a row for each distinct text. places: where each of them stands."""

    matches: DataFrame
    used: DataFrame
    places: DataFrame


#: Order of what the model reads: names of files, then documents by their kind, then lines of code.
_PRIORITY = {"filename": -1, "metadata": 0, "ocr": 1, "office": 2, "pdf": 2, "text": 3}
CODE_PRIORITY = 4


def _inputs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries(bundle, priority, seq, doc, text) that the model may read, and the places of each.

    Names and lines of code are taken once for each text, with all their places; lines of documents stay as they are.
    """
    prose = (F.col("kind") != "text") | is_prose(F.col("path"))
    name = F.col("kind") == "filename"
    wanted = F.when(name, human_filename(F.col("text"))).otherwise((F.length("text") <= P.MAX_MODEL_LINE_CHARS) & (prose | model_worthy(F.col("text"))))
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in _PRIORITY.items()], F.lit(_PRIORITY["text"]))
    doc = F.concat_ws("\x00", "path", F.lpad(F.coalesce("page", F.lit(0)).cast("string"), 10, "0"))
    own = lines.where(wanted).select(
        # No bundle is a name of its own, so that joins need not look out for nulls.
        F.coalesce(F.concat(F.lit("="), F.col("bundle").cast("string")), F.lit("")).alias("bundle"), F.when(prose, rank).otherwise(CODE_PRIORITY).alias("priority"),
        F.when(name | ~prose, F.lit("")).otherwise(doc).alias("doc"), F.concat_ws("\x00", doc, F.lpad(F.coalesce("line", F.lit(0)).cast("string"), 10, "0")).alias("seq"),
        F.when(~prose, T.stripped(F.col("text"))).otherwise(F.col("text")).alias("text"), F.struct("path", "page", "line", "kind").alias("place"),
    )
    own = materialized(own, "model-lines")
    once = own.where("doc = ''").groupBy("bundle", "priority", "doc", "text").agg(F.min("seq").alias("seq"))
    entries = once.select("bundle", "priority", "doc", "seq", "text").unionByName(own.where("doc != ''").select("bundle", "priority", "doc", "seq", "text"))
    return entries, own


def model_stage(lines: DataFrame, make_tokenizer: Callable[[], Tokenizer], make_model: Callable[[], Model], labels: list[str], budget: int = P.TOKEN_BUDGET,
                size: int = P.MODEL_WINDOW, overlap: int = P.MODEL_CONTEXT, detector: str = "model") -> ModelStage:
    """What a model finds in lines(bundle, path, page, line, kind, text): A5, W4, M1 with W5, M2, P6, J3, J2.

    Texts are admitted up to the budget of their bundle, scored as one sequence for each bundle, and what is found in
    them goes back to all their places. A span that crosses lines belongs to the first of them.
    """
    entries, own = _inputs(lines)
    priced = materialized(apply_token_budget(materialized(count_tokens(entries, make_tokenizer), "priced"), budget), "budget")
    admitted = priced.where("admitted").select("bundle", "priority", "doc", "seq", "text")
    # An empty line before each document.
    gaps = admitted.select("bundle", "priority", "doc").distinct().select("*", F.lit("").alias("seq"), F.lit("").alias("text"))
    length = F.length("text").cast("long")
    joined = running_total(admitted.unionByName(gaps), length + 1, "bundle", "priority", "doc", "seq")
    key = F.concat_ws("\x00", F.col("priority").cast("string"), "seq").alias("seq")
    text = materialized(joined.select("bundle", key, "text", length.alias("length"), (F.col("total") - length - 1).alias("start"), F.col("total").alias("next"), (F.col("seq") == "").alias("gap")), "model-text")
    tokens = materialized(tokens_of(text.withColumn("text", F.concat("text", F.lit("\n"))), make_tokenizer), "model-tokens")
    placed = text.where("NOT gap")
    blocks = materialized(score_windows(tokens, make_model, size, overlap), "model-blocks")
    spans = best_spans(blocks, labels)
    valued = accept_spans(span_values(spans, placed))
    context = T.context(F.col("text"), F.col("line_start").cast("int"), F.col("line_end").cast("int"))
    hits = materialized(valued.select("bundle", "seq", "text", "category", T.normalize_value(F.col("value")).alias("value"), "score", context.alias("context"), F.col("line_start").alias("_at")).where("value IS NOT NULL"), "model-hits")
    # Lines of documents have one place each, other texts all of theirs.
    priority = F.substring_index("seq", "\x00", 1).cast("int")
    own_key = F.concat_ws("\x00", F.col("priority").cast("string"), "seq")
    shared = attach_locations(hits.where(priority.isin(-1, CODE_PRIORITY)).withColumn("priority", priority), own.where("doc = ''").select("bundle", "priority", "text", "place"), ("bundle", "priority", "text"))
    single = hits.join(own.where("doc != ''").select("bundle", own_key.alias("seq"), "place"), ["bundle", "seq"])
    columns = ["bundle", "seq", "category", "value", "score", "context", "place", "_at"]
    found = shared.select(columns).unionByName(single.select(columns))
    rank = F.concat(F.lpad((priority + 1).cast("string"), 2, "0"), F.substring("seq", 1, 1 << 20))
    matches = found.select(
        "category", "value", F.lit(detector).alias("detector"), "score", *[F.col(f"place.{c}").alias(c) for c in ("path", "page", "line", "kind")], "context",
        seen_at("model", rank, F.col("place.path"), F.col("place.page"), F.col("place.line"), F.lit(0), F.col("_at").cast("int")).alias("seq"), _bundle_name().alias("bundle"),
    )
    read = priced.select("*", F.when(F.col("doc") != "", F.substring_index("doc", "\x00", 1)).otherwise(F.substring_index("seq", "\x00", 1)).alias("path"))
    return ModelStage(matches, read.select(_bundle_name().alias("bundle"), "priority", "seq", "path", "text", "tokens", "admitted"), own)


def _bundle_name() -> Column:
    return F.when(F.col("bundle") != "", F.substring("bundle", 2, 1 << 30))


def not_model_scanned(stage: ModelStage, limit: int = 50) -> DataFrame:
    """bundle, tokens_over and the first paths with lines that were over the budget of their bundle.

    Paths are those of all places of such a text. Spark keeps the first of each task before it shuffles them by bundle.
    """
    own = stage.places
    over = stage.used.where("NOT admitted").select(F.coalesce(F.concat(F.lit("="), "bundle"), F.lit("")).alias("bundle"), "priority", "seq", "text", "tokens")
    sums = over.groupBy("bundle").agg(F.sum(F.col("tokens") + 1).alias("tokens_over"))
    shared = own.where("doc = ''").select("bundle", "priority", "text", F.col("place.path").alias("path")).join(over.select("bundle", "priority", "text"), ["bundle", "priority", "text"], "left_semi")
    single = own.where("doc != ''").select("bundle", "priority", "seq", F.col("place.path").alias("path")).join(over.select("bundle", "priority", "seq"), ["bundle", "priority", "seq"], "left_semi")
    paths = shared.select("bundle", "path").unionByName(single.select("bundle", "path")).distinct()
    rank = F.row_number().over(Window.partitionBy("bundle").orderBy("path"))
    few = paths.withColumn("_n", rank).where(F.col("_n") <= limit)
    lists = few.groupBy("bundle").agg(F.array_sort(F.collect_list("path")).alias("not_model_scanned"))
    return sums.join(lists, "bundle").select(_bundle_name().alias("bundle"), "tokens_over", "not_model_scanned")
