"""Secrets in whole texts: patterns, and character Markov models for what no pattern names.

Two first-order Markov models over the characters of secrets, one of random strings and one of
ordinary identifiers, are counted from labelled texts. Random are the values that the patterns find
in all texts, and generated strings; ordinary are the other runs of such
characters in these texts, identifiers joined from common words, and kinds that look random (part numbers,
acronyms, sequences of proteins). UUIDs, addresses and short identifiers in links are known by their form. All texts fall by hash into PARTS,
of which two are not counted. On all texts of the first, the least score that is reported is
fitted, the one that at most FALSE_RUNS of the ordinary runs reach. On all texts of the second, which
nothing is learned from, precision and recall are measured (evaluate).

The score of a run is the log-likelihood ratio of its best segment, the stretch of characters whose
ratios have the largest sum. So a random string is found also where ordinary words are joined to it
by marks, and beside a part that a pattern has reported. Its length is not asked for; a short one
doesn't reach the least score.

Defined cases: null text is empty and has no spans; very long texts are scanned whole, in numpy over
all their characters at once; repeated rows get equal results and are learned from once; an empty
table gives an empty result and models of the generated samples alone; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import buffers, written

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "markov")
#: Byte patterns: letters match in either case only in ASCII.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_CHARS = 6
#: One of these stands in each match of ASSIGN.
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
START = len(ALPHABET)
_CODE = np.full(256, 255, np.uint8)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(START, dtype=np.uint8)
#: Shortest run of ordinary characters to learn from.
WORD_CHARS = 4
#: No limit: all texts are learned from.
SAMPLE = None
#: Parts of texts: one for the least score, one to measure on, the rest to count.
PARTS = 8
FITTED, MEASURED = 0, 1
#: Random strings that are generated for each alphabet.
GENERATED = 2000
#: Share of ordinary runs that may reach the least score, and what it is at least: odds of a million to one.
FALSE_RUNS = 1e-5
LEAST_SCORE = math.log(1e6)
REPLACEMENT = "[secret]"

Span = tuple[int, int, int]


def base_spans(raw: bytes) -> list[Span]:
    """(start, end, kind) of pattern matches in bytes, leftmost and not overlapping within a kind."""
    small, found = raw.lower(), []
    if any(word in small for word in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if m.end(1) - m.start(1) >= ASSIGN_CHARS]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(raw)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _count(codes: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    """Adds the pairs of each run; starts marks where runs begin in codes."""
    before = np.where(starts, START, np.concatenate(([0], codes[:-1])).astype(np.int64))
    out += np.bincount(before * START + codes, minlength=(START + 1) * START).reshape(START + 1, START)


def generated() -> np.ndarray:
    """Pair counts of random strings over the usual alphabets of secrets."""
    out, draw = np.zeros((START + 1, START), np.int64), np.random.default_rng(7)
    for letters in (string.ascii_letters + string.digits, ALPHABET.replace("=", ""), string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, "0123456789abcdef"):
        codes = _CODE[np.frombuffer(letters.encode(), np.uint8)]
        chosen = codes[draw.integers(0, len(codes), (GENERATED, 32))]
        starts = np.zeros(chosen.shape, bool)
        starts[:, 0] = True
        _count(chosen.ravel(), starts.ravel(), out)
    return out


#: Labelled samples of ordinary identifiers: these words, joined two and three at a time in each style.
ORDINARY_WORDS = (
    "access account address admin api app application array base build button cache client code config connection content context count create credentials "
    "data database date default delete description document domain error event example export field file filter first folder format function group handler "
    "header host html http https id image import index info input item json key label language last length level library license line link list load local "
    "location login main manager map max memory message method min model module name network node null number object option order output package page param "
    "parent password path pattern payment phone port position product profile project property public query read record region release report request resource "
    "response result role root row run save schema search secret section select server service session set setting size sort source start state status store "
    "string style submit summary system table tag target task template test text time title token total tree type update upload url user util value version "
    "view warning width window word write www zone"
).split()


#: Names of character sets, for samples of lists of them.
CHARSETS = ("ISO-8859-1", "ISO-8859-15", "ISO-2022-JP", "UTF-8", "UTF-16LE", "UTF-16BE", "UTF-32", "CP1252", "CP437", "CP932", "KOI8-R", "Windows-1251", "Shift_JIS", "EUC-KR", "GB18030", "Big5", "US-ASCII", "IBM850", "MacRoman")
_CAPITALS, _CONSONANTS, _AMINO = string.ascii_uppercase, "bcdfghjklmnpqrstvwxz", "ACDEFGHIKLMNPQRSTVWY"


def ordinary_kinds(seed: int, n: int) -> dict[str, list[str]]:
    """n ordinary identifiers of each kind that looks random: labelled samples, to learn from and, of another seed, to measure on."""
    draw = np.random.default_rng(seed)
    word = lambda letters, low, high: "".join(draw.choice(list(letters), int(draw.integers(low, high + 1))))
    hexes, digits = string.hexdigits[:16], string.digits
    short = string.ascii_letters + digits + "_-"
    dashed = lambda letters: "-".join(word(letters, k, k) for k in (8, 4, 4, 4, 12))
    kinds = {
        "uuid": lambda: dashed(hexes) if draw.integers(2) else dashed(hexes).upper(),
        "charsets": lambda: draw.choice(list("/,;")).join(draw.choice(CHARSETS, int(draw.integers(1, 4)))),
        "part_number": lambda: "-".join((word(_CAPITALS, 2, 3), word(digits, 3, 5), word(_CAPITALS, 1, 2), word(digits, 1, 3) + word(_CAPITALS, 0, 1))) + ("-REV" + word(digits, 1, 1) if draw.integers(2) else ""),
        "acronym": lambda: word(_CAPITALS, 3, 9),
        "consonants": lambda: word(_CONSONANTS, 4, 9),
        "url_id": lambda: "https://media.example/watch?v=" + word(short, 11, 11) if draw.integers(2) else "http://x.example/i/" + word(short, 6, 10) + "?page=2",
        "address": lambda: "0x" + word(hexes, 6, 16),
        "protein": lambda: word(_AMINO, 15, 40),
        "time": lambda: f"{draw.integers(1970, 2040)}-{draw.integers(1, 13):02d}-{draw.integers(1, 29):02d}T{draw.integers(24):02d}:{draw.integers(60):02d}:{draw.integers(60):02d}Z",
    }
    return {kind: [make() for _ in range(n)] for kind, make in kinds.items()}


#: Forms by which an identifier is known that no model of characters tells from a secret: UUIDs, addresses in
#: memory, and short identifiers in links.
KNOWN = re.compile(rb"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![0-9A-Za-z])|0x[0-9a-fA-F]{1,16}(?![0-9A-Za-z])")
_LINK = re.compile(rb"https?://[^\x00-\x20\"'<>]+")
_SHORT = re.compile(rb"[A-Za-z0-9_-]+")
LINK_CHARS = 12


def known_spans(raw: bytes) -> list[Span]:
    """Where identifiers of known forms stand."""
    found = [(m.start(), m.end(), 3) for m in KNOWN.finditer(raw)]
    for link in _LINK.finditer(raw):
        found += [(m.start(), m.end(), 3) for m in _SHORT.finditer(raw, link.start(), link.end()) if m.end() - m.start() <= LINK_CHARS]
    return found


def ordinary() -> np.ndarray:
    """Pair counts of ordinary identifiers."""
    out, draw = np.zeros((START + 1, START), np.int64), np.random.default_rng(11)
    hard = ordinary_kinds(12, 1500)
    for text in (x for kind in ("charsets", "part_number", "acronym", "consonants", "protein", "time") for x in hard[kind]):
        codes = _CODE[np.frombuffer(text.encode(), np.uint8)]
        inside = codes < START
        first = inside & ~np.concatenate(([False], inside[:-1]))
        _count(codes[inside], first[inside], out)
    styles = [lambda w, s=s: s.join(w) for s in "_-/"]
    styles += [lambda w: w[0] + "".join(x.title() for x in w[1:]), lambda w: "".join(x.title() for x in w), lambda w: "_".join(w).upper(), lambda w: "".join(w)]
    for k in range(7000):
        chosen = [ORDINARY_WORDS[i] for i in draw.integers(0, len(ORDINARY_WORDS), 2 + k % 3)]
        text = styles[k % len(styles)](chosen) + ("" if k % 5 else str(int(draw.integers(0, 2100))))
        codes = _CODE[np.frombuffer(text.encode(), np.uint8)]
        _count(codes, np.arange(len(codes)) == 0, out)
    return out


@dataclass
class Model:
    """Log-likelihood ratio by pair of characters, and the least score of a span."""

    ratios: np.ndarray
    least: float = LEAST_SCORE


def runs_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of characters of secrets."""
    edge = np.diff(np.concatenate(([0], (codes < START).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _outside(raw: bytes, taken: list[Span]) -> np.ndarray:
    """Codes of a text's bytes, with spans blanked."""
    codes = _CODE[np.frombuffer(raw, np.uint8)]
    for start, end, _ in taken:
        codes[start:end] = 255
    return codes


def _values(raw: bytes, spans: list[Span]) -> list[bytes]:
    """What patterns found: an assignment's value, else the whole match."""
    return [m.group(1) if k == 0 and (m := ASSIGN.match(raw[a:b])) else raw[a:b] for a, b, k in spans]


def _counted(raw: bytes) -> np.ndarray:
    """Pair counts of a text's ordinary runs and of its secrets."""
    counts, spans = np.zeros((2, START + 1, START), np.int64), base_spans(raw)
    for value in _values(raw, spans):
        codes = _CODE[np.frombuffer(value, np.uint8)]
        codes = codes[codes < START]
        _count(codes, np.arange(len(codes)) == 0, counts[1])
    codes = _outside(raw, spans)
    first, last = runs_of(codes)
    long = last - first >= WORD_CHARS
    kept = np.repeat(long, last - first)
    starts = np.zeros(len(codes), bool)
    starts[first] = True
    inside = codes < START
    _count(codes[inside][kept], starts[inside][kept], counts[0])
    return counts


def _models(counts: np.ndarray) -> np.ndarray:
    samples = np.stack((ordinary(), generated()))
    # The corpus counts as much as the other samples, however large its sample is.
    counts = counts * (samples.sum(axis=(1, 2)) / np.maximum(counts.sum(axis=(1, 2)), 1))[:, None, None] + samples
    logs = np.log((counts + 0.5) / (counts + 0.5).sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


def best_segments(codes: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and score of the best segment of each run; all runs at once, as sums from the last low point of a run."""
    first, last = runs_of(codes)
    if not len(first):
        return first, last, np.zeros(0)
    inside = codes < START
    before = np.empty(len(codes), np.int64)
    before[0], before[1:] = START, codes[:-1]
    before[first] = START
    steps = np.where(inside, ratios[np.where(inside, before, START), np.where(inside, codes, 0)], 0.0)
    total = np.concatenate(([0.0], np.cumsum(steps)))
    # Most runs are words whose positive steps together stay low.
    upto = np.concatenate(([0.0], np.cumsum(np.maximum(steps, 0))))
    likely = np.flatnonzero(upto[last] - upto[first] > 0)
    starts, ends, scores = first.copy(), last.copy(), np.zeros(len(first))
    for i in likely[upto[last[likely]] - upto[first[likely]] >= LEAST_SCORE]:
        own = total[first[i] : last[i] + 1]
        low = np.minimum.accumulate(own)
        end = int((own - low).argmax())
        begin = int(own[: end + 1].argmin())
        starts[i], ends[i], scores[i] = first[i] + begin, first[i] + end, own[end] - own[begin]
    return starts, ends, scores


def learn(docs: DataFrame) -> Model:
    """Models and the least score from all distinct texts."""
    return _fitted(_sampled(docs))


def _rank() -> Column:
    return F.xxhash64("text", F.lit(4))


def _sampled(docs: DataFrame, limit: None = SAMPLE) -> DataFrame:
    """text and rank of what is learned from: every text."""
    return docs.where("text IS NOT NULL").select("text", _rank().alias("rank"))


def _once(texts: DataFrame) -> DataFrame:
    """Each text once. Copies go within their task first, so that a large group of them doesn't meet in one."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = []
            for rank in batch.column("rank").to_pylist():
                new.append(rank not in seen)
                seen.add(rank)
            yield batch.filter(pa.array(new, pa.bool_()))

    shape = "text string, rank long"
    return texts.mapInArrow(first, shape).repartition("rank").mapInArrow(first, shape)


def _part() -> Column:
    """The part of a text, by a hash of its rank."""
    return F.pmod(F.xxhash64("rank"), F.lit(PARTS))


def _fitted(texts: DataFrame) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, START + 1, START), np.int64)
        for batch in batches:
            for text in batch.column("text"):
                counts += _counted(text.as_py().encode())
        label, before, after = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(before * START + after, pa.int32()), pa.array(counts[label, before, after])], ["label", "pair", "n"])

    found = _once(texts.where(~_part().isin(FITTED, MEASURED))).select("text").mapInArrow(count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, (START + 1) * START))
    counts[found["label"].to_numpy(), found["pair"].to_numpy()] = found["n"].to_numpy()
    ratios = _models(counts.reshape(2, START + 1, START))
    ordinary_runs = written(_held_scores(_once(texts.where(_part() == FITTED)), ratios).where("NOT secret"), "secret-scores")
    facts = ordinary_runs.agg(F.sum("n").alias("n")).first()["n"] or 0
    # At most FALSE_RUNS of the runs may reach the least score: that many of the highest scores and one more are looked at.
    top = ordinary_runs.where("score > 0").orderBy(F.desc("score")).limit(int(facts * FALSE_RUNS) + 1).collect()
    least = top[-1]["score"] + 1e-9 if len(top) > facts * FALSE_RUNS and top else 0.0
    return Model(ratios, max(LEAST_SCORE, least))


def _held_scores(texts: DataFrame, ratios: np.ndarray) -> DataFrame:
    """secret, score and n of held-out runs; runs that score nothing are one row for each text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                raw = text.as_py().encode()
                spans = base_spans(raw)
                for value in _values(raw, spans):
                    _, _, scores = best_segments(_CODE[np.frombuffer(value, np.uint8)], ratios)
                    rows.append((True, float(scores.max(initial=0.0)), 1))
                _, _, scores = best_segments(_outside(raw, spans), ratios)
                rows += [(False, float(x), 1) for x in scores[scores > 0]] + [(False, 0.0, int((scores <= 0).sum()))]
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.float64(), pa.int64()))], ["secret", "score", "n"])

    return texts.select("text").mapInArrow(score, "secret boolean, score double, n long")


def evaluate(docs: DataFrame, model: Model) -> dict[str, float]:
    """Precision and recall of the Markov models alone, on runs labelled by the patterns, of texts that nothing was learned from."""
    apart = docs.where("text IS NOT NULL").select("text", _rank().alias("rank")).where(_part() == MEASURED).dropDuplicates(["rank"])
    hit = F.when(F.col("score") >= model.least, F.col("n")).otherwise(0)
    row = _held_scores(apart, model.ratios).agg(
        F.sum(F.when(F.col("secret"), hit)).alias("right"), F.sum(F.when(F.col("secret"), F.col("n"))).alias("secrets"), F.sum(hit).alias("hits"), F.sum("n").alias("runs")
    )
    right, secrets, hits, runs = (x or 0 for x in row.first())
    return {"precision": right / max(hits, 1), "recall": right / max(secrets, 1), "secrets": secrets, "runs": runs}


def markov_spans(raw: bytes, model: Model, taken: list[Span]) -> list[Span]:
    """The best segment of each run outside what is taken and known forms, if its score is high enough."""

    def found(taken: list[Span]) -> list[Span]:
        starts, ends, scores = best_segments(_outside(raw, taken), model.ratios)
        return [(int(starts[i]), int(ends[i]), 3) for i in np.flatnonzero(scores >= model.least)]

    spans = found(taken)
    # Known forms are looked for only where something was found.
    known = known_spans(raw) if spans else []
    return found(taken + known) if known else spans


def measured(model: Model, seed: int = 99, n: int = 2000) -> dict[str, float]:
    """On generated samples that nothing was learned from: by kind of ordinary identifier the share that gets a span,
    and by alphabet and length the share of random strings that get one."""
    hit = lambda texts: sum(bool(markov_spans(f"see {t} there".encode(), model, [])) for t in texts) / len(texts)
    out = {kind: hit(texts) for kind, texts in ordinary_kinds(seed, n).items()}
    draw = np.random.default_rng(seed)
    for name, letters in (("base62", string.ascii_letters + string.digits), ("base64url", ALPHABET.replace("+", "").replace("/", "").replace("=", "")), ("lower36", string.ascii_lowercase + string.digits)):
        for size in (12, 16, 20, 32):
            out[f"{name}_{size}"] = hit(["".join(row) for row in draw.choice(list(letters), (n, size))])
    return out


def in_characters(raw: bytes, spans: list[Span]) -> list[Span]:
    """Byte spans as code point spans."""
    if not spans:
        return spans
    inner = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)
    at = lambda i: i - (int(inner[i - 1]) if i else 0)
    return [(at(a), at(b), k) for a, b, k in spans]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def find_spans(text: str, model: Model) -> list[Span]:
    """All spans of a text, in code points."""
    raw = text.encode("utf-8", "surrogatepass")
    base = base_spans(raw)
    return sorted(in_characters(raw, base + markov_spans(raw, model, base)), key=lambda s: (s[0], s[2]))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts by kind, the digest of the base spans, and all spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                raw = data[a:b].tobytes()
                base = base_spans(raw)
                more = markov_spans(raw, own, base)
                plain = in_characters(raw, base)
                kinds = [k for _, _, k in base]
                digest = hashlib.sha256(listed(plain).encode()).hexdigest()
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), digest, listed(plain + in_characters(raw, more))))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return plain.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with each secret in text replaced, n_chars counted anew, and everything else as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            spans = find_spans(text, shared.value) if text else []
            out, at = [], 0
            for a, b, _ in spans:
                if b > at:
                    out += [text[at:a], REPLACEMENT] if a >= at else []
                    at = b
            return "".join([*out, text[at:]]) if spans else text

        return texts.map(one)

    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, learn(docs))
