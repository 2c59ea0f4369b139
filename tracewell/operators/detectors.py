"""Detectors D1 to D8: a registry of rules, and one pass over lines that applies them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.functions import text as T
from tracewell.operators.findings import seen_at, step_of

Check = Callable[[Column, Column], Column]


@dataclass(frozen=True)
class Detector:
    """guard is a cheap test of the line; valid tests a match and its line."""

    name: str
    category: str
    pattern: str
    guard: Callable[[Column], Column]
    valid: Check | None = None


def _phone(value: Column, line: Column) -> Column:
    return F.length(T.luhn_digits(value)).between(10, 15)


def email(ignored: str | None = P.EMAIL_IGNORED) -> Detector:
    return Detector("email", "private_email", P.EMAIL, lambda x: F.contains(x, F.lit("@")), (lambda v, _: ~v.rlike(ignored)) if ignored else None)


def card(require_context: bool = True) -> Detector:
    def valid(value: Column, line: Column) -> Column:
        spaced = value.rlike(r"(?U)\D")
        return T.card_valid(value) & ((spaced | line.rlike(P.CARD_CONTEXT)) if require_context else F.lit(True))

    return Detector("card", "account_number", P.CARD, lambda x: x.rlike(r"(?U)\d{4}"), valid)


JP_PHONE = Detector("jp_phone", "private_phone", P.JP_PHONE, lambda x: F.contains(x, F.lit("0")), _phone)
INTL_PHONE = Detector("intl_phone", "private_phone", P.INTL_PHONE, lambda x: F.contains(x, F.lit("+")), _phone)
POSTAL = Detector("postal", "private_address", P.POSTAL, lambda x: F.contains(x, F.lit("〒")))
ADDRESS = Detector("address", "private_address", P.ADDRESS, lambda x: x.rlike("[都道府県]"))
MY_NUMBER = Detector("my_number", "my_number", P.MY_NUMBER, lambda x: x.rlike(P.MY_NUMBER_CONTEXT), lambda v, _: T.my_number_valid(v))
BANK = Detector("bank", "account_number", P.BANK, lambda x: x.rlike("口座番号|普通|当座"))

#: In the order in which a line's findings are counted.
DETECTORS: tuple[Detector, ...] = (email(), JP_PHONE, INTL_PHONE, POSTAL, ADDRESS, MY_NUMBER, card(), BANK)


_HITS = "array<struct<rule:int,category:string,raw:string,start:int>>"


def _hits(line: Column, number: int, d: Detector) -> Column:
    hits = T.find_matches(line, d.pattern)
    if d.valid:
        hits = F.filter(hits, lambda m: d.valid(m["value"], line))
    return F.transform(hits, lambda m: F.struct(F.lit(number).alias("rule"), F.lit(d.category).alias("category"), m["value"].alias("raw"), m["start"].alias("start")))


def detect(lines: DataFrame, detectors: Sequence[Detector] = DETECTORS, chars: int | None = P.MAX_SCANNED_CHARS) -> DataFrame:
    """A row for each match in lines(path, page, line, kind, text): category, value, detector, score, context and seq.

    No shuffle and no Python: each rule's pattern runs only on lines that pass its guard. seq is the
    order in which findings are first seen: phase of the scan, place, rule, position. Of each line the first chars
    characters are scanned, as many as in the original tool; None is all of them.
    """
    scanned = lines.withColumn("_scan", F.col("text") if chars is None else F.substring("text", 1, chars))
    line = F.col("_scan")
    found = [F.when(d.guard(line), _hits(line, number, d)).otherwise(F.array().cast(_HITS)) for number, d in enumerate(detectors)]
    hits = scanned.where(_any([d.guard(line) for d in detectors])).select("*", F.explode(F.concat(*found)).alias("_m"))
    value = T.normalize_value(F.col("_m.raw"))
    end = F.col("_m.start") + F.length("_m.raw")
    return hits.select(
        F.col("_m.category").alias("category"), value.alias("value"), F.lit("regex").alias("detector"), F.lit(1.0).alias("score"),
        "path", "page", "line", "kind", T.context(line, F.col("_m.start"), end).alias("context"),
        seen_at(F.col("kind"), F.col("path"), F.col("path"), F.col("page"), F.col("line"), F.col("_m.rule"), F.col("_m.start"), step_of(F.col("kind"))).alias("seq"),
    ).where("value IS NOT NULL")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
