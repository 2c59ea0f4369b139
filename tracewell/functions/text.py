"""Text functions as Column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewell.functions import patterns as P

_OPEN, _CLOSE = "\x01", "\x02"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def find_matches(text: Column, pattern: str) -> Column:
    """array<struct<value, start>> of the matches of a pattern, start in characters from 0.

    Matches are marked in the text and the marked text is split, so no Python is run. A text that has one of the
    two control characters that mark them is matched twice instead, for the matches and for what is between.
    """
    marked = F.regexp_replace(text, pattern, f"{_OPEN}$0{_CLOSE}")
    none = F.array().cast("array<struct<value:string,start:int>>").alias("found")

    def step(acc: Column, part: Column) -> Column:
        one = F.struct(F.substring_index(part, _CLOSE, 1).alias("value"), acc["at"].alias("start"))
        return F.struct((acc["at"] + F.length(part) - 1).alias("at"), F.array_append(acc["found"], one).alias("found"))

    def of_parts(parts: Column) -> Column:
        start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), none)
        return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda acc: acc["found"])

    # Parts are bound to a name, as what stands several times in an expression is worked out as often.
    quick = F.get(F.transform(F.array(F.split(marked, _OPEN)), of_parts), F.lit(0))
    gaps = F.split(text, pattern)

    def after(acc: Column, value: Column) -> Column:
        at = acc["at"] + F.length(F.get(gaps, F.size(acc["found"])))
        return F.struct((at + F.length(value)).alias("at"), F.array_append(acc["found"], F.struct(value.alias("value"), at.alias("start"))).alias("found"))

    twice = F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.struct(F.lit(0).alias("at"), none), after, lambda acc: acc["found"])
    return F.when(F.contains(text, F.lit(_OPEN)) | F.contains(text, F.lit(_CLOSE)), twice).otherwise(quick)


def to_lines(texts: DataFrame, *keep: str) -> DataFrame:
    """A row per line that is not blank; line numbers count blank lines too, from 1."""
    exploded = texts.select(*keep, F.posexplode(F.split("text", LINE_BREAK)).alias("_at", "text"))
    return exploded.where(~F.col("text").rlike(BLANK)).select(*keep, (F.col("_at") + 1).alias("line"), "text")


def split_pages(texts: DataFrame, *keep: str) -> DataFrame:
    """Pages between form feeds, numbered from 1; blank pages and texts under 20 characters are left out."""
    whole = texts.where(F.length(stripped(F.col("text"))) >= 20)
    pages = whole.select(*keep, F.posexplode(F.split("text", "\f")).alias("_at", "text"))
    return pages.where(~F.col("text").rlike(BLANK)).select(*keep, (F.col("_at") + 1).alias("page"), "text")


def normalize_value(value: Column) -> Column:
    """White space to single spaces, ends stripped of space and then of punctuation; null if nothing is left."""
    single = F.btrim(F.regexp_replace(value, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.nullif(F.btrim(single, F.lit(P.EDGE_PUNCTUATION)), F.lit(""))


def context(line: Column, start: Column, end: Column, width: int = 40) -> Column:
    """The surroundings of a match, with an ellipsis where they are cut."""
    low = F.greatest(start - width, F.lit(0))
    high = F.least(end + width, F.length(line))
    body = F.translate(F.substring(line, low + 1, high - low), "\t", " ")
    return F.concat(F.when(low > 0, "…").otherwise(""), body, F.when(high < F.length(line), "…").otherwise(""))


def human_size(n: Column) -> Column:
    """a size in steps of 1000. format_number rounds the exact value, halves to even."""
    tenths = lambda step, unit: F.concat(F.call_function("format_number", n / step, F.lit("0.0")), F.lit(f" {unit}"))
    out = tenths(1e12, "TB")
    for unit, step in (("GB", 1e9), ("MB", 1e6), ("KB", 1e3)):
        out = F.when(n < step * 1e3, tenths(step, unit)).otherwise(out)
    return F.when(n < 1000, F.format_string("%d B", n.cast("long"))).otherwise(out)


def cjk_despace(text: Column) -> Column:
    """no single white space between two CJK characters."""
    return F.regexp_replace(text, rf"(?U)(?<={P.CJK})[\s\x1c-\x1f](?={P.CJK})", "")


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t is not None else None)


def unescape(text: Column) -> Column:
    """Named and numeric entities as characters; only texts with an ampersand go to Python."""
    return F.coalesce(_unescaped(F.when(F.contains(text, F.lit("&")), text)), text)


def xml_to_text(xml: Column) -> Column:
    """line ends for paragraphs, rows and strings, tabs for cells, no tags, entities unescaped."""
    lines = F.regexp_replace(F.regexp_replace(xml, P.XML_LINE_END, "\n"), P.XML_CELL_END, "\t")
    return unescape(F.regexp_replace(lines, P.XML_TAG, ""))


def luhn_digits(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def my_number_valid(value: Column) -> Column:
    """Twelve digits of which the last is the check digit: weights 2 to 7 and 2 to 6 from the right, modulo 11."""
    digits = F.translate(luhn_digits(value), "０１２３４５６７８９", "0123456789")
    digit = lambda i: F.substring(digits, i, 1).cast("int")
    total = sum((digit(11 - k) * (k + 2 if k <= 5 else k - 4) for k in range(11)), F.lit(0))
    rest = total % 11
    return (F.length(digits) == 12) & (F.when(rest <= 1, 0).otherwise(11 - rest) == digit(12))


def card_valid(value: Column) -> Column:
    digits = luhn_digits(value)
    return F.length(digits).isin(14, 15, 16, 19) & F.call_function("luhn_check", digits) & digits.rlike(P.CARD_PREFIX)
