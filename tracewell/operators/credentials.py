"""Credentials by documented formats. Values are masked in the output, and any hit blocks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import text as T

#: Public token formats.
RULES = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google_api_key": r"\bAIza[A-Za-z0-9_\-]{35}\b",
    "stripe_key": r"\b[sr]k_live_[A-Za-z0-9]{16,}\b",
    "json_web_token": r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}",
    "assigned_secret": r"""(?i:password|passwd|secret|token|api_?key)["']? ?[:=] ?["']?[A-Za-z0-9+/_.=\-]{8,}""",
}
#: Of these words each match of a rule has one; those of an assignment in either case.
WORDS = {
    "aws_access_key": ("AKIA", "ASIA"), "private_key": ("PRIVATE KEY",), "github_token": ("gh",), "slack_token": ("xox",), "google_api_key": ("AIza",),
    "stripe_key": ("k_live_",), "json_web_token": ("eyJ",), "assigned_secret": ("password", "passwd", "secret", "token", "apikey", "api_key"),
}
REFUSED_NAMES = r"(?i)(?:^|[/!])(?:\.env(?:\..+)?|auth\.json|credentials|\.netrc|id_rsa|id_ed25519|[^/!]+\.(?:jks|keystore|p12|pfx|pem))$"
MASK_KEEP = 4


def _masked(value):
    return F.concat(F.substring(value, 1, MASK_KEEP), F.repeat(F.lit("*"), F.greatest(F.length(value) - MASK_KEEP, F.lit(0))))


def _likely(name: str) -> Column:
    """A cheap test of the line, without the rule's pattern."""
    text = F.lower("text") if name == "assigned_secret" else F.col("text")
    return reduce(or_, [F.contains(text, F.lit(word)) for word in WORDS[name]])


def _hits(name: str, pattern: str):
    hits = F.transform(T.find_matches(F.col("text"), pattern), lambda m: F.struct(F.lit(name).alias("rule"), _masked(m["value"]).alias("detail")))
    return F.when(_likely(name), hits).otherwise(F.array().cast("array<struct<rule:string,detail:string>>"))


def credential_hits(lines: DataFrame) -> DataFrame:
    """path, line, rule and detail (masked) of each hit in lines(path, line, text)."""
    found = F.concat(*[_hits(name, rx) for name, rx in RULES.items()])
    return lines.where(reduce(or_, map(_likely, RULES))).select("path", "line", F.explode(found).alias("_h")).select("path", "line", "_h.rule", "_h.detail")


def refused_files(files: DataFrame) -> DataFrame:
    """Files that are credentials by name."""
    return files.where(F.col("path").rlike(REFUSED_NAMES)).select("path", F.lit(None).cast("int").alias("line"), F.lit("credential_file").alias("rule"), F.element_at(F.split("path", "[/!]"), -1).alias("detail"))


#: Reasons for which a file could not be looked into: what it holds may be a credential.
CLOSED = r"^(?:uninspectable archive|archive nesting too deep|archive unpacks to more than the limit|unreadable zip|corrupt \w+ stream|damaged tar|error \()"


def root_of(path: Column) -> Column:
    """The outermost file that a path of outer!member!member lies in."""
    return F.substring_index(path, "!", 1)


def file_hits(lines: DataFrame, names: DataFrame, skipped: DataFrame) -> DataFrame:
    """D9 over files: root, path, line, rule and detail of each hit in lines, names of files and members, and closed archives.

    lines(path, line, text) and names(path) are what the scan of files reads, skipped(path, reason) what it can't.
    Whatever is hit, in whatever depth of archives, counts against its root.
    """
    content = credential_hits(lines)
    named = refused_files(names)
    closed = skipped.where(F.col("reason").rlike(CLOSED)).select("path", F.lit(None).cast("int").alias("line"), F.lit("uninspectable").alias("rule"), F.col("reason").alias("detail"))
    hits = content.unionByName(named).unionByName(closed)
    return hits.select(root_of(F.col("path")).alias("root"), "path", "line", "rule", "detail")


def blocked_roots(hits: DataFrame) -> DataFrame:
    """path of each root with a hit, for size_check(); nothing overrides it."""
    return hits.select(F.col("root").alias("path")).distinct()


def blocked(hits: DataFrame) -> DataFrame:
    """path and blocked of each file with any hit; nothing overrides it."""
    return hits.groupBy("path").agg(F.count(F.lit(1)).alias("n_hits")).withColumn("blocked", F.col("n_hits") > 0)
