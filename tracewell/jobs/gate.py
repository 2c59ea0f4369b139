"""The release gate: requests checked, reports joined to the current files, shares recorded (P5, F2, J4, WL2, WL3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import patterns as P

NO_MODEL_NEEDED = "no text needed model inspection"
#: Server and file id of a share link.
SHARE_URL = r"^https?://([0-9]{1,3}\.[a-z0-9-]+\.[a-z]+)/([0-9]{4}-[0-9a-z]+)/?$"


def validate_share_requests(requests: DataFrame) -> DataFrame:
    """P5: the first rule that a request breaks as error, and the link's parts."""
    checks = (
        (~F.coalesce(F.col("dlkey").rlike("^[0-9A-Za-z]{1,4}$"), F.lit(False)), "dlkey must be 1-4 letters or digits"),
        (~F.coalesce(F.col("lifetime").isin(*P.LIFETIMES), F.lit(False)), f"lifetime must be one of {P.LIFETIMES}"),
        (~F.coalesce(F.col("chunk_mb").between(1, 100), F.lit(False)), "chunk_mb must be between 1 and 100"),
        (F.col("url").isNotNull() & ~F.col("url").rlike(SHARE_URL), "url is not a share link"),
        (F.col("delkey").isNotNull() & ~F.col("delkey").rlike("^[0-9A-Za-z]{4}$"), "delkey must be 4 letters or digits"),
    )
    error = F.coalesce(*[F.when(broken, F.lit(text)) for broken, text in checks])
    return requests.select("*", error.alias("error"), F.nullif(F.regexp_extract("url", SHARE_URL, 1), F.lit("")).alias("server"), F.nullif(F.regexp_extract("url", SHARE_URL, 2), F.lit("")).alias("file_id"))


def expiry_date(jwt: Column, lifetime: Column, today: Column) -> Column:
    """d_expiry of the token's payload if it is a date, else today plus the lifetime."""
    part = F.translate(F.get(F.split(jwt, r"\."), F.lit(1)), "-_", "+/")
    padded = F.rpad(part, F.ceil(F.length(part) / 4).cast("int") * 4, "=")
    payload = F.try_to_binary(padded, F.lit("base64")).cast("string")
    stated = F.get_json_object(payload, "$.d_expiry")
    return F.coalesce(F.when(stated.rlike(r"^\d{4}-\d{2}-\d{2}$"), stated), F.date_add(today, lifetime).cast("string"))


def latest_reports(reports: DataFrame) -> DataFrame:
    """The row of each bundle's latest report, by created, of reports that are kept for good.

    A report without time is older than any other. Of reports of one time, one that is reviewed comes last, then the
    one with fewer findings, then the one with the greater fingerprint.
    """
    kept = [c for c in reports.columns if c != "bundle"]
    order = F.struct("created", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), (-F.col("findings_count")).alias("fewer"), "fingerprint")
    return reports.groupBy("bundle").agg(F.max_by(F.struct(*kept), order).alias("_latest")).select("bundle", *[F.col(f"_latest.{c}").alias(c) for c in kept])


def release_gate(reports: DataFrame, current: DataFrame) -> DataFrame:
    """Status and reasons of each bundle of current(bundle, fingerprint) by its latest report.

    reports may hold several reports of a bundle; created tells which is the latest. Without created, there is one for each.
    """
    if "created" in reports.columns:
        reports = latest_reports(reports)
    model_missing = ~F.col("model_used") & ~F.coalesce(F.col("model_reason") == NO_MODEL_NEEDED, F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("findings_count") > 0, F.concat(F.col("findings_count").cast("string"), F.lit(" finding(s)"))),
            F.when(F.col("visual_images") > 0, F.concat(F.col("visual_images").cast("string"), F.lit(" image(s) for visual review"))),
            F.when(model_missing, F.concat(F.lit("model not used ("), F.coalesce("model_reason", F.lit("None")), F.lit(")"))).when(F.size("not_model_scanned") > 0, F.lit("token budget exceeded")),
        )
    )
    joined = current.join(reports.withColumnRenamed("fingerprint", "_reported").withColumnRenamed("bundle", "_bundle"), F.col("bundle").eqNullSafe(F.col("_bundle")), "left")
    status = (
        F.when(F.col("_reported").isNull(), "missing")
        .when(F.col("_reported") != F.col("fingerprint"), "mismatched")
        .when((F.size(reasons) > 0) & ~F.coalesce("reviewed", F.lit(False)), "needs review")
        .otherwise("ok")
    )
    return joined.select("bundle", status.alias("status"), F.when(F.col("_reported").isNotNull(), reasons).alias("reasons"))


def share_records(requests: DataFrame, gate: DataFrame, sizes: DataFrame) -> DataFrame:
    """WL3: the first refusal of each request in order: validation, existence, gate, secrets, size."""
    checked = validate_share_requests(requests).join(gate, "bundle", "left").join(sizes, "bundle", "left")
    refusal = F.coalesce(
        F.col("error"),
        F.when(~F.coalesce("exists", F.lit(False)), "missing file"),
        F.when(F.coalesce("status", F.lit("missing")) != "ok", F.concat(F.lit("report "), F.coalesce("status", F.lit("missing")))),
        F.when(F.coalesce("blocked", F.lit(False)), "secrets found"),
        F.when(F.col("size_bytes") > P.MAX_FILE_BYTES, "too large"),
    )
    return checked.select("id", "bundle", refusal.alias("refusal"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), F.when(refusal.isNull(), expiry_date(F.col("jwt"), F.col("lifetime"), F.col("today"))).alias("expires_on"))
