"""Image metadata and which images to read or look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.functions import text as T


def _degrees(dms: Column, ref: Column, negative: str) -> Column:
    value = F.get(dms, F.lit(0)) + F.get(dms, F.lit(1)) / 60 + F.get(dms, F.lit(2)) / 3600
    return F.when(ref == negative, -value).otherwise(value)


def gps_findings(image_meta: DataFrame) -> DataFrame:
    """A position for each image with latitude and longitude, from image_meta(path, gps)."""
    lat, lon = _degrees(F.col("gps.lat"), F.col("gps.lat_ref"), "S"), _degrees(F.col("gps.lon"), F.col("gps.lon_ref"), "W")
    value = F.format_string("%.6f, %.6f", lat, lon)
    found = image_meta.where(lat.isNotNull() & lon.isNotNull())
    return found.select("path", F.lit("location_gps").alias("category"), value.alias("value"), F.concat(F.lit("EXIF GPS "), value).alias("context"))


def author_metadata(meta: DataFrame) -> DataFrame:
    """People named in meta(path, tag, value)."""
    value = F.btrim("value")
    found = meta.where(F.col("tag").isin(*P.IMAGE_AUTHOR_TAGS) & (value != ""))
    return found.select("path", F.lit("metadata_person").alias("category"), value.alias("value"), F.concat("tag", F.lit(" = "), value).alias("context"))


def metadata_lines(meta: DataFrame) -> DataFrame:
    """Descriptions, titles and comments of meta(path, tag, value) as lines to scan."""
    value = F.when(F.col("tag") == "ImageDescription", T.stripped(F.col("value"))).otherwise(F.substring("value", 1, P.MAX_METADATA_CHARS))
    texts = meta.where(F.col("tag").isin(*P.IMAGE_TEXT_TAGS)).select("path", value.alias("text"))
    return T.to_lines(texts, "path").select("path", F.lit(None).cast("int").alias("page"), "line", F.lit("metadata").alias("kind"), "text")


def _first(rows: DataFrame, order: list[Column], limit: int, salts: int = 32) -> DataFrame:
    """The first rows of each bundle with their number nth, taken per salt and then per bundle."""
    salted = Window.partitionBy("bundle", F.pmod(F.xxhash64("path"), F.lit(salts))).orderBy(*order)
    few = rows.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= limit).drop("_n")
    return few.withColumn("nth", F.row_number().over(Window.partitionBy("bundle").orderBy(*order))).where(F.col("nth") <= limit)


def select_ocr_images(images: DataFrame, cap: int = P.MAX_OCR) -> DataFrame:
    """Status small, selected or cap; the largest images of a bundle come first.

    The last image that is selected in a bundle tells which others are; no bundle is sorted as a whole.
    """
    area = F.col("width") * F.col("height")
    small = (F.least("width", "height") < P.OCR_MIN_SIDE) | (area < P.OCR_MIN_AREA)
    place = F.struct((-area).alias("area"), F.col("path").alias("path"))
    first = _first(images.where(~small).select("bundle", "path", "width", "height"), [F.desc(area), F.col("path")], cap)
    ranked = first.groupBy("bundle").agg(F.max(place).alias("_last"), F.collect_list(place).alias("_all"))
    last = ranked.select(F.col("bundle").alias("_bundle"), "_last", F.size(F.filter("_all", lambda x: x == F.col("_last"))).alias("_same"))
    joined = images.join(last, F.col("bundle").eqNullSafe(F.col("_bundle")), "left")
    at_last = F.coalesce(~small & (place == F.col("_last")), F.lit(False))
    status = F.when(small, "small").when(place < F.col("_last"), "selected").otherwise("cap")
    # Rows that repeat the last image: as many as the cap leaves room for.
    again = F.row_number().over(Window.partitionBy("bundle", "path", "width", "height").orderBy("path"))
    tied = joined.where(at_last).withColumn("status", F.when(again <= F.col("_same"), "selected").otherwise("cap"))
    return joined.where(~at_last).withColumn("status", status).unionByName(tied).drop("_last", "_same", "_bundle")


def visual_review(images: DataFrame, ocr_available: bool = True, limit: int = P.MAX_VISUAL) -> DataFrame:
    """The images of a bundle to look at, in order, and how many more there are."""
    wanted = F.col("photo_like") | (F.col("ocr_chars") >= 10)
    if not ocr_available:
        wanted = wanted | (F.least("width", "height") >= P.OCR_MIN_SIDE)
    seen = images.where(wanted)
    order = [F.desc("photo_like"), F.desc("ocr_chars"), F.desc(F.col("width") * F.col("height")), F.col("path")]
    counts = seen.groupBy(F.col("bundle").alias("_bundle")).agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("overflow"))
    return _first(seen, order, limit).join(counts, F.col("bundle").eqNullSafe(F.col("_bundle"))).drop("_bundle")
