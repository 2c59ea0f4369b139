"""Detection on a stream of texts. It keeps no state, so it is the batch operator on readStream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tracewell.jobs.report import lines_of
from tracewell.operators.detectors import DETECTORS, Detector, detect


def detect_stream(texts: DataFrame, detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """Matches of a streaming frame texts(path, text)."""
    return detect(lines_of(texts), detectors)


def write_matches(texts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends matches as Parquet; each input file is read once, also after a restart."""
    return detect_stream(texts).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
