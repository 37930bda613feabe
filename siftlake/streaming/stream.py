"""Detection on streams: the same narrow detection as in batch. Ranks, caps and line numbers belong to batches, so they run per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog
from ..config import ScanConfig
from ..functions.text import strip
from ..operators.detect import detect, findings


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as they arrive: file, line, arrived."""
    raw = spark.readStream.text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), strip(F.col("value")).alias("line"), F.current_timestamp().alias("arrived"))


def stream_findings(lines: DataFrame, catalog: Catalog, config: ScanConfig = ScanConfig()) -> DataFrame:
    """Findings of a stream of lines; stateless."""
    return findings(detect(lines, catalog, config))


def windowed_counts(found: DataFrame, time_col: str = "arrived", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Findings by pattern and time window, with a watermark."""
    return found.withWatermark(time_col, late).groupBy(F.window(time_col, window), "pattern", "krit").agg(F.count(F.lit(1)).alias("n"))


def write_batches(found: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Hands each micro-batch to sink(frame, number), which should be idempotent by number."""
    writer = found.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
