"""Event-time metrics: the same plan on a stream (with late rows dropped) and on a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_stream_metrics(
    df: DataFrame, time: str, hit: Column, *, by: list[str] | None = None, size: str = "1 hour", slide: str | None = None, session_gap: str | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Count and accuracy per tumbling, sliding or session window of event time.

    ``watermark`` bounds state and drops later rows on a stream; on a table it has no effect.  A stream's
    time is cast to TIMESTAMP, which watermarks need; a table's zone-free time stays as it is.
    """
    at = F.col(time).cast("timestamp") if df.isStreaming else F.col(time)
    rows = df.withColumn(time, at).withColumn("__hit", hit.cast("int"))
    if watermark and rows.isStreaming:
        rows = rows.withWatermark(time, watermark)
    window = F.session_window(time, session_gap) if session_gap else F.window(time, size, slide or size)
    agg = rows.groupBy(*(by or []), window.alias("window")).agg(F.count("*").alias("n"), F.avg("__hit").alias("accuracy"))
    return agg.select(*(by or []), F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "accuracy")
