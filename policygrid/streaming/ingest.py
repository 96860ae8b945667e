"""Streams: resumable ingestion, upserts per micro-batch, tumbling windows and sessions with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from policygrid.sources.writers import Checkpoint


def ingest_new(stream: DataFrame, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append the rows whose key isn't in `target` yet, of everything there is now, then stop.

    A micro-batch that is replayed finds its keys and adds nothing; of equal keys in
    a batch one row is kept.
    """

    def write(batch: DataFrame, _: int) -> None:
        Checkpoint(batch.sparkSession, target, key).open_rows(batch.dropDuplicates([key])).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """keys, window_start, n, total per tumbling window; rows later than `late` are dropped by the watermark."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(*keys, F.col("window.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, time: str, gap: str, late: str, *keys: str) -> DataFrame:
    """keys, session_start, session_end, n per session: rows less than `gap` apart."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(*keys, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
