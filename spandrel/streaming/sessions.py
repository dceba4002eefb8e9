"""Sessions of event streams, and interval unions kept over arriving loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, session_start, session_end, n: bursts of events with gaps under ``gap``; for batches and streams.

    Events later than ``late`` behind the newest are dropped from a stream, as its watermark says.
    """
    e = events.withWatermark(ts, late) if events.isStreaming else events
    s = e.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def keep_states(stream: DataFrame, path: str, keys: list[str], start: str, end: str, checkpoint: str):
    """Writes each micro-batch's interval states under its own folder, so that a batch that runs again replaces itself.

    States of all batches are put together with ``combine_states``.
    """
    from spandrel.operators.intervals import interval_states

    def load(batch: DataFrame, number: int) -> None:
        interval_states(batch, keys, F.col(start), F.col(end)).write.mode("overwrite").parquet(f"{path}/load={number}")

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
