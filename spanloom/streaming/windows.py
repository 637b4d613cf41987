"""Event-time windows over streams, with Spark's own watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import fixed_values as fv
from spanloom.functions import codec


def window_counts(stream: DataFrame, width: str, lateness: str, by: Column, ts: str = "ts") -> DataFrame:
    """Events per window and class; a window comes out once the watermark has passed it."""
    timed = stream.withColumn("_time", F.timestamp_micros(ts)).withWatermark("_time", lateness)
    counted = timed.groupBy(F.window("_time", width), by).agg(F.count(F.lit(1)).alias("n"))
    keys = [c for c in counted.columns if c not in ("window", "n")]
    return counted.select(F.unix_micros("window.start").alias("window_start"), *keys, "n")


def lost_events(stream: DataFrame, width: str, lateness: str, is_marker: Column | None = None, ts: str = "ts") -> DataFrame:
    """Lost-event markers per window."""
    marker = (codec.event_id(F.col("debugid")) == fv.LOST_EVENTS) if is_marker is None else is_marker
    timed = stream.withColumn("_time", F.timestamp_micros(ts)).withWatermark("_time", lateness)
    # Counted, not filtered: a filter would go below the watermark, which every record is to move.
    counted = timed.groupBy(F.window("_time", width)).agg(F.count(F.when(marker, 1)).alias("markers"))
    return counted.filter("markers > 0").select(F.unix_micros("window.start").alias("window_start"), "markers")


def end_marker(rows: DataFrame, width: str, lateness: str, ts: str = "ts") -> DataFrame:
    """The row to land once a capture has ended, so that its open windows come out.

    ``rows`` are all records of the capture. The marker's time lies so far
    behind theirs that the watermark passes all their windows; its own window
    never closes and its other columns are null.
    """
    after = F.timestamp_micros(F.max(ts)) + F.expr(f"INTERVAL {width}") + F.expr(f"INTERVAL {lateness}") + F.expr("INTERVAL 1 second")
    marker = rows.agg(F.unix_micros(after).alias("_at"))
    return marker.select(*[(F.col("_at") if n == ts else F.lit(None).cast(t)).alias(n) for n, t in rows.dtypes])


def to_parquet(counts: DataFrame, path: str, checkpoint: str):
    """Append finished windows to a folder, take what has arrived and stop."""
    writer = counts.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.option("path", path).trigger(availableNow=True).start()
