"""Latency windows over a stream, and resumable logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.evaluate import percentile


def windowed(rows: DataFrame, time: str = "ts", key: str = "event_type", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means for each window and key; the same plan for a batch and for a stream."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if rows.isStreaming else rows
    out = timed.groupBy(F.window(time, length), key).agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("largest"))
    return out.select(F.col("window.start").alias("window_start"), key, "n", "mean", "largest")


def window_percentiles(rows: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Median and 95th percentile for each window and key: exact for a batch, close to it (a share of 1e-4 off at most) for a stream."""
    if rows.isStreaming:
        timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
        near = F.percentile_approx(value, [0.5, 0.95], 10_000)
        out = timed.groupBy(F.window(time, length), key).agg(F.count(value).alias("n"), near.alias("p"))
        return out.select(F.col("window.start").alias("window_start"), key, "n", F.get("p", 0).alias("p50"), F.get("p", 1).alias("p95"))
    keyed = rows.withColumn("window_start", F.window(time, length).start)
    return percentile(keyed, value, {"p50": 0.5, "p95": 0.95}, "window_start", key)


def value_counts(rows: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """How often each value occurs in a window and key. The state of a stream is a counter a value, spread over all tasks, so a
    large window is no single group; a window's counters leave it once, when it can get no more rows."""
    timed = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if rows.isStreaming else rows
    counted = timed.filter(F.col(value).isNotNull()).groupBy(F.window(time, length), key, value).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), key, value, "n")


def append_value_counts(rows: DataFrame, path: str, checkpoint: str, **options):
    """Write the counters of closed windows of a stream, going on after a restart where it stopped; each is written once."""
    return value_counts(rows, **options).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def percentiles_of_counts(counts: DataFrame, key: str = "event_type", value: str = "value") -> DataFrame:
    """Exact median and 95th percentile of each window and key from ``value_counts``: those that ``window_percentiles`` gives for a batch."""
    return percentile(counts, value, {"p50": 0.5, "p95": 0.95}, "window_start", key, weight=F.col("n"))


def append_log(rows: DataFrame, path: str, checkpoint: str, key: str = "page_id", late: str = "1 day", time: str = "ts"):
    """Write each key of a stream once, and go on after a restart where it stopped."""
    once = rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
