"""Structured Streaming counterparts of the daily operators, for telemetric feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fluvia.functions.columns import finite


def deduplicate(stream: DataFrame, keys: list[str], time: str = "ts", delay: str = "2 days") -> DataFrame:
    """One row for each key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def daily_stats(stream: DataFrame, key: str, value: str, time: str = "ts", delay: str = "2 days") -> DataFrame:
    """Count, mean, least and greatest value by key and day, closed once the watermark passes the day."""
    v = finite(value)
    rows = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day"), key).agg(F.count(v).alias("n_values"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    return rows.select(key, F.col("window.start").cast("date").alias("date"), "n_values", "mean", "min", "max")


def exceedance_events(stream: DataFrame, key: str, value: str, threshold: float, time: str = "ts", gap: str = "7 days", delay: str = "2 days") -> DataFrame:
    """Runs of exceedances parted by gaps: the streaming form of declustering."""
    over = stream.withWatermark(time, delay).where(F.col(value) > threshold)
    rows = over.groupBy(F.session_window(time, gap), key).agg(F.max(value).alias("peak"), F.count("*").alias("n_exceedances"))
    return rows.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "peak", "n_exceedances")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch of what is there to a function, then ends."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
