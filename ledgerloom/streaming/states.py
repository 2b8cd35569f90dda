"""Streams of events: distinct observations, latest states of searches, counters by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_within(stream: DataFrame, keys: list[str], ts: str, ttl: str) -> DataFrame:
    """Events whose keys haven't come within `ttl` of event time; state older than that is dropped."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by window of event time and `by`; events more than `late` behind are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *by, "n", "value")


def latest(stream: DataFrame, key: str, ts: str, late: str, *values: str) -> DataFrame:
    """The values of each key's newest event so far (for update or complete output)."""
    return stream.withWatermark(ts, late).groupBy(key).agg(F.max_by(F.struct(*values), ts).alias("v"), F.max(ts).alias(ts)).select(key, ts, "v.*")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there into an in-memory table of that name, and stop (for tests and backfills)."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
