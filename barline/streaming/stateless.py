"""Streaming operators that Spark's own operators express."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedup(stream: DataFrame, ids: Sequence[str], keep: str = "90 days") -> DataFrame:
    """First arrival of each id; ids are remembered for ``keep`` after they arrived.

    The watermark follows the time of arrival, so a new id is never refused for being old.
    """
    seen = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", keep)
    return seen.dropDuplicatesWithinWatermark(list(ids)).drop("_arrived")


def event_counts(stream: DataFrame, kind: str = "event_type", time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and type. On a batch frame it is the batch twin."""
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind)
        .agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
    )


def silent_feeds(events: DataFrame, feed: str, as_of: Column, days: int = 1, time: str = "ts") -> DataFrame:
    """Feeds without a row for more than ``days`` days at ``as_of``: each run of the schedule
    asks this of what has landed, so a feed is reported while it is dead."""
    last = events.groupBy(feed).agg(F.max(time).cast("date").alias("last_day"))
    return last.withColumn("silent_days", F.date_diff(as_of, F.col("last_day")).cast("long")).where(F.col("silent_days") > days)
