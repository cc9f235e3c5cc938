"""Sessions of an event stream: the streaming twin of activity stretches with t_end = t."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of each session; works on batch and streaming frames alike.

    ts may be a timestamp without zone (taken as UTC). In append mode a session is emitted once the watermark, `late`
    behind the latest event, has passed its end; sessions still open at the end of the input aren't. Later events are
    dropped, which the batch form doesn't do.
    """
    timed = events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
    out = timed.groupBy(key, F.session_window("__at", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events once each, though a client may send a batch again within `late`."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.dropDuplicatesWithinWatermark(keys)
