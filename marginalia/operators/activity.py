"""Activity logs: stretches, attributed segments and tallies of an append-only event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds: a longer pause ends a stretch; a shorter stretch counts as so long.
GAP, LEAST = 600, 60


def stretches(events: DataFrame, keys: list[str], t: str = "t", t_end: str = "t_end", order: str = "event_id", gap: float = GAP) -> DataFrame:
    """events with `stretch`, numbered from 1 per key: a new one begins when t is more than gap after all that came before.

    A log that also holds a server's events is filtered to the person's first.
    """
    w = Window.partitionBy(*keys).orderBy(t, order)
    before = F.max(t_end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (before.isNull() | (F.col(t) - before > gap)).cast("long")
    return events.withColumn("__new", new).withColumn("stretch", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def segments(
    events: DataFrame, keys: list[str], place: str, kind: str, away: list[str], t: str = "t", t_end: str = "t_end",
    order: str = "event_id", gap: float = GAP, least: float = LEAST,
) -> DataFrame:
    """Pieces of time (keys, stretch, place, start, end, seconds) that never overlap within a key.

    An event's time runs to the next event of its stretch unless its kind is in away, from where the time before ends. A
    stretch in which less than least seconds were spent is filled up to that, for the place of its last event, from where
    its last piece ends or, without one, from its last event. t_end must not be before t.
    """
    run = Window.partitionBy(*keys, "stretch").orderBy(t, order)
    named = stretches(events, keys, t, t_end, order, gap).withColumn("__next", F.lead(t).over(run))
    stays = ~F.col(kind).isin(*away)
    end = F.greatest(F.col(t_end), F.when(stays, F.coalesce("__next", t_end)).otherwise(F.col(t_end)))
    named = named.withColumn("__end", end)
    counted = F.max("__end").over(run.rowsBetween(Window.unboundedPreceding, -1))
    named = named.withColumn("__start", F.greatest(F.col(t), F.coalesce(counted, F.col(t))))
    base = named.select(*keys, "stretch", F.col(place).alias("place"), F.col("__start").alias("start"), F.col("__end").alias("end"))
    piece = F.col("__end") > F.col("__start")
    whole = named.groupBy(*keys, "stretch").agg(
        F.coalesce(F.sum(F.when(piece, F.col("__end") - F.col("__start"))), F.lit(0)).alias("spent"),
        F.coalesce(F.max(F.when(piece, F.col("__end"))), F.max(t)).alias("start"), F.max_by(place, F.struct(t, order)).alias("place"),
    )
    short = whole.where(F.col("spent") < least).select(*keys, "stretch", "place", "start", (F.col("start") + least - F.col("spent")).alias("end"))
    out = base.where(F.col("end") > F.col("start")).unionByName(short)
    return out.withColumn("seconds", F.col("end") - F.col("start"))


def attribute(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds per key and place."""
    return pieces.groupBy(*keys, "place").agg(F.sum("seconds").alias("seconds"))


def tallies(events: DataFrame, keys: list[str], group: Column, weight: Column, waits: Column) -> DataFrame:
    """Weighted counts per key and group; events that waits marks count as times and seconds instead."""
    return events.groupBy(*keys, group.alias("group")).agg(
        F.sum(F.when(~waits, weight).otherwise(0)).alias("n"), F.count_if(waits).alias("waits"),
        F.round(F.sum(F.when(waits, weight).otherwise(0)), 2).alias("wait_seconds"),
    )


def reset_cumulative(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """rows with `total`: the running total of a counter that starts again whenever it falls (a restarted clock)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    step = F.when(before.isNull() | (F.col(value) < before), F.col(value)).otherwise(F.col(value) - before)
    return rows.withColumn("__step", step).withColumn("total", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def systems_by_gap(rows: DataFrame, keys: list[str], position: str, order: str, factor: float = 1.6) -> DataFrame:
    """rows with `system`: a new one where the gap to the row before is over factor times the upper median gap of the key."""
    w = Window.partitionBy(*keys).orderBy(position, order)
    gaps = rows.withColumn("__gap", F.col(position) - F.lag(position).over(w))
    typical = gaps.where("__gap is not null").withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*keys).orderBy("__gap", order))
    )
    typical = typical.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    typical = typical.where(F.expr("__rank = __n div 2 + 1")).select(*keys, F.col("__gap").alias("__typical"))
    named = gaps.join(typical, keys, "left")
    new = F.coalesce((F.col("__gap") > factor * F.col("__typical")).cast("long"), F.lit(0))
    return named.withColumn("__new", new).withColumn("system", 1 + F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__gap", "__typical", "__new")


def newest(rows: DataFrame, keys: list[str], order: list[Column], keep: int) -> DataFrame:
    """The first `keep` rows per key in the given order: retention of backups, or the newest by priority."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= keep)


def coalesced(events: DataFrame, keys: list[str], t: str = "t", order: str = "event_id", gap: float = 5) -> DataFrame:
    """Repeats of an event (equal keys) within gap seconds of the one before as one: t, t_end, n."""
    w = Window.partitionBy(*keys).orderBy(t, order)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("long"), F.lit(1))
    runs = events.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min(t).alias("t"), F.max(t).alias("t_end"), F.count("*").alias("n"))
