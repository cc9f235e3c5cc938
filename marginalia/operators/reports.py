"""Reports on the activity log: what was done, how often, and how long each source and page took."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import activity

#: Kinds after which the time isn't the page's: the tab was left, or the panel that shows times was open.
AWAY = ["blur", "pause"]


def whats(what: Column) -> Column:
    """The items of a comma list, trimmed; blank ones are left out."""
    return F.filter(F.transform(F.split(F.coalesce(what, F.lit("")), ","), lambda w: F.trim(w)), lambda w: w != "")


def tallies(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, counter, what, n, seconds): the eight counters of a log, one row for each thing counted.

    edits and corrections (items that end in "(detected)") of edit events; undone: "undo: " and "redo: " items; machine: "by:
    item" of automatic changes; commands and keys: the whole text. An event weighs n, 1 if absent. A server's other events
    are waits, or background if their kind ends in "-ahead": times and seconds. Other events count nowhere.
    """
    kind, what = F.col("kind"), F.coalesce("what", F.lit(""))
    entry = lambda counter, w: F.struct(F.lit(counter).alias("counter"), w.alias("what"))
    detected = lambda w: F.when(w.endswith("(detected)"), F.lit("corrections")).otherwise("edits")
    each = lambda f: F.transform(whats(F.col("what")), f)
    server = F.when(kind.endswith("-ahead"), F.lit("background")).otherwise("waits")
    found = (
        F.when(kind == "edit", each(lambda w: F.struct(detected(w).alias("counter"), w.alias("what"))))
        .when(kind.isin("undo", "redo"), each(lambda w: entry("undone", F.concat(kind, F.lit(": "), w))))
        .when(kind == "auto", each(lambda w: entry("machine", F.concat(F.coalesce("by", F.lit("?")), F.lit(": "), w))))
        .when(kind == "command", F.array(entry("commands", what))).when(kind == "key", F.array(entry("keys", what)))
        .when(F.col("src") == "labeler-server", F.array(F.struct(server.alias("counter"), kind.alias("what"))))
    )
    rows = events.select(*keys, F.explode(found).alias("e"), F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
    timed = F.col("e.counter").isin("waits", "background")
    out = rows.groupBy(*keys, F.col("e.counter").alias("counter"), F.col("e.what").alias("what")).agg(
        F.sum(F.when(timed, 1).otherwise(F.col("n"))).cast("long").alias("n"), F.sum(F.when(timed, F.col("seconds"))).alias("seconds")
    )
    return out


def top_tallies(counted: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """The `most` most frequent things of each counter; ties by name."""
    w = Window.partitionBy(*keys, "counter").orderBy(F.desc("n"), "what")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def reviewed_at(events: DataFrame, keys: list[str], order: str = "event_id") -> DataFrame:
    """(keys, where, reviewed_at): when each page was first marked reviewed since that was last undone; pages that aren't
    reviewed at the end are left out. An edit or redo of "status reviewed" marks, an undo of any status change clears."""
    items = whats(F.col("what"))
    marks = F.col("kind").isin("edit", "redo") & F.array_contains(items, "status reviewed")
    clears = (F.col("kind") == "undo") & F.exists(items, lambda w: w.startswith("status "))
    seen = events.withColumn("where", F.coalesce("where", F.lit(""))).where(marks | clears).withColumn("clears", clears)
    w = Window.partitionBy(*keys, "where").orderBy(F.desc("t"), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    left = seen.withColumn("cleared", F.max(F.col("clears").cast("int")).over(w)).where("cleared = 0")
    return left.groupBy(*keys, "where").agg(F.min("t").alias("reviewed_at"))


def bars_per_page(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, where, bars): the bars that each music page's bar lines count, under "p" and its number."""
    count = F.aggregate(
        F.coalesce("systems", F.array()), F.lit(0),
        lambda n, s: n + F.aggregate(F.coalesce(s["barlines"], F.array()), F.lit(0), lambda m, b: m + F.coalesce(b["bar_count"], F.lit(1))),
    )
    return pages.where("kind = 'music'").select(*keys, F.concat(F.lit("p"), "page").alias("where"), count.cast("long").alias("bars"))


def page_report(events: DataFrame, pages: DataFrame, keys: list[str], gap: float = activity.GAP, order: str = "event_id", least: float = activity.LEAST) -> DataFrame:
    """A row for each page of each source that has any time or events: seconds, of these first_pass and review, edits,
    corrections, opened, bars, page, status, kind, part, reviewed_at.

    events: keys, src, kind, where, what, n, t, t_end. A piece of time is review if it begins when the page is marked
    reviewed or later.
    """
    log = events.withColumn("where", F.coalesce("where", F.lit(""))).withColumn("n", F.coalesce("n", F.lit(1)))
    person = log.where("src = 'labeler'")
    pieces = activity.segments(person, keys, "where", "kind", AWAY, order=order, gap=gap, least=least).withColumnRenamed("place", "where")
    marked = reviewed_at(log, keys, order)
    timed = pieces.join(marked, [*keys, "where"], "left")
    later = F.coalesce(F.col("start") >= F.col("reviewed_at"), F.lit(False))
    spent = timed.groupBy(*keys, "where").agg(
        F.round(F.sum("seconds"), 1).alias("seconds"), F.round(F.sum(F.when(later, 0.0).otherwise(F.col("seconds"))), 1).alias("first_pass"),
        F.round(F.sum(F.when(later, F.col("seconds")).otherwise(0.0)), 1).alias("review"),
    )
    edit = F.col("kind") == "edit"
    detected = F.size(F.filter(whats(F.col("what")), lambda w: w.endswith("(detected)")))
    done = person.groupBy(*keys, "where").agg(
        F.sum(F.when(edit, F.col("n")).otherwise(0)).cast("long").alias("edits"), F.sum(F.when(edit, F.col("n") * detected).otherwise(0)).cast("long").alias("corrections"),
        F.count_if(F.col("kind") == "open").alias("opened"),
    )
    labels = pages.select(*keys, F.concat(F.lit("p"), "page").alias("where"), "status", "kind", "part")
    out = done.join(spent, [*keys, "where"], "full").join(labels, [*keys, "where"], "left").join(bars_per_page(pages, keys), [*keys, "where"], "left").join(marked, [*keys, "where"], "left")
    zero = lambda *cs: [F.coalesce(c, F.lit(0)).alias(c) for c in cs]
    number = F.regexp_extract("where", "^.(\\d+)$", 1).try_cast("int").alias("page")
    return out.select(*keys, "where", number, *zero("seconds", "first_pass", "review", "edits", "corrections", "opened", "bars"), "status", "kind", "part", "reviewed_at")


def by_source(report: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seconds, pages, bars, edits, per_100_bars): each source's pages (of page_report) added up; minutes per 100 bars of
    pages with time, null without bars."""
    timed = F.col("seconds") > 0
    out = report.groupBy(*keys).agg(
        F.sum("seconds").alias("seconds"), F.count_if(timed).alias("pages"), F.sum(F.when(timed, F.col("bars")).otherwise(0)).alias("bars"), F.sum("edits").alias("edits")
    )
    return out.withColumn("per_100_bars", F.when(F.col("bars") > 0, F.col("seconds") / 60 / F.col("bars") * 100))


def days(events: DataFrame, keys: list[str], gap: float = activity.GAP, order: str = "event_id", least: float = activity.LEAST, per_second: int = 1) -> DataFrame:
    """(keys, day, seconds): a person's time by the day, in the session's time zone, on which each piece of it begins; without
    keys over the whole log. Times are in units of which per_second make a second."""
    pieces = activity.segments(events.where("src = 'labeler'"), keys, "where", "kind", AWAY, order=order, gap=gap, least=least)
    day = F.to_date(F.timestamp_micros((F.col("start") * (1_000_000 // per_second)).cast("long")))
    return pieces.groupBy(*keys, day.alias("day")).agg(F.round(F.sum("seconds") / per_second, 1).alias("seconds"))


def source_report(events: DataFrame, pages: DataFrame, keys: list[str], gap: float = activity.GAP, order: str = "event_id", least: float = activity.LEAST) -> DataFrame:
    """A row for each source with pages or events: seconds, stretches, bars, pages_total, music_pages, reviewed and first_logged.

    events and pages as for page_report. seconds is the person's time, bars what all music pages' bar lines count. Days are
    in `days`, pages in `page_report`, counters in `tallies`, stretches in `timeline`.
    """
    person = events.where("src = 'labeler'").withColumn("where", F.coalesce("where", F.lit("")))
    spent = activity.segments(person, keys, "where", "kind", AWAY, order=order, gap=gap, least=least).groupBy(*keys).agg(
        F.round(F.sum("seconds"), 1).alias("seconds"), F.count_distinct("stretch").alias("stretches")
    )
    first = events.groupBy(*keys).agg(F.round(F.min("t"), 1).alias("first_logged"))
    labels = pages.groupBy(*keys).agg(
        F.count("*").alias("pages_total"), F.count_if(F.col("kind") == "music").alias("music_pages"), F.count_if(F.col("status") == "reviewed").alias("reviewed")
    )
    bars = bars_per_page(pages, keys).groupBy(*keys).agg(F.sum("bars").alias("bars"))
    out = labels.join(first, keys, "full").join(spent, keys, "left").join(bars, keys, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(*keys, zero("seconds"), zero("stretches"), zero("bars"), zero("pages_total"), zero("music_pages"), zero("reviewed"), "first_logged")


def timeline(events: DataFrame, keys: list[str], gap: float = activity.GAP, order: str = "event_id", least: float = activity.LEAST) -> tuple[DataFrame, DataFrame]:
    """(stretches, items) of each source: stretches with start and end; their items, a row each: stretch, item, from, to, kind,
    where, what, n.

    Items: a piece of time on a page; a wait, a server's event (none that runs ahead) that begins in the stretch or at most
    `least` after it; a mark, an edit or an opening up to the stretch's end. A stretch ends with its last event, piece or wait.
    What belongs to which stretch is a lookup in time, so no stretch is gathered.
    """
    log = events.withColumn("where", F.coalesce("where", F.lit("")))
    person = log.where("src = 'labeler'")
    runs = activity.stretches(person, keys, order=order, gap=gap).groupBy(*keys, "stretch").agg(F.min("t").alias("lo"), F.max("t_end").alias("hi"))
    none = lambda kind: F.lit(None).cast(kind)
    piece = activity.segments(person, keys, "where", "kind", AWAY, order=order, gap=gap, least=least)
    piece = piece.select(*keys, "stretch", F.lit("piece").alias("item"), F.col("start").alias("from"), F.col("end").alias("to"), none("string").alias("kind"), F.col("place").alias("where"), none("string").alias("what"), none("long").alias("n"))
    # The stretch that began last, at or before an event.
    begun = runs.select(*keys, F.col("lo").alias("t"), F.lit(0).alias("side"), F.struct("stretch", "lo", "hi").alias("run"))
    asked = log.where((F.col("src") == "labeler-server") & ~F.col("kind").endswith("-ahead") | F.col("kind").isin("edit", "open")).withColumn("side", F.lit(1))
    w = Window.partitionBy(*keys).orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(begun, allowMissingColumns=True).withColumn("at", F.last("run", ignorenulls=True).over(w)).where("side = 1 and at is not null")
    found = found.withColumn("n", F.coalesce(F.col("n").cast("long"), F.lit(1)))
    item = lambda rows, name, to: rows.select(*keys, F.col("at.stretch").alias("stretch"), F.lit(name).alias("item"), F.col("t").alias("from"), to.alias("to"), "kind", "where", "what", "n")
    wait = item(found.where((F.col("src") == "labeler-server") & (F.col("t") <= F.col("at.hi") + least) & ~F.col("kind").endswith("-ahead")), "wait", F.col("t_end"))
    reach = piece.unionByName(wait).groupBy(*keys, "stretch").agg(F.max("to").alias("far"))
    ends = runs.join(reach, [*keys, "stretch"], "left").select(*keys, "stretch", F.col("lo").alias("start"), F.greatest("hi", "far").alias("end"))
    mark = item(found.where(F.col("kind").isin("edit", "open")), "mark", F.col("t")).join(ends, [*keys, "stretch"]).where(F.col("from") <= F.col("end")).drop("start", "end")
    return ends, piece.unionByName(wait).unionByName(mark)
