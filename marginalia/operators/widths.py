"""Bars by their widths: boxes on a staff, odd bars and staff ends, and candidates weighed by the bars they would make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import suppressed, within

#: Bars over and under these shares of the median are odd; bar lines closer than this many spaces are stacked; a staff's
#: end may lie so many spaces past its place and short of its last bar line, and its place is half a space past that line.
WIDE, NARROW, STACKED, SLACK, SHORT, END = 1.8, 0.4, 0.5, 1.0, 0.25, 0.5
#: Staff spaces that bars are at least wide, that a double bar's strokes are less apart, of a usual bar where none is
#: known, and of music after the last bar line that make a box more; what a gap is where there is no neighbour.
MIN_BAR, DOUBLE, USUAL, AFTER, NONE = 4.0, 1.2, 6.0, 1.5, 99.0


def _mids(s: Column) -> Column:
    lines = F.filter(F.coalesce(s["barlines"], F.array()), lambda b: b.isNotNull())
    return F.array_sort(F.transform(lines, lambda b: (b["x0"] + b["x1"]) / 2))


def _median(xs: Column) -> Column:
    sorted_, n = F.array_sort(xs), F.size(xs)
    at = lambda k: F.get(sorted_, k.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def box_edges(s: Column, aspect: Column) -> Column:
    """Where a staff's bar boxes begin and end: its start, its bar lines more than a space past it, and its right end where over
    AFTER spaces of staff follow the last one, or none is there. aspect: the page's height over its width."""
    gap = (s["bottom"] - s["top"]) / 4 * aspect
    xs = F.filter(_mids(s), lambda x: x > s["start"] + gap)
    more = (F.size(xs) == 0) | (s["right"] - F.array_max(xs) > AFTER * gap)
    return F.concat(F.array(s["start"]), xs, F.when(more, F.array(s["right"])).otherwise(F.array().cast("array<double>")))


def box_count(s: Column, aspect: Column) -> Column:
    """How many bar boxes a staff has."""
    return F.size(box_edges(s, aspect)) - 1


def music_after(s: Column, aspect: Column) -> Column:
    """Whether over AFTER spaces of staff follow the last bar line; not where there is none."""
    gap = (s["bottom"] - s["top"]) / 4 * aspect
    last = F.array_max(F.filter(_mids(s), lambda x: x > s["start"] + gap))
    return F.coalesce(s["right"] - last > AFTER * gap, F.lit(False))


def first_box_share(s: Column, aspect: Column) -> Column:
    """A staff's first box as a share of the median of the others; 1 with one box."""
    edges = box_edges(s, aspect)
    widths = F.zip_with(F.slice(edges, 2, F.greatest(F.size(edges) - 1, F.lit(0))), F.slice(edges, 1, F.greatest(F.size(edges) - 1, F.lit(0))), lambda b, a: b - a)
    rest = F.slice(widths, 2, F.greatest(F.size(widths) - 1, F.lit(0)))
    return F.when(F.size(widths) > 1, F.get(widths, F.lit(0)) / _median(rest)).otherwise(1.0)


def end_outside(s: Column, space: Column) -> Column:
    """How far a counted staff's end lies outside its place, in spaces: past its last bar line (above 0), short of it (below), 0
    inside or without bar lines. A staff that runs on is never past; cues have no place. space: a staff space in page widths."""
    lines = F.coalesce(s["barlines"], F.array())
    far = F.array_max(F.transform(lines, lambda b: F.greatest(b["x0"], b["x1"])))
    past = F.when(s["right"] - (far + END * space) > SLACK * space, (s["right"] - far) / space)
    short = (s["right"] - F.array_max(_mids(s))) / space
    out = F.when(F.size(lines) == 0, 0.0).otherwise(F.coalesce(past, F.when(short < -SHORT, short), F.lit(0.0)))
    counts = F.coalesce(s["role"], F.lit("part")) == "part"
    return F.when(~counts, 0.0).when(F.coalesce(s["runs_on"], F.lit(False)), F.least(out, F.lit(0.0))).otherwise(out)


def odd_bars(staves: DataFrame, keys: list[str], staff: str, space: Column, reviewed: Column) -> DataFrame:
    """(keys, kind, place, ratio): what looks wrong about a staff's bars (staff: a column with the struct).

    stacked: bar lines less than STACKED spaces apart; past or short: the staff's end (end_outside, ratio in spaces, place one
    more than its bar lines); wide and narrow: single bars over WIDE or under NARROW of the median, where at least three single
    bars aren't stacked; the first bar of a line, which begins with its clef, has no width. place is the place of the bar
    line that ends the bar, from 1. On reviewed pages only the first three are told.
    """
    s = F.col(staff)
    lines = F.array_sort(F.transform(F.filter(F.coalesce(s["barlines"], F.array()), lambda b: b.isNotNull()), lambda b, i: F.struct(((b["x0"] + b["x1"]) / 2).alias("m"), i.alias("i"), F.coalesce(b["bar_count"], F.lit(1)).alias("n"))))
    counts = F.coalesce(s["role"], F.lit("part")) == "part"
    rows = staves.where(counts).withColumn("__b", lines).withColumn("__space", space).withColumn("__off", end_outside(s, F.col("__space"))).withColumn("__reviewed", F.coalesce(reviewed, F.lit(False)))
    bars = F.transform(F.slice("__b", 2, F.greatest(F.size("__b") - 1, F.lit(0))), lambda b, k: F.struct((b["m"] - F.get("__b", k)["m"]).alias("w"), (b["n"] == 1).alias("one"), (k + 2).alias("place")))
    rows = rows.withColumn("__w", bars)
    plain = F.transform(F.filter("__w", lambda x: x["one"] & (x["w"] >= STACKED * F.col("__space"))), lambda x: x["w"])
    rows = rows.withColumn("__n", F.size(plain)).withColumn("__med", _median(plain))
    said = lambda kind, place, ratio: F.struct(kind.alias("kind"), place.cast("int").alias("place"), ratio.cast("double").alias("ratio"))
    stacked = F.transform(F.filter("__w", lambda x: x["w"] < STACKED * F.col("__space")), lambda x: said(F.lit("stacked"), x["place"], F.lit(0.0)))
    end = F.when(F.col("__off") != 0, F.array(said(F.when(F.col("__off") > 0, "past").otherwise("short"), F.size("__b") + 1, F.abs("__off"))))
    odd = F.filter("__w", lambda x: x["one"] & (x["w"] >= STACKED * F.col("__space")) & ((x["w"] > WIDE * F.col("__med")) | (x["w"] < NARROW * F.col("__med"))))
    odd = F.when((F.col("__n") >= 3) & ~F.col("__reviewed"), F.transform(odd, lambda x: said(F.when(x["w"] > F.col("__med"), "wide").otherwise("narrow"), x["place"], x["w"] / F.col("__med"))))
    none = F.array().cast("array<struct<kind:string,place:int,ratio:double>>")
    return rows.select(*keys, F.inline(F.concat(stacked, F.coalesce(end, none), F.coalesce(odd, none))))


def _last_below(rows: DataFrame, keys: list[str], at: str, which: Column, name: str, down: bool = False) -> DataFrame:
    """rows with `name`: the nearest place below (above, if down) each row's own at which a row of `which` stands."""
    places = rows.groupBy(*keys, at).agg(F.max(which).alias("__there"))
    w = Window.partitionBy(*keys).orderBy(F.desc(at) if down else F.asc(at)).rowsBetween(Window.unboundedPreceding, -1)
    near = places.withColumn(name, F.last(F.when(F.col("__there"), F.col(at)), ignorenulls=True).over(w)).drop("__there")
    return rows.join(near, [*keys, at])


def with_widths(candidates: DataFrame, keys: list[str], row_id: str, x: str, gap: str, p: str) -> DataFrame:
    """candidates with gap_prev and gap_next (to the neighbours, in spaces, NONE without one), typical (the median bar between
    provisional bar lines, in spaces, USUAL with fewer than three), w_left, w_right and w_merged: the bars to the provisional
    ones beside a candidate, and the bar without it, as shares of typical, -1 without one.

    Provisional are candidates of p at least 0.5, likeliest first, MIN_BAR spaces apart (ties: the least row_id).
    """
    rows = candidates.withColumn("__u", F.col(x) / F.col(gap))
    w = Window.partitionBy(*keys).orderBy("__u", row_id)
    rows = rows.withColumn("gap_prev", F.coalesce(F.col("__u") - F.lag("__u").over(w), F.lit(NONE))).withColumn("gap_next", F.coalesce(F.lead("__u").over(w) - F.col("__u"), F.lit(NONE)))
    chosen = suppressed(rows.where(F.col(p) >= 0.5).select(*keys, row_id, "__u", p), keys, row_id, "__u", p, MIN_BAR)
    step = chosen.withColumn("__d", F.col("__u") - F.lag("__u").over(Window.partitionBy(*keys).orderBy("__u")))
    usual = step.groupBy(*keys).agg(F.median("__d").alias("__t"), F.count("*").alias("__n")).select(*keys, F.when(F.col("__n") >= 3, F.col("__t")).alias("__t"))
    rows = rows.join(chosen.select(*keys, row_id, F.lit(True).alias("__prov")), [*keys, row_id], "left").withColumn("__prov", F.coalesce("__prov", F.lit(False)))
    rows = _last_below(rows, keys, "__u", F.col("__prov"), "__left")
    rows = _last_below(rows, keys, "__u", F.col("__prov"), "__right", down=True).join(usual, keys, "left")
    typical = F.coalesce("__t", F.lit(USUAL))
    share = lambda d: F.coalesce(d / typical, F.lit(-1.0))
    return rows.select(
        *candidates.columns, "gap_prev", "gap_next", typical.alias("typical"), share(F.col("__u") - F.col("__left")).alias("w_left"), share(F.col("__right") - F.col("__u")).alias("w_right"),
        share(F.col("__right") - F.col("__left")).alias("w_merged"),
    )


def chosen_lines(candidates: DataFrame, keys: list[str], row_id: str, x: str, gap: str, p: str, threshold: float, partner: Column) -> DataFrame:
    """candidates that are bar lines, with kind: likeliest first, MIN_BAR spaces apart, from `threshold` on; double where another
    candidate that may be a partner lies less than DOUBLE spaces away, else single."""
    rows = candidates.withColumn("__u", F.col(x) / F.col(gap)).withColumn("__partner", F.coalesce(partner, F.lit(False)))
    kept = suppressed(rows.where(F.col(p) >= threshold), keys, row_id, "__u", p, MIN_BAR)
    other = rows.where("__partner").select(*keys, F.col(row_id).alias("__other"), F.col("__u").alias("__v"))
    near = within(kept, other, keys, "__u", "__v", DOUBLE, strict=True).where(F.col(row_id) != F.col("__other")).select(*keys, row_id, F.lit(True).alias("__double")).distinct()
    out = kept.join(near, [*keys, row_id], "left")
    return out.select(*candidates.columns, F.when(F.col("__double"), "double").otherwise("single").alias("kind"))
