"""Sets of staves chosen by a cascade of rejections, each with its reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Measures that aren't one bar but can be labelled.
LABELLED = ("a bar a repeat splits", "a bar line the reading missed", "a multi-bar rest")
BAR = "struct<work:string,movement:string,bar:int>"
BOX = "struct<bar:int,count:int,rests:int>"


def cascade(rows: DataFrame, rules: list[tuple[str | Column, Callable[[Column], Column]]]) -> DataFrame:
    """rows with `reason`: that of the first rule that rejects a row, null for those that are kept.

    A rule is its reason (text, or a column where the row tells it) and a function of one column, whether a row is still in,
    that gives whether to reject. Rules about single rows needn't look at it; a rule over a window takes its aggregates over
    rows that are still in, so that it sees what the rules before it left. A null answer doesn't reject. All rules are one
    plan: columns, and windows where they are asked for; no row is dropped on the way, so reasons always add up.
    """
    out = rows.withColumn("reason", F.lit(None).cast("string"))
    for name, rejects in rules:
        why = F.lit(name) if isinstance(name, str) else name
        out = out.withColumn("__out", F.coalesce(rejects(F.col("reason").isNull()), F.lit(False)))
        out = out.withColumn("reason", F.coalesce("reason", F.when(F.col("__out"), F.coalesce(why, F.lit("")))))
    return out.drop("__out")


def reasons(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reason, n): how many rows each reason put out, null being those that are kept."""
    return chosen.groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def labellable(plain: Column, told: Column, irregular: Column) -> Column:
    """Whether every measure is one bar (plain), or, if the pairing told which aren't, all of these can be labelled."""
    allowed = F.array(*map(F.lit, LABELLED))
    return plain | (told & (F.size(F.array_except(F.coalesce(irregular, F.array().cast("array<string>")), allowed)) == 0))


def staff_boxes(k: Column) -> Column:
    """(boxes, cut, why) of a kept staff: its bar boxes, the bars that are cut, and why it can't be labelled, or null.

    k: a struct of plain, bars and measures (arrays of BAR structs; a measure has bars, count and two), halves (structs of bar
    and half, `first` or `second`), split_bars and rest_bars (numbers of bars that a repeat splits, and of bar rests). A plain
    staff has a box a bar. Else a measure is its one bar; two bars with a bar line missed between; a run of bar rests; a half
    that a line break cut (count 1 for the first); or half of a bar that a repeat splits, if both are in the staff or it
    stands at an end.
    """
    none = F.lit(None).cast("int")
    box = lambda b, count, rests=none: F.struct(b.cast("int").alias("bar"), F.lit(count).cast("int").alias("count") if not isinstance(count, Column) else count.cast("int").alias("count"), rests.cast("int").alias("rests"))
    number = lambda bars: F.transform(bars, lambda b: b["bar"])
    measures, last = k["measures"], F.size(k["measures"]) - 1
    ok = lambda boxes: F.struct(boxes.cast(f"array<{BOX}>").alias("boxes"), none.alias("cut"), F.lit(None).cast("string").alias("why"))
    cut = lambda b, count: F.struct(F.array(box(b, count)).cast(f"array<{BOX}>").alias("boxes"), b.cast("int").alias("cut"), F.lit(None).cast("string").alias("why"))
    fails = lambda why: F.struct(F.array().cast(f"array<{BOX}>").alias("boxes"), none.alias("cut"), F.lit(why).alias("why"))

    def measure(m: Column, i: Column) -> Column:
        run, b = number(m["bars"]), F.get(m["bars"], F.lit(0))["bar"]
        first = F.get(run, F.lit(0))
        rising = F.forall(F.transform(run, lambda x, n: x == first + n), lambda t: t) & (F.size(run) > 0)
        rests = rising & F.forall(run, lambda x: F.array_contains(k["rest_bars"], x))
        half = F.get(F.filter(k["halves"], lambda h: h["bar"] == b), F.lit(0))["half"]
        both = F.size(F.filter(measures, lambda x: x["bars"] == m["bars"])) == 2
        ends = (i == 0) | (i == last)
        count = F.when(both, m["count"]).when(i == last, 1).otherwise(0)
        several = F.when(F.coalesce(m["two"], F.lit(False)), ok(F.transform(run, lambda x: box(x, 1)))).when(rests, ok(F.array(box(first, 1, F.size(run))))).otherwise(fails("a multi-bar rest"))
        split = F.when(both | ends, cut(b, count)).otherwise(fails("a split bar that can't be cut"))
        return F.when(F.size(run) != 1, several).when(half.isNotNull(), cut(b, F.when(half == "first", 1).otherwise(0))).when(F.array_contains(k["split_bars"], b), split).otherwise(ok(F.array(box(b, 1))))

    each = F.transform(F.coalesce(measures, F.array().cast(f"array<struct<bars:array<{BAR}>,count:int,two:boolean>>")), measure)
    boxes = F.when(k["plain"], F.transform(k["bars"], lambda b: box(b["bar"], 1)).cast(f"array<{BOX}>")).otherwise(F.flatten(F.transform(each, lambda e: e["boxes"])))
    cuts = F.when(k["plain"], F.array().cast("array<int>")).otherwise(F.array_distinct(F.array_compact(F.transform(each, lambda e: e["cut"]))))
    first_why = F.get(F.array_compact(F.transform(each, lambda e: e["why"])), F.lit(0))
    why = F.when(~k["plain"], F.coalesce(first_why, F.when(F.size(boxes) == 0, "no bar boxes from the pairing")))
    return F.struct(boxes.alias("boxes"), cuts.alias("cuts"), why.alias("why"))


def chosen_staves(
    staves: DataFrame, works: list[str], max_unlike: float | None = None, heads_only: bool = False, min_pitch: float | None = None, clef_checks: bool = False,
) -> DataFrame:
    """staves with boxes, cuts and reason: which kept staves make a set to learn from, and why the others don't.

    staves: plain, told, irregular, bars, measures, halves, split_bars, rest_bars (see labellable and staff_boxes), part, worst
    (how unlike its bar the worst measure is), first (the movement's first bar), time_bars (bars where the time changes),
    hits and notes (pitches read right in the chosen clef, of how many), drawn_clefs and read_clefs (arrays), unwritable (why
    no label can be written, or null), far (steps from the middle line of the farthest note) and by_eye (why an editor left it
    out, or null). Each rule sees only what those before it left.
    """
    k = F.struct("plain", "bars", "measures", "halves", "split_bars", "rest_bars")
    told = staves.withColumn("__b", staff_boxes(k)).withColumn("boxes", F.col("__b.boxes")).withColumn("cuts", F.col("__b.cuts")).withColumn("__why", F.col("__b.why")).drop("__b")
    names = F.array_sort(F.array_except(F.coalesce("irregular", F.array().cast("array<string>")), F.array(*map(F.lit, LABELLED))))
    places = F.array_distinct(F.transform("bars", lambda b: F.struct(b["work"], b["movement"])))
    first_bar = F.get("bars", F.lit(0))
    split = F.exists("cuts", lambda b: F.array_contains("split_bars", b) & (F.array_contains("time_bars", b) | F.array_contains("time_bars", b + 1)))
    row = lambda c: lambda left: c
    rules = [
        (F.coalesce(F.nullif(F.array_join(names, "; "), F.lit("")), F.lit("not plain")), row(~labellable(F.col("plain"), F.col("told"), F.col("irregular")))),
        ("two movements", row(F.size(places) > 1)),
        ("another work", row(~first_bar["work"].isin(*works))),
        *([("a measure unlike its bar", row(F.col("worst") > max_unlike))] if max_unlike is not None else []),
        (F.col("__why"), row(F.col("__why").isNotNull())),
        ("a bar a repeat splits at a time change", row(split)),
        ("a movement's first bar split across a line break", row(F.array_contains("cuts", F.col("first")) & ~F.array_contains("split_bars", F.col("first")))),
        *([("no clef or key drawn (not a movement's first staff)", row(first_bar["bar"] != F.col("first")))] if heads_only else []),
        *([("few pitches as the encoding's", row((F.col("notes") > 0) & (F.col("hits") / F.col("notes") < min_pitch)))] if min_pitch is not None else []),
        *([
            ("the encoding's clef changes on the staff", row(F.size(F.array_distinct("drawn_clefs")) > 1)), ("the reading wrote two clefs", row(F.size(F.array_distinct("read_clefs")) > 1)),
        ] if clef_checks else []),
        (F.col("unwritable"), row(F.col("unwritable").isNotNull())),
        *([("notes far off the staff in the clef written", row(F.col("part").isin("va", "va2", "vc") & (F.col("far") > 9)))] if clef_checks else []),
        ("left out by eye", row(F.col("by_eye").isNotNull())),
    ]
    return cascade(told, rules).drop("__why")
