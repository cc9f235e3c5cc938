"""A movement bar by bar, as all parts have it: what they must agree on, what is written at each bar, and whether a structure text
says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .structure import _BRACES, _COMMENT, _QUOTED, TOKENS, movements

#: Bar lines with an end-repeat and with a start-repeat sign; the parts that must agree.
ENDS, STARTS = ("repeat_end", "repeat_both"), ("repeat_start", "repeat_both")
PARTS = ("vn1", "vn2", "va", "vc")
#: What a template's block may hold besides its spacers of one bar.
TEMPLATE = (
    r"\\time\s+\d+\s*/\s*\d+|\\key\s+[a-z]+\s*\\(?:major|minor)|\\(?:tempo|sectionLabel)\s+\"[^\"]*\"|\\repeat\s+volta\s+\d+|\\bar\s+\"[^\"]*\"|\\(?:numeric|default)TimeSignature"
    r"|s\d+\.*\s*\*\s*1(?![\d/])|[{}\s]|\\once|\\override\s+[\w.-]+\s*=\s*#?[\w-]+|\\mark\b|\\daCapoEnd\b|\\daCapo\s+\"[^\"]*\""
)


def shape(bars: DataFrame, keys: list[str], order: str = "order") -> DataFrame:
    """(keys, slot, number, upbeat, end, start): what parts must agree on, a row for each bar of a part's movement (keys).

    bars: keys, order, bar, count, kind (of the bar line that ends it) and opens_line (it is its line's first). A rest of many bars
    stands for each of them; a signed space that opens a line before a start-repeat is no bar, its sign is the bar line's before
    it, unless that ends a repeat: then the two are one sign.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    opening = (F.col("count") == 0) & F.col("opens_line") & F.col("kind").isin(*STARTS)
    rows = bars.withColumn("__opening", F.coalesce(opening, F.lit(False))).withColumn("__next", F.coalesce(F.lead("__opening").over(w), F.lit(False))).where("not __opening")
    n = F.greatest(F.col("count"), F.lit(1))
    rows = rows.withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(0), n - 1)))
    last = F.col("__k") == F.col("__n") - 1
    end = last & F.col("kind").isin(*ENDS)
    start = last & ~F.col("kind").isin(*ENDS) & (F.col("__next") | F.col("kind").isin(*STARTS))
    slot = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "__k")) - 1
    return rows.select(*keys, slot.alias("slot"), (F.col("bar") + F.col("__k")).alias("number"), (F.col("count") == 0).alias("upbeat"), F.coalesce(end, F.lit(False)).alias("end"), F.coalesce(start, F.lit(False)).alias("start"))


def disagreements(shapes: DataFrame, movement: list[str], part: str = "part") -> DataFrame:
    """(movement, slot, parts): the first slot at which a movement's parts differ, and what each has there (part and text); no row
    for movements that agree. shapes: those of the movement's parts."""
    said = F.concat_ws(":", *[F.col(c).cast("string") for c in ("number", "upbeat", "end", "start")])
    parts = shapes.select(*movement, part).distinct().groupBy(*movement).agg(F.count("*").alias("__all"))
    each = shapes.groupBy(*movement, "slot").agg(F.count("*").alias("n"), F.count_distinct(said).alias("kinds"), F.array_sort(F.collect_list(F.struct(F.col(part).alias("part"), said.alias("has")))).alias("parts"))
    off = each.join(parts, movement).where((F.col("kinds") > 1) | (F.col("n") < F.col("__all")))
    return off.groupBy(*movement).agg(F.min(F.struct("slot", "parts")).alias("f")).select(*movement, "f.slot", "f.parts")


def merged_changes(changes: DataFrame, movement: list[str], parts: tuple[str, ...] = PARTS) -> tuple[DataFrame, DataFrame]:
    """(values, conflicts): the key or time written at a place of a movement by any part, the first part's where several do, and
    where parts write different ones. changes: movement, part, number, upbeat, field, value. conflicts: movement, number, field,
    and the first part's and each other part's value."""
    place = F.array_position(F.array(*map(F.lit, parts)), F.col("part"))
    told = changes.where(F.col("part").isin(*parts) & F.col("value").isNotNull()).withColumn("__p", place)
    at = [*movement, "number", "upbeat", "field"]
    first = told.groupBy(*at).agg(F.min(F.struct("__p", "part", "value")).alias("f"))
    values = first.select(*at, F.col("f.value").alias("value"))
    other = told.join(first, at).where(F.col("value") != F.col("f.value"))
    return values, other.select(*movement, "number", "upbeat", "field", F.col("f.part").alias("part"), F.col("f.value").alias("value"), F.col("part").alias("other_part"), told["value"].alias("other_value"))


def slots(shapes: DataFrame, values: DataFrame, headings: DataFrame, movement: list[str]) -> DataFrame:
    """(movement, slot, number, upbeat, end, start, key, time, tempo, title): a movement's bars with what is written there.

    shapes: one part's, as the parts agree; values: of merged_changes; headings: movement, number, upbeat, kind (tempo or title),
    text and place (which comes first where several stand).
    """
    at = [*movement, "number", "upbeat"]
    written = values.groupBy(*at).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("key", "time")])
    first = lambda kind: F.min_by("text", F.when(F.col("kind") == kind, F.col("place"))).alias(kind)
    said = headings.where(F.col("text") != "").groupBy(*at).agg(first("tempo"), first("title"))
    return shapes.select(*movement, "slot", "number", "upbeat", "end", "start").join(written, at, "left").join(said, at, "left")


def expected_of(bars: DataFrame, movement: list[str]) -> DataFrame:
    """(movement, total, pickup, repeat_ends, key, time, changes): what a structure text must say of the slots.

    changes are later keys and times that differ from what holds: arrays of bar, field and value, in order, key before time.
    """
    w = Window.partitionBy(*movement).orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    rows = bars.withColumn("n", F.sum(F.when(F.col("upbeat"), 0).otherwise(1)).over(w))
    before = Window.partitionBy(*movement).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    new = {f: F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.last(f, ignorenulls=True).over(before)) & (F.col("slot") > 0) for f in ("key", "time")}
    for f, test in new.items():
        rows = rows.withColumn(f"__{f}", F.when(test, F.struct("slot", F.lit(f).alias("field"), F.col("number").cast("long").alias("bar"), F.col(f).cast("string").alias("value"))))
    both = F.array_sort(F.flatten(F.collect_list(F.array_compact(F.array("__key", "__time")))))
    out = rows.groupBy(*movement).agg(
        F.max("n").cast("long").alias("total"), F.min_by("upbeat", "slot").alias("pickup"), F.array_sort(F.collect_list(F.when(F.col("end"), F.col("n").cast("long")))).alias("repeat_ends"),
        F.min_by("key", "slot").alias("key"), F.min_by("time", "slot").alias("time"), both.alias("c"),
    )
    return out.select(*movement, "total", "pickup", "repeat_ends", F.col("key").cast("string").alias("key"), "time", F.transform("c", lambda c: F.struct(c["bar"], c["field"], c["value"])).alias("changes"))


def read_back(texts: DataFrame, wanted: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, movement, problems): what a structure text says otherwise than wanted (of expected_of: keys, movement and the rest);
    an empty array where it says the same."""
    got = movements(texts, keys, text)
    ends = F.filter(F.transform("segments", lambda s, i: F.struct(F.aggregate(F.slice("segments", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x["bars"]).alias("n"), s["repeat"].alias("r"))), lambda x: x["r"])
    have = got.select(
        *keys, "movement", F.lit(True).alias("__got"), F.col("total").alias("h_total"), F.col("pickup").alias("h_pickup"), F.transform(ends, lambda x: x["n"]).alias("h_repeat_ends"), F.col("key").cast("string").alias("h_key"),
        F.col("time").alias("h_time"), F.transform("changes", lambda c: F.struct(c["bar"].alias("bar"), c["field"].alias("field"), c["value"].alias("value"))).alias("h_changes"),
    )
    both = wanted.join(have, [*keys, "movement"], "left")
    shown = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("{}"))
    value = lambda c: F.coalesce(F.get_json_object(shown(c), "$.v"), F.lit("none"))
    off = [F.when(~F.col(c).eqNullSafe(F.col(f"h_{c}")), F.concat(F.lit(f"{c}: the block gives "), value(f"h_{c}"), F.lit(", the labels "), value(c))) for c in ("total", "pickup", "repeat_ends", "key", "time", "changes")]
    problems = F.when(F.col("__got").isNull(), F.array(F.lit("the block doesn't parse"))).otherwise(F.array_compact(F.array(*off)))
    return both.select(*keys, "movement", problems.alias("problems"))


def block_text(text: Column, movement: Column) -> Column:
    """The text in a movement's braces, comments and markup left out and quoted texts emptied; null without a block."""
    music = F.regexp_replace(text, f"(?U)(?:{_COMMENT}|{TOKENS['markup']})|({_QUOTED}\"?)", "$1")
    music = F.regexp_replace(music, f'(?U){_QUOTED}"?', '""')
    pattern = F.concat(F.lit(r"(?U)\\tag\s+#'mvt"), movement, F.lit(rf"\s*(\{{{_BRACES}(?:\}}|\z))"))
    return F.nullif(F.call_function("regexp_extract", music, pattern, F.lit(1)), F.lit(""))


def is_template(text: Column, movement: Column) -> Column:
    """Whether a text has no real block for a movement: none, or one with nothing but the template's spacers of one bar among
    signatures, headings, repeats and bar lines."""
    block = block_text(text, movement)
    rest = F.regexp_replace(block, f"(?U){TEMPLATE}", "")
    return block.isNull() | ((F.trim(rest) == "") & block.rlike(r"s\d+\.*\s*\*\s*1(?![\d/])"))


def offered(complete: DataFrame, texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, movement): movements that all PARTS have complete and that the source's text has no real block for. complete: keys,
    part, movement, complete; texts: keys, text; a source without a text is offered nothing."""
    done = complete.where(F.col("complete") & F.col("part").isin(*PARTS)).groupBy(*keys, "movement").agg(F.count_distinct("part").alias("n")).where(F.col("n") == len(PARTS))
    both = done.join(texts.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text")), keys)
    return both.where(is_template(F.col("__text"), F.col("movement"))).select(*keys, "movement")
