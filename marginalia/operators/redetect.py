"""A new detection merged into edited pages: what an editor touched stays, what they removed doesn't come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .matching import greedy_pairs, within

#: The share of the smaller staff that must overlap, and how near a bar line may be to one that is kept.
SHARE, NEAR = 0.5, 0.008


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell), F.floor(F.greatest(low, high) / cell))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], l_edges: tuple[str, str], r_edges: tuple[str, str], cell: float, share: float = SHARE) -> DataFrame:
    """Pairs of intervals of equal keys that overlap by more than `share` of the smaller one.

    An interval stands in each cell of width `cell` that it touches, so a hot key is split by place; a pair counts in the cell
    where its overlap begins. The sides' other column names must differ.
    """
    (a, b), (c, d) = ([F.col(x) for x in e] for e in (l_edges, r_edges))
    x = left.withColumn("__cell", F.explode(_cells(a, b, cell)))
    y = right.withColumn("__cell", F.explode(_cells(c, d, cell)))
    pairs = x.join(y, [*keys, "__cell"]).where(F.col("__cell") == F.floor(F.greatest(a, c) / cell)).drop("__cell")
    return pairs.where(F.least(b, d) - F.greatest(a, c) > share * F.least(b - a, d - c))


def redetected(
    staves: DataFrame, lines: DataFrame, found: DataFrame, found_lines: DataFrame, no_staves: DataFrame, no_lines: DataFrame,
    page: list[str], cell: float = 0.05, near: float = NEAR,
) -> tuple[DataFrame, DataFrame]:
    """(staves, lines) of pages after a new detection.

    staves: page, id, place (their order), top, bottom, auto (not edited), shape (a struct with bend). lines: page, id (staff),
    line, mid, auto. found: page, n (order), top, bottom, shape; found_lines: page, n, m, mid. no_staves: page, y of staves that
    an editor deleted; no_lines: page, id, x of bar lines that they deleted.

    Found staves, in order, each take the first unused staff that they overlap by over half the smaller. Of a pair an
    unedited staff gets the found place and shape, an edited one only a bend, if it has none; its edited bar lines stay,
    and found ones come in unless within `near` of an edited or deleted one. A found staff without a pair is new, unless a
    deleted one was inside it. Staves without a pair stay, bar lines and all, if they or any of their bar lines were
    edited. Results: staves with n (null: not found again) and is_new, id null where new; lines with n and m where found.
    """
    s = staves.select(*page, "id", F.col("place").alias("__place"), F.col("top").alias("__top"), F.col("bottom").alias("__bottom"))
    f = found.select(*page, "n", F.col("top").alias("__ftop"), F.col("bottom").alias("__fbottom"))
    pairs = overlapping(s, f, page, ("__top", "__bottom"), ("__ftop", "__fbottom"), cell).select(*page, "id", "n", "__place")
    taken = cut_lineage(greedy_pairs(pairs, page, "n", "id", [F.col("n"), F.col("__place"), F.col("id")]).select(*page, "id", "n"), "taken")

    own = staves.join(taken, [*page, "id"], "left")
    edited = lines.where(~F.col("auto")).select(*page, "id").distinct().withColumn("__edited", F.lit(True))
    own = own.join(edited, [*page, "id"], "left").where(F.col("n").isNotNull() | ~F.col("auto") | F.coalesce("__edited", F.lit(False)))
    new = found.select(*page, "n", F.col("top").alias("__ftop"), F.col("bottom").alias("__fbottom"), F.col("shape").alias("__fshape"))
    own = own.join(new, [*page, "n"], "left")
    again = F.col("n").isNotNull() & F.col("auto")
    bend = (F.col("n").isNotNull() & F.col("shape.bend").isNull() & F.col("__fshape.bend").isNotNull())
    shape = F.when(again, F.col("__fshape")).when(bend, F.col("shape").withField("bend", F.col("__fshape.bend"))).otherwise(F.col("shape"))
    kept = own.select(
        *page, "id", "n", F.lit(False).alias("is_new"), F.when(again, F.col("__ftop")).otherwise(F.col("top")).alias("top"),
        F.when(again, F.col("__fbottom")).otherwise(F.col("bottom")).alias("bottom"), shape.alias("shape"), "auto",
    )
    lone = found.join(taken.select(*page, "n"), [*page, "n"], "left_anti")
    spread = lone.select(*page, "n", "top", "bottom", F.explode(_cells(F.col("top"), F.col("bottom"), cell)).alias("__cell"))
    gone = spread.join(no_staves.select(*page, "y", F.floor(F.col("y") / cell).alias("__cell")), [*page, "__cell"])
    gone = gone.where((F.col("y") > F.col("top")) & (F.col("y") < F.col("bottom"))).select(*page, "n").distinct()
    fresh = lone.join(gone, [*page, "n"], "left_anti")
    added = fresh.select(*page, F.lit(None).cast(staves.schema["id"].dataType).alias("id"), "n", F.lit(True).alias("is_new"), "top", "bottom", "shape", F.lit(True).alias("auto"))
    out_staves = cut_lineage(kept.unionByName(added), "staves")

    told = out_staves.where("not is_new").select(*page, "id", "n")
    stays = lines.join(told, [*page, "id"]).where(F.col("n").isNull() | ~F.col("auto"))
    stays = stays.select(*page, "id", F.lit(None).cast(found.schema["n"].dataType).alias("n"), "line", F.lit(None).cast(found_lines.schema["m"].dataType).alias("m"), "mid", "auto")
    blocks = lines.where(~F.col("auto")).select(*page, "id", F.col("mid").cast("double").alias("__x")).unionByName(no_lines.select(*page, "id", F.col("x").cast("double").alias("__x")))
    fits = out_staves.where("n is not null").select(*page, "n", "id", "is_new").join(found_lines, [*page, "n"])
    near_by = within(fits.where("not is_new"), blocks, [*page, "id"], "mid", "__x", near, strict=True).select(*page, "n", "m").distinct()
    comes = fits.join(near_by, [*page, "n", "m"], "left_anti")
    comes = comes.select(*page, "id", "n", F.lit(None).cast(lines.schema["line"].dataType).alias("line"), "m", "mid", F.lit(True).alias("auto"))
    return out_staves, stays.unionByName(comes)
