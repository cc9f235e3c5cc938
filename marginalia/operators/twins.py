"""Which line of one copy is which of another: profiles compared under stretches and shifts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship

#: Stretches and shifts (in 600ths of the length) that are tried, and the share of a profile that must be covered.
STRETCHES, SHIFTS, COVERED = (0.90, 1.10, 0.01), (-48, 48, 2), 0.7


def _grid(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For profiles of n values: the place that each variant reads at each value, and the first and last value it covers."""
    low, high, step = STRETCHES
    s = low + step * np.arange(round((high - low) / step) + 1)
    d = np.arange(SHIFTS[0], SHIFTS[1] + 1, SHIFTS[2]) * n / 600
    at = (np.arange(n)[None, None, :] - d[None, :, None]) / s[:, None, None]
    at = at.reshape(-1, n)
    inside = (at >= 0) & (at <= n - 1)
    at, inside = at[inside.sum(axis=1) >= COVERED * n], inside[inside.sum(axis=1) >= COVERED * n]
    first = inside.argmax(axis=1)
    return at, first, first + inside.sum(axis=1)


class _Resampled:
    """A profile read in every variant, with the sums that correlations need."""

    def __init__(self, b: np.ndarray, grid: tuple[np.ndarray, np.ndarray, np.ndarray]):
        at, self.first, self.end = grid
        n = len(b)
        inside = (np.arange(n) >= self.first[:, None]) & (np.arange(n) < self.end[:, None])
        self.values = np.where(inside, np.interp(at, np.arange(n), b), 0.0)
        self.sum, self.square = self.values.sum(axis=1), (self.values**2).sum(axis=1)

    def correlations(self, a: np.ndarray) -> np.ndarray:
        """Pearson's r of a with each variant over what it covers; NaN where either is constant there."""
        n = (self.end - self.first).astype(np.float64)
        part = lambda x: np.concatenate(([0.0], np.cumsum(x)))
        span = lambda p: p[self.end] - p[self.first]
        sa, saa = span(part(a)), span(part(a * a))
        with np.errstate(invalid="ignore", divide="ignore"):
            va, vb = saa - sa * sa / n, self.square - self.sum**2 / n
            r = (self.values @ a - sa * self.sum / n) / np.sqrt(va * vb)
        return np.where((va > 1e-9 * np.maximum(saa, 1e-300)) & (vb > 1e-9 * np.maximum(self.square, 1e-300)), r, np.nan)


def alike(pairs: DataFrame, keys: list[str], a: str, b: str, b_id: list[str]) -> DataFrame:
    """(keys, r): the best correlation of profile a with b over all stretches and shifts; null if a profile is null, empty,
    constant or of another length. Pairs are dealt and sorted by b_id, so that a task resamples each b once."""
    schema = pairs.select(*keys).schema.add("r", "double")
    rows = pairs.select(*keys, F.col(a).cast("array<double>").alias("__a"), F.col(b).cast("array<double>").alias("__b"), F.struct(*b_id).alias("__id"))
    dealt = rows.repartition("__id").sortWithinPartitions("__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict[int, tuple] = {}
        now, held = None, None
        for batch in batches:
            out: list[float | None] = []
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("__a", "__b", "__id")]
            for x, y, i in zip(*columns, strict=True):
                usable = x.is_valid and y.is_valid and len(x) == len(y) > 1 and not x.values.null_count and not y.values.null_count
                if not usable:
                    out.append(None)
                    continue
                if i != now:
                    n = len(y)
                    grids.setdefault(n, _grid(n))
                    now, held = i, _Resampled(np.asarray(y.values), grids[n])
                r = held.correlations(np.asarray(x.values))
                out.append(float(np.nanmax(r)) if np.isfinite(r).any() else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(out, pa.float64())], names=schema.names)

    ship(pairs.sparkSession)
    return dealt.mapInArrow(run, schema)


def twins(first: DataFrame, second: DataFrame, pair: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pages, staves): for each page of the first copy the page of the second that it is, and for each staff its twin there.

    first, second: pair (names the two copies that are compared), page, place (0, 1, ... down the page) and profile. A page's
    score with another is the mean of its staves' correlations with the staff at the same place, over the places both have;
    the best page wins (ties: the least), next is the runner-up's score. pages: pair, page, other, score, next. staves: pair,
    page, place, other, twin (place of the best staff on that page; ties: the first), r, next, at_place.

    Every page is compared with every page of the other copy, as any may be its twin: pages times pages of two copies.
    """
    a = first.select(*pair, "page", "place", F.col("profile").alias("a"))
    b = second.select(*pair, F.col("page").alias("other"), F.col("place").alias("other_place"), F.col("profile").alias("b"))
    met = a.join(b.withColumn("place", F.col("other_place")), [*pair, "place"])
    by_place = alike(met, [*pair, "page", "place", "other"], "a", "b", [*pair, "other", "other_place"])
    score = by_place.groupBy(*pair, "page", "other").agg(F.avg("r").alias("score")).where("score is not null")
    w = Window.partitionBy(*pair, "page").orderBy(F.desc("score"), "other")
    ranked = score.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("rank = 1")
    pages = cut_lineage(ranked.select(*pair, "page", "other", "score", "next"), "pages")
    on = a.join(pages.select(*pair, "page", "other"), [*pair, "page"]).join(b, [*pair, "other"])
    r = alike(on, [*pair, "page", "place", "other", "other_place"], "a", "b", [*pair, "other", "other_place"]).where("r is not null")
    best = Window.partitionBy(*pair, "page", "place").orderBy(F.desc("r"), "other_place")
    staves = r.withColumn("rank", F.row_number().over(best)).withColumn("next", F.lead("r").over(best)).where("rank = 1")
    return pages, staves.select(*pair, "page", "place", "other", F.col("other_place").alias("twin"), "r", "next", (F.col("place") == F.col("other_place")).alias("at_place"))
