"""Splits, scores at several levels, thresholds and comparisons of labelled rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_share(text: Column, salt: str = "") -> Column:
    """A fixed number in [0, 1) of a text: the first 32 bits of its sha1."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(salt), text)), 1, 8), 16, 10).cast("double") / 4294967296


def hash_split(rows: DataFrame, key: Column, test_share: float, held: list | None = None, held_key: Column | None = None) -> DataFrame:
    """rows with `split`: test where the key's share is below test_share or its held_key is held out, else train."""
    test = stable_share(key) < test_share
    if held is not None and held_key is not None:
        test = test | held_key.isin(*held)
    return rows.withColumn("split", F.when(test, "test").otherwise("train"))


def folds(rows: DataFrame, key: Column, n: int, validation_share: float = 0.1) -> DataFrame:
    """rows with `fold` 0 to n - 1 and `validation`, by independent hashes of the key."""
    return rows.withColumn("fold", F.floor(stable_share(key) * n).cast("long")).withColumn(
        "validation", stable_share(key, "validation:") < validation_share
    )


def tally(rows: DataFrame, levels: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures over all rows and by each level alone, in one pass: (level, key, measures)."""
    named = rows.select(*[F.col(c).cast("string").alias(c) for c in levels], *[m.alias(f"__{k}") for k, m in measures.items()])
    pairs = F.array(F.struct(F.lit("all").alias("level"), F.lit("all").alias("key")), *[F.struct(F.lit(c).alias("level"), F.col(c).alias("key")) for c in levels])
    out = named.select(F.explode(pairs).alias("p"), *[f"__{k}" for k in measures])
    return out.groupBy(F.col("p.level").alias("level"), F.col("p.key").alias("key")).agg(*[F.sum(f"__{k}").alias(k) for k in measures])


def precision_recall(found: Column, false: Column, missed: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of counts; null where nothing is found or true."""
    p = F.when(found + false > 0, found / (found + false))
    r = F.when(found + missed > 0, found / (found + missed))
    return p, r, F.when(2 * found + false + missed > 0, 2 * found / (2 * found + false + missed))


def sweep(rows: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """(threshold, found, false, missed, f1, errors) for each threshold: score >= threshold predicts truth.

    Rows are counted once per cell between thresholds; the totals of a threshold are sums over these few cells.
    """
    ts = sorted(thresholds)
    cell = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in ts[1:]), F.when(F.col(score) >= ts[0], 1).otherwise(0))
    cells = rows.groupBy(cell.alias("cell")).agg(
        F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg")
    )
    each = cells.select("*", F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i + 1).alias("i")) for i, t in enumerate(ts)])).alias("t"))
    above = F.col("cell") >= F.col("t.i")
    out = each.groupBy(F.col("t.threshold").alias("threshold")).agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("found"), F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("false"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("missed"),
    )
    f1 = precision_recall(F.col("found"), F.col("false"), F.col("missed"))[2]
    return out.withColumn("f1", f1).withColumn("errors", F.col("false") + F.col("missed"))


def best_f1(swept: DataFrame) -> DataFrame:
    """The threshold of the largest F1, the first on ties."""
    return swept.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.f1").alias("f1"))


def fewest_errors(swept: DataFrame) -> DataFrame:
    """The threshold of the fewest errors, the first on ties."""
    return swept.agg(F.min(F.struct("errors", "threshold")).alias("b")).select("b.threshold", "b.errors")


def order_statistic_cut(rows: DataFrame, score: str, positive: str, lose: float) -> DataFrame:
    """(cut, kept, caught): the largest cut on score that loses at most a share of the positives, and the negatives below it.

    Positives are counted once per score. The counts are dealt into ranges of scores, one a task; the sums of the ranges
    say in which of them the cut lies, and only that one's scores are ranked.
    """
    counts = rows.where(F.col(positive) & F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"))
    parts = counts.repartitionByRange(score).groupBy(F.spark_partition_id().alias("part")).agg(F.sum("n").alias("m"), F.min(score).alias("low"))
    w = Window.orderBy("low")  # a row a task
    past = F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    parts = parts.select("low", F.lead("low").over(w).alias("next"), past.alias("past"), "m", (F.floor(every * lose) + 1).alias("place"))
    part = parts.where((F.col("past") < F.col("place")) & (F.col("place") <= F.col("past") + F.col("m")))
    near = counts.crossJoin(F.broadcast(part))  # one row
    near = near.where((F.col(score) >= F.col("low")) & (F.col("next").isNull() | (F.col(score) < F.col("next"))))
    upto = F.col("past") + F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, 0))
    cut = near.withColumn("upto", upto).where("upto >= place").agg(F.min(score).alias("cut")).where("cut is not null")
    return rows.crossJoin(F.broadcast(cut)).groupBy("cut").agg(
        F.count_if(F.col(positive) & (F.col(score) >= F.col("cut"))).alias("kept"),
        F.count_if(~F.col(positive) & (F.col(score) < F.col("cut"))).alias("caught"),
    )


def both_answer(rows: DataFrame, a: str, b: str, truth: str, near: float, far: float) -> DataFrame:
    """Errors of two methods where both answer, and how often each gives none; one row."""
    ea, eb = F.abs(F.col(a) - F.col(truth)), F.abs(F.col(b) - F.col(truth))
    both = F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(truth).isNotNull()
    stats = lambda e, k: [
        F.median(F.when(both, e)).alias(f"{k}_median"), F.count_if(both & (e <= near)).alias(f"{k}_near"), F.count_if(both & (e > far)).alias(f"{k}_far")
    ]
    return rows.agg(F.count_if(both).alias("both"), *stats(ea, "a"), *stats(eb, "b"), F.count_if(F.col(a).isNull()).alias("a_none"), F.count_if(F.col(b).isNull()).alias("b_none"))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else null: a cascade of rejections."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def readers_agree(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, verdict): agreed, the first field that differs, or the reader that has no answer."""
    both = a.select(key, *[F.col(c).alias(f"__a_{c}") for c in fields], F.lit(1).alias("__a")).join(
        b.select(key, *[F.col(c).alias(f"__b_{c}") for c in fields], F.lit(1).alias("__b")), key, "full"
    )
    rules = [("only second", F.col("__a").isNull()), ("only first", F.col("__b").isNull())]
    rules += [(f"other {c}", ~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))) for c in fields]
    return both.select(key, F.coalesce(first_reason(rules), F.lit("agreed")).alias("verdict"))


def edits(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change, fields): rows added, removed or changed between two versions, with the fields that differ."""
    both = old.select(key, *[F.col(c).alias(f"__a_{c}") for c in fields], F.lit(1).alias("__a")).join(
        new.select(key, *[F.col(c).alias(f"__b_{c}") for c in fields], F.lit(1).alias("__b")), key, "full"
    )
    differs = F.array_compact(F.array(*[F.when(~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), F.lit(c)) for c in fields]))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(differs) > 0, "changed")
    held = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return both.select(key, change.alias("change"), F.when(held, F.array_join(differs, ",")).otherwise("").alias("fields")).where("change is not null")


def popular(rows: DataFrame, item: str, kind: str) -> DataFrame:
    """(item, n, kind): how often each item occurs and its most frequent kind (ties: the least), most frequent first by rank."""
    counts = rows.groupBy(item, kind).agg(F.count("*").alias("n"))
    by = counts.groupBy(item).agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("k"), F.col(kind).alias("kind"))).alias("b"))
    return by.select(item, "n", F.col("b.kind").alias("kind"))


def step_shift(a: Column, b: Column) -> Column:
    """The constant difference of two equally long arrays, else null."""
    diff = F.array_distinct(F.zip_with(a, b, lambda x, y: y - x))
    return F.when((F.size(a) == F.size(b)) & (F.size(diff) == 1), F.element_at(diff, 1))


def bootstrap_interval(rows: DataFrame, a: str, b: str, draws: int = 10_000, seed: int = 1) -> DataFrame:
    """(mean, low, high): the mean of b - a over rows where both are there, and its 95 % percentile interval over resamples.

    Paired: a draw takes each row 0, 1, 2 ... times for both columns. The times are Poisson with mean 1, drawn by a generator
    that is seeded by a batch's place and contents, so that they repeat on recomputation. A task keeps two sums a draw and
    returns them once; the driver gets one row per draw. Without rows all three are null.
    """
    both = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(b) - F.col(a)).cast("double").alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, times, place = np.zeros(draws), np.zeros(draws), 0
        for batch in batches:
            d = batch.column(0).to_numpy()
            gen = np.random.default_rng([seed, TaskContext.get().partitionId(), place, zlib.crc32(d.tobytes())])
            for at in range(0, len(d), 256):
                k = gen.poisson(1.0, (min(256, len(d) - at), draws))
                total += d[at : at + 256] @ k
                times += k.sum(axis=0)
            place += 1
        if place:
            yield pa.RecordBatch.from_pydict({"draw": np.arange(draws), "s": total, "k": times})

    parts = both.mapInArrow(run, "draw long, s double, k double").groupBy("draw").agg((F.sum("s") / F.nullif(F.sum("k"), F.lit(0.0))).alias("m"))
    low, high = (F.percentile("m", p).alias(n) for p, n in ((0.025, "low"), (0.975, "high")))
    return parts.agg(low, high).crossJoin(F.broadcast(both.agg(F.avg("d").alias("mean")))).select("mean", "low", "high")
