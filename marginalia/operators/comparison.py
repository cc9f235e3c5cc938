"""Matching by confidence, rates, claims, sequences and versions compared."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.notation import lookup


def errors_per_100(found: Column, false: Column, missed: Column) -> Column:
    """Errors per 100 true items; 0 where there are none."""
    return F.when(found + missed > 0, 100.0 * (false + missed) / (found + missed)).otherwise(0.0)


@F.pandas_udf(DoubleType())
def _inverse_normal(p: pd.Series) -> pd.Series:
    return p.map(NormalDist().inv_cdf)


def detection_rates(rows: DataFrame, keys: list[str], there: Column, said: Column) -> DataFrame:
    """(keys, hits, there, false, absent, hit, fa, d): hit and false-alarm rates (null without cases) and d'.

    d' takes half a case more on both sides, so that rates of 0 and 1 stay finite.
    """
    counts = rows.groupBy(*keys).agg(
        F.count_if(there & said).alias("hits"), F.count_if(there).alias("there"), F.count_if(~there & said).alias("false"), F.count_if(~there).alias("absent")
    )
    rate = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of))
    z = lambda n, of: _inverse_normal((F.col(n) + 0.5) / (F.col(of) + 1))
    return counts.select("*", rate("hits", "there").alias("hit"), rate("false", "absent").alias("fa"), (z("hits", "there") - z("false", "absent")).alias("d"))


def all_hold(*answers: Column) -> Column:
    """True if all answers are yes, null if none was given, else false: a missing answer among others is a no."""
    given = F.coalesce(*answers).isNotNull()
    yes = [F.coalesce(a, F.lit(False)) for a in answers]
    out = yes[0]
    for a in yes[1:]:
        out = out & a
    return F.when(given, out)


def claims(rows: DataFrame, keys: list[str], true: Column, right: Column) -> DataFrame:
    """(keys, true, accepted, moved, rejected): true claims and those accepted, moved ones and those rejected; null answers are neither."""
    return rows.groupBy(*keys).agg(
        F.count_if(true).alias("true"), F.count_if(true & right).alias("accepted"), F.count_if(~true).alias("moved"), F.count_if(~true & ~right).alias("rejected")
    )


def claim_windows(rows: DataFrame, keys: list[str], first: str, last: str, low: Column, high: Column, reach: int) -> DataFrame:
    """rows with `from` and `to`: the claim first..last widened by reach, clipped to the least low and greatest high of its keys."""
    ends = rows.groupBy(*keys).agg(F.min(low).alias("__low"), F.max(high).alias("__high"))
    match = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    out = rows.alias("r").join(ends.alias("e"), match)
    return out.select("r.*", F.greatest(F.col("__low"), F.col(first) - reach).alias("from"), F.least(F.col("__high"), F.col(last) + reach).alias("to"))


def merged_sequence(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, sequence): the values of each key in order, consecutive repeats merged, nulls skipped; one short array a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    said = rows.where(F.col(value).isNotNull())
    new = said.withColumn("__was", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("__was")))
    listed = new.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value")))).alias("s"))
    return listed.select(*keys, F.transform("s", lambda x: x["__value"]).alias("sequence"))


def top_sequences(sequences: DataFrame, by: list[str], n: int) -> DataFrame:
    """(by, rank, sequence, n): the n most frequent sequences of each group, joined by spaces; ties go by the text."""
    counts = sequences.groupBy(*by, F.array_join("sequence", " ").alias("sequence")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "sequence")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(*by, "rank", "sequence", "n")


def sequence_tally(sequences: DataFrame, part: str, usual: dict[str, str], far: Column) -> DataFrame:
    """(part, staves, change, unusual, far): rows, those that change inside, have a value not their part's usual, have far notes."""
    own = lookup(usual, F.col(part))
    return sequences.groupBy(part).agg(
        F.count("*").alias("staves"), F.count_if(F.size("sequence") > 1).alias("change"),
        F.count_if(F.exists("sequence", lambda c: c != own)).alias("unusual"), F.count_if(far > 0).alias("far"),
    )


def version_outcomes(old: DataFrame, kept: DataFrame, dropped: DataFrame, key: str, value: str, why: str) -> DataFrame:
    """(key, outcome, reason, as_before): what became of each old row in a new version.

    Kept with the same value, kept with another, or not kept: then with its reason up to " [" or " at " (? for none), and
    whether its value is as before. kept and dropped have one row a key; dropped rows carry value and why.
    """
    out = old.select(key, F.col(value).alias("__old"))
    out = out.join(kept.select(key, F.col(value).alias("__new"), F.lit(True).alias("__kept")), key, "left")
    out = out.join(dropped.select(key, F.col(value).alias("__not"), F.col(why).alias("__why")), key, "left")
    gone = F.col("__kept").isNull()
    reason = F.split_part(F.split_part(F.coalesce("__why", F.lit("?")), F.lit(" ["), F.lit(1)), F.lit(" at "), F.lit(1))
    outcome = F.when(gone, "not kept").when(F.col("__old").eqNullSafe(F.col("__new")), "same").otherwise("other")
    return out.select(key, outcome.alias("outcome"), F.when(gone, reason).alias("reason"), F.when(gone, F.col("__not").eqNullSafe(F.col("__old"))).alias("as_before"))


def incomplete(scored: DataFrame, methods: DataFrame, done: DataFrame, page: list[str], method: str) -> DataFrame:
    """(page, method) of scored pages that a method hasn't read: a score over all methods holds only if there are none.

    methods has one row a method, of which there are few.
    """
    wanted = scored.select(*page).distinct().withColumn("__all", F.lit(1)).join(F.broadcast(methods.select(method).distinct().withColumn("__all", F.lit(1))), "__all").drop("__all")
    return wanted.join(done.select(*page, method).distinct(), [*page, method], "left_anti")
