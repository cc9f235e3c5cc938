"""Edit distances and alignments of token sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .parts import each_block, each_part


def edit_distance(a: Column, b: Column, substitution=None) -> Column:  # noqa: ANN001
    """Edit distance of two token arrays in higher-order functions: one row of the table per token of a.

    substitution(x, y) gives the cost of putting y for x; 1 for different tokens by default. Insertions and deletions cost
    1. Meant for short arrays (bars, lines, turns); the time is the product of the lengths. Null arrays give null.
    """
    cost = substitution or (lambda x, y: F.when(x == y, 0.0).otherwise(1.0))
    zero = F.transform(F.sequence(F.lit(0), F.size(b)), lambda i: i.cast("double"))

    def row(prev: Column, x: Column) -> Column:
        first = F.array(F.element_at(prev, 1) + 1.0)

        def cell(acc: Column, i: Column) -> Column:
            up = F.get(prev, i) + 1.0
            left = F.element_at(acc, -1) + 1.0
            across = F.get(prev, i - 1) + cost(x, F.get(b, i - 1))
            return F.concat(acc, F.array(F.least(up, left, across)))

        return F.when(F.size(b) == 0, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(b), F.lit(1))), first, cell))

    return F.element_at(F.aggregate(a, zero, row), -1)


def unlikeness(a: Column, b: Column, alike) -> Column:  # noqa: ANN001
    """Edit distance with substitutions of alike tokens at 0.5, over the longer length; 0 for two empty arrays."""
    d = edit_distance(a, b, lambda x, y: F.when(x == y, 0.0).when(alike(x, y), 0.5).otherwise(1.0))
    longer = F.greatest(F.size(a), F.size(b))
    return F.when(longer > 0, d / longer).otherwise(0.0)


def _distance(a: list, b: list, kinds_a: list | None = None, kinds_b: list | None = None) -> float:
    """Edit distance by whole rows of the table; substitutions of tokens of equal kinds cost 0.5, if kinds are given."""
    number: dict = {}
    coded = lambda x: np.array([number.setdefault(t, len(number)) for t in x], np.int64)
    x, y = coded(a), coded(b)
    kx, ky = (coded(kinds_a), coded(kinds_b)) if kinds_a is not None else (x, y)
    steps = np.arange(len(y) + 1, dtype=np.float64)
    row = steps
    for i in range(len(x)):
        across = row[:-1] + np.where(y == x[i], 0.0, np.where(ky == kx[i], 0.5, 1.0))
        best = np.concatenate(([i + 1.0], np.minimum(row[1:] + 1, across)))
        row = np.minimum.accumulate(best - steps) + steps  # insertions; halves are exact
    return float(row[-1])


@F.pandas_udf(DoubleType())
def whole_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """edit_distance of long token arrays: memory of one row of the table, whatever the lengths."""
    return pd.Series([None if x is None or y is None else _distance(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def whole_unlikeness(a: pd.Series, b: pd.Series, kinds_a: pd.Series, kinds_b: pd.Series) -> pd.Series:
    """unlikeness of long token arrays, where tokens of equal kinds are alike."""
    rows = zip(a, b, kinds_a, kinds_b, strict=True)
    return pd.Series([None if r[0] is None or r[1] is None else _distance(*r) / max(len(r[0]), len(r[1]), 1) for r in rows], dtype="float64")


def symbol_error_rate(rows: DataFrame, keys: list[str], wanted: str, got: str) -> DataFrame:
    """(keys, rows, symbols, errors, rate, cut_errors, cut_rate, exact, runaways) of readings (token arrays) against what is wanted.

    errors are edits, rate their share of the wanted symbols. A runaway, a reading of over twice the wanted length, can swamp
    a rate: cut_errors take readings cut at that length. Rates without symbols are null; rows with a null array are left out.
    """
    told = rows.where(F.col(wanted).isNotNull() & F.col(got).isNotNull())
    n = F.size(wanted)
    each = told.select(*keys, n.alias("n"), whole_distance(F.col(wanted), F.col(got)).alias("e"), whole_distance(F.col(wanted), F.slice(got, F.lit(1), 2 * n)).alias("c"), (F.size(got) > 2 * n).alias("far"))
    out = each.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.sum("n").alias("symbols"), F.sum("e").cast("long").alias("errors"), F.sum("c").cast("long").alias("cut_errors"), F.count_if(F.col("e") == 0).alias("exact"), F.count_if("far").alias("runaways")
    )
    rate = lambda c: F.when(F.col("symbols") > 0, F.col(c) / F.col("symbols"))
    return out.select(*keys, "rows", "symbols", "errors", rate("errors").alias("rate"), "cut_errors", rate("cut_errors").alias("cut_rate"), "exact", "runaways")


def align_sequences(left: DataFrame, right: DataFrame, keys: list[str], order: str, token: str, band: int = 64, gap: float = 0.45) -> DataFrame:
    """(keys, op, l, r): the cheapest alignment of two ordered token rows per key, within a band of the diagonal.

    op is `one` (l and r paired; costs 0 if equal, else 1), `extra` (l alone) or `missed` (r alone), gap each; equal costs
    prefer `one`, then `extra`. Tokens of a key are one group, so keys must be as fine as a part of a source.
    """
    schema = left.select(*keys).schema
    schema = schema.add("op", "string").add("l", "long").add("r", "long")
    cols = [*keys, order, token]

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(order), b.sort_values(order)
        at_a, at_b = a[order].tolist(), b[order].tolist()
        steps = _path(a[token].tolist(), b[token].tolist(), band, gap)
        out = [(*key, op, None if i is None else at_a[i], None if j is None else at_b[j]) for op, i, j in steps]
        made = pd.DataFrame(out, columns=[*keys, "op", "l", "r"])
        return made.astype({"l": "Int64", "r": "Int64"})

    return left.select(*cols).groupBy(*keys).cogroup(right.select(*cols).groupBy(*keys)).applyInPandas(run, schema)


def _path(x: list, y: list, band: int, gap: float) -> list[tuple[str, int | None, int | None]]:
    """(op, place in x, place in y) of the cheapest alignment, as in align_sequences: a row of the table at once, in the band only.

    Costs are whole numbers of 2**-20, so that equal costs are equal however they add up.
    """
    n, m = len(x), len(y)
    number: dict = {}
    a, b = (np.array([number.setdefault(t, len(number)) for t in s], np.int64) for s in (x, y))
    whole, step, far = 1 << 20, round(gap * (1 << 20)), np.int64(1) << 60
    reach = max(band, abs(n - m) + 1)
    middle = [i * m // max(n, 1) for i in range(n + 1)]
    low, high = [max(0, c - reach) for c in middle], [min(m, c + reach) for c in middle]
    back: list[np.ndarray] = []
    before = np.zeros(0, np.int64)
    for i in range(n + 1):
        width = high[i] - low[i] + 1
        row, ops = np.full(width, far), np.zeros(width, np.int8)
        if i:
            last = np.full(width + 1, far)  # the row above at places low[i] - 1 .. high[i]
            left, right = max(low[i] - 1, low[i - 1]), min(high[i], high[i - 1])
            last[left - low[i] + 1 : right - low[i] + 2] = before[left - low[i - 1] : right - low[i - 1] + 1]
            extra = last[1:] + step
            one = last[:-1].copy()
            at = np.arange(low[i], high[i] + 1)
            one[at > 0] += np.where(b[at[at > 0] - 1] == a[i - 1], 0, whole)
            one[at == 0] = far
            row = np.minimum(one, extra)
            ops = np.where(one <= extra, 1, 2).astype(np.int8)
        elif not low[0]:
            row[0] = 0
        missed = np.arange(width) * step
        run = np.minimum.accumulate(row - missed) + missed
        ops[run < row] = 3
        before = run
        back.append(ops)
    out, i, j = [], n, m
    while i or j:
        op = back[i][j - low[i]]
        i, j = i - (op != 3), j - (op != 2)
        out.append((("one", "extra", "missed")[op - 1], i if op != 3 else None, j if op != 2 else None))
    return out[::-1]


def align_arrays(pairs: DataFrame, keys: list[str], a: str, b: str, band: int = 64, gap: float = 0.45) -> DataFrame:
    """(keys, op, l, r): align_sequences of two token arrays of each row; l and r count from 0. A null array is empty."""
    schema = pairs.select(*keys).schema.add("op", "string").add("l", "long").add("r", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for at in range(0, len(rows), 256):
                out = [(*(r[k] for k in keys), *step) for r in rows[at : at + 256] for step in _path(r[a] or [], r[b] or [], band, gap)]
                cols = zip(*out, strict=True) if out else [[] for _ in schema]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=schema.names)

    types = [to_arrow_type(f.dataType) for f in schema]
    return pairs.select(*keys, a, b).mapInArrow(run, schema)


def align_whole(pairs: DataFrame, keys: list[str], a: str, b: str, band: int = 64, gap: float = 0.45) -> DataFrame:
    """(keys, steps): align_arrays with the steps (op, l, r) of each row in one array, for pairs as short as bars."""
    schema = pairs.select(*keys).schema.add("steps", ArrayType(StructType().add("op", "string").add("l", "long").add("r", "long")))
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, list[dict]] = {}  # a path depends on which tokens are equal alone; short bars have few such patterns

        def path(x: list, y: list) -> list[dict]:
            number: dict = {}
            pattern = len(x), *(number.setdefault(t, len(number)) for t in (*x, *y))
            steps = known.get(pattern)
            if steps is None:
                steps = [{"op": op, "l": l, "r": r} for op, l, r in _path(x, y, band, gap)]  # noqa: E741
                if len(pattern) <= 32 and len(known) < 10_000:
                    known[pattern] = steps
            return steps

        for batch in batches:
            rows = batch.to_pylist()
            steps = [path(x[a] or [], x[b] or []) for x in rows]
            cols = [*([x[k] for x in rows] for k in keys), steps]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=schema.names)

    return pairs.select(*keys, a, b).mapInArrow(run, schema)


def heaviest_common(pairs: DataFrame, keys: list[str], i: str, j: str, weight: str) -> DataFrame:
    """(keys, weight): the most weight of a common subsequence, a chain of pairs with i and j both rising.

    pairs are the places that match, with a positive weight; only they cost, not the product of the lengths: a task sorts a
    key's pairs by i and keeps prefix maxima over j in a Fenwick tree. Keys without pairs have no row.
    """
    made = pairs.select(*keys).schema.add("weight", "double")
    told = pairs.select(*keys, F.col(i).cast("long").alias("__i"), (-F.col(j)).cast("long").alias("__j"), F.col(weight).cast("double").alias("__w"))

    def best(rows: list[dict]) -> Iterator[tuple]:
        at = {j: k + 1 for k, j in enumerate(sorted({-r["__j"] for r in rows}))}
        tree = [0.0] * (len(at) + 1)
        for r in rows:  # of one i from the last j to the first, so that none follows another
            k = at[-r["__j"]] - 1
            total = r["__w"]
            gained = 0.0
            while k > 0:
                gained = max(gained, tree[k])
                k &= k - 1
            k, total = at[-r["__j"]], total + gained
            while k < len(tree):
                tree[k] = max(tree[k], total)
                k += k & -k
        yield (max(tree),)

    return each_part(told, keys, ["__i", "__j"], made, best)


def placed(evidence: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, x): a place for each slot, in order, each at least its gap after the one before, with the most evidence.

    slots: keys, slot (0, 1, ...) and gap (whole, at least 1; that of slot 0 isn't used). evidence: keys, slot, x (whole) and
    value; the places are the whole numbers from the least to the greatest x of the key, where a slot without evidence has 0.
    Of equal totals the last slot stands as early as it can, and the slots before it as late as they can. Keys where the
    slots find no room have no rows.
    """
    e = evidence.select(*keys, F.lit(1).alias("side"), F.col("slot").cast("long").alias("slot"), F.col("x").cast("long").alias("x"), F.col("value").cast("double").alias("value"))
    s = slots.select(*keys, F.lit(0).alias("side"), F.col("slot").cast("long").alias("slot"), F.col("gap").cast("long").alias("x"), F.lit(0.0).alias("value"))
    made = slots.select(*keys).schema.add("slot", "long").add("x", "long")

    return each_block(e.unionByName(s), keys, ["side", "slot", "x"], made, _places)


def _places(rows: dict[str, np.ndarray], starts: np.ndarray, cells: int = 1 << 20) -> tuple[np.ndarray, list[np.ndarray]]:
    """(key, [slot, x]), as in placed; tables of one shape are worked out together, up to so many cells."""
    n = len(starts)
    key, side, slot, x = np.repeat(np.arange(n), np.diff([*starts, len(rows["side"])])), rows["side"], rows["slot"], rows["x"]
    seen = side == 1
    slots, first = np.bincount(key[~seen], minlength=n), starts
    seen_key, seen_slot, seen_x, value = key[seen], slot[seen], x[seen], rows["value"][seen]
    there, begin = np.unique(seen_key, return_index=True)  # rows are in order of their keys, slots before evidence
    low, width = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(there):
        low[there] = np.minimum.reduceat(seen_x, begin)
        width[there] = np.maximum.reduceat(seen_x, begin) - low[there] + 1
    shapes, which = np.unique(np.stack([slots, width], axis=1), axis=0, return_inverse=True)
    out: list[tuple[np.ndarray, ...]] = []
    for shape, (s, w) in enumerate(shapes.tolist()):
        if not s or not w:
            continue
        same, many = np.flatnonzero(which.reshape(-1) == shape), max(1, cells // (s * w))
        for held in (same[at : at + many] for at in range(0, len(same), many)):
            own, each, place = np.zeros((len(held), s, w)), np.arange(len(held)), np.arange(w)
            local = np.full(n, -1)
            local[held] = each
            told = np.flatnonzero((local[seen_key] >= 0) & (seen_slot >= 0) & (seen_slot < s))
            np.add.at(own, (local[seen_key[told]], seen_slot[told], seen_x[told] - low[seen_key[told]]), value[told])
            gaps = np.maximum(1, x[first[held][:, None] + np.arange(s)])
            total, back = own[:, 0], []
            for k in range(1, s):
                reach = np.maximum.accumulate(total, axis=1)
                last = np.maximum.accumulate(np.where(total == reach, place, 0), axis=1)  # the last place of each prefix's best
                before = place - gaps[:, k, None]
                at = np.maximum(before, 0)
                total = np.where(before < 0, -np.inf, np.take_along_axis(reach, at, axis=1)) + own[:, k]
                back.append(np.where(before < 0, 0, np.take_along_axis(last, at, axis=1)))
            best = total.argmax(axis=1)
            fits, found = total[each, best] > -np.inf, [best]
            for b in reversed(back):
                found.append(b[each, found[-1]])
            xs = (np.stack(found[::-1], axis=1) + low[held][:, None])[fits]
            out.append((np.repeat(held[fits], s), np.tile(np.arange(s), len(xs)), xs.reshape(-1)))
    none = np.zeros(0, np.int64)
    made, at, xs = (np.concatenate([none, *c]) for c in zip(*out, strict=True)) if out else (none, none, none)
    return made, [at, xs]
