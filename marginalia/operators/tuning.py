"""Thresholds by coordinate descent, and scores that no row's own label has touched."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..session import cut_lineage


def tuned(
    rows: DataFrame, grid: dict[str, list[float]], accept: Callable[[dict[str, Column]], Column], truth: Column, start: dict[str, float], false_weight: float = 2.0,
) -> tuple[dict[str, float], float, int]:
    """(parameters, score, rounds) of the best found by coordinate descent.

    A row is found if accept(parameters as literals) holds for it; the score is the true rows that are found less false_weight
    times the others that are. Parameters are tried in turn, each over the values of its grid and its own, least first; what
    is better than all before is kept, until a round over all keeps nothing new. All values of a parameter are scored in one
    pass over the rows: sums, one for each value. A null answer finds nothing.
    """
    rows = cut_lineage(rows.withColumn("__true", F.coalesce(truth, F.lit(False))), "tuned")
    worth = F.when(F.col("__true"), F.lit(1.0)).otherwise(F.lit(-float(false_weight)))

    def scores(tries: list[dict[str, float]]) -> list[float]:
        sums = [F.coalesce(F.sum(F.when(accept({k: F.lit(v) for k, v in t.items()}), worth)), F.lit(0.0)).alias(f"s{i}") for i, t in enumerate(tries)]
        return list(rows.agg(*sums).first())

    now = dict(start)
    best, rounds, better = scores([now])[0], 0, True
    while better:
        better, rounds = False, rounds + 1
        for name, values in grid.items():
            tries = [now | {name: v} for v in sorted({*values, now[name]})]
            for t, score in zip(tries, scores(tries), strict=True):
                if score > best:
                    best, now, better = score, t, True
    return now, best, rounds


def out_of_fold(rows: DataFrame, features: list[str], label: str, fold: str, ridge: float = 1e-3) -> DataFrame:
    """rows with `score`: a ridge regression's value for the label, fitted on the rows of all other folds.

    One pass sums each fold's normal equations (few numbers a fold); a fold's model is solved from all sums less its own, and
    is joined to its rows. Rows whose label is null are scored and teach nothing; a null feature counts as 0. Folds are few
    (each one's sums reach the driver).
    """
    x = [F.lit(1.0), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]]
    d = len(x)
    cells = [(i, j) for i in range(d) for j in range(i, d)]
    known = rows.where(F.col(label).isNotNull())
    sums = known.groupBy(fold).agg(*[F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i, j in cells], *[F.sum(x[i] * F.col(label)).alias(f"b{i}") for i in range(d)], F.count("*").alias("n"))
    parts = {r[fold]: r for r in sums.collect()}
    folds = [r[0] for r in rows.select(fold).distinct().collect()]

    def equations(r: object) -> tuple[np.ndarray, np.ndarray, int]:
        a, b = np.zeros((d, d)), np.array([r[f"b{i}"] for i in range(d)], float)
        for i, j in cells:
            a[i, j] = a[j, i] = r[f"a{i}_{j}"]
        return a, b, r["n"]

    every = [equations(r) for r in parts.values()]
    total = [sum(e[k] for e in every) for k in range(3)] if every else [np.zeros((d, d)), np.zeros(d), 0]
    models = []
    for f in folds:
        own = equations(parts[f]) if f in parts else (0, 0, 0)
        a, b, n = (t - o for t, o in zip(total, own, strict=True))
        penalty = ridge * max(n, 1) * np.diag([0.0, *[1.0] * (d - 1)])
        weights = np.linalg.lstsq(a + penalty, b, rcond=None)[0] if n else np.zeros(d)
        models.append((f, [float(w) for w in weights]))
    schema = rows.select(fold).schema.add("__w", ArrayType(DoubleType()))
    of = rows.sparkSession.createDataFrame(models, schema)
    held = rows.join(F.broadcast(of.withColumnRenamed(fold, "__fold")), F.col(fold).eqNullSafe(F.col("__fold")))
    score = x[0] * F.get("__w", F.lit(0))
    for i in range(1, d):
        score = score + x[i] * F.get("__w", F.lit(i))
    return held.withColumn("score", score).drop("__w", "__fold")


def second_stage(rows: DataFrame, features: list[str], label: str, fold: str, neighbour: Callable[[Column], dict[str, Column]], ridge: float = 1e-3) -> DataFrame:
    """rows with `first` and `score`: a second model that also sees what `neighbour` makes of the first one's scores (window
    expressions over a column: the scores of rows around, say), both out of fold, so that neither has seen a row's own fold."""
    first = out_of_fold(rows, features, label, fold, ridge).withColumnRenamed("score", "first")
    more = neighbour(F.col("first"))
    return out_of_fold(cut_lineage(first.withColumns(more), "second-stage"), [*features, "first", *more], label, fold, ridge).drop(*more)
