"""Twins under known stretches and shifts, tuning and out-of-fold scores against plain loops."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.operators import tuning, twins

N = 200
gen = np.random.default_rng(4)


def plain_alike(a, b):
    best = None
    xs = np.arange(N)
    for s in 0.90 + 0.01 * np.arange(21):
        for d in range(-48, 49, 2):
            at = (xs - d * N / 600) / s
            ok = (at >= 0) & (at <= N - 1)
            if ok.sum() >= 0.7 * N:
                r = np.corrcoef(a[ok], np.interp(at[ok], xs, b))[0, 1]
                best = r if best is None else max(best, r)
    return best


def smooth():
    return np.convolve(gen.normal(size=N + 20), np.ones(9) / 9, "same")[10:-10]


def test_best_correlations_equal_a_loop_over_the_grid(spark):
    rows = [(k, smooth(), smooth()) for k in range(4)]
    df = spark.createDataFrame([(k, a.tolist(), b.tolist()) for k, a, b in rows] + [(9, None, [1.0] * N), (10, [1.0] * N, smooth().tolist()), (11, [1.0, 2.0], [1.0])], "k int, a array<double>, b array<double>")
    got = {r.k: r.r for r in twins.alike(df, ["k"], "a", "b", ["k"]).collect()}
    assert all(abs(got[k] - plain_alike(a, b)) < 1e-9 for k, a, b in rows) and got[9] is None and got[10] is None and got[11] is None


def test_stretched_and_shifted_lines_find_their_twins(spark):
    pages = [[smooth() for _ in range(3)] for _ in range(5)]
    xs = np.arange(N)
    first, second = [], []
    for p, staves in enumerate(pages):
        for i, prof in enumerate(staves):
            second.append(("c", 10 + p, (i + 1) % 3 if p == 3 else i, (prof + gen.normal(size=N) * 0.01).tolist()))
            seen = np.interp((xs - 6) / 1.05, xs, prof)  # stretched by 1.05, shifted by 18 of 600
            first.append(("c", p, i, seen.tolist()))
    schema = "copy string, page int, place int, profile array<double>"
    found, staves = twins.twins(spark.createDataFrame(first, schema), spark.createDataFrame(second, schema), ["copy"])
    got = {r.page: r for r in found.collect()}
    assert {p: got[p].other for p in (0, 1, 2, 4)} == {0: 10, 1: 11, 2: 12, 4: 14} and all(got[p].score > 0.95 > got[p].next + 0.2 for p in (0, 1, 2, 4))
    told = {(r.page, r.place): (r.twin, r.at_place, r.r > r.next) for r in staves.collect()}
    assert all(told[p, i] == (i, True, True) for p in (0, 1, 2, 4) for i in range(3)) and len(told) == 15
    moved = spark.createDataFrame([r for r in second if r[1] == 13], schema)
    _, staves = twins.twins(spark.createDataFrame([r for r in first if r[1] == 3], schema), moved, ["copy"])
    assert {r.place: (r.twin, r.at_place) for r in staves.collect()} == {i: ((i + 1) % 3, False) for i in range(3)}


def test_tuning_equals_a_plain_descent(spark):
    rng = random.Random(6)
    rows = [(rng.random(), rng.random(), rng.random() < 0.5) for _ in range(300)] + [(None, 0.9, True)]
    df = spark.createDataFrame(rows, "x double, y double, t boolean")
    grid = {"low": [0.1, 0.3, 0.5], "high": [0.6, 0.8, 1.0]}
    got = tuning.tuned(df, grid, lambda p: (F.col("x") > p["low"]) & (F.col("y") < p["high"]), F.col("t"), {"low": 0.5, "high": 0.6}, 0.9)
    score = lambda low, high: sum(1.0 if t else -0.9 for x, y, t in rows if x is not None and x > low and y < high)
    now, best, rounds, better = {"low": 0.5, "high": 0.6}, score(0.5, 0.6), 0, True
    while better:
        better, rounds = False, rounds + 1
        for name in grid:
            for v in sorted({*grid[name], now[name]}):
                s = score(**(now | {name: v}))
                if s > best + 1e-9:
                    best, now, better = s, now | {name: v}, True
    assert got[0] == now and abs(got[1] - best) < 1e-6 and got[2] == rounds
    assert best <= max(score(a, b) for a, b in itertools.product(*grid.values())) + 1e-9


def test_out_of_fold_scores_leave_the_own_fold_out(spark):
    rows = [(i, i % 4, float(a), float(b), (float(2 * a - b + 0.1 * e) if i % 10 else None)) for i, (a, b, e) in enumerate(gen.normal(size=(200, 3)))]
    df = spark.createDataFrame(rows, "i int, f int, a double, b double, y double")
    got = {r.i: r.score for r in tuning.out_of_fold(df, ["a", "b"], "y", "f", 1e-3).collect()}
    for f in range(4):
        fit = [r for r in rows if r[1] != f and r[4] is not None]
        x = np.array([[1.0, r[2], r[3]] for r in fit])
        w = np.linalg.solve(x.T @ x + 1e-3 * len(fit) * np.diag([0, 1, 1]), x.T @ np.array([r[4] for r in fit]))
        assert all(abs(got[r[0]] - w @ [1.0, r[2], r[3]]) < 1e-6 for r in rows if r[1] == f)
    w = Window.partitionBy("f").orderBy("i")
    both = tuning.second_stage(df, ["a"], "y", "f", lambda s: {"before": F.coalesce(F.lag(s).over(w), F.lit(0.0))})
    assert both.columns == [*df.columns, "first", "score"] and both.count() == 200
    lone = tuning.out_of_fold(df.where("f = 0"), ["a"], "y", "f").agg(F.max(F.abs("score"))).first()[0]
    assert lone == pytest.approx(0.0)  # no other fold to learn from
