"""Boxes, odd bars and candidates by width, on literal staves and against plain loops."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from marginalia.operators import widths

STAFF = "struct<top:double,bottom:double,start:double,right:double,role:string,runs_on:boolean,barlines:array<struct<x0:double,x1:double,bar_count:int>>>"


def staves(spark, *rows):
    made = [(i, (0.2, 0.24, 0.1, right, role, on, [(x, x, n) for x, n in lines])) for i, (right, lines, role, on) in enumerate(rows)]
    return spark.createDataFrame(made, f"i int, s {STAFF}")


def test_boxes_of_a_staff(spark):
    # A space is 0.01 page widths at an aspect of 1.
    df = staves(spark, (0.5, [(0.3, 1), (0.5, 1), (0.105, 1)], None, None), (0.6, [(0.3, 1), (0.5, 1)], None, None), (0.9, [], None, None), (0.9, [(0.3, 1), (0.5, 1), (0.89, 1)], None, None))
    one = F.lit(1.0)
    got = df.select("i", widths.box_count(F.col("s"), one).alias("n"), widths.music_after(F.col("s"), one).alias("after"), F.round(widths.first_box_share(F.col("s"), one), 6).alias("share")).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [(2, False, 1.0), (3, True, round(0.2 / statistics.median([0.2, 0.1]), 6)), (1, False, 1.0), (3, False, round(0.2 / statistics.median([0.2, 0.39]), 6))]


def test_odd_bars_and_ends(spark):
    even = [(0.1 * k, 1) for k in range(2, 8)]
    df = staves(
        spark, (0.705, even, None, None), (0.76, even, None, None), (0.69, even, None, None), (0.76, even, None, True), (0.9, even, "cue", None), (0.705, [*even, (0.503, 1)], None, None),
        (0.705, [x for x in even if x[0] != even[2][0]], None, None), (0.705, [(0.2, 1), (0.7, 1)], None, None), (0.705, [*even[:2], (0.52, 2), *even[4:], (0.735, 1)], None, None),
    )
    got: dict = {}
    for r in widths.odd_bars(df, ["i"], "s", F.lit(0.01), F.col("i") == 8).collect():
        got.setdefault(r.i, []).append((r.kind, r.place, round(r.ratio, 4)))
    assert got == {1: [("past", 7, 6.0)], 2: [("short", 7, 1.0)], 5: [("stacked", 5, 0.0)], 6: [("wide", 3, 2.0)], 8: [("short", 7, 3.0)]}


def test_candidates_are_weighed_as_in_a_plain_loop(spark):
    rng = random.Random(17)
    rows, want, kept = [], {}, []
    for k in range(40):
        gap = rng.choice([5.3, 8.1])
        xs = sorted(rng.sample(range(0, 400), rng.randrange(1, 14)))
        cands = [(i, float(x), round(rng.random(), 3)) for i, x in enumerate(xs)]
        rows += [(k, i, x, gap, p) for i, x, p in cands]
        prov = []
        for i, x, p in sorted(cands, key=lambda c: (-c[2], c[0])):
            if p >= 0.5 and all(abs(x - cands[j][1]) >= widths.MIN_BAR * gap for j in prov):
                prov.append(i)
        at = sorted(cands[j][1] for j in prov)
        typical = statistics.median([b - a for a, b in zip(at, at[1:], strict=False)]) if len(at) >= 3 else 6 * gap
        for i, x, _ in cands:
            left, right = max((y for y in at if y < x), default=None), min((y for y in at if y > x), default=None)
            want[k, i] = (
                (x - xs[i - 1]) / gap if i else 99.0, (xs[i + 1] - x) / gap if i + 1 < len(xs) else 99.0, typical / gap, (x - left) / typical if left is not None else -1.0,
                (right - x) / typical if right is not None else -1.0, (right - left) / typical if left is not None and right is not None else -1.0,
            )
        lines = []
        for i, x, p in sorted(cands, key=lambda c: (-c[2], c[0])):
            if p >= 0.6 and all(abs(x - cands[j][1]) >= widths.MIN_BAR * gap for j in lines):
                lines.append(i)
        kept += [(k, i, "double" if any(j != i and p >= 0.5 and abs(y - cands[i][1]) < 1.2 * gap for j, y, p in cands) else "single") for i in lines]
    df = spark.createDataFrame(rows, "k int, i int, x double, gap double, p double")
    got = {(r.k, r.i): tuple(r)[5:] for r in widths.with_widths(df, ["k"], "i", "x", "gap", "p").collect()}
    assert set(got) == set(want) and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))
    lines = widths.chosen_lines(df, ["k"], "i", "x", "gap", "p", 0.6, F.col("p") >= 0.5).collect()
    assert sorted((r.k, r.i, r.kind) for r in lines) == sorted(kept) and {k for *_, k in kept} == {"single", "double"}
