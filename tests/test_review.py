"""Scans, edit counts, truth, counts against a structure, votes and standings, on literal pages and against plain loops."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from marginalia.operators import review
from marginalia.sources import documents


def pages_of(spark, docs):
    rows = [(k, json.dumps({"schema": 5, "source": {}, "pages": p})) for k, p in docs.items()]
    return documents.pages(spark.createDataFrame(rows, "d string, raw string").selectExpr("d", f"from_json(raw, '{documents.DOCUMENT}') as doc"), ["d"])


def line(x, auto=None):
    return {"id": f"b{x}", "x0": x, "x1": x, **({"auto": auto} if auto is not None else {})}


PAGE = {
    "status": "reviewed", "kind": "music", "part": "va", "rejected_staves": [0.1, 0.2],
    "systems": [{"id": "s", "top": 0.2, "auto": True, "rejected": [0.5], "barlines": [line(0.1, True), line(0.2, False), line(0.3)]}, {"id": "t", "top": 0.4, "barlines": []}, {"id": "c", "role": "cue", "barlines": [line(0.9, True)]}],
}
CROP = {"status": "reviewed", "kind": "music", "systems": [{"id": "s", "above": 2.0, "below": 3.0, "barlines": []}]}


def test_reviewed_pages_and_their_edits(spark):
    p = pages_of(spark, {"a": {"1": PAGE, "2": CROP, "3": {**PAGE, "status": "edited"}, "4": {**PAGE, "kind": "title"}}, "b": {"1": {"status": "reviewed", "kind": "music"}}})
    assert sorted((r.d, r.page) for r in review.reviewed_music(p).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert [(r.d, r.page) for r in review.edited_crops(p).collect()] == [("a", 2)]
    counts = review.edit_counts(p, ["d"])
    assert {(r.d, r.page): tuple(r)[3:] for r in counts.collect()} == {("a", 1): (2, 1, 2, 3, 1, 2, 1), ("a", 2): (1, 1, 0, 0, 0, 0, 0), ("b", 1): (0,) * 7}
    assert {r.d: tuple(r)[1:] for r in review.edit_report(counts, ["d"]).collect()} == {"a": (2, 3, 2, 2, 3, 1, 2, 1, 1 / 3), "b": (1, *(0,) * 7, 0.0)}


def test_truth_changes_with_what_models_learn_from(spark):
    old = {"a": {"1": PAGE}, "b": {"1": PAGE}, "c": {"1": PAGE}, "d": {"1": CROP}, "e": {"1": PAGE}}
    moved = json.loads(json.dumps(PAGE))
    moved["systems"][0]["barlines"][0]["x1"] = 0.11
    new = {"a": {"1": {**PAGE, "notes": "x"}}, "b": {"1": moved}, "c": {"1": {**PAGE, "status": "edited"}}, "d": {"1": {**CROP, "systems": [{**CROP["systems"][0], "above": 2.5}]}}, "f": {"2": PAGE}}
    a, b = pages_of(spark, old), pages_of(spark, new)
    of = lambda f: {r.d: r.changed for r in review.truth_changed(f(a, ["d"]), f(b, ["d"]), ["d"]).collect()}
    assert of(review.bar_line_truth) == {"a": False, "b": True, "c": True, "d": False, "e": True, "f": True}
    assert of(review.crop_truth)["d"] and not of(review.crop_truth)["a"]
    key = lambda p, v="1": tuple(review.training_key(review.bar_line_truth(p, ["d"]), v).first())
    assert key(a) == key(a.repartition(3)) and len({key(a), key(b), key(a, "2")}) == 3 and key(a.limit(0))[1] == 0


def test_counts_against_a_structure(spark):
    bars = [("s", "va", "I", 0, 0, "single", False), ("s", "va", "I", 1, 1, "repeat_end", False), ("s", "va", "I", 2, 3, "repeat_both", True), ("s", "va", "II", 1, 1, "single", False), ("s", "va", "II", 1, 0, "repeat_end", False), ("s", "vc", "III", 1, 2, "final", True)]
    b = spark.createDataFrame(bars, "d string, part string, movement string, bar int, count int, kind string, ends boolean")
    e = spark.createDataFrame([("s", "I", 4, False), ("s", "II", 9, False), ("s", "III", 5, None), ("s", "IV", 7, True)], "d string, movement string, total int, template boolean")
    got = {(r.part, r.movement): tuple(r)[4:] for r in review.counts_against_expected(b, e, ["d"]).collect()}
    assert got["va", "I"] == (4, 4, "ok", True, True, [1, 4], []) and got["va", "II"] == (1, 9, None, False, False, [], [1]) and got["vc", "III"] == (2, 5, "bad", False, True, [], [])
    assert got["va", "IV"] == (0, None, None, False, False, [], []) and got["vc", "I"] == (0, 4, None, False, False, [], []) and len(got) == 8


def test_values_in_force_and_bars_that_are_filled(spark):
    df = spark.createDataFrame([(1, 1), (4, 1), (5, 1), (5, 0), (8, 1), (8, 0), (9, 1)], "bar int, count int")
    changes = F.expr("array(named_struct('bar', 5, 'on_bar_line', true, 'field', 'key', 'value', '2'), named_struct('bar', 8, 'on_bar_line', false, 'field', 'key', 'value', '3'), named_struct('bar', 2, 'on_bar_line', true, 'field', 'time', 'value', 'C'))")
    got = df.select(review.value_in_force(F.lit("1"), changes, "key", F.col("bar"), F.col("count")).alias("v")).collect()
    assert [r.v for r in got] == ["1", "1", "2", "2", "2", "3", "3"]
    segments = F.expr("array(named_struct('bars', 4, 'repeat', true), named_struct('bars', 3, 'repeat', false), named_struct('bars', 5, 'repeat', true))")
    assert spark.range(1).select(review.repeat_ends(segments).alias("r")).first().r == [4, 12]
    m = spark.createDataFrame([(3, []), (4, [("note", False, "half")]), (1, [("rest", True, None)]), (1, [("rest", None, "whole")]), (1, [("note", False, "whole")])], "ticks int, events array<struct<kind:string,bar_rest:boolean,dur:string>>")
    assert [r.fills for r in review.bar_fill(m, F.lit(4)).collect()] == [False, True, True, True, False]


def vote(own, said, voters, tol, need):
    if len(voters) < 3:
        return sorted(own)
    need = min(need, len(voters)) if need else len(voters) // 2 + 1
    points, groups = sorted([(x, "own") for x, _ in own] + said), []
    for p in points:
        if groups and p[0] - groups[-1][0][0] <= tol:
            groups[-1].append(p)
        else:
            groups.append([p])
    free, out = sorted(own), []
    for g in groups:
        if len({w for _, w in g}) >= need:
            x = sum(p[0] for p in g) / len(g)
            near = sorted((abs(o[0] - x), k) for k, o in enumerate(free) if o and abs(o[0] - x) <= tol)
            out.append(free[near[0][1]] if near else (x, None))
            if near:
                free[near[0][1]] = None
                free = [o if o else (float("inf"), None) for o in free]
    kept = []
    for b in sorted(out, key=lambda p: p[0]):
        if kept and b[0] - kept[-1][0] <= tol:
            kept[-1] = b if kept[-1][1] is None and b[1] is not None else kept[-1]
        else:
            kept.append(b)
    return kept


def test_votes_equal_a_plain_loop(spark):
    rng = random.Random(14)
    staves, own, readers, said, want = [], [], [], [], {}
    for s in range(80):
        lines = [(rng.randrange(100, 900) + k / 10, f"l{k}") for k in range(rng.randrange(6))]
        names = [f"d{k}" for k in range(rng.randrange(5))]
        props = [(n, max(0, rng.choice([x for x, _ in lines] or [500]) + rng.randrange(-9, 10)) if rng.random() < 0.7 else rng.randrange(50, 990), rng.random()) for n in names for _ in range(5)]
        staves.append((s, 90.0, 900.0, 20.0, 910.0, 1000.0))
        own += [(s, i, float(x)) for x, i in lines]
        readers += [(s, n, 0.4) for n in names]
        said += [(s, n, float(x), c) for n, x, c in props]
        heard = [(float(x), n) for n, x, c in props if c >= 0.4 and 90 <= x <= 910]
        want[s] = [(s, round(x, 6), i) for x, i in vote([(float(x), i) for x, i in lines], heard, {"own", *names}, 6.0, None)]
    frames = [
        spark.createDataFrame(staves, "s int, left double, right double, gap double, paper double, width double"), spark.createDataFrame(own, "s int, line string, x double"),
        spark.createDataFrame(readers, "s int, detector string, threshold double"), spark.createDataFrame(said, "s int, detector string, x double, sure double"),
    ]
    got = [(r.s, round(r.x, 6), r.line) for r in review.staff_votes(*frames, ["s"]).collect()]
    assert sorted(got, key=repr) == sorted((x for v in want.values() for x in v), key=repr) and any(x[2] is None for x in got)
    assert review.staff_votes(frames[0], frames[1].limit(0), frames[2].limit(0), frames[3], ["s"]).count() == 0


def test_how_staves_stand(spark):
    staves = spark.createDataFrame([("f", i) for i in range(6)], "f string, i int")
    keys = lambda *i: spark.createDataFrame([("f", k) for k in i], "f string, i int")
    out = spark.createDataFrame([("f", 3, ["faint"])], "f string, i int, why array<string>")
    left = spark.createDataFrame([("f", 1, 1, "early"), ("f", 1, 2, "late"), ("f", 0, 1, "x")], "f string, i int, set_order int, reason string")
    got = review.standing(staves, keys(0, 1, 2), out, keys(0, 0), left, ["f", "i"])
    assert {r.i: (r.status, r.why) for r in got.collect()} == {0: ("set", []), 1: ("paired", ["late"]), 2: ("paired", []), 3: ("unpaired", ["faint"]), 4: ("unknown", []), 5: ("unknown", [])}
    assert tuple(review.pairing_summary(got, ["f"]).first()) == ("f", 1, 2, 1)
