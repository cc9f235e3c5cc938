"""Proposed bar lines, chosen staves and cascades against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from marginalia.operators import proposals, selection

SEGMENT = "struct<bars:int,repeat:boolean,split:boolean,heading:boolean>"


def walk(lines, expected, part):
    """A part's lines as [kind, count, ends, auto, reviewed, stop], numbered with proposals one after the other."""
    names = {1: "I", 2: "II", 3: "III", 4: "IV", 5: "V", 6: "VI", 7: "VII", 8: "VIII", 9: "IX", 10: "X"}
    name = lambda n: names.get(n, str(n))
    movement, bar, up, out = 1, 1, None, []
    closed = [not x[3] or x[4] for x in lines]
    for i, (kind, count, ends, *_rest, stop) in enumerate(lines):
        e = expected.get(name(movement)) if part != "score" else None
        at, n = {}, 0
        for j, s in enumerate(e["segments"] if e else []):
            n += s[0]
            nxt = e["segments"][j + 1] if j + 1 < len(e["segments"]) else None
            opens = nxt is not None and nxt[1] and not nxt[3]
            at[n] = ({(True, True): "repeat_both", (True, False): "repeat_end", (False, True): "repeat_start"}.get((s[1], opens)), nxt is not None and s[2])
        if up is None:
            up = bool(e and e["pickup"])
        this, up = up, False
        new = (kind, count, ends)
        if not closed[i]:
            sign = at.get(bar, (None,))[0] if e and not this else None
            end = bool(e) and not this and bar == e["total"]
            bars = 0
            for k in range(i + 1, len(lines)):
                bars += (1 if lines[k][1] is None else lines[k][1]) if closed[k] else 1
                if (closed[k] and lines[k][2]) or lines[k][5]:
                    nxt = expected.get(name(movement + 1))
                    end = end and not (nxt is None or bars < nxt["total"] / 2)
                    break
            new = (sign or ("single" if kind.startswith("repeat") else kind), 0 if this else 1, end)
        c = 1 if new[1] is None else new[1]
        if e and c and at.get(bar + c - 1, (None, False))[1]:
            up = True
        out.append((i, *new, not closed[i] and new != (kind, count, ends), name(movement), bar if c else bar - 1))
        bar += c
        if new[2] or stop:
            movement, bar, up = movement + 1, 1, None
    return out


def test_proposals_equal_a_plain_loop(spark):
    rng = random.Random(10)
    lines, plans, want = [], [], []
    for s in range(50):
        expected = {}
        for m in ("I", "II", "III")[: rng.randrange(4)]:
            segments = [(rng.randrange(1, 5), rng.random() < 0.6, rng.random() < 0.3, rng.random() < 0.3) for _ in range(rng.randrange(1, 4))]
            template = rng.random() < 0.15
            plan = {"total": sum(x[0] for x in segments), "pickup": rng.random() < 0.4, "segments": segments}
            plans.append((s, m, plan["total"], plan["pickup"], template, segments))
            if not template:
                expected[m] = plan
        for part in ("vn1", "score")[: rng.choice([1, 1, 2])]:
            own = [(rng.choice(["single", "double", "repeat_end"]), rng.choice([None, 1, 1, 0, 3]), rng.random() < 0.15, rng.random() < 0.7, rng.random() < 0.2, rng.random() < 0.08) for _ in range(rng.randrange(25))]
            lines += [(s, part, i, *x) for i, x in enumerate(own)]
            want += [(s, part, *r) for r in walk(own, expected, part)]
    table = spark.createDataFrame(lines, "s int, part string, n int, kind string, bar_count int, ends_movement boolean, auto boolean, reviewed boolean, stop boolean")
    plan = spark.createDataFrame(plans, f"s int, movement string, total int, pickup boolean, template boolean, segments array<{SEGMENT}>")
    assert sorted(map(tuple, proposals.proposed(table, plan, ["s"]).collect())) == sorted(want)
    assert any(r[6] for r in want) and {r[3] for r in want} >= {"repeat_both", "repeat_start"}
    assert proposals.proposed(table.limit(0), plan, ["s"]).count() == 0
    plain = sorted(map(tuple, proposals.proposed(table, plan.limit(0), ["s"]).collect()))
    assert len(plain) == len(want) and not any(r[5] and r[6] for r in plain if r[3].startswith("repeat"))


def test_a_window_rule_sees_what_is_left(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(10)) for k in range(20) for i in range(6)]
    df = spark.createDataFrame(rows, "k int, i int, x int")
    w = Window.partitionBy("k")
    rules = [("odd", lambda left: F.col("x") % 2 == 1), ("least", lambda left: F.col("x") == F.min(F.when(left, F.col("x"))).over(w)), ("least again", lambda left: F.col("x") == F.min(F.when(left, F.col("x"))).over(w)), ("never", lambda left: F.lit(None).cast("boolean"))]
    want = []
    for k in range(20):
        left = {(k, i): x for key, i, x in rows if key == k}
        why = {key: "odd" for key, x in left.items() if x % 2}
        for name in ("least", "least again"):
            still = [x for key, x in left.items() if key not in why]
            why |= {key: name for key, x in left.items() if key not in why and x == min(still)}
        want += [(*key, x, why.get(key)) for key, x in left.items()]
    got = selection.cascade(df, rules)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(r.n for r in selection.reasons(got, []).collect()) == len(rows)


def staff(held, /, **k):
    base = {
        "plain": True, "told": True, "irregular": [], "bars": [("W1", "I", b) for b in held], "measures": [([("W1", "I", b)], 1, False) for b in held], "halves": [], "split_bars": [], "rest_bars": [],
        "part": "va", "worst": 0.1, "first": 1, "time_bars": [], "hits": 9, "notes": 10, "drawn_clefs": ["alto"], "read_clefs": ["C3"], "unwritable": None, "far": 4, "by_eye": None,
    }
    return base | k


SCHEMA = (
    f"plain boolean, told boolean, irregular array<string>, bars array<{selection.BAR}>, measures array<struct<bars:array<{selection.BAR}>,count:int,two:boolean>>, "
    "halves array<struct<bar:int,half:string>>, split_bars array<int>, rest_bars array<int>, part string, worst double, first int, time_bars array<int>, hits int, notes int, drawn_clefs array<string>, "
    "read_clefs array<string>, unwritable string, far int, by_eye string"
)


def test_staves_are_chosen_or_told_why_not(spark):
    one = lambda b, count=1, two=False: ([("W1", "I", b)], count, two)
    run = lambda *b, two=False: ([("W1", "I", x) for x in b], len(b), two)
    half = {"plain": False, "irregular": ["a bar a repeat splits"]}
    cases = [
        (staff([4, 5]), None, [(4, 1, None), (5, 1, None)], []),
        (staff([4], plain=False, told=False), "not plain", None, None),
        (staff([4], plain=False, irregular=["b", "a multi-bar rest", "a"]), "a; b", None, None),
        (staff([4], bars=[("W1", "I", 4), ("W1", "II", 1)]), "two movements", None, None),
        (staff([4], bars=[("W9", "I", 4)]), "another work", None, None),
        (staff([4], worst=0.9, plain=False, told=False), "not plain", None, None),
        (staff([4], worst=0.9), "a measure unlike its bar", None, None),
        (staff([4], plain=False, measures=[one(4), run(5, 6)]), "a multi-bar rest", None, None),
        (staff([4], plain=False, measures=[one(4), run(5, 6, 7)], rest_bars=[5, 6, 7]), None, [(4, 1, None), (5, 1, 3)], []),
        (staff([4], plain=False, measures=[one(4), run(5, 6, two=True)]), None, [(4, 1, None), (5, 1, None), (6, 1, None)], []),
        (staff([4], plain=False, measures=[one(4), one(5)], halves=[(5, "first")]), None, [(4, 1, None), (5, 1, None)], [5]),
        (staff([4], plain=False, measures=[one(5), one(6)], halves=[(5, "second")]), None, [(5, 0, None), (6, 1, None)], [5]),
        (staff([4], **half, measures=[one(4), one(7, 1), one(7, 0)], split_bars=[7]), None, [(4, 1, None), (7, 1, None), (7, 0, None)], [7]),
        (staff([4], **half, measures=[one(7), one(8)], split_bars=[7]), None, [(7, 0, None), (8, 1, None)], [7]),
        (staff([4], **half, measures=[one(6), one(7), one(8)], split_bars=[7]), "a split bar that can't be cut", None, None),
        (staff([4], **half, measures=[one(7), one(8)], split_bars=[7], time_bars=[8]), "a bar a repeat splits at a time change", None, None),
        (staff([4], plain=False, measures=[]), "no bar boxes from the pairing", None, None),
        (staff([4], plain=False, measures=[one(1), one(2)], halves=[(1, "first")]), "a movement's first bar split across a line break", None, None),
        (staff([4], hits=2), "few pitches as the encoding's", None, None),
        (staff([4], hits=0, notes=0), None, [(4, 1, None)], []),
        (staff([4], drawn_clefs=["alto", "tenor", "alto"], read_clefs=["C3", "C4"]), "the encoding's clef changes on the staff", None, None),
        (staff([4], read_clefs=["C3", "C4"], unwritable="x"), "the reading wrote two clefs", None, None),
        (staff([4], unwritable="the bars don't read back", far=12), "the bars don't read back", None, None),
        (staff([4], far=12), "notes far off the staff in the clef written", None, None),
        (staff([4], far=12, part="vn1"), None, [(4, 1, None)], []),
        (staff([4], by_eye="smudged"), "left out by eye", None, None),
    ]
    names = ["plain", "told", "irregular", "bars", "measures", "halves", "split_bars", "rest_bars", "part", "worst", "first", "time_bars", "hits", "notes", "drawn_clefs", "read_clefs", "unwritable", "far", "by_eye"]
    df = spark.createDataFrame([(n, *(k[c] for c in names)) for n, (k, *_) in enumerate(cases)], "case int, " + SCHEMA)
    got = {r.case: r for r in selection.chosen_staves(df, ["W1"], max_unlike=0.75, min_pitch=0.5, clef_checks=True).collect()}
    for n, (_, reason, boxes, cuts) in enumerate(cases):
        assert got[n].reason == reason, (n, got[n].reason, reason)
        assert reason or ([tuple(b) for b in got[n].boxes], got[n].cuts) == (boxes, cuts), n
    heads = {r.case: r.reason for r in selection.chosen_staves(df, ["W1"], heads_only=True).collect()}
    assert heads[0] == "no clef or key drawn (not a movement's first staff)" and heads[6] == heads[0] and len(heads) == len(cases)
