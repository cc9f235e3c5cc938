"""Readings against encodings, by plain loops."""

from __future__ import annotations

import random
from collections import Counter

from marginalia.operators import alignment, scoring
from marginalia.streaming import sessions

EVENT = "struct<kind:string,pitches:array<string>,dur:string,dots:int,grace:boolean,acc:array<string>>"
ORDER = "CDEFGAB"


def same(a, b):
    return a[:5] == b[:5]


def path(enc, read):
    d = [[i + j if not i or not j else 0 for j in range(len(read) + 1)] for i in range(len(enc) + 1)]
    for i in range(1, len(enc) + 1):
        for j in range(1, len(read) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (not same(enc[i - 1], read[j - 1])))
    i, j, out = len(enc), len(read), []
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (not same(enc[i - 1], read[j - 1])):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


def differs(a, b):
    if a[0] != b[0]:
        return ["note for rest" if b[0] == "note" else "rest for note"]
    out = []
    if a[1] != b[1]:
        out.append("chord size" if len(a[1]) != len(b[1]) else "octave" if [p[0] for p in a[1]] == [p[0] for p in b[1]] else "pitch")
    return out + ["duration"] * (a[2:4] != b[2:4]) + ["grace"] * (a[4] != b[4])


def event(rng):
    note = rng.random() < 0.8
    return ("note" if note else "rest", sorted(rng.choice("CD") + rng.choice("45") for _ in range(rng.randrange(1, 3))) if note else [], rng.choice(["quarter", "8th"]), rng.randrange(2), rng.random() < 0.1, [rng.choice(["#", "b"])] if rng.random() < 0.3 else [])


def test_bars_and_tallies_equal_plain_loops(spark):
    rng = random.Random(21)
    bars, want, total = [], {}, Counter()
    for n in range(150):
        part, movement = rng.choice(["va", "vc"]), rng.choice(["I", "II"])
        enc = [event(rng) for _ in range(rng.randrange(6))]
        read = [e if rng.random() < 0.6 else event(rng) for e in enc if rng.random() < 0.85] + [event(rng)] * (rng.random() < 0.2)
        written = enc if rng.random() < 0.4 else read
        comparable, known, seen = rng.random() < 0.9, rng.random() < 0.9, rng.random() < 0.85
        bars.append((part, movement, n, enc if known else None, read if seen else None, written, comparable))
        levels = ("all", part, movement)
        if not comparable or not known:
            add = Counter({"bars not compared": 1})
            want[n] = ("not compared", None, None, None, None, None)
        elif not seen:
            add = Counter({"bars": 1, "bars unread": 1, "events": len(enc), "event: unread": len(enc)})
            want[n] = ("unread", None, None, None, None, None)
        else:
            eq = lambda a, b, key: [key(x) for x in a] == [key(x) for x in b]
            exact, as_written = eq(enc, read, lambda e: e[:5]), eq(enc, written, lambda e: e[:5])
            rhythm = eq(enc, read, lambda e: (e[0], *e[2:5]))
            pitch = [e[1] for e in enc if e[0] == "note"] == [e[1] for e in read if e[0] == "note"]
            kinds, right, shown = [], 0, 0
            for i, j in path(enc, read):
                if i is None or j is None:
                    kinds.append("extra" if i is None else "missed")
                elif same(enc[i], read[j]):
                    kinds.append("right")
                    right += enc[i][0] == "note"
                    shown += enc[i][0] == "note" and enc[i][5] == read[j][5]
                else:
                    kinds += differs(enc[i], read[j])
            want[n] = ("compared", exact, as_written, rhythm, pitch, sorted(k for k in kinds if k != "right"))
            add = Counter({"bars": 1, "bars exact": exact, "bars exact as written": as_written, "bars right, clef apart": exact or as_written, "bars right in rhythm": rhythm, "bars right in pitch": pitch, "events": len(enc), "notes right": right, "accidentals shown as encoded": shown})
            add.update("event: " + k for k in kinds)
        for level in levels:
            for k, v in add.items():
                total[level, k] += v
    df = spark.createDataFrame(bars, f"part string, movement string, bar int, encoded array<{EVENT}>, read array<{EVENT}>, written array<{EVENT}>, comparable boolean")
    out = scoring.compared_bars(df, ["part", "movement", "bar"])
    got = {r.bar: (r.standing, r.exact, r.exact_written, r.rhythm, r.pitch, None if r.errors is None else sorted(r.errors)) for r in out.collect()}
    assert got == want
    assert {(r.level, r.counter): r.n for r in scoring.tally(out, "part", "movement").collect()} == {k: v for k, v in total.items() if v}
    assert scoring.compared_bars(df.limit(0), ["part", "movement", "bar"]).count() == 0


def test_runs_in_a_wrong_clef_are_one_error_each(spark):
    wrong = [(1, True), (2, True), (0, False), (1, True), (1, False), (3, True), (0, True), (0, False), (1, False)]
    rows = [("s", i, "va", n, w) for i, (n, w) in enumerate(wrong)] + [("t", 0, "va", 1, True), ("u", 0, "vc", 0, True)]
    df = spark.createDataFrame(rows, "staff string, at int, part string, notes int, wrong boolean")
    assert [tuple(r) for r in scoring.clef_errors(df, ["staff"], "at", ["part"]).collect()] == [("va", 3)]


def test_the_clef_with_most_hits(spark):
    df = spark.createDataFrame([("a", 0, 28), ("a", 1, 29), ("a", 2, 36), ("b", 0, 5), ("c", 0, 34), ("c", 0, 28)], "staff string, place int, encoded int")
    got = {r.staff: (r.clef, r.hits) for r in scoring.clef_votes(df, ["staff"], {"treble": 34, "alto": 28, "tenor": 26, "bass": 22}).collect()}
    assert got == {"a": ("alto", 2), "b": ("treble", 0), "c": ("treble", 1)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_symbol_errors_with_and_without_runaways(spark):
    rng = random.Random(3)
    word = lambda n: [rng.choice("abc") for _ in range(n)]
    rows = [(k % 3, w, w if rng.random() < 0.2 else word(rng.randrange(30))) for k in range(60) for w in [word(rng.randrange(9))]] + [(0, None, ["a"]), (1, ["a"], None), (7, [], ["a"])]
    got = {r.k: tuple(r)[1:] for r in alignment.symbol_error_rate(spark.createDataFrame(rows, "k int, a array<string>, b array<string>"), ["k"], "a", "b").collect()}
    for k in range(3):
        own = [(a, b) for key, a, b in rows if key == k and a is not None and b is not None]
        n, e, c = sum(len(a) for a, _ in own), sum(edits(a, b) for a, b in own), sum(edits(a, b[: 2 * len(a)]) for a, b in own)
        assert got[k] == (len(own), n, e, e / n, c, c / n, sum(a == b for a, b in own), sum(len(b) > 2 * len(a) for a, b in own))
    assert got[7] == (1, 0, 1, None, 0, None, 0, 1)


def test_events_sent_again_count_once(spark, tmp_path):
    rows = [("2026-01-01 10:00:00", "a"), ("2026-01-01 10:00:00", "a"), ("2026-01-01 10:10:00", "b"), ("2026-01-01 10:20:00", "a")]
    spark.createDataFrame(rows, "ts string, k string").write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k string").json(f"{tmp_path}/in")
    q = sessions.distinct_events(stream, "ts", ["ts", "k"]).writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((str(r.ts), r.k) for r in spark.table("once").collect()) == sorted(set(rows))


def test_equal_bars_are_not_aligned_and_a_bar_is_one_row(spark):
    event = lambda p, acc=(): ("note", [p], "8th", 0, False, list(acc))
    e = "array<struct<kind:string,pitches:array<string>,dur:string,dots:int,grace:boolean,acc:array<string>>>"
    same, other = [event("C4", ["#"]), event("D4")], [event("C4"), event("E4"), event("D4")]
    df = spark.createDataFrame([(1, same, same, same, True), (2, same, other, same, True), (3, [], [], [], True)], f"k int, encoded {e}, read {e}, written {e}, comparable boolean")
    out = scoring.compared_bars(df, ["k"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    got = {r.k: (r.exact, r.kinds, r.errors, r.notes_right, r.accidentals_right) for r in out.collect()}
    assert got == {1: (True, ["right", "right"], [], 2, 2), 2: (False, ["right", "extra", "right"], ["extra"], 2, 1), 3: (True, [], [], 0, 0)}
