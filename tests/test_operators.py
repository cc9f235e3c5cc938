"""Literal cases of the operators on ordered, matched and versioned rows."""

from __future__ import annotations

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.functions import geometry
from marginalia.operators import activity, alignment, evaluation, matching, numbering
from marginalia.plans import queries
from marginalia.sources import documents
from marginalia.streaming import sessions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_numbering_counts_resets_and_pickups(spark):
    data = [("va", 1, "a", 1, False), ("va", 2, "b", 1, False), ("va", 3, "c", 0, False), ("va", 4, "d", 2, True), ("va", 5, "e", 0, False), ("va", 6, "f", 1, False)]
    df = spark.createDataFrame(data, "part string, x int, id string, c int, e boolean")
    got = numbering.number_with_resets(df, ["part"], ["x"], F.col("c"), F.col("e")).select("id", "movement", "bar")
    assert rows(got) == [("a", 1, 1), ("b", 1, 2), ("c", 1, 2), ("d", 1, 3), ("e", 2, 0), ("f", 2, 1)]


@pytest.mark.parametrize(
    ("pages", "want"),
    [
        ([(1, "vn1", "music"), (2, "vn1", "other"), (3, "va", "music"), (4, None, None), (5, "va", "music"), (6, None, "title"), (7, "vc", "music")], [1, 5]),
        ([(1, "vn1", "music"), (5, "va", "music")], []),  # pages 2 to 4 aren't labelled
        ([(1, "vn1", "music"), (2, None, "other"), (4, "va", "music")], []),  # the gap is after the chart
        ([(1, None, "music"), (2, "va", "music"), (3, None, "music"), (4, None, "blank")], []),
        ([(1, "va", "music"), (2, "va", "title")], [1]),
    ],
)
def test_part_ends_need_a_next_page_that_says_something(spark, pages, want):
    df = spark.createDataFrame([("s", *p) for p in pages], "s string, page int, part string, kind string")
    assert [r.page for r in numbering.part_ends(df, ["s"], "page", "part", "kind").where("ends").orderBy("page").collect()] == want


def test_stretches_keep_an_exact_gap_and_split_beyond(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 600, 1000), (3, 700, 700), (4, 1601, 1601)], "event_id int, t long, t_end long").withColumn("u", F.lit(1))
    assert [r.stretch for r in activity.stretches(df, ["u"]).orderBy("t").collect()] == [1, 1, 1, 2]


def test_segments_never_overlap_and_short_stretches_fill_up(spark):
    data = [(1, 0, 0, "p1", "edit"), (2, 120, 120, "p2", "edit"), (3, 200, 200, "p2", "hidden"), (4, 500, 500, "p3", "edit"), (5, 5000, 5000, "p9", "edit")]
    df = spark.createDataFrame(data, "event_id int, t long, t_end long, place string, kind string").withColumn("u", F.lit(1))
    got = activity.segments(df, ["u"], "place", "kind", ["hidden"])
    assert rows(activity.attribute(got, ["u"]).select("place", "seconds")) == [("p1", 120), ("p2", 80), ("p9", 60)]


@pytest.mark.parametrize(
    ("events", "want"),
    [
        ([(0, 0, "p1", "blur"), (100, 100, "p1", "edit")], {"p1": 60}),  # nothing spent: a whole minute
        ([(0, 30, "p1", "blur"), (100, 110, "p2", "edit")], {"p1": 30, "p2": 30}),  # 40 spent, 20 more at the end
        ([(0, 0, "p1", "edit")], {"p1": 60}),
        ([(0, 100, "p1", "active"), (40, 40, "p2", "edit"), (90, 90, "p1", "edit")], {"p1": 100}),
    ],
)
def test_short_stretches_fill_up_what_was_spent(spark, events, want):
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(events)], "event_id int, t long, t_end long, place string, kind string").withColumn("u", F.lit(1))
    got = activity.segments(df, ["u"], "place", "kind", ["blur"])
    assert {r.place: r.seconds for r in activity.attribute(got, ["u"]).collect()} == want


def test_reset_totals_and_gaps(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 2), (4, 6)], "t int, v int").withColumn("k", F.lit(1))
    assert [r.total for r in activity.reset_cumulative(df, ["k"], "v", ["t"]).orderBy("t").collect()] == [5, 9, 11, 15]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([0.0, 1.0, 2.0, 5.0, 6.0, 7.0])], "i int, x double").withColumn("k", F.lit(1))
    assert [r.system for r in activity.systems_by_gap(df, ["k"], "x", "i").orderBy("i").collect()] == [1, 1, 1, 2, 2, 2]


def test_anchored_groups_do_not_chain(spark):
    df = spark.createDataFrame([(0.0, "a"), (0.6, "b"), (1.2, "c")], "x double, v string").withColumn("k", F.lit(1))
    assert matching.anchored_groups(df, ["k"], "x", 1.0).first().groups == [[0.0, 0.6], [1.2]]
    assert rows(matching.vote(df, ["k"], "x", "v", 1.0, 2).select("at", "voters")) == [(0.3, 2)]


def test_greedy_takes_the_nearest_pair_first(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 1.0)], "t_id int, t double").withColumn("k", F.lit(1))
    b = spark.createDataFrame([(7, 0.9), (8, 2.5)], "f_id int, f double").withColumn("k", F.lit(1))
    assert rows(matching.greedy_one_to_one(a, b, ["k"], "t_id", "f_id", "t", "f", 2.0).select("t_id", "f_id")) == [(2, 7)]
    assert rows(matching.nearest_within(a, b, ["k"], "t_id", "f_id", "t", "f", 1.0).select("t_id", "f_id")) == [(1, 7), (2, 7)]


def test_of_rows_of_the_last_page_the_first_tells_whether_a_run_is_complete(spark):
    df = spark.createDataFrame([(1, 1, 1, True), (1, 1, 0, False), (2, 1, 0, True), (2, 1, 1, False), (2, None, 2, True)], "k int, page int, place int, ends boolean").withColumn("seen", F.lit(True))
    assert rows(numbering.complete_runs(df, ["k"], "page", ["place"], "ends", "seen")) == [(1, False), (2, True)]


def test_rows_that_do_not_say_whether_they_end_are_passed_over_as_in_sql(spark, tmp_path):
    items = [(1, 1, "N", "F"), (1, 2, None, "F"), (2, 1, "R", "F"), (2, 2, None, None), (3, 1, None, "F"), (4, 1, "R", "F"), (4, 1, None, "O")]
    df = spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string").withColumn("l_suppkey", F.lit(7))
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    sql = queries.ORACLE["complete_runs"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = rows(queries.QUERIES["complete_runs"](spark, str(tmp_path)))
    assert found == sorted(duckdb.sql(sql).fetchall()) == [(7, 1, False), (7, 2, True), (7, 3, None), (7, 4, False)]


def test_nearest_within_looks_up_places_instead_of_pairing_rows(spark):
    rng = random.Random(5)
    left = [(rng.randint(0, 2), i, rng.randint(0, 300) / 4) for i in range(300)] + [(None, 900, 1.0), (0, 901, None), (0, 902, float("nan")), (5, 903, 1.0)]
    right = [(rng.randint(0, 2), i, rng.randint(0, 300) / 4) for i in range(200)] + [(None, 900, 1.0), (0, 901, None), (0, 902, float("nan"))]
    found = matching.nearest_within(spark.createDataFrame(left, "k int, t_id int, t double"), spark.createDataFrame(right, "k int, f_id int, f double"), ["k"], "t_id", "f_id", "t", "f", 0.5)
    near = {(k, i): min(((abs(x - y), j) for n, j, y in right if n == k and y is not None and abs(x - y) <= 0.5), default=None) for k, i, x in left if k is not None and x is not None}
    assert {((r.k, r.t_id), (r.distance, r.f_id)) for r in found.collect()} == {p for p in near.items() if p[1]}
    assert "__bin" not in found._jdf.queryExecution().toString()  # cells in which all rows of both sides meet


def test_overlapping_boxes_equal_brute_force(spark):
    rng = random.Random(7)
    made = [(rng.randint(0, 1), float(rng.randint(-9, 9)), float(rng.randint(-9, 9)), rng.randint(0, 7), rng.randint(0, 7)) for _ in range(60)]
    boxes = [(k, i, x, y, x + w, y + h) for i, (k, x, y, w, h) in enumerate(made + made[:20])]
    df = spark.createDataFrame(boxes, "k int, id int, l double, t double, r double, d double")
    found = matching.overlapping(df, ["k"], "id", ["l", "t", "r", "d"], 0.25, 3.0, 2.0)

    def iou(a, b):
        w, h = max(min(a[4], b[4]) - max(a[2], b[2]), 0), max(min(a[5], b[5]) - max(a[3], b[3]), 0)
        union = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h
        return w * h / union if union > 0 else 0.0

    want = [(a[0], a[1], b[1], iou(a, b)) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and iou(a, b) > 0.25]
    assert rows(found) == sorted(want)


def test_matchings_equal_brute_force(spark):
    rng = random.Random(2)
    t = [(i, rng.randrange(60) / 4, rng.random()) for i in range(40)]
    f = [(100 + i, rng.randrange(60) / 4, rng.random()) for i in range(30)]
    a = spark.createDataFrame(t, "t_id int, t double, u double").withColumn("k", F.lit(1))
    b = spark.createDataFrame(f, "f_id int, f double, sure double").withColumn("k", F.lit(1))
    used, want = set(), []
    for d, i, j in sorted((abs(x - y), i, j) for i, x, _ in t for j, y, _ in f if abs(x - y) <= 2):
        if not used & {i, j}:
            used |= {i, j}
            want.append((i, j, d))
    assert rows(matching.greedy_one_to_one(a, b, ["k"], "t_id", "f_id", "t", "f", 2.0).select("t_id", "f_id", "distance")) == sorted(want)
    free, want = dict((i, x) for i, x, _ in t), []
    for j, y, _ in sorted(f, key=lambda r: (-r[2], r[0])):
        near = min(((abs(x - y), x, i) for i, x in free.items() if abs(x - y) <= 2), default=None)
        if near:
            want.append((j, near[2]))
            del free[near[2]]
    assert rows(matching.surest_first(b, a, ["k"], "f_id", "t_id", "f", "t", "sure", 2.0).select("f_id", "t_id")) == sorted(want)
    boxes = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.7), (2, 8, 0.9), (3, 7, 0.2)], "a int, b int, iou double").withColumn("k", F.lit(1))
    assert rows(matching.boxes_one_to_one(boxes, ["k"], "a", "b", 0.3).select("a", "b")) == [(1, 7), (2, 8)]
    assert matching.greedy_one_to_one(a.limit(0), b, ["k"], "t_id", "f_id", "t", "f", 2.0).count() == 0


def test_owners_equal_brute_force(spark):
    rng = random.Random(4)
    marks = [(i % 3, i, rng.randrange(400) / 2) for i in range(60)]
    boxes = [(i % 2, 100 + i, rng.randrange(400) / 2) for i in range(25)]
    want = []
    for k, i, x in marks:
        own = [(lo, b) for c, b, lo in boxes if c == k]
        holds, after, before = ([p for p in own if test(p[0])] for test in (lambda lo: lo <= x < lo + 3, lambda lo: lo > x, lambda lo: lo <= x))
        if own:
            rule, box = (1, min(holds)[1]) if holds else (2, min(after)[1]) if after else (3, min(before, key=lambda p: (-p[0], p[1]))[1])
            want.append((k, i, box, rule))
    m, b = spark.createDataFrame(marks, "k int, mark long, x double"), spark.createDataFrame(boxes, "k int, box long, lo double")
    assert rows(matching.owners(m, b, ["k"], "mark", "box", "x", "lo", 3.0)) == sorted(want)


def test_first_fit_equals_brute_force(spark):
    rng = random.Random(6)
    t = [(i, x, x + rng.randrange(3)) for i in range(40) for x in [rng.randrange(80) / 2]]
    f = [(100 + i, x, x + rng.randrange(3)) for i in range(40) for x in [rng.randrange(80) / 2]]
    used, want = set(), []
    for i, lo, hi in sorted(t, key=lambda r: (r[1], r[0])):
        hit = next((j for j, a, b in sorted(f, key=lambda r: (r[1], r[0])) if j not in used and abs(a - lo) <= 1 and abs(b - hi) <= 1), None)
        used.add(hit)
        want.append((i, -1 if hit is None else hit))
    a, b = spark.createDataFrame(t, "t long, lo double, hi double").withColumn("k", F.lit(1)), spark.createDataFrame(f, "f long, flo double, fhi double").withColumn("k", F.lit(1))
    got = matching.first_fit(a, b, ["k"], ["t", "lo", "hi"], ["f", "flo", "fhi"], 1.0)
    assert rows(got.select("t", F.coalesce("f", F.lit(-1)))) == sorted(want)


@pytest.mark.parametrize("lose", [0.0, 0.05, 0.5, 0.99])
def test_cut_loses_at_most_its_share(spark, lose):
    rng = random.Random(3)
    data = [(float(rng.randrange(50)), rng.random() < 0.6) for _ in range(300)]
    pos = sorted(s for s, y in data if y)
    cut = pos[int(len(pos) * lose)]
    got = evaluation.order_statistic_cut(spark.createDataFrame(data, "s double, y boolean"), "s", "y", lose)
    assert rows(got) == [(cut, sum(s >= cut for s in pos), sum(not y and s < cut for s, y in data))]


def test_paired_bootstrap_brackets_the_mean(spark):
    rng = random.Random(1)
    data = [(x, x + 0.3 + rng.gauss(0, 0.5)) for x in (rng.random() for _ in range(200))] + [(None, 1.0)]
    got = evaluation.bootstrap_interval(spark.createDataFrame(data, "a double, b double"), "a", "b", 400).first()
    d = [b - a for a, b in data if a is not None]
    se = (sum((x - got.mean) ** 2 for x in d) / len(d) / len(d)) ** 0.5
    assert abs(got.mean - sum(d) / len(d)) < 1e-9 and abs(got.low - (got.mean - 1.96 * se)) < 0.5 * se and abs(got.high - (got.mean + 1.96 * se)) < 0.5 * se


def test_small_expressions(spark):
    one = spark.range(1)
    texts = [geometry.duration_text(F.lit(float(x))) for x in (29, 90, 150, 5399, 5400, 7200)]
    assert list(one.select(*texts).first()) == ["0 min", "2 min", "2 min", "90 min", "1.5 h", "2.0 h"]
    cases = [("clef", "tenor", True), ("clef", "soprano", False), ("key", "-7", True), ("key", "8", False), ("key", "-0", False), ("time", "C/", True), ("time", "3/", False), ("x", "C", False)]
    assert list(one.select(*[geometry.signature_valid(F.lit(k), F.lit(v)) for k, v, _ in cases]).first()) == [w for _, _, w in cases]
    assert one.select(geometry.margin(F.lit(None).cast("double"), F.lit(1.0)), geometry.margin(F.lit(None).cast("double"), F.lit(None).cast("double"))).first()[:] == (1.0, 2.5)
    assert one.select(geometry.content_key(F.lit("a"), F.lit("b"))).first()[0] == hashlib.sha1(b"a|b").hexdigest()[:10]


def test_scores_are_strict_and_not_one_to_one(spark):
    a = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 9.0)], "t_id int, t double").withColumn("k", F.lit(1))
    b = spark.createDataFrame([(7, 0.5), (8, 2.0)], "f_id int, f double").withColumn("k", F.lit(1))
    assert rows(matching.found_missed_extra(a, b, ["k"], "t", "f", "t_id", "f_id", 1.0)) == [(1, 3, 2, 1, 1)]


def test_suppression_and_first_fit(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 0.5, 9.0), (3, 1.2, 8.0), (4, 3.0, 1.0)], "i int, x double, s double").withColumn("k", F.lit(1))
    assert sorted(r.i for r in matching.suppressed(df, ["k"], "i", "x", "s", 1.0).collect()) == [2, 4]
    t = spark.createDataFrame([(1, 0.0, 1.0), (2, 0.1, 1.1)], "a int, lo double, hi double").withColumn("k", F.lit(1))
    f = spark.createDataFrame([(5, 0.05, 1.05), (6, 4.0, 5.0)], "b int, flo double, fhi double").withColumn("k", F.lit(1))
    assert rows(matching.first_fit(t, f, ["k"], ["a", "lo", "hi"], ["b", "flo", "fhi"], 0.2).select("a", F.coalesce("b", F.lit(-1)))) == [(1, 5), (2, -1)]


@pytest.mark.parametrize(("a", "b", "want"), [("abcd", "axc", 2), ("", "abc", 3), ("abc", "", 3), ("", "", 0), ("kitten", "sitting", 3)])
def test_edit_distance(spark, a, b, want):
    df = spark.createDataFrame([(list(a), list(b))], "a array<string>, b array<string>")
    assert df.select(alignment.edit_distance(F.col("a"), F.col("b"))).first()[0] == want


def test_alignment_path(spark):
    seq = lambda t: spark.createDataFrame([(1, i, c) for i, c in enumerate(t)], "k int, i long, w string")
    got = alignment.align_sequences(seq("abcd"), seq("acde"), ["k"], "i", "w").collect()
    assert [(r.op, r.l, r.r) for r in got] == [("one", 0, 0), ("extra", 1, None), ("one", 2, 1), ("one", 3, 2), ("missed", None, 3)]


def test_runs_and_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "a"), (5, "b")], "i int, v string").withColumn("k", F.lit(1))
    assert [r.i for r in numbering.changes(df, ["k"], ["i"], "v").orderBy("i").collect()] == [1, 5]
    nums = spark.createDataFrame([(x,) for x in (1, 2, 3, 7, 9, 10)], "n long").withColumn("k", F.lit(1))
    assert numbering.compact_runs(nums, ["k"], "n").first().spans == "1-3,7,9-10"
    assert numbering.run_length_text(df.where("v is not null"), ["k"], ["i"], "v").first().text == "a*3 b"


def test_geometry(spark):
    df = spark.createDataFrame([([0.0, 0.2, 0.0], 0.0, 1.0)], "b array<double>, l double, r double")
    at = lambda x: geometry.bend_at(F.col("b"), F.col("l"), F.col("r"), F.lit(x))
    got = df.select(at(-1.0), at(0.25), at(0.5), at(2.0), geometry.number_list(F.lit("8-6,3,6-8")), geometry.diatonic(F.lit("D4")), geometry.written_time(F.lit(4), F.lit(4), F.lit(False))).first()
    assert [round(x, 9) for x in got[:4]] == [0.0, 0.1, 0.2, 0.0] and list(got[4:]) == [[3, 6, 7, 8], 29, "C"]
    quad = df.select(geometry.bar_quad((F.lit(0.1), F.lit(0.2)), (F.lit(0.5), F.lit(0.5)), F.lit(0.4), F.lit(0.8), F.lit(1.0), F.lit(9.0))).first()[0]
    assert [[round(v, 9) for v in c] for c in quad] == [[0.075, 0.3], [0.5, 0.3], [0.5, 1.0], [0.425, 1.0]]


def test_sweep_and_reasons(spark):
    df = spark.createDataFrame([(0.1, False), (0.4, True), (0.6, False), (0.8, True)], "s double, y boolean")
    swept = evaluation.sweep(df, "s", "y", [0.2, 0.5, 0.7])
    assert rows(swept.select("threshold", "found", "false", "missed")) == [(0.2, 2, 1, 0), (0.5, 1, 1, 1), (0.7, 1, 0, 1)]
    assert evaluation.best_f1(swept).first().threshold == 0.2 and evaluation.fewest_errors(swept).first().threshold == 0.2


PAGE = {"status": "reviewed", "kind": "music", "part": "va", "clef": "alto"}
STAFF = {"id": "s1", "top": 0.2, "bottom": 0.3, "left": 0, "right": 1, "barlines": [{"id": "b1", "x0": 0.1, "x1": 0.1, "kind": "single"}]}
MARK = {"id": "m1", "x": 0.1, "y": 0.1, "w": 0.1, "h": 0.1, "kind": "text"}


def sound():
    return json.loads(json.dumps({"schema": 5, "source": {}, "pages": {"1": {**PAGE, "systems": [STAFF], "marks": [MARK]}}}))


def broken(path, value):
    doc = sound()
    at = doc
    for k in path[:-1]:
        at = at[k]
    if value is KeyError:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return doc


P, S, B, M = ["pages", "1"], ["pages", "1", "systems", 0], ["pages", "1", "systems", 0, "barlines", 0], ["pages", "1", "marks", 0]
BROKEN = [
    (sound(), []), ([1], ["document is not an object"]), (broken(["schema"], 4), ["schema must be 5"]), (broken(["source"], "x"), ["source must be an object"]),
    (broken(["pages"], []), ["pages must be an object"]), (broken(["pages", "0"], PAGE), ["page 0: page keys are page numbers from 1"]), (broken(["pages", "2"], 3), ["page 2: not an object"]),
    (broken([*P, "status"], "odd"), ["page 1: bad status"]), (broken([*P, "kind"], KeyError), ["page 1: bad kind"]), (broken([*P, "part"], "vn3"), ["page 1: bad part"]),
    (broken([*P, "part"], None), []), (broken([*P, "clef"], "soprano"), ["page 1: bad clef"]), (broken([*P, "corners"], {"points": [[0, 0], [1, 0], [1, 1]]}), ["page 1: corners.points must be 4 [x, y] pairs"]),
    (broken([*P, "corners"], {"points": [[0, 0], [1, 0], [1, 1], [0, True]]}), ["page 1: corners.points must be 4 [x, y] pairs"]), (broken([*P, "rejected_staves"], ["x"]), ["page 1: rejected_staves must be a list of numbers"]),
    (broken([*S, "top"], True), ["page 1 system s1: top must be a number"]), (broken([*S, "bend"], [0.1]), ["page 1 system s1: bend must be a list of numbers"]), (broken([*S, "bend"], None), []),
    (broken([*S, "above"], None), ["page 1 system s1: above must be a number"]), (broken([*S, "runs_on"], 1), ["page 1 system s1: runs_on must be true or false"]), (broken([*S, "role"], "solo"), ["page 1 system s1: bad role"]),
    (broken([*S, "key"], 8), ["page 1 system s1: bad key"]), (broken([*S, "key"], True), ["page 1 system s1: bad key"]), (broken([*S, "time"], "C|"), ["page 1 system s1: bad time"]), (broken([*S, "clef"], "bass"), []),
    (broken([*B, "x1"], "0.2"), ["page 1 system s1 barline b1: x0 and x1 must be numbers"]), (broken([*B, "kind"], "thick"), ["page 1 system s1 barline b1: bad kind"]),
    (broken([*B, "bar_count"], -1), ["page 1 system s1 barline b1: bar_count must be a whole number >= 0"]), (broken([*B, "bar_count"], 1.5), ["page 1 system s1 barline b1: bar_count must be a whole number >= 0"]),
    (broken([*B, "id"], "s1"), ["page 1 system s1 barline s1: duplicate id s1"]), (broken([*M, "id"], "b1"), ["page 1 mark b1: duplicate id b1"]), (broken([*M, "id"], KeyError), ["page 1 mark None: missing id"]),
    (broken([*M, "w"], None), ["page 1 mark m1: x, y, w, h must be numbers"]), (broken([*M, "kind"], "clef"), ["page 1 mark m1: bad kind"]), (broken([*M, "text_auto"], "no"), ["page 1 mark m1: text_auto must be true or false"]),
    (broken([*M, "kind"], "signature"), ["page 1 mark m1: a signature mark needs a clef, key or time"]), (broken(M, {**MARK, "kind": "signature", "key": -8}), ["page 1 mark m1: bad key"]),
]


def test_every_rule_of_validation(spark):
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, (d, _) in enumerate(BROKEN)] + [(900, "{"), (901, None)], "i int, raw string")
    got = {r.i: r.problems for r in documents.problems(docs, ["i"]).collect()}
    assert got == {**{i: w for i, (_, w) in enumerate(BROKEN)}, 900: ["document is not an object"], 901: ["document is not an object"]}
    assert documents.problems(docs.limit(0), ["i"]).count() == 0


ODD = [
    (broken([*P, "systems"], {"id": "s1"}), []), (broken([*P, "marks"], 3), []), (broken([*P, "systems"], None), []), (broken(["schema"], 5.0), []), (broken(["schema"], "5"), ["schema must be 5"]),
    (broken([*P, "systems"], [STAFF, 3, {**STAFF, "id": "s2", "barlines": {"id": "b1"}}]), [f"page 1 system None: {t}" for t in (*(f"{f} must be a number" for f in ("bottom", "left")), "missing id", *(f"{f} must be a number" for f in ("right", "top")))]),
    (broken([*S, "barlines"], [None]), [f"page 1 system s1 barline None: {t}" for t in ("bad kind", "missing id", "x0 and x1 must be numbers")]),
    (broken([*P, "status"], "sauto"), ["page 1: bad status"]), (broken([*P, "part"], "ns"), ["page 1: bad part"]), (broken([*P, "clef"], "null"), ["page 1: bad clef"]),
    (broken([*S, "id"], 's"1\\": null, "é\n'), []), (broken([*S, "id"], ""), ["page 1 system : missing id"]), (broken([*B, "id"], 7), ["page 1 system s1 barline 7: missing id"]),
    (broken([*M, "id"], {"b": "x", "a": None}), ['page 1 mark {"a":null,"b":"x"}: missing id']), (broken([*S, "runs_on"], "true"), ["page 1 system s1: runs_on must be true or false"]),
    (broken([*S, "top"], -0.5), []), (broken([*S, "top"], "0.5"), ["page 1 system s1: top must be a number"]), (broken([*S, "rejected"], []), []), (broken([*S, "rejected"], [1, None]), ["page 1 system s1: rejected must be a list of numbers"]),
    (broken([*S, "bar_count"], "odd"), []), (broken([*S, "key"], 1.0), ["page 1 system s1: bad key"]), (broken([*B, "bar_count"], 2.0), ["page 1 system s1 barline b1: bar_count must be a whole number >= 0"]), (broken([*P, "corners"], [[0, 0]] * 4), ["page 1: corners.points must be 4 [x, y] pairs"]), (broken([*P, "corners"], {"points": [[0, -1], [1, 0.5], [1e3, 1], [0, 1]]}), []),
]


def test_validation_of_odd_values_in_one_pass(spark, monkeypatch):
    docs = [(i, json.dumps(d)) for i, (d, _) in enumerate(ODD)] + [(900, ' {"schema": 5, "schema": 5, "source": {}, "pages": {}}'), (901, '\n{"schema": 5, "source": {}, "pages": {}} '), (902, "{'schema': 5}")]
    docs.append((903, json.dumps(sound()).replace('"top": 0.2', '"top": 1e999').replace('"marks"', '"m\\u0061rks"').replace('"text"', '"tex"')))
    monkeypatch.setattr(documents, "cut_lineage", None)  # nothing is written and read back on the way
    got = {r.i: r.problems for r in documents.problems(spark.createDataFrame(docs, "i int, raw string"), ["i"]).collect()}
    bad = ["document is not an object"]
    assert got == {**{i: w for i, (_, w) in enumerate(ODD)}, 900: bad, 901: [], 902: bad, 903: ["page 1 mark m1: bad kind"]}


def test_documents_migrate_and_refuse(spark, tmp_path):
    page = {**PAGE, "marks": [{**MARK, "kind": "clef"}]}
    for name, doc in {"old": {"schema": 2, "pages": {"1": page, "x": {"status": "odd", "kind": "music"}}}, "new": {"schema": 9, "pages": {}}, "none": {"pages": {}}, "zero": {"schema": 0, "pages": {}}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    docs = documents.read_labels(spark, str(tmp_path))
    current, refused = documents.migrated(docs)
    assert refused.count() == 3 and current.first().doc.pages["1"].marks[0].kind == "signature" and current.first().doc.schema == 5
    assert rows(documents.pages(current, []).select("page").where("page is not null")) == [(1,)]


def test_activity_log_rejects_and_reads(spark, tmp_path):
    path = str(tmp_path / "log")
    good = spark.createDataFrame([(1.7e9, "edit"), (1.7e9 + 5, "view")], "t double, kind string")
    documents.append_activity(good, path)
    for bad in ([(3.0, "edit")], [(1.7e9, None)]):
        with pytest.raises(ValueError):
            documents.append_activity(spark.createDataFrame(bad, "t double, kind string"), path)
    assert documents.read_activity(spark, path, since=1.7e9 + 1).count() == 1


def test_versions_refuse_a_stale_writer(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    documents.write_version(df, str(tmp_path / "v"), None, "e1")
    with pytest.raises(RuntimeError):
        documents.write_version(df, str(tmp_path / "v"), None, "e2")
    documents.write_version(df.selectExpr("a + 1 as a"), str(tmp_path / "v"), "e1", "e2")
    etag, folder = documents.current_version(spark, str(tmp_path / "v"))
    assert etag == "e2" and spark.read.parquet(folder).first().a == 2
    (tmp_path / "v" / "log" / "00000003").write_text("")  # a writer just ahead
    with pytest.raises(RuntimeError):
        documents.write_version(df, str(tmp_path / "v"), "e2", "e3")
    assert len(list((tmp_path / "v").glob("version=*"))) == 2


def test_saves_are_judged_backed_up_and_rounded(spark):
    doc = lambda schema, top="0.1": f'{{"schema":{schema},"source":{{"pdf":"1.23456e0"}},"pages":{{"1":{{"status":"edited","kind":"blank","part":null,"corners":{{"points":[[{top},0.00001],[1.5e-1,1],[1.0,2.34565],[0,0]],"auto":true}}}}}}}}'
    etag = lambda x: hashlib.sha1(x.encode()).hexdigest()
    old = {"a": doc(5), "b": doc(5), "c": doc(9), "d": doc(5)}
    current = spark.createDataFrame(list(old.items()), "file string, raw string")
    backups = spark.createDataFrame([("a", 1000.0, "x"), ("b", 10.0, "y"), *(("b", float(-k), "z") for k in range(100))], "file string, at double, raw string")
    sent = [("a", doc(5, "0.12346"), etag(old["a"])), ("b", doc(3, "0.7"), etag(old["b"])), ("c", doc(5), etag(old["c"])), ("d", doc(5), "stale"), ("e", doc(2), "none"), ("f", doc(8), "none"), ("g", doc(5).replace("blank", "cover"), "none"), ("h", "no document", "none")]
    after, copies, told = documents.saved(current, backups, spark.createDataFrame(sent, "file string, raw string, if_match string"), 1050)
    outcome = {r.file: r for r in told.collect()}
    assert {f: r.outcome for f, r in outcome.items()} == {"a": "saved", "b": "saved", "c": "newer", "d": "conflict", "e": "saved", "f": "invalid", "g": "invalid", "h": "invalid"}
    now = {r.file: r.raw for r in after.collect()}
    assert set(now) == {*"abcde"} and now["c"] == old["c"] and now["d"] == old["d"] and all(outcome[f].etag == etag(now[f]) for f in "abcde")
    page = json.loads(now["a"])
    assert page["pages"]["1"]["corners"]["points"] == [[0.1235, 0.0], [0.15, 1.0], [1.0, 2.3457], [0.0, 0.0]] and page["source"]["pdf"] == "1.23456e0" and json.loads(now["b"])["schema"] == 5
    kept = sorted((r.file, r.at, r.raw) for r in copies.collect())
    assert [k for k in kept if k[0] == "a"] == [("a", 1000.0, "x")] and kept[-1] == ("b", 1050.0, old["b"]) and len(kept) == 101 and ("b", -98.0, "z") not in kept


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").coalesce(1)
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = sessions.sessions(stream, "user_id", "ts").writeStream.format("memory").queryName("got").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("got")) == rows(sessions.sessions(src, "user_id", "ts"))


def test_migration_is_one_pass(spark):
    df = spark.createDataFrame([(1, '{"schema": 2, "pages": {"1": {"marks": [{"kind": "clef"}]}}}'), (2, '{"schema": 6, "pages": {}}'), (3, "{}"), (4, None)], "k int, raw string")
    both = documents.lifted(df.withColumn("doc", F.from_json("raw", documents.DOCUMENT)))
    got = {r.k: (r.known, r.doc and r.doc.schema, [m.kind for p in (r.doc and r.doc.pages or {}).values() for m in p.marks]) for r in both.collect()}
    assert got == {1: (True, documents.SCHEMA, ["signature"]), 2: (False, 6, []), 3: (False, None, []), 4: (False, None, [])}
