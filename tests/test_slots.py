"""Movements bar by bar, and structure texts read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import slots

BAR = "m string, part string, order int, bar int, count int, kind string, opens_line boolean"


def bars(spark, **parts):
    rows = []
    for part, own in parts.items():
        rows += [("I", part, i, *b) for i, b in enumerate(own)]
    return spark.createDataFrame(rows, BAR)


def said(df, part="va"):
    return [tuple(r) for r in df.where(F.col("part") == part).orderBy("slot").select("number", "upbeat", "end", "start").collect()]


def test_shapes_and_where_parts_differ(spark):
    a = [(0, 0, "single", True), (1, 1, "repeat_start", False), (2, 3, "repeat_end", False), (4, 0, "repeat_start", True), (5, 1, "single", False), (6, 1, "single", False), (6, 0, "repeat_both", True), (7, 1, "final", False)]
    b = [(0, 0, "single", True), (1, 1, "repeat_start", False), (2, 1, "single", False), (3, 2, "repeat_both", False), (5, 1, "single", False), (6, 1, "repeat_start", False), (7, 1, "final", True)]
    got = slots.shape(bars(spark, va=a, vc=b), ["m", "part"])
    want = [(0, True, False, False), (1, False, False, True), (2, False, False, False), (3, False, False, False), (4, False, True, False), (5, False, False, False), (6, False, False, True), (7, False, False, False)]
    assert said(got) == want == said(got, "vc") and slots.disagreements(got, ["m"]).count() == 0
    c = slots.shape(bars(spark, va=a, vc=[*b[:4], (5, 1, "repeat_end", False), *b[5:]], vn1=b[:-1]), ["m", "part"])
    off = slots.disagreements(c, ["m"]).first()
    assert (off.slot, [tuple(p) for p in off.parts]) == (5, [("va", "5:false:false:false"), ("vc", "5:false:true:false"), ("vn1", "5:false:false:false")])
    short = slots.disagreements(slots.shape(bars(spark, va=b, vc=b[:-1]), ["m", "part"]), ["m"]).first()
    assert short.slot == 7 and [p.part for p in short.parts] == ["va"]


def test_changes_of_all_parts_and_their_conflicts(spark):
    rows = [("I", "vc", 1, False, "key", "2"), ("I", "vn1", 1, False, "key", "3"), ("I", "va", 1, False, "key", "3"), ("I", "vc", 4, True, "time", "C"), ("I", "score", 9, False, "key", "1"), ("I", "va", 5, False, "key", None)]
    values, conflicts = slots.merged_changes(spark.createDataFrame(rows, "m string, part string, number int, upbeat boolean, field string, value string"), ["m"])
    assert sorted(tuple(r) for r in values.collect()) == [("I", 1, False, "key", "3"), ("I", 4, True, "time", "C")]
    assert [tuple(r) for r in conflicts.collect()] == [("I", 1, False, "key", "vn1", "3", "vc", "2")]


def test_a_text_is_read_back_against_the_labels(spark):
    rows = [(0, True, False, False), (1, False, False, False), (2, False, True, False), (2, True, False, False), (3, False, False, False), (4, False, True, False)]
    shapes = spark.createDataFrame([("I", i, *r) for i, r in enumerate(rows)], "movement string, slot int, number int, upbeat boolean, end boolean, start boolean")
    values = [("I", 0, True, "key", "2"), ("I", 0, True, "time", "3/4"), ("I", 2, False, "key", "2"), ("I", 2, True, "key", "-1"), ("I", 3, False, "time", "3/4"), ("I", 3, False, "key", "-1")]
    heads = [("I", 0, True, "tempo", "Allegro", 2), ("I", 0, True, "tempo", "Andante", 1), ("I", 2, True, "title", "Trio", 1), ("I", 3, False, "tempo", "", 1)]
    full = slots.slots(shapes, spark.createDataFrame(values, "movement string, number int, upbeat boolean, field string, value string"), spark.createDataFrame(heads, "movement string, number int, upbeat boolean, kind string, text string, place int"), ["movement"])
    assert [(r.tempo, r.title) for r in full.orderBy("slot").collect()] == [("Andante", None), (None, None), (None, None), (None, "Trio"), (None, None), (None, None)]
    want = slots.expected_of(full.withColumn("f", F.lit("f")), ["f", "movement"])
    r = want.first()
    assert (r.total, r.pickup, r.repeat_ends, r.key, r.time, [tuple(c) for c in r.changes]) == (4, True, [2, 4], "2", "3/4", [(2, "key", "-1")])
    good = r"\tag #'mvtI { \time 3/4 \key d \major \repeat volta 2 { \partial 4 s4 s2. s2 } \key f \major \repeat volta 2 { s4 s2. s2 } }"
    texts = lambda *t: spark.createDataFrame([("f", x) for x in t], "f string, text string")
    problems = lambda t: slots.read_back(texts(t), want, ["f"]).first().problems
    # The second half of bar 2 completes it, so the last bar is short and the text has four bars.
    assert problems(good) == []
    assert problems(good.replace("s4 s2. s2 } }", "s4 s2.*2 s2 } }").replace("d \\major", "a \\major"))[0].startswith("total: the block gives 5, the labels 4")
    assert len(problems(good.replace("s4 s2. s2 } }", "s4 s2.*2 s2 } }").replace("d \\major", "a \\major"))) == 3
    assert problems("nothing") == ["the block doesn't parse"]


def test_templates_and_offers(spark):
    text = r"""\tag #'mvtI { \time 3/4 \key c \major \tempo "Allegro { s4" s2.*1 \repeat volta 2 { s2. * 1 } \bar "|." } % \tag #'mvtIV { s1 }
      \tag #'mvtII { \time 3/4 s2.*12 } \tag #'mvtIII { \once \override Score.Mark = #'x \mark \markup { s } s1*1 }"""
    df = spark.createDataFrame([(text, m) for m in ("I", "II", "III", "IV")], "t string, m string")
    assert [r.x for r in df.select(slots.is_template(F.col("t"), F.col("m")).alias("x")).collect()] == [True, False, False, True]
    parts = [("f", p, m, not (p == "va" and m == "III")) for p in slots.PARTS for m in ("I", "II", "III", "IV")] + [("g", p, "I", True) for p in slots.PARTS]
    complete = spark.createDataFrame(parts, "f string, part string, movement string, complete boolean")
    texts = spark.createDataFrame([("f", text), ("g", None)], "f string, text string")
    assert sorted(tuple(r) for r in slots.offered(complete, texts, ["f"]).collect()) == [("f", "I"), ("f", "IV")]
