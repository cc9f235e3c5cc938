"""Reports on the activity log, on literal logs."""

from __future__ import annotations

from marginalia.operators import reports
from marginalia.sources import documents

LOG = "event_id int, file string, src string, kind string, where string, what string, n int, by string, seconds double, t double, t_end double"


def log(spark, *events):
    rows = [(i, "f", e.get("src", "labeler"), e["kind"], e.get("where"), e.get("what"), e.get("n"), e.get("by"), e.get("seconds"), float(e.get("t", i)), float(e.get("t_end", e.get("t", i)))) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, LOG)


def test_the_eight_counters(spark):
    events = log(
        spark, {"kind": "edit", "what": "bar line, , staff (detected)", "n": 2}, {"kind": "edit", "what": "bar line"}, {"kind": "undo", "what": "bar line"}, {"kind": "redo", "what": "bar line"},
        {"kind": "auto", "what": "staff", "by": "detect"}, {"kind": "auto", "what": "staff"}, {"kind": "command", "what": "a, b"}, {"kind": "key", "what": "Tab", "n": 3}, {"kind": "open"},
        {"kind": "detect", "src": "labeler-server", "seconds": 1.5}, {"kind": "detect", "src": "labeler-server", "seconds": 0.25}, {"kind": "detect-ahead", "src": "labeler-server"},
    )
    got = {(r.counter, r.what): (r.n, r.seconds) for r in reports.tallies(events, ["file"]).collect()}
    assert got == {
        ("edits", "bar line"): (3, None), ("corrections", "staff (detected)"): (2, None), ("undone", "undo: bar line"): (1, None), ("undone", "redo: bar line"): (1, None),
        ("machine", "detect: staff"): (1, None), ("machine", "?: staff"): (1, None), ("commands", "a, b"): (1, None), ("keys", "Tab"): (3, None), ("waits", "detect"): (2, 1.75), ("background", "detect-ahead"): (1, 0.0),
    }
    top = reports.top_tallies(reports.tallies(events, ["file"]), ["file"], 1).where("counter = 'undone'").collect()
    assert [r.what for r in top] == ["redo: bar line"]


def test_time_is_split_at_the_review_that_stands(spark):
    events = log(
        spark, {"kind": "open", "where": "p1", "t": 0}, {"kind": "edit", "where": "p1", "what": "status reviewed", "t": 100}, {"kind": "undo", "where": "p1", "what": "status reviewed", "t": 150},
        {"kind": "edit", "where": "p1", "what": "note, staff (detected)", "t": 200, "n": 2}, {"kind": "redo", "where": "p1", "what": "status reviewed", "t": 300}, {"kind": "edit", "where": "p2", "what": "x", "t": 400},
        {"kind": "pause", "where": "p2", "t": 420}, {"kind": "detect", "src": "labeler-server", "where": "p9", "t": 425, "t_end": 500},
    )
    doc = '{"schema": 5, "source": {}, "pages": {"1": {"status": "reviewed", "kind": "music", "part": "va", "systems": [{"id": "s", "barlines": [{"id": "a", "bar_count": 3}, {"id": "b"}]}]}, "2": {"status": "auto", "kind": "title"}}}'
    pages = documents.pages(spark.createDataFrame([("f", doc)], "file string, raw string").selectExpr("file", f"from_json(raw, '{documents.DOCUMENT}') as doc"), ["file"])
    report = reports.page_report(events, pages, ["file"])
    got = {r["where"]: (r.seconds, r.first_pass, r.review, r.edits, r.corrections, r.opened, r.bars, r.status, r.reviewed_at) for r in report.collect()}
    assert got == {"p1": (400.0, 300.0, 100.0, 3, 2, 1, 4, "reviewed", 300.0), "p2": (20.0, 20.0, 0.0, 1, 0, 0, 0, "auto", None)}
    total = reports.by_source(report, ["file"]).first()
    assert (total.seconds, total.pages, total.bars, total.edits, round(total.per_100_bars, 6)) == (420.0, 2, 4, 4, round(420 / 60 / 4 * 100, 6))
    assert [(str(r.day), r.seconds) for r in reports.days(events, ["file"]).collect()] == [("1970-01-01", 420.0)]


def test_a_source_and_its_stretches(spark):
    events = log(
        spark, {"kind": "open", "where": "p1", "t": 0}, {"kind": "edit", "where": "p1", "what": "bar line (detected)", "t": 60}, {"kind": "edit", "where": "p1", "what": "status reviewed", "t": 120},
        {"kind": "open", "where": "p2", "t": 150}, {"kind": "pause", "where": "p2", "t": 200}, {"kind": "resume", "where": "p2", "t": 500}, {"kind": "key", "where": "p2", "t": 560},
        {"kind": "detect", "src": "labeler-server", "where": "p2", "t": 565, "t_end": 569}, {"kind": "read-ahead", "src": "labeler-server", "where": "p3", "t": 566, "t_end": 700},
        {"kind": "edit", "where": "p2", "what": "x", "n": 3, "t": 5000}, {"kind": "detect", "src": "labeler-server", "where": "p2", "t": 5070, "t_end": 5071},
    )
    doc = '{"schema": 5, "source": {}, "pages": {"1": {"kind": "music", "part": "va", "systems": [{"id": "s", "barlines": [{"id": "a"}, {"id": "b"}]}]}, "2": {"status": "reviewed", "kind": "music", "systems": [{"id": "t", "barlines": [{"id": "c"}]}]}}}'
    docs = spark.createDataFrame([("f", doc), ("g", doc)], "file string, raw string").selectExpr("file", f"from_json(raw, '{documents.DOCUMENT}') as doc")
    pages = documents.pages(docs, ["file"])
    got = {r.file: tuple(r)[1:] for r in reports.source_report(events, pages, ["file"]).collect()}
    assert got == {"f": (320.0, 2, 3, 2, 2, 1, 0.0), "g": (0.0, 0, 3, 2, 2, 1, None)}
    ends, items = reports.timeline(events, ["file"])
    assert sorted((r.stretch, r.start, r.end) for r in ends.collect()) == [(1, 0.0, 569.0), (2, 5000.0, 5060.0)]
    told = sorted(tuple(r)[1:] for r in items.collect())
    assert [r[:5] for r in told if r[1] == "wait"] == [(1, "wait", 565.0, 569.0, "detect")]
    assert [(r[0], r[2], r[4], r[6], r[7]) for r in told if r[1] == "mark"] == [(1, 0.0, "open", None, 1), (1, 60.0, "edit", "bar line (detected)", 1), (1, 120.0, "edit", "status reviewed", 1), (1, 150.0, "open", None, 1), (2, 5000.0, "edit", "x", 3)]
    assert [(r[0], r[2], r[3], r[5]) for r in told if r[1] == "piece"] == [(1, 0.0, 60.0, "p1"), (1, 60.0, 120.0, "p1"), (1, 120.0, 150.0, "p1"), (1, 150.0, 200.0, "p2"), (1, 500.0, 560.0, "p2"), (2, 5000.0, 5060.0, "p2")]
    assert reports.timeline(events.limit(0), ["file"])[1].count() == 0


def test_reports_of_an_empty_log(spark):
    events = log(spark, {"kind": "open"}).limit(0)
    assert reports.tallies(events, ["file"]).count() == 0 and reports.reviewed_at(events, ["file"]).count() == 0 and reports.days(events, ["file"]).count() == 0
