"""Labels, logs and sources of several editions, on files in a folder."""

from __future__ import annotations

import json

from marginalia.sources import catalogue, documents


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def doc(*statuses):
    return json.dumps({"schema": 5, "source": {}, "pages": {str(i + 1): {"status": s, "kind": "music"} if s else {"kind": "music"} for i, s in enumerate(statuses)}})


def test_labels_and_logs_of_editions(spark, tmp_path):
    write(tmp_path / "data/op48/sources/G1/a.labels.json", doc("reviewed", "auto", "auto"))
    write(tmp_path / "data/op48/sources/b.labels.json", "no document")
    write(tmp_path / "data/op48/other/c.labels.json", doc("auto"))
    write(tmp_path / "data/op48/sources/b.bars.json", "{}")
    write(tmp_path / "data/op32/sources/d.labels.json", doc(None))
    found = catalogue.read_sources(spark, f"{tmp_path}/data", {"op48": "/x/op48", "op32": "/y/op32"})
    got = sorted((r.edition, r.pdf, r.doc is not None) for r in found.collect())
    assert [g[2] for g in got] == [True, True, False] and [g[:2] for g in got] == [("op32", "/y/op32/sources/d.pdf"), ("op48", "/x/op48/sources/G1/a.pdf"), ("op48", "/x/op48/sources/b.pdf")]
    states = {r.pdf: r.statuses for r in catalogue.page_statuses(found, "pdf").collect()}
    assert states == {"/y/op32/sources/d.pdf": {"?": 1}, "/x/op48/sources/G1/a.pdf": {"auto": 2, "reviewed": 1}, "/x/op48/sources/b.pdf": {"unreadable": 1}}
    write(tmp_path / "log48/2026-01.jsonl", '{"t": 1.7e9, "kind": "edit", "file": "G1/a.pdf"}\nbroken\n{"kind": "edit"}\n')
    write(tmp_path / "log32/2026-01.jsonl", '{"t": 1.7e9, "kind": "open", "file": "d.pdf", "seconds": 2.5}\n')
    logs = {"op48": f"{tmp_path}/log48", "op32": f"{tmp_path}/log32"}
    assert sorted((r.edition, r.kind, r.t_end - r.t) for r in catalogue.read_logs(spark, logs).collect()) == [("op32", "open", 2.5), ("op48", "edit", 0.0)]
    assert [r.edition for r in catalogue.read_logs(spark, logs, source="G1").collect()] == ["op48"]
    assert catalogue.read_logs(spark, logs, until=1.0e9).count() == 0


def test_manuscripts_of_an_archive(spark):
    meta = lambda **k: json.dumps(k)
    rows = [
        ("G1/s/a.pdf", meta(record_type="manuscript")), ("G1/s/a-vn1.pdf", meta(record_type="manuscript")), ("G2/t/b-vc.pdf", meta(medium="autograph")), ("G226/u/c.pdf", meta(record_type="manuscript")),
        ("G3/v/d.pdf", meta(record_type="manuscript", gerard_numbers=[226, 227])), ("G226/w/e.pdf", meta(record_type="manuscript", gerard_numbers=[226, 5])), ("G4/x/f.pdf", meta(record_type="print", medium="manuscript")),
        ("G5/y/g.pdf", None), ("G6/z/h.pdf", "broken"), ("none/z2/i.pdf", meta(record_type="", medium="manuscript")),
    ]
    df = spark.createDataFrame([(f"/arc/{p}", "/arc/" + p.rsplit("/", 1)[0], m) for p, m in rows], "pdf string, folder string, metadata string")
    got = sorted(r.pdf.rsplit("/", 1)[1] for r in catalogue.archive_manuscripts(df, list(range(226, 232)), "-(vn1|vn2|va|vc)$").collect())
    assert got == ["a.pdf", "b-vc.pdf", "e.pdf", "i.pdf"]
    pdfs = lambda *x: spark.createDataFrame([(p,) for p in x], "pdf string")
    states = spark.createDataFrame([("a", {"auto": 2})], "pdf string, statuses map<string,bigint>")
    out = catalogue.listed(pdfs("a", "b"), pdfs("c"), pdfs("b", "d"), states)
    assert sorted((r.pdf, r.group, r.is_paired, r.statuses) for r in out.collect()) == [("a", "edition", False, {"auto": 2}), ("b", "edition", True, {}), ("c", "archive", False, {}), ("d", "paired", True, {})]


def test_texts_that_marks_have(spark):
    mark = lambda i, text, kind=None, auto=None: {"id": str(i), "text": text, **({"kind": kind} if kind else {}), **({"text_auto": auto} if auto is not None else {})}
    pages = {"1": {"status": "edited", "marks": [mark(1, " Allegro ", "tempo"), mark(2, "p", "text"), mark(3, "Trio", "title", True), mark(4, "")]}, "2": {"status": "reviewed", "marks": [mark(5, "Allegro", "title"), mark(6, "Trio", "tempo", True), mark(7, "p", "dynamic"), mark(8, "p", "dynamic"), mark(9, "q")]}}
    df = spark.createDataFrame([("f", json.dumps({"schema": 5, "source": {}, "pages": pages}))], "file string, raw string").selectExpr("file", f"from_json(raw, '{documents.DOCUMENT}') as doc")
    got = {r.text: (r.n, r.kind, r.kinds) for r in catalogue.mark_texts(documents.pages(df, ["file"]), ["file", "page"]).collect()}
    assert got == {"Allegro": (2, "tempo", ["tempo", "title"]), "p": (3, "dynamic", ["dynamic", "text"]), "Trio": (1, "tempo", ["tempo"]), "q": (1, "text", ["text"])}
