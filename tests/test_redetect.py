"""A new detection merged into pages, against a plain loop."""

from __future__ import annotations

import random

from marginalia import session
from marginalia.operators import redetect
from marginalia.plans import notation_queries

SHAPE = "struct<left:double,bend:array<double>>"


def loop(staves, lines, found, no_staves, no_lines):
    """One page: staves as (id, top, bottom, auto, shape), lines by staff as (line, mid, auto), found as (n, top, bottom, shape, mids)."""
    used, out, drawn = {}, {}, {s[0]: list(lines.get(s[0], [])) for s in staves}
    at = {s[0]: s for s in staves}
    for n, top, bottom, shape, mids in found:
        over = next((s for s in staves if s[0] not in used and min(s[2], bottom) - max(s[1], top) > 0.5 * min(s[2] - s[1], bottom - top)), None)
        if over is None:
            if not any(top < y < bottom for y in no_staves):
                out["new", n] = (top, bottom, shape, [(m, x) for m, x in enumerate(mids)])
            continue
        i, _, _, auto, own = over
        used[i] = n
        if auto:
            at[i] = (i, top, bottom, auto, shape)
        elif own[1] is None and shape[1] is not None:
            at[i] = (*at[i][:4], (own[0], shape[1]))
        kept = [x for x in drawn[i] if not x[2]]
        taken = [x[1] for x in kept] + no_lines.get(i, [])
        drawn[i] = kept + [(("m", m), x, True) for m, x in enumerate(mids) if not any(abs(t - x) < 0.008 for t in taken)]
    for i, top, bottom, auto, shape in at.values():
        if i in used or not auto or any(not x[2] for x in drawn[i]):
            out[i] = (top, bottom, shape, sorted(drawn[i], key=repr))
    return out


def test_redetected_pages_equal_a_plain_loop(spark):
    rng = random.Random(5)
    tables: list[list] = [[], [], [], [], [], []]
    want = {}
    place = lambda: round(rng.randrange(0, 95) / 100, 2)
    for p in range(60):
        staves, lines, found, no_lines = [], {}, [], {}
        for i in range(rng.randrange(6)):
            top = place()
            staves.append((100 + i, top, round(top + rng.choice([0.04, 0.05, 0.1]), 2), rng.random() < 0.6, (0.1, rng.choice([None, [0.0, 0.1]]))))
            lines[100 + i] = [(k, place(), rng.random() < 0.7) for k in range(rng.randrange(4))]
            no_lines[100 + i] = [place() for _ in range(rng.randrange(2))]
        for n in range(rng.randrange(6)):
            top = place()
            found.append((n, top, round(top + rng.choice([0.04, 0.06, 0.1]), 2), (0.2, rng.choice([None, [0.5, 0.6]])), [place() for _ in range(rng.randrange(4))]))
        no_staves = [place() + 0.005 for _ in range(rng.randrange(3))]
        want[p] = loop(staves, lines, found, no_staves, no_lines)
        tables[0] += [(p, i, k, top, bottom, auto, shape) for k, (i, top, bottom, auto, shape) in enumerate(staves)]
        tables[1] += [(p, i, k, x, auto) for i, own in lines.items() for k, x, auto in own]
        tables[2] += [(p, n, top, bottom, shape) for n, top, bottom, shape, _ in found]
        tables[3] += [(p, n, m, x) for n, *_, mids in found for m, x in enumerate(mids)]
        tables[4] += [(p, y) for y in no_staves]
        tables[5] += [(p, i, x) for i, xs in no_lines.items() for x in xs]
    schemas = [
        f"p int, id int, place int, top double, bottom double, auto boolean, shape {SHAPE}", "p int, id int, line int, mid double, auto boolean",
        f"p int, n int, top double, bottom double, shape {SHAPE}", "p int, n int, m int, mid double", "p int, y double", "p int, id int, x double",
    ]
    frames = [spark.createDataFrame(t, s) for t, s in zip(tables, schemas, strict=True)]
    staves, lines = redetect.redetected(*frames, ["p"])
    got: dict = {p: {} for p in want}
    for r in staves.collect():
        got[r.p]["new", r.n] = got[r.p].pop(("new", r.n), None)
        del got[r.p]["new", r.n]
        got[r.p][("new", r.n) if r.is_new else r.id] = (r.top, r.bottom, (r.shape.left, r.shape.bend), [])
    for r in lines.collect():
        at = got[r.p][r.id if r.id is not None else ("new", r.n)]
        at[3].append((r.m, r.mid) if r.id is None else (r.line if r.line is not None else ("m", r.m), r.mid, r.auto))
    for own in got.values():
        for x in own.values():
            x[3].sort(key=repr)
    assert got == want
    empty = redetect.redetected(*[f.limit(0) for f in frames], ["p"])
    assert [x.count() for x in empty] == [0, 0]


def test_merged_pages_are_dealt_out_once(spark, monkeypatch):
    plans = {}

    def seen(df, tag="table"):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return session.cut_lineage(df, tag)

    held = {n: spark.conf.get(n, None) for n in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for module in (notation_queries, redetect):
        monkeypatch.setattr(module, "cut_lineage", seen)
    merged = notation_queries.overlap_merge(spark, "/root/testdata/sf0.001")
    assert {n: spark.conf.get(n, None) for n in held} == held and not spark.catalog.listTables()
    assert not merged.isEmpty()
    # Only what was written on the way is shuffled again, and what two joins bring together (lines of both origins, what blocks them).
    shuffled = {tag: plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") for tag, plan in plans.items()}
    assert shuffled["staves"] <= 4 and shuffled["merged"] <= 8
    assert "BroadcastExchange" not in plans["staves"] + plans["merged"]


def test_tables_dealt_out_join_where_they_are(spark):
    table = session.cut_dealt(spark.range(200).selectExpr("id % 7 AS k", "id AS i", "id % 3 AS v"), ["k"])
    with session.dealt_joins(spark):
        both = table.where("v > 0").select("k", "i").join(table.select("k", "i", "v"), ["k", "i"])
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.i for r in both.collect()) == [i for i in range(200) if i % 3]
    assert table.count() == 200
