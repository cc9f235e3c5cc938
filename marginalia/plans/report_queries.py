"""Registered queries of reports on the log, of proposals, and of sets chosen by cascades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars, proposals, reports, review, selection, tuning, twins, widths
from ..session import cut_lineage
from ..sources import documents
from .queries import SEGMENTS, US, log, query, read


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of pages p0 to p8: errors pause, views open, clicks edit, signups undo; purchases are the server's."""
    e = log(spark, sf_dir)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event_type"))
    n = F.col("event_id")
    server = F.col("event_type") == "purchase"
    reviewed = (F.col("event_type") == "signup") | (n % 11 == 0)
    return e.select(
        "event_id", "user_id", "t", "t_end", F.when(server, "labeler-server").otherwise("labeler").alias("src"), F.when(server & (F.col("value") > 40), "detect-ahead").otherwise(kind).alias("kind"),
        F.concat(F.lit("p"), (n % 9).cast("string")).alias("where"), F.when(reviewed, "status reviewed").when(n % 2 == 0, "bar line, staff (detected)").otherwise("bar line").alias("what"),
        F.when(n % 5 == 0, 2).alias("n"),
    )


#: Kinds of log events that the table's types stand for.
KINDS = {"error": "pause", "view": "open", "click": "edit", "signup": "undo", "purchase": "detect"}


def log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 1 to 8 of each user's document."""
    p = read(spark, sf_dir, "events").select("user_id").distinct().withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(8))))
    u = F.col("user_id") + F.col("page")
    line = lambda i: F.struct(F.when(i % 2 == 0, (i % 3).cast("int")).alias("bar_count"))
    systems = F.array(F.struct(F.transform(F.sequence(F.lit(0), (u % 4).cast("int")), line).alias("barlines")))
    return p.select("user_id", "page", F.when(u % 5 == 0, "reviewed").otherwise("edited").alias("status"), F.when(u % 3 > 0, "music").otherwise("title").alias("kind"), F.when(u % 2 == 0, "va").alias("part"), systems.alias("systems"))


PAGE_LOG = SEGMENTS.replace(
    "json_extract_string(props, '$.k') AS place FROM events", "'p' || event_id % 9 AS place FROM events WHERE event_type <> 'purchase'"
).replace("SELECT user_id, place, s, e FROM starts", "SELECT user_id, stretch, place, s, e FROM starts").replace("SELECT user_id, arg_max(place", "SELECT user_id, stretch, arg_max(place")
PAGE_SQL = f"""{PAGE_LOG},
w AS (SELECT *, CASE WHEN event_type = 'signup' OR event_id % 11 = 0 THEN 'status reviewed' WHEN event_id % 2 = 0 THEN 'bar line, staff (detected)' ELSE 'bar line' END AS what,
  CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS n FROM log),
cleared AS (SELECT user_id, place, max((t, event_id)) AS c FROM w WHERE event_type = 'signup' GROUP BY ALL),
review AS (SELECT w.user_id, w.place, min(t) AS reviewed_at FROM w LEFT JOIN cleared c ON c.user_id = w.user_id AND c.place = w.place
  WHERE event_type = 'click' AND what = 'status reviewed' AND (c IS NULL OR (t, event_id) > c) GROUP BY ALL),
spent AS (SELECT p.user_id, p.place, sum(e - s) AS seconds, sum(CASE WHEN s >= reviewed_at THEN 0 ELSE e - s END) AS first_pass, sum(CASE WHEN s >= reviewed_at THEN e - s ELSE 0 END) AS review
  FROM pieces p LEFT JOIN review r ON r.user_id = p.user_id AND r.place = p.place GROUP BY ALL),
done AS (SELECT user_id, place, sum(CASE WHEN event_type = 'click' THEN n ELSE 0 END) AS edits, sum(CASE WHEN event_type = 'click' AND what LIKE '%(detected)' THEN n ELSE 0 END) AS corrections,
  count(*) FILTER (event_type = 'view') AS opened FROM w GROUP BY ALL),
labels AS (SELECT user_id, 'p' || page AS place, page, user_id + page AS u, CASE WHEN u % 5 = 0 THEN 'reviewed' ELSE 'edited' END AS status, CASE WHEN u % 3 > 0 THEN 'music' ELSE 'title' END AS kind, CASE WHEN u % 2 = 0 THEN 'va' END AS part,
  CASE WHEN u % 3 > 0 THEN list_sum(list_transform(range(u % 4 + 1), lambda i: CASE WHEN i % 2 = 0 THEN i % 3 ELSE 1 END)) ELSE 0 END AS bars FROM (SELECT DISTINCT user_id FROM events), range(1, 9) r(page)),
page_rows AS (SELECT d.user_id, d.place, coalesce(seconds, 0) AS seconds, coalesce(first_pass, 0) AS first_pass, coalesce(review, 0) AS review, edits, corrections, opened, coalesce(bars, 0) AS bars, status, kind, part, reviewed_at
  FROM done d LEFT JOIN spent s ON s.user_id = d.user_id AND s.place = d.place LEFT JOIN labels l ON l.user_id = d.user_id AND l.place = d.place LEFT JOIN review r ON r.user_id = d.user_id AND r.place = d.place)"""
OPTIONS = {"gap": 600 * US, "least": 60 * US}


@query(f"""WITH {PAGE_SQL} SELECT user_id, place AS "where", CAST(substr(place, 2) AS INTEGER) AS page, CAST(seconds AS DOUBLE) AS seconds, CAST(first_pass AS DOUBLE) AS first_pass, CAST(review AS DOUBLE) AS review,
  CAST(edits AS BIGINT) AS edits, CAST(corrections AS BIGINT) AS corrections, opened, CAST(bars AS BIGINT) AS bars, status, kind, part, reviewed_at FROM page_rows""")
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.page_report(page_log(spark, sf_dir), log_pages(spark, sf_dir), ["user_id"], **OPTIONS)
    return out.select("user_id", "where", "page", *[F.col(c).cast("double").alias(c) for c in ("seconds", "first_pass", "review")], "edits", "corrections", "opened", F.col("bars").cast("long").alias("bars"), "status", "kind", "part", "reviewed_at")


@query(f"""WITH {PAGE_SQL} SELECT l.user_id, coalesce(s.micros, 0) AS seconds, coalesce(s.stretches, 0) AS stretches, l.bars, l.pages_total, l.music_pages, l.reviewed, f.first_logged
  FROM (SELECT user_id, CAST(sum(bars) AS BIGINT) AS bars, count(*) AS pages_total, count(*) FILTER (kind = 'music') AS music_pages, count(*) FILTER (status = 'reviewed') AS reviewed FROM labels GROUP BY user_id) l
  JOIN (SELECT user_id, epoch_us(min(ts)) AS first_logged FROM events GROUP BY user_id) f ON f.user_id = l.user_id
  LEFT JOIN (SELECT user_id, CAST(sum(e - s) AS BIGINT) AS micros, count(DISTINCT stretch) AS stretches FROM pieces GROUP BY user_id) s ON s.user_id = l.user_id""")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.source_report(page_log(spark, sf_dir), log_pages(spark, sf_dir), ["user_id"], **OPTIONS)
    return out.select("user_id", *[F.col(c).cast("long").alias(c) for c in ("seconds", "stretches", "bars", "pages_total", "music_pages", "reviewed", "first_logged")])


@query(f"""WITH {PAGE_SQL} SELECT user_id, CAST(sum(seconds) AS BIGINT) AS seconds, count(*) FILTER (seconds > 0) AS pages, CAST(sum(CASE WHEN seconds > 0 THEN bars ELSE 0 END) AS BIGINT) AS bars, CAST(sum(edits) AS BIGINT) AS edits,
  round(CASE WHEN sum(CASE WHEN seconds > 0 THEN bars ELSE 0 END) > 0 THEN sum(seconds) / 60 / sum(CASE WHEN seconds > 0 THEN bars ELSE 0 END) * 100 / 1000000 END, 6) AS per_100_bars FROM page_rows GROUP BY user_id""")
def whole_log_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.by_source(reports.page_report(page_log(spark, sf_dir), log_pages(spark, sf_dir), ["user_id"], **OPTIONS), ["user_id"])
    return out.select("user_id", *[F.col(c).cast("long").alias(c) for c in ("seconds", "pages", "bars", "edits")], F.round(F.col("per_100_bars") / US, 6).alias("per_100_bars"))


@query(f"""WITH {PAGE_LOG}, spans AS (SELECT user_id, stretch, min(t) AS lo, max(t_end) AS hi FROM runs GROUP BY ALL),
  server AS (SELECT event_id, user_id, epoch_us(ts) AS t, epoch_us(ts) + CAST(round(least(greatest(coalesce(value, 0.0), 0.0), 300.0) * 1000000) AS BIGINT) AS t_end FROM events WHERE event_type = 'purchase' AND NOT coalesce(value > 40, false)),
  waits AS (SELECT s.user_id, r.stretch, s.t_end FROM server s ASOF JOIN spans r ON s.user_id = r.user_id AND s.t >= r.lo WHERE s.t <= r.hi + 60000000),
  tops AS (SELECT s.user_id, s.stretch, lo, greatest(hi, coalesce((SELECT max(e) FROM pieces p WHERE p.user_id = s.user_id AND p.stretch = s.stretch), hi), coalesce((SELECT max(t_end) FROM waits w WHERE w.user_id = s.user_id AND w.stretch = s.stretch), hi)) AS hi FROM spans s),
  marks AS (SELECT l.user_id, r.stretch, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS n FROM log l ASOF JOIN tops r ON l.user_id = r.user_id AND l.t >= r.lo WHERE l.t <= r.hi AND event_type IN ('view', 'click'))
  SELECT e.user_id, e.stretch, e.lo AS start, CAST(e.hi AS BIGINT) AS "end", coalesce(p.n, 0) AS pieces, coalesce(w.n, 0) AS waits, CAST(coalesce(m.n, 0) AS BIGINT) AS marks FROM tops e
  LEFT JOIN (SELECT user_id, stretch, count(*) AS n FROM pieces GROUP BY ALL) p ON p.user_id = e.user_id AND p.stretch = e.stretch
  LEFT JOIN (SELECT user_id, stretch, count(*) AS n FROM waits GROUP BY ALL) w ON w.user_id = e.user_id AND w.stretch = e.stretch
  LEFT JOIN (SELECT user_id, stretch, sum(n) AS n FROM marks GROUP BY ALL) m ON m.user_id = e.user_id AND m.stretch = e.stretch""")
def log_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch with how many pieces, waits and marked changes it has."""
    ends, items = reports.timeline(page_log(spark, sf_dir), ["user_id"], **OPTIONS)
    count = lambda item, value: F.coalesce(F.sum(F.when(F.col("item") == item, value)), F.lit(0)).cast("long").alias(item)
    held = items.groupBy("user_id", "stretch").agg(count("piece", 1), count("wait", 1), count("mark", F.col("n")))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return ends.join(held, ["user_id", "stretch"], "left").select("user_id", "stretch", "start", "end", zero("piece", "pieces"), zero("wait", "waits"), zero("mark", "marks"))


@query("""WITH r AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'returned' END AS r1 FROM lineitem),
  s AS (SELECT *, coalesce(r1, CASE WHEN l_quantity = min(CASE WHEN r1 IS NULL THEN l_quantity END) OVER (PARTITION BY l_orderkey) THEN 'least left in its order' END) AS r2 FROM r),
  t AS (SELECT *, coalesce(r2, CASE WHEN l_tax > 0.06 THEN 'tax of ' || CAST(round(l_tax * 100) AS INTEGER) END) AS r3 FROM s),
  u AS (SELECT *, coalesce(r3, CASE WHEN count(CASE WHEN r3 IS NULL THEN 1 END) OVER (PARTITION BY l_suppkey) < 3 THEN 'few of its supplier left' END) AS reason FROM t)
  SELECT reason, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM u GROUP BY reason""")
def rejection_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items put out by four rules, of which two look at what the rules before them left."""
    of, by = Window.partitionBy("l_orderkey"), Window.partitionBy("l_suppkey")
    rules = [
        ("returned", lambda left: F.col("l_returnflag") == "R"),
        ("least left in its order", lambda left: F.col("l_quantity") == F.min(F.when(left, F.col("l_quantity"))).over(of)),
        (F.concat(F.lit("tax of "), F.round(F.col("l_tax") * 100).cast("int").cast("string")), lambda left: F.col("l_tax") > 0.06),
        ("few of its supplier left", lambda left: F.count(F.when(left, 1)).over(by) < 3),
    ]
    chosen = selection.cascade(read(spark, sf_dir, "lineitem"), rules)
    return chosen.groupBy("reason").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query("""WITH s AS (SELECT o_orderkey, o_orderkey % 3 > 0 AS plain, o_orderkey % 4 > 0 AS told, o_orderkey % 5 = 0 AS odd, 'W' || o_custkey % 4 AS work, o_custkey % 10 / 10.0 AS worst, o_orderkey % 9 AS b,
    CASE o_orderstatus WHEN 'F' THEN 'I' ELSE 'II' END AS m, o_orderkey % 7 = 0 AS two, o_orderkey % 11 = 0 AS eye, CAST(floor(o_totalprice) AS BIGINT) % 12 AS far, o_custkey % 2 = 0 AS viola FROM orders),
  r AS (SELECT *, CASE WHEN NOT (plain OR (told AND NOT odd)) THEN CASE WHEN odd THEN 'a multi-bar rest read as one; noise' ELSE 'not plain' END WHEN two THEN 'two movements' WHEN work NOT IN ('W0', 'W1', 'W2') THEN 'another work'
    WHEN worst > 0.75 THEN 'a measure unlike its bar' WHEN NOT plain AND b = 3 THEN 'a multi-bar rest' WHEN viola AND far > 9 THEN 'notes far off the staff in the clef written' WHEN eye THEN 'left out by eye' END AS reason FROM s)
  SELECT reason, count(*) AS n, CAST(sum(CASE WHEN reason IS NULL THEN CASE WHEN plain THEN 1 WHEN b = 4 THEN 2 ELSE 1 END END) AS BIGINT) AS boxes FROM r GROUP BY reason""")
def chosen_staves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as staves of one or two bars: why each is left out, and the boxes of those that are kept."""
    o = read(spark, sf_dir, "orders")
    n, c = F.col("o_orderkey"), F.col("o_custkey")
    work, movement = F.concat(F.lit("W"), (c % 4).cast("string")), F.when(F.col("o_orderstatus") == "F", "I").otherwise("II")
    bar = lambda m, b: F.struct(work.alias("work"), m.alias("movement"), F.lit(b).cast("int").alias("bar") if isinstance(b, int) else b.cast("int").alias("bar"))
    b = n % 9
    two = F.array(bar(movement, b), bar(movement, b + 1))
    measure = F.struct(F.when((b == 3) | (b == 4), two).otherwise(F.array(bar(movement, b))).alias("bars"), F.lit(1).alias("count"), (b == 4).alias("two"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    staves = o.select(
        "o_orderkey", (n % 3 > 0).alias("plain"), (n % 4 > 0).alias("told"), F.when(n % 5 == 0, F.array(F.lit("noise"), F.lit("a multi-bar rest read as one"))).otherwise(F.array(F.lit("a multi-bar rest"))).alias("irregular"),
        F.when(n % 7 == 0, F.array(bar(movement, b), bar(F.lit("IX"), 1))).otherwise(F.array(bar(movement, b))).alias("bars"), F.array(measure).alias("measures"), none("struct<bar:int,half:string>").alias("halves"),
        none("int").alias("split_bars"), none("int").alias("rest_bars"), F.when(c % 2 == 0, "va").otherwise("vn1").alias("part"), (c % 10 / 10.0).alias("worst"), F.lit(99).alias("first"), none("int").alias("time_bars"),
        F.lit(1).alias("hits"), F.lit(1).alias("notes"), none("string").alias("drawn_clefs"), none("string").alias("read_clefs"), F.lit(None).cast("string").alias("unwritable"), (F.col("o_totalprice").cast("long") % 12).alias("far"),
        F.when(n % 11 == 0, "seen").alias("by_eye"),
    )
    chosen = selection.chosen_staves(staves, ["W0", "W1", "W2"], max_unlike=0.75, clef_checks=True)
    return chosen.groupBy("reason").agg(F.count("*").alias("n"), F.sum(F.when(F.col("reason").isNull(), F.size("boxes"))).alias("boxes"))


@query()
def structure_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's line items as the bar lines of a part, proposed from a structure of two movements that its number sets."""
    w = Window.partitionBy("o_custkey", "part").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "score").otherwise("vn1").alias("part"))
    li = read(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.element_at(F.array(*map(F.lit, ("single", "double", "repeat_end", "single"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    lines = li.select(
        "o_custkey", "part", F.row_number().over(w).alias("n"), kind.alias("kind"), F.when(F.col("l_suppkey") % 3 > 0, (F.col("l_suppkey") % 3).cast("int")).alias("bar_count"), (F.col("l_returnflag") == "R").alias("ends_movement"),
        (F.col("l_partkey") % 5 > 0).alias("auto"), (F.col("o_orderstatus") == "P").alias("reviewed"), (F.col("l_partkey") % 97 == 0).alias("stop"),
    )
    c = F.col("o_custkey")
    first, then = (c % 5 + 2).cast("int"), (c % 7 + 3).cast("int")
    part = lambda n, repeat, split: F.struct(n.alias("bars"), repeat.alias("repeat"), split.alias("split"), F.lit(False).alias("heading"))
    movement = lambda name, a, b: F.struct(F.lit(name).alias("movement"), (a + b).alias("total"), (c % 2 == 0).alias("pickup"), F.lit(False).alias("template"), F.array(part(a, c % 3 == 0, c % 4 == 0), part(b, c % 3 < 2, F.lit(False))).alias("segments"))
    expected = o.select("o_custkey").distinct().select("o_custkey", F.inline(F.array(movement("I", first, then), movement("II", then, first))))
    return proposals.proposed(cut_lineage(lines, "lines"), expected, ["o_custkey"])


@query("""WITH li AS (SELECT l_orderkey, l_partkey AS p, l_suppkey AS u, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
  base AS (SELECT o_custkey AS c, o_orderkey AS o, o.page, CASE WHEN o_orderkey % 2 = 0 THEN 'alto' END AS page_clef, p, u, i FROM li
    JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page FROM orders) o ON o_orderkey = l_orderkey),
  sy AS (SELECT *, 0.2::DOUBLE * i - 0.1::DOUBLE AS top, 0.2::DOUBLE * i - 0.06::DOUBLE AS bottom, p % 11 > 0 AS counts, ['treble', 'alto', 'tenor', 'bass'][u % 6 + 1] AS clef,
    CASE WHEN u % 5 = 0 THEN CAST(p % 15 - 7 AS VARCHAR) END AS "key", CASE p % 6 WHEN 0 THEN '3/4' WHEN 1 THEN 'C' END AS "time" FROM base WHERE i <= 4),
  bl AS (SELECT c, page, i, k, 0.1::DOUBLE + 0.25::DOUBLE * k AS pos FROM sy, range(1, 4) r(k) WHERE k <= 1 + p % 3),
  mk AS (SELECT c, page, o, i AS n, (p % 95) / 100.0::DOUBLE AS x, (u % 95) / 100.0::DOUBLE AS y, 0.04::DOUBLE AS w, x + w / 2 AS cx, y + 0.02::DOUBLE / 2 AS cy, x + w AS far, ['text', 'tempo', 'signature', 'title', 'dynamic'][p % 5 + 1] AS kind,
    CASE WHEN u % 3 = 0 THEN ['treble', 'alto', 'tenor', 'bass'][i % 4 + 1] END AS clef, CASE WHEN u % 3 = 1 THEN CAST(i % 15 - 7 AS VARCHAR) END AS "key", CASE WHEN u % 3 = 2 THEN '2/4' END AS "time" FROM base),
  placed AS (SELECT m.c, m.page, m.n, m.x, m.w, m.clef, m."key", m."time", s.i, s.top, s.counts, row_number() OVER (PARTITION BY m.c, m.page, m.n ORDER BY greatest(s.top - m.cy, 0.0, m.cy - s.bottom), s.top, s.i) AS r FROM mk m JOIN sy s ON s.c = m.c AND s.page = m.page WHERE m.kind = 'signature'),
  signs AS (SELECT p.*, coalesce((SELECT arg_min(b.pos, (abs(p.x - b.pos), b.k)) FROM bl b WHERE b.c = p.c AND b.page = p.page AND b.i = p.i AND b.pos - p.w / 2 <= p.x AND p.x <= b.pos + p.w), p.x + p.w / 2) AS pos FROM placed p WHERE r = 1 AND counts),
  changes AS (SELECT c, page, top, -1.7976931348623157e308::DOUBLE AS x, i, clef, "key", "time", 0 AS side, i AS n FROM sy WHERE counts UNION ALL SELECT c, page, top, pos, i, clef, "key", "time", 1, n FROM signs),
  lists AS (SELECT c, page, list({'top': top, 'x': x, 'i': i, 'v': clef} ORDER BY top, x, side, n) FILTER (clef IS NOT NULL) AS clefs, list({'x': x, 'i': i, 'v': "key"} ORDER BY top, x, side, n) FILTER ("key" IS NOT NULL) AS keys,
    list({'x': x, 'i': i, 'v': "time"} ORDER BY top, x, side, n) FILTER ("time" IS NOT NULL) AS times FROM changes GROUP BY ALL),
  bars AS (SELECT s.c, s.page, s.o, s.i, k, s.page_clef, lag(pos) OVER line AS "left", pos AS "right", coalesce(lag(pos) OVER line, 0.1::DOUBLE) AS x0, pos AS x1, top, bottom, greatest(top + 0.0::DOUBLE - 2.5::DOUBLE * ((bottom - top) / 4), 0.0) AS y0, least(bottom + 0.0::DOUBLE + 2.5::DOUBLE * ((bottom - top) / 4), 1.0) AS y1,
    row_number() OVER (PARTITION BY s.c, s.page ORDER BY s.i, k) AS pos FROM sy s JOIN bl b ON b.c = s.c AND b.page = s.page AND b.i = s.i WHERE counts WINDOW line AS (PARTITION BY s.c, s.page, s.i ORDER BY k)),
  tried AS (SELECT m.c, m.page, m.n, any_value(m.kind) IN ('tempo', 'title') AS heading, any_value(far) AS far, min(pos) FILTER (x0 <= cx AND cx <= x1 AND y0 <= cy AND cy <= y1) AS holds,
    arg_min(pos, (abs((top + bottom) / 2 - cy), pos)) FILTER ("left" IS NULL AND y0 <= cy AND cy <= y1 AND far <= x0) AS beside, arg_min(pos, (top, pos)) FILTER (top > cy) AS below, arg_min(b.i, (greatest(y0 - cy, 0.0, cy - y1), pos)) AS staff
    FROM mk m JOIN bars b ON b.c = m.c AND b.page = m.page GROUP BY m.c, m.page, m.n),
  owned AS (SELECT t.c, t.page, t.n, coalesce(holds, beside, CASE WHEN heading THEN below ELSE (SELECT coalesce(max(b.pos) FILTER (b.x0 <= t.far), min(b.pos)) FROM bars b WHERE b.c = t.c AND b.page = t.page AND b.i = t.staff) END) AS pos FROM tried t),
  marks AS (SELECT c, page, pos, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY n) AS marks FROM owned WHERE pos IS NOT NULL GROUP BY ALL),
  told AS (SELECT b.*, l.keys, l.times, coalesce("left", 0.1::DOUBLE) AS start, list_filter(l.clefs, lambda e: (e.top < b.top AND e.i <> b.i) OR (e.i = b.i AND e.x <= coalesce(b."left", 0.1::DOUBLE))) AS before,
    list_filter(l.clefs, lambda e: e.i = b.i AND e.x > coalesce(b."left", 0.1::DOUBLE) AND e.x < b."right") AS later FROM bars b LEFT JOIN lists l ON l.c = b.c AND l.page = b.page),
  seen AS (SELECT *, list_concat(CASE WHEN coalesce(before[-1].v, page_clef) IS NULL THEN [] ELSE [coalesce(before[-1].v, page_clef)] END, list_transform(coalesce(later, []), lambda e: e.v)) AS all_clefs,
    list_filter(keys, lambda e: e.i = told.i AND e.x >= coalesce("left" - 1e-9::DOUBLE, -1.7976931348623157e308::DOUBLE) AND e.x < "right")[-1].v AS "key",
    list_filter(times, lambda e: e.i = told.i AND e.x >= coalesce("left" - 1e-9::DOUBLE, -1.7976931348623157e308::DOUBLE) AND e.x < "right")[-1].v AS "time" FROM told)
  SELECT s.c AS o_custkey, row_number() OVER (PARTITION BY s.c ORDER BY s.page, s.pos) - 1 AS "order", s.page, 'b-' || s.o || '-' || s.i || '-' || s.k AS barline, row_number() OVER (PARTITION BY s.c ORDER BY s.page, s.pos) AS bar, coalesce(m.marks, '') AS marks,
    array_to_string(list_filter(all_clefs, lambda v, j: j = 1 OR v <> all_clefs[j - 1]), ' ') AS clefs, CAST("key" AS INTEGER) AS "key", "time", round(x0, 6) AS x0, round(x1, 6) AS x1, round(y0, 6) AS y0, round(y1, 6) AS y1
  FROM seen s LEFT JOIN marks m ON m.c = s.c AND m.page = s.page AND m.pos = s.pos""")
def bars_export_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer as a source, an order as a page: its first line items are staves (some are cues) with up to three bar lines, every
    one is a mark, of which some are signatures. Owners, clefs, keys, times and corners of each bar."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("u"), F.row_number().over(w).alias("i"))
    p, u, i = F.col("p"), F.col("u"), F.col("i")
    clefs = F.array(*map(F.lit, ("treble", "alto", "tenor", "bass")))
    line = lambda k: F.struct(F.concat_ws("-", F.lit("b"), "l_orderkey", "i", k.cast("string")).alias("id"), (0.1 + 0.25 * k).alias("x0"), (0.1 + 0.25 * k).alias("x1"), F.lit("single").alias("kind"))
    staff = F.struct(
        i.alias("i"), F.concat_ws("-", F.lit("s"), "l_orderkey", "i").alias("id"), (0.2 * i - 0.1).alias("top"), (0.2 * i - 0.06).alias("bottom"), F.lit(0.1).alias("left"), F.lit(0.9).alias("right"),
        F.when(p % 11 == 0, "cue").alias("role"), F.get(clefs, (u % 6).cast("int")).alias("clef"), F.when(u % 5 == 0, (p % 15 - 7).cast("int")).alias("key"), F.when(p % 6 == 0, "3/4").when(p % 6 == 1, "C").alias("time"),
        F.transform(F.sequence(F.lit(1), (1 + p % 3).cast("int")), line).alias("barlines"),
    )
    sign = (p % 5) == 2
    mark = F.struct(
        i.alias("i"), F.concat_ws("-", F.lit("m"), "l_orderkey", "i").alias("id"), (p % 95 / 100.0).alias("x"), (u % 95 / 100.0).alias("y"), F.lit(0.04).alias("w"), F.lit(0.02).alias("h"),
        F.get(F.array(*map(F.lit, ("text", "tempo", "signature", "title", "dynamic"))), (p % 5).cast("int")).alias("kind"), F.when(sign & (u % 3 == 0), F.get(clefs, i % 4)).alias("clef"),
        F.when(sign & (u % 3 == 1), (i % 15 - 7).cast("int")).alias("key"), F.when(sign & (u % 3 == 2), "2/4").alias("time"),
    )
    json = lambda items, kind: F.from_json(F.to_json(F.array_sort(F.collect_list(items))), f"array<struct<{kind}>>")
    held = li.groupBy("l_orderkey").agg(json(F.when(i <= 4, staff), documents.SYSTEM).alias("systems"), json(mark, documents.MARK).alias("marks"))
    o = read(spark, sf_dir, "orders").withColumn("page", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    pages = o.join(held, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_custkey", "page", F.lit("reviewed").alias("status"), F.lit("music").alias("kind"), F.lit("va").alias("part"), F.when(F.col("o_orderkey") % 2 == 0, "alto").alias("clef"), "systems", "marks"
    )
    out = bars.bars_export(pages, ["o_custkey"])
    number = lambda m: F.element_at(F.split(m, "-"), -1)
    corner = lambda c, k: F.round(F.get(F.get("quad", F.lit(c)), F.lit(k)), 6)
    return out.select(
        "o_custkey", F.col("order").cast("long").alias("order"), F.col("page").cast("long").alias("page"), "barline", F.col("bar").cast("long").alias("bar"), F.array_join(F.transform("marks", number), " ").alias("marks"),
        F.array_join("clefs", " ").alias("clefs"), "key", "time", corner(0, 0).alias("x0"), corner(2, 0).alias("x1"), corner(0, 1).alias("y0"), corner(2, 1).alias("y1"),
    )


@query()
def twin_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as profiles: of each 64 in a row, the even ones are one copy's pages of four lines, the odd ones the other's."""
    v = read(spark, sf_dir, "embeddings").where("vec_id is not null")
    i = F.col("vec_id")
    lines = v.select(F.floor(i / 64).alias("copies"), (F.floor(i / 8) % 8).alias("page"), (F.floor(i / 2) % 4).alias("place"), (i % 2).alias("side"), F.col("embedding").alias("profile"))
    lines = cut_lineage(lines, "profiles")
    _, staves = twins.twins(lines.where("side = 0").drop("side"), lines.where("side = 1").drop("side"), ["copies"])
    return staves.withColumn("r", F.round("r", 6)).withColumn("next", F.round("next", 6))


@query()
def tuned_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least quantity, greatest tax and greatest discount that find returned line items best, and the score."""
    li = read(spark, sf_dir, "lineitem")
    grid = {"quantity": [1.0, 10.0, 20.0, 30.0, 40.0], "tax": [0.02, 0.04, 0.06, 0.08], "discount": [0.02, 0.05, 0.08, 0.1]}
    accept = lambda p: (F.col("l_quantity") >= p["quantity"]) & (F.col("l_tax") <= p["tax"]) & (F.col("l_discount") <= p["discount"])
    best, score, rounds = tuning.tuned(li, grid, accept, F.col("l_returnflag") == "R", {"quantity": 20.0, "tax": 0.04, "discount": 0.05}, 0.5)
    found = li.agg(F.count_if(accept({k: F.lit(v) for k, v in best.items()})).alias("found"))
    return found.select(*[F.lit(v).alias(k) for k, v in best.items()], F.lit(score).alias("score"), F.lit(rounds).alias("rounds"), "found")


@query("""WITH s AS (SELECT l_suppkey % 5 AS f, count(*) AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy FROM lineitem GROUP BY 1),
  o AS (SELECT a.f, sum(b.n) AS n, sum(b.x) AS x, sum(b.y) AS y, sum(b.xx) AS xx, sum(b.xy) AS xy FROM s a JOIN s b ON a.f <> b.f GROUP BY a.f),
  m AS (SELECT f, (n * xy - x * y) / (n * xx - x * x) AS k, (y - k * x) / n AS c FROM o)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(c + k * l_quantity, 3) AS score FROM lineitem JOIN m ON f = l_suppkey % 5""")
def out_of_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price that a line item's quantity suggests, learnt from the suppliers of other folds."""
    li = read(spark, sf_dir, "lineitem").withColumn("f", F.col("l_suppkey") % 5)
    scored = tuning.out_of_fold(li, ["l_quantity"], "l_extendedprice", "f", 0.0)
    return scored.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("score", 3).alias("score"))


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as pages, line items as staves with two bar lines each; some staves are cues, some were edited."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    li = read(spark, sf_dir, "lineitem").withColumn("i", F.row_number().over(w))
    p, u = F.col("l_partkey"), F.col("l_suppkey")
    line = lambda k: F.struct(F.concat_ws("-", F.lit("b"), "i", F.lit(str(k))).alias("id"), (F.lit(k) / 10).alias("x0"), (F.lit(k) / 10).alias("x1"), ((p + k) % 3 > 0).alias("auto"))
    some = lambda c, n: F.transform(F.sequence(F.lit(1), (c % n + 1).cast("int")), lambda x: x / 10)
    staff = F.struct(
        "i", F.concat_ws("-", F.lit("s"), "i").alias("id"), (F.col("i") / 10).alias("top"), F.when(u % 4 == 0, "cue").alias("role"), (p % 5 > 0).alias("auto"), F.when(u % 3 == 0, F.lit(2.0)).alias("above"),
        F.when(u % 2 == 0, F.lit(2.0)).alias("below"), F.when(u % 5 == 0, some(p, 3)).alias("rejected"), F.array(line(1), line(2)).alias("barlines"),
    )
    held = li.groupBy("l_orderkey").agg(F.from_json(F.to_json(F.array_sort(F.collect_list(staff))), f"array<struct<{documents.SYSTEM}>>").alias("systems"))
    o = read(spark, sf_dir, "orders").join(held, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(
        "o_custkey", F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") == "F", "reviewed").otherwise("edited").alias("status"), F.when(F.col("o_orderkey") % 7 > 0, "music").otherwise("title").alias("kind"),
        F.lit("va").alias("part"), F.when(F.col("o_orderkey") % 2 == 0, some(F.col("o_orderkey"), 4)).alias("rejected_staves"), "systems",
    )


@query("""WITH s AS (SELECT o_custkey AS c, o_orderkey AS o, l_partkey AS p, l_suppkey AS u FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND o_orderkey % 7 > 0),
  t AS (SELECT c, o, count(*) FILTER (u % 4 > 0) AS staves, count(*) FILTER (u % 4 > 0 AND p % 5 = 0) AS staves_changed, 2 * count(*) FILTER (u % 4 > 0) AS lines,
    sum(CASE WHEN u % 4 > 0 THEN CAST((p + 1) % 3 > 0 AS INT) + CAST((p + 2) % 3 > 0 AS INT) ELSE 0 END) AS kept, sum(CASE WHEN u % 4 > 0 AND u % 5 = 0 THEN p % 3 + 1 ELSE 0 END) AS deleted FROM s GROUP BY ALL)
  SELECT c AS o_custkey, count(*) AS pages, CAST(sum(staves) AS BIGINT) AS staves, CAST(sum(staves_changed) AS BIGINT) AS staves_changed, CAST(sum(CASE WHEN o % 2 = 0 THEN o % 4 + 1 ELSE 0 END) AS BIGINT) AS staves_deleted,
    CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(lines - kept) AS BIGINT) AS changed, CAST(sum(deleted) AS BIGINT) AS deleted, round(CASE WHEN sum(lines) > 0 THEN sum(kept) / sum(lines) ELSE 0 END, 9) AS kept_share FROM t GROUP BY c""")
def edit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.edit_report(review.edit_counts(order_pages(spark, sf_dir), ["o_custkey"]), ["o_custkey"])
    return out.withColumn("kept_share", F.round("kept_share", 9))


@query("""SELECT o_custkey, o_orderkey AS page FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 7 > 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 6 = 0)""")
def edited_crop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.edited_crops(order_pages(spark, sf_dir)).select("o_custkey", "page")


@query("""WITH o AS (SELECT o_custkey, o_orderkey AS page, o_orderstatus = 'F' AND o_orderkey % 7 > 0 AS there, bool_or(l_partkey % 50 = 0) AS moved FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
  SELECT o_custkey, bool_or(moved OR page % 41 = 0) AS changed FROM o WHERE there GROUP BY o_custkey""")
def truth_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose reviewed truth differs in a version with other staves for some parts and without some pages."""
    pages = cut_lineage(order_pages(spark, sf_dir), "pages")
    moved = read(spark, sf_dir, "lineitem").where("l_partkey % 50 = 0").select(F.col("l_orderkey").alias("page")).distinct().withColumn("moved", F.lit(True))
    new = pages.where("page % 41 > 0").join(moved, "page", "left")
    new = new.withColumn("systems", F.when(F.col("moved"), F.transform("systems", lambda s: s.withField("top", s["top"] + 1))).otherwise(F.col("systems")))
    return review.truth_changed(review.bar_line_truth(pages, ["o_custkey"]), review.bar_line_truth(new, ["o_custkey"]), ["o_custkey"])


@query("""WITH b AS (SELECT o_custkey AS c, CASE WHEN l_suppkey % 2 = 0 THEN 'va' ELSE 'vc' END AS part, CASE l_partkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'III' END AS m, l_linenumber AS bar, CAST(l_quantity AS BIGINT) % 3 AS n,
    CASE WHEN l_returnflag = 'R' THEN 'repeat_end' ELSE 'single' END AS kind, l_linestatus = 'F' AS ends FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  r AS (SELECT c, part, m, sum(n) AS bars, bool_or(n = 0 AND bar = 0) AS pickup, bool_or(ends) AS ended, coalesce(string_agg(bar + n - 1, ' ' ORDER BY bar + n - 1) FILTER (kind = 'repeat_end' AND n > 0), '') AS repeats,
    coalesce(string_agg(bar, ' ' ORDER BY bar) FILTER (kind = 'repeat_end' AND n = 0), '') AS on_pickup FROM b GROUP BY ALL),
  e AS (SELECT c, part, m, CASE WHEN m <> 'IV' THEN c % 9 + 2 END AS total FROM (SELECT DISTINCT c, part FROM r), (VALUES ('I'), ('II'), ('IV')) x(m))
  SELECT coalesce(r.c, e.c) AS o_custkey, coalesce(r.part, e.part) AS part, coalesce(r.m, e.m) AS movement, CAST(coalesce(bars, 0) AS BIGINT) AS bars, total,
    CASE WHEN coalesce(bars, 0) = total THEN 'ok' WHEN coalesce(bars, 0) <> total AND coalesce(ended, false) THEN 'bad' END AS verdict, coalesce(pickup, false) AS pickup, coalesce(ended, false) AS ended, coalesce(repeats, '') AS repeats, coalesce(on_pickup, '') AS on_pickup
  FROM r FULL JOIN e ON r.c = e.c AND r.part = e.part AND r.m = e.m""")
def counts_against_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    movement = F.element_at(F.array(*map(F.lit, ("I", "II", "III"))), (F.col("l_partkey") % 3 + 1).cast("int"))
    bars_ = li.select(
        "o_custkey", F.when(F.col("l_suppkey") % 2 == 0, "va").otherwise("vc").alias("part"), movement.alias("movement"), F.col("l_linenumber").cast("long").alias("bar"), (F.col("l_quantity").cast("long") % 3).alias("count"),
        F.when(F.col("l_returnflag") == "R", "repeat_end").otherwise("single").alias("kind"), (F.col("l_linestatus") == "F").alias("ends"),
    )
    held = bars_.select("o_custkey").distinct()
    expected = held.select("o_custkey", F.explode(F.array(*map(F.lit, ("I", "II", "IV")))).alias("movement"), (F.col("o_custkey") % 9 + 2).alias("total")).withColumn("template", F.col("movement") == "IV")
    out = review.counts_against_expected(bars_, expected, ["o_custkey"])
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return out.select("o_custkey", "part", "movement", "bars", "total", "verdict", "pickup", "ended", joined("repeats"), joined("on_pickup"))


@query("""WITH s AS (SELECT p_partkey, p_partkey % 3 > 0 AS kept, p_partkey % 7 = 0 AS known, p_partkey % 4 = 0 AS in_set, CASE WHEN p_partkey % 5 = 0 THEN 'late' WHEN p_partkey % 10 = 1 THEN 'early' END AS reason FROM part)
  SELECT p_partkey, CASE WHEN kept THEN CASE WHEN in_set THEN 'set' ELSE 'paired' END WHEN known THEN 'unpaired' ELSE 'unknown' END AS status,
    CASE WHEN NOT kept AND known THEN 'faint' WHEN kept AND NOT in_set THEN coalesce(reason, '') ELSE '' END AS why FROM s""")
def staff_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as staves: which are paired, in a set, or left out, and why; the second set's reasons hold over the first one's."""
    p = read(spark, sf_dir, "part").select("p_partkey")
    left = p.where("p_partkey % 5 = 0").select("p_partkey", F.lit(2).alias("set_order"), F.lit("late").alias("reason"))
    left = left.unionByName(p.where("p_partkey % 5 = 0 or p_partkey % 10 = 1").select("p_partkey", F.lit(1).alias("set_order"), F.lit("early").alias("reason")))
    out = review.standing(p, p.where("p_partkey % 3 > 0"), p.where("p_partkey % 7 = 0").withColumn("why", F.array(F.lit("faint"))), p.where("p_partkey % 4 = 0"), left, ["p_partkey"])
    return out.select("p_partkey", "status", F.array_join("why", ";").alias("why"))


@query()
def staff_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as staves on a page 1,000 wide: their line items' places are their own bar lines, and up to four detectors' proposals."""
    li = read(spark, sf_dir, "lineitem")
    staves = read(spark, sf_dir, "orders").select("o_orderkey", F.lit(100.0).alias("left"), F.lit(900.0).alias("right"), F.lit(20.0).alias("gap"), F.lit(915.0).alias("paper"), F.lit(1000.0).alias("width"))
    x = (F.col("l_partkey") % 900 + 100).cast("double")
    own = li.where("l_suppkey % 3 > 0").select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("line"), x.alias("x"))
    four = F.explode(F.sequence(F.lit(0), F.lit(3)))
    readers = staves.select("o_orderkey", four.alias("d")).where("(o_orderkey + d) % 5 > 0").select("o_orderkey", F.concat(F.lit("d"), F.col("d").cast("string")).alias("detector"), F.lit(0.3).alias("threshold"))
    said = li.select(F.col("l_orderkey").alias("o_orderkey"), four.alias("d"), x.alias("x"), "l_suppkey", "l_tax")
    said = said.select("o_orderkey", F.concat(F.lit("d"), F.col("d").cast("string")).alias("detector"), (F.col("x") + (F.col("l_suppkey") + F.col("d")) % 9 - 4).alias("x"), (F.col("l_tax") * 10 + F.col("d") / 10).alias("sure"))
    return review.staff_votes(staves, own, readers, said, ["o_orderkey"]).withColumn("x", F.round("x", 6))


@query("""WITH li AS (SELECT l_orderkey AS o, (l_partkey % 997) / 1000.0::DOUBLE AS m, CASE WHEN l_suppkey % 5 = 0 THEN 2 ELSE 1 END AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
  s AS (SELECT l.*, o_orderkey % 9 = 0 AS cue, o_orderkey % 4 = 0 AS runs_on, o_orderstatus = 'F' AS reviewed, (o_custkey % 300 + 700) / 1000.0::DOUBLE AS "right" FROM li l JOIN orders ON o_orderkey = o),
  b AS (SELECT *, row_number() OVER w AS place, m - lag(m) OVER w AS w FROM s WHERE NOT cue WINDOW w AS (PARTITION BY o ORDER BY m, i)),
  g AS (SELECT o, any_value("right") AS r, any_value(runs_on) AS runs_on, max(m) AS far, count(*) AS n FROM b GROUP BY o),
  f AS (SELECT o, n, CASE WHEN r - (far + 0.5::DOUBLE * 0.01::DOUBLE) > 0.01::DOUBLE THEN (r - far) / 0.01::DOUBLE WHEN (r - far) / 0.01::DOUBLE < -0.25 THEN (r - far) / 0.01::DOUBLE ELSE 0 END AS off, runs_on FROM g),
  e AS (SELECT o, n, CASE WHEN runs_on THEN least(off, 0.0) ELSE off END AS off FROM f),
  d AS (SELECT o, median(w) AS med, count(*) AS k FROM b WHERE n = 1 AND w >= 0.5::DOUBLE * 0.01::DOUBLE GROUP BY o)
  SELECT o AS l_orderkey, 'stacked' AS kind, CAST(place AS INTEGER) AS place, 0.0::DOUBLE AS ratio FROM b WHERE w < 0.5::DOUBLE * 0.01::DOUBLE
  UNION ALL SELECT o, CASE WHEN off > 0 THEN 'past' ELSE 'short' END, CAST(n + 1 AS INTEGER), round(abs(off), 6) FROM e WHERE off <> 0
  UNION ALL SELECT b.o, CASE WHEN w > med THEN 'wide' ELSE 'narrow' END, CAST(place AS INTEGER), round(w / med, 6) FROM b JOIN d ON d.o = b.o WHERE NOT reviewed AND k >= 3 AND n = 1 AND w >= 0.5::DOUBLE * 0.01::DOUBLE AND (w > 1.8::DOUBLE * med OR w < 0.4::DOUBLE * med)""")
def odd_bars_of_staves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as staves, their line items as bar lines: stacked ones, ends off their place, and bars of odd width."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.struct(
        (F.col("l_partkey") % 997 / 1000.0).alias("x0"), (F.col("l_partkey") % 997 / 1000.0).alias("x1"), F.when(F.col("l_suppkey") % 5 == 0, 2).alias("bar_count")).alias("b"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["b"]).alias("barlines"))
    o = read(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.col("o_orderkey")
    staff = F.struct(F.lit(0.2).alias("top"), F.lit(0.24).alias("bottom"), F.lit(0.0).alias("start"), ((F.col("o_custkey") % 300 + 700) / 1000.0).alias("right"), F.when(n % 9 == 0, "cue").alias("role"), (n % 4 == 0).alias("runs_on"), "barlines")
    out = widths.odd_bars(o.select("l_orderkey", "o_orderstatus", staff.alias("s")), ["l_orderkey"], "s", F.lit(0.01), F.col("o_orderstatus") == "F")
    return out.withColumn("ratio", F.round("ratio", 6))
