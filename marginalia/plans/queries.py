"""Registered queries: the operators over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import notation
from ..operators import activity, alignment, bars, comparison, evaluation, matching, numbering, reports
from ..session import ship, spread
from ..sources import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
US = 1_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    path = f"{sf_dir}/{name}.parquet"
    spread(spark, path)
    return spark.read.parquet(path)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def with_next(rows: DataFrame, at: str, value: str, name: str, width: int = 64) -> DataFrame:
    """rows with `name`, the value of the next row by the whole number `at` in the whole table.

    A window looks within a block of `width` numbers; a block's last row takes the first value of the next block that has rows,
    from one small row per block."""
    block = F.floor(F.col(at) / width)
    own = rows.withColumn("__b", block)
    w = Window.partitionBy("__b").orderBy(at)
    first = own.groupBy("__b").agg(F.min_by(value, at).alias("__first"))
    # Which block comes next: a window over groups of blocks, and over the groups' own first blocks.
    at_most = F.floor(F.col("__b") / 4096)
    ids = first.select("__b", at_most.alias("__g"))
    edge = ids.groupBy("__g").agg(F.min("__b").alias("__least")).withColumn("__after", F.lead("__least").over(Window.partitionBy(F.lit(0)).orderBy("__g")))
    to = ids.withColumn("__to", F.lead("__b").over(Window.partitionBy("__g").orderBy("__b"))).join(edge.select("__g", "__after"), "__g")
    to = to.select("__b", F.coalesce("__to", "__after").alias("__to")).join(first.select(F.col("__b").alias("__to"), "__first"), "__to")
    out = own.withColumn("__next", F.lead(value).over(w)).withColumn("__last", F.lead(at).over(w).isNull()).join(to.select("__b", "__first"), "__b", "left")
    return out.withColumn(name, F.when(F.col("__last"), F.col("__first")).otherwise(F.col("__next"))).drop("__b", "__next", "__last", "__first")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: t and t_end in whole microseconds, kind and place."""
    e = read(spark, sf_dir, "events")
    lasts = F.round(F.least(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)), F.lit(300.0)) * US).cast("long")
    return e.select(
        "event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("t"), (micros(F.col("ts")) + lasts).alias("t_end"),
        F.get_json_object("props", "$.k").alias("place"),
    )


LOG = """log AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t,
  epoch_us(ts) + CAST(round(least(greatest(coalesce(value, 0.0), 0.0), 300.0) * 1000000) AS BIGINT) AS t_end,
  json_extract_string(props, '$.k') AS place FROM events),
marked AS (SELECT *, CASE WHEN t - max(t_end) OVER w <= 600000000 THEN 0 ELSE 1 END AS new FROM log
  WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
runs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stretch FROM marked)"""


@query(f"WITH {LOG} SELECT event_id, user_id, stretch FROM runs")
def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.stretches(log(spark, sf_dir), ["user_id"], gap=600 * US).select("event_id", "user_id", "stretch")


SEGMENTS = f"""{LOG},
nexts AS (SELECT *, lead(t) OVER (PARTITION BY user_id, stretch ORDER BY t, event_id) AS nx FROM runs),
ends AS (SELECT *, greatest(t_end, CASE WHEN event_type <> 'error' THEN coalesce(nx, t_end) ELSE t_end END) AS e FROM nexts),
starts AS (SELECT *, greatest(t, coalesce(max(e) OVER (PARTITION BY user_id, stretch ORDER BY t, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), t)) AS s FROM ends),
pieces AS (
  SELECT user_id, place, s, e FROM starts WHERE e > s
  UNION ALL
  SELECT user_id, arg_max(place, (t, event_id)), coalesce(max(e) FILTER (e > s), max(t)),
    coalesce(max(e) FILTER (e > s), max(t)) + 60000000 - coalesce(sum(e - s) FILTER (e > s), 0) FROM starts GROUP BY user_id, stretch
  HAVING coalesce(sum(e - s) FILTER (e > s), 0) < 60000000)"""


@query(f"WITH {SEGMENTS} SELECT user_id, place, CAST(sum(e - s) AS BIGINT) AS micros FROM pieces GROUP BY user_id, place")
def segments_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = activity.segments(log(spark, sf_dir), ["user_id"], "place", "event_type", ["error"], gap=600 * US, least=60 * US)
    return activity.attribute(pieces, ["user_id"]).select("user_id", "place", F.col("seconds").cast("long").alias("micros"))


@query(f"""WITH {SEGMENTS} SELECT user_id, CAST(make_timestamp(s) AS DATE) AS day, CAST(sum(e - s) AS BIGINT) AS micros
  FROM pieces GROUP BY ALL""")
def source_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = activity.segments(log(spark, sf_dir), ["user_id"], "place", "event_type", ["error"], gap=600 * US, least=60 * US)
    day = F.to_date(F.timestamp_micros(F.col("start").cast("long")))
    return pieces.groupBy("user_id", day.alias("day")).agg(F.sum("seconds").cast("long").alias("micros"))


@query("""WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 600000000 THEN 0 ELSE 1 END AS new FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM r GROUP BY user_id, k""")
def session_window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = e.groupBy("user_id", F.session_window("at", "10 minutes").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("start"), "n")


@query("""SELECT user_id, event_type AS "group", CAST(sum(CASE WHEN value > 200 THEN 0 ELSE round(value * 100) END) AS BIGINT) AS n,
  count(*) FILTER (value > 200) AS waits, CAST(sum(CASE WHEN value > 200 THEN round(value * 100) ELSE 0 END) AS BIGINT) AS wait_cents
  FROM events GROUP BY user_id, event_type""")
def activity_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = F.coalesce(F.col("value") > 200, F.lit(False))
    weight = F.round(F.col("value") * 100).cast("long")
    out = activity.tallies(read(spark, sf_dir, "events"), ["user_id"], F.col("event_type"), weight, waits)
    return out.select("user_id", "group", F.col("n").cast("long").alias("n"), "waits", F.col("wait_seconds").cast("long").alias("wait_cents"))


@query("""WITH e AS (SELECT user_id, event_type, value, json_extract_string(props, '$.k') AS place FROM events),
  w AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'undo' WHEN event_type = 'purchase' THEN 'server' ELSE 'edit' END AS kind,
    unnest(CASE WHEN event_type = 'purchase' THEN ['purchase'] ELSE [event_type, place || ' (detected)'] END) AS what, value FROM e),
  g AS (SELECT user_id, CASE kind WHEN 'server' THEN 'waits' WHEN 'undo' THEN 'undone' ELSE CASE WHEN what LIKE '%(detected)' THEN 'corrections' ELSE 'edits' END END AS counter,
    CASE WHEN kind = 'undo' THEN 'undo: ' || what ELSE what END AS what, value FROM w WHERE what IS NOT NULL)
  SELECT user_id, counter, what, count(*) AS n, round(sum(CASE WHEN counter = 'waits' THEN coalesce(value, 0) END), 2) AS seconds FROM g GROUP BY user_id, counter, what""")
def log_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are a server's events, errors undo, the others edit: each edits its type and, as detected, its place."""
    place = F.get_json_object("props", "$.k")
    server = F.col("event_type") == "purchase"
    e = read(spark, sf_dir, "events").select(
        "user_id", F.when(server, "labeler-server").otherwise("labeler").alias("src"), F.when(server, "purchase").when(F.col("event_type") == "error", "undo").otherwise("edit").alias("kind"),
        F.concat_ws(", ", "event_type", F.concat(place, F.lit(" (detected)"))).alias("what"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("string").alias("by"), F.col("value").alias("seconds"),
    )
    return reports.tallies(e, ["user_id"]).withColumn("seconds", F.round("seconds", 2))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(l_quantity AS INT) % 3 AS c, CAST(l_returnflag = 'R' AS INT) AS e,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem),
  m AS (SELECT *, CAST(1 + coalesce(sum(e) OVER (PARTITION BY l_suppkey ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS movement FROM r)
  SELECT l_suppkey, l_orderkey, l_linenumber, movement, CAST(1 + coalesce(sum(c) OVER (PARTITION BY l_suppkey, movement ORDER BY rn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - CASE WHEN c = 0 THEN 1 ELSE 0 END AS BIGINT) AS bar FROM m""")
def number_rows_with_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = numbering.number_with_resets(
        read(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"],
        F.col("l_quantity").cast("int") % 3, F.col("l_returnflag") == "R",
    )
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "movement", "bar")


@query("""WITH p AS (SELECT o_custkey, o_orderkey, nullif(o_orderpriority, '3-MEDIUM') AS part, CASE o_orderstatus WHEN 'F' THEN 'music' WHEN 'O' THEN 'other' ELSE 'title' END AS kind,
    row_number() OVER w + count(*) FILTER (o_orderpriority = '1-URGENT') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS page FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  n AS (SELECT p.o_orderkey, p.o_custkey, p.page, p.part, p.kind, min(q.page) AS np FROM p LEFT JOIN p q ON q.o_custkey = p.o_custkey AND q.page > p.page AND q.kind <> 'other' GROUP BY ALL)
  SELECT n.o_orderkey, coalesce(n.kind = 'music' AND n.part IS NOT NULL AND (q.kind = 'title' OR q.kind = 'music' AND q.part <> n.part)
    AND (SELECT count(*) FROM p x WHERE x.o_custkey = n.o_custkey AND x.page > n.page AND x.page < n.np) = n.np - n.page - 1, false) AS ends
  FROM n LEFT JOIN p q ON q.o_custkey = n.o_custkey AND q.page = n.np""")
def part_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are pages; one page number is left out after each urgent order."""
    kind = F.when(F.col("o_orderstatus") == "F", "music").when(F.col("o_orderstatus") == "O", "other").otherwise("title")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    gaps = F.count_if(F.col("o_orderpriority") == "1-URGENT").over(w.rowsBetween(Window.unboundedPreceding, -1))
    o = read(spark, sf_dir, "orders").withColumn("page", F.row_number().over(w) + gaps)
    o = o.select("o_custkey", "o_orderkey", "page", F.nullif("o_orderpriority", F.lit("3-MEDIUM")).alias("part"), kind.alias("kind"))
    return numbering.part_ends(o, ["o_custkey"], "page", "part", "kind").select("o_orderkey", "ends")


@query("""SELECT l_suppkey, l_orderkey, arg_max(l_returnflag <> 'N', l_linenumber) AND bool_and(l_linestatus = 'F')
  AND count(DISTINCT l_linenumber) = max(l_linenumber) AS complete FROM lineitem GROUP BY l_suppkey, l_orderkey""")
def complete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of line items of one number the first in the table counts."""
    place = [F.col(f"_metadata.{c}").alias(c) for c in ("file_name", "row_index")]
    li = read(spark, sf_dir, "lineitem").select("*", *place).withColumn("ends", F.col("l_returnflag") != "N").withColumn("seen", F.col("l_linestatus") == "F")
    return numbering.complete_runs(li, ["l_suppkey", "l_orderkey"], "l_linenumber", ["file_name", "row_index"], "ends", "seen")


@query("""SELECT c_nationkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
  HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)""")
def offers_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    every = o.agg(F.count_distinct("o_orderpriority").alias("all"))
    held = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_mktsegment")
    held = held.agg(F.count_distinct("o_orderpriority").alias("n"))
    return held.join(F.broadcast(every), F.col("n") == F.col("all")).select("c_nationkey", "c_mktsegment")


SPARSE = """CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END"""


@query(f"""SELECT o_orderkey, last_value({SPARSE} IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
  ROWS UNBOUNDED PRECEDING) AS in_force FROM orders""")
def value_in_force_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("said", F.expr(SPARSE))
    return numbering.in_force(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "said").select("o_orderkey", "in_force")


@query("""SELECT s.s_suppkey, (SELECT arg_max(c.c_custkey, (c.c_acctbal, c.c_custkey)) FROM customer c
  WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal <= s.s_acctbal) AS covering FROM supplier s""")
def covering_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("at"), "s_suppkey", F.lit(0).cast("long").alias("id"))
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("at"), F.col("c_custkey").alias("covering"), F.col("c_custkey").alias("id"))
    return numbering.as_of(s, c, ["n"], "at", "covering", "id").select("s_suppkey", "covering")


@query(f"""WITH s AS (SELECT *, {SPARSE} AS said FROM orders),
  w AS (SELECT *, last_value(said IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM s)
  SELECT o_orderkey, said FROM w WHERE said IS NOT NULL AND (prior IS NULL OR prior <> said)""")
def key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("said", F.expr(SPARSE))
    return numbering.changes(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "said").select("o_orderkey", "said")


@query("""WITH v AS (SELECT o_orderkey % 200 AS slot, o_custkey % 4 AS part, min(o_orderpriority) AS value FROM orders GROUP BY ALL),
  c AS (SELECT slot, value, count(*) AS n FROM v GROUP BY ALL HAVING count(*) >= 2),
  a AS (SELECT slot, arg_max(value, (n, value)) AS others FROM c GROUP BY slot),
  o AS (SELECT v.*, others, slot - row_number() OVER (PARTITION BY part, value, others ORDER BY slot) AS run FROM v JOIN a USING (slot) WHERE value <> others)
  SELECT part, value, others, min(slot) AS first, max(slot) AS last FROM o GROUP BY part, value, others, run""")
def key_disagreement_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 200).alias("slot"), (F.col("o_custkey") % 4).alias("part")).agg(F.min("o_orderpriority").alias("value"))
    return numbering.disagreements(v, "slot", "part", "value")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, median(l_extendedprice) OVER (PARTITION BY l_orderkey) AS m,
    count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN n < 3 THEN NULL WHEN p > 1.8 * m THEN 'wide' WHEN p < 0.4 * m THEN 'narrow' END AS odd FROM m""")
def odd_values_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.odd_against_median(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_extendedprice").select("l_orderkey", "l_linenumber", "odd")


@query("""WITH r AS (SELECT l_orderkey, l_returnflag AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem),
  m AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY l_orderkey ORDER BY rn) THEN 0 ELSE 1 END AS new FROM r),
  k AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS UNBOUNDED PRECEDING) AS run FROM m),
  g AS (SELECT l_orderkey, run, any_value(v) AS v, count(*) AS n FROM k GROUP BY l_orderkey, run)
  SELECT l_orderkey, string_agg(CASE WHEN n = 1 THEN v ELSE v || '*' || n END, ' ' ORDER BY run) AS text FROM g GROUP BY l_orderkey""")
def run_length_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.run_length_text(read(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_returnflag")


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem),
  r AS (SELECT *, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS run FROM d),
  g AS (SELECT l_suppkey, min(l_orderkey) AS a, max(l_orderkey) AS b FROM r GROUP BY l_suppkey, run)
  SELECT l_suppkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS spans FROM g GROUP BY l_suppkey""")
def run_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.compact_runs(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey")


@query("""WITH s AS (SELECT *, lag(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  t AS (SELECT *, CASE WHEN b IS NULL OR value < b THEN round(value * 100) ELSE round(value * 100) - round(b * 100) END AS step FROM s)
  SELECT event_id, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM t""")
def reset_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return activity.reset_cumulative(e, ["user_id"], "cents", ["ts", "event_id"]).select("event_id", "total")


@query("""WITH g AS (SELECT event_id, user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
  m AS (SELECT user_id, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS l FROM g GROUP BY user_id),
  n AS (SELECT g.*, CASE WHEN gap > 1.6 * l[len(l) // 2 + 1] THEN 1 ELSE 0 END AS new FROM g JOIN m USING (user_id))
  SELECT event_id, CAST(1 + sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS system FROM n""")
def systems_by_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", micros(F.col("ts")).alias("t"))
    return activity.systems_by_gap(e, ["user_id"], "t", "event_id").select("event_id", "system")


@query("""SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 100""")
def backup_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.newest(read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 100).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_custkey, arg_min(o_orderkey, (o_orderpriority, -epoch_us(o_orderdate), o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def newest_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = activity.newest(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderpriority"), F.desc("o_orderdate"), F.col("o_orderkey")], 1)
    return out.select("o_custkey", "o_orderkey")


@query("""WITH r AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= 90000000 THEN 0 ELSE 1 END AS new FROM events),
  k AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r)
  SELECT user_id, event_type, epoch_us(min(ts)) AS t, epoch_us(max(ts)) AS t_end, count(*) AS n FROM k GROUP BY user_id, event_type, run""")
def event_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.coalesced(log(spark, sf_dir), ["user_id", "event_type"], gap=90 * US).drop("run")


SIDES = """t AS (SELECT s_nationkey AS n, s_suppkey AS t_id, s_acctbal AS t_at FROM supplier),
  f AS (SELECT c_nationkey AS n, c_custkey AS f_id, c_acctbal AS f_at FROM customer)"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s, c = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "customer")
    return (
        s.select(F.col("s_nationkey").alias("n"), F.col("s_suppkey").alias("t_id"), F.col("s_acctbal").alias("t_at")),
        c.select(F.col("c_nationkey").alias("n"), F.col("c_custkey").alias("f_id"), F.col("c_acctbal").alias("f_at")),
    )


@query(f"""WITH {SIDES}, p AS (SELECT t.n, t_id, f_id, abs(t_at - f_at) AS d FROM t JOIN f ON t.n = f.n WHERE abs(t_at - f_at) <= 50)
  SELECT n, t_id, arg_min(f_id, (d, f_id)) AS f_id FROM p GROUP BY n, t_id""")
def nearest_within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f = sides(spark, sf_dir)
    return matching.nearest_within(t, f, ["n"], "t_id", "f_id", "t_at", "f_at", 50.0).drop("distance")


@query(f"""WITH {SIDES}, k AS (SELECT n FROM t UNION SELECT n FROM f)
  SELECT k.n, (SELECT count(*) FROM t WHERE t.n = k.n) AS "true",
  (SELECT count(*) FROM t WHERE t.n = k.n AND EXISTS (SELECT 1 FROM f WHERE f.n = t.n AND abs(t_at - f_at) < 20)) AS found,
  (SELECT count(*) FROM t WHERE t.n = k.n AND NOT EXISTS (SELECT 1 FROM f WHERE f.n = t.n AND abs(t_at - f_at) < 20)) AS missed,
  (SELECT count(*) FROM f WHERE f.n = k.n AND NOT EXISTS (SELECT 1 FROM t WHERE f.n = t.n AND abs(t_at - f_at) < 20)) AS extra FROM k""")
def semi_anti_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f = sides(spark, sf_dir)
    return matching.found_missed_extra(t, f, ["n"], "t_at", "f_at", "t_id", "f_id", 20.0)


@query(f"""WITH RECURSIVE {SIDES}, p AS (SELECT t.n, t_id, f_id, abs(t_at - f_at) AS d, row_number() OVER (PARTITION BY t.n ORDER BY abs(t_at - f_at), t_id, f_id) AS k
    FROM t JOIN f ON t.n = f.n WHERE abs(t_at - f_at) <= 50),
  g AS (SELECT n, k, t_id, f_id, d, true AS took, [t_id] AS ts, [f_id] AS fs FROM p WHERE k = 1
    UNION ALL SELECT p.n, p.k, p.t_id, p.f_id, p.d, NOT (list_contains(ts, p.t_id) OR list_contains(fs, p.f_id)),
      CASE WHEN list_contains(ts, p.t_id) OR list_contains(fs, p.f_id) THEN ts ELSE list_append(ts, p.t_id) END,
      CASE WHEN list_contains(ts, p.t_id) OR list_contains(fs, p.f_id) THEN fs ELSE list_append(fs, p.f_id) END FROM g JOIN p ON p.n = g.n AND p.k = g.k + 1)
  SELECT n, t_id, f_id, round(d, 6) AS distance FROM g WHERE took""")
def greedy_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, f = sides(spark, sf_dir)
    return matching.greedy_one_to_one(t, f, ["n"], "t_id", "f_id", "t_at", "f_at", 50.0).withColumn("distance", F.round("distance", 6))


@query("""WITH RECURSIVE r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_extendedprice) AS k FROM lineitem),
  g AS (SELECT *, true AS kept, [l_extendedprice] AS xs FROM r WHERE k = 1
    UNION ALL SELECT r.*, len(list_filter(xs, lambda x: abs(x - r.l_extendedprice) < 5000)) = 0,
      CASE WHEN len(list_filter(xs, lambda x: abs(x - r.l_extendedprice) < 5000)) = 0 THEN list_append(xs, r.l_extendedprice) ELSE xs END FROM g JOIN r ON r.l_orderkey = g.l_orderkey AND r.k = g.k + 1)
  SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS "row", l_extendedprice, l_quantity FROM g WHERE kept""")
def strongest_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("row"), "l_extendedprice", "l_quantity")
    return matching.suppressed(li, ["l_orderkey"], "row", "l_extendedprice", "l_quantity", 5000.0)


@query("""WITH RECURSIVE p AS (SELECT p_brand, p_partkey AS id, CAST(p_size AS DOUBLE) AS lo, p_size + p_retailprice % 7 AS hi FROM part),
  t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY lo, id) AS k FROM p WHERE id % 2 = 0),
  f AS (SELECT p_brand, list({'id': id, 'lo': lo, 'hi': hi} ORDER BY lo, id) AS fs FROM p WHERE id % 2 = 1 GROUP BY p_brand),
  g AS (SELECT p_brand, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS t_id, CAST(NULL AS BIGINT) AS f_id, coalesce(fs, []) AS fs FROM (SELECT DISTINCT p_brand FROM t) LEFT JOIN f USING (p_brand)
    UNION ALL SELECT t.p_brand, t.k, t.id, list_filter(g.fs, lambda x: abs(x.lo - t.lo) <= 1 AND abs(x.hi - t.hi) <= 1)[1].id,
      list_filter(g.fs, lambda x: x.id IS DISTINCT FROM list_filter(g.fs, lambda y: abs(y.lo - t.lo) <= 1 AND abs(y.hi - t.hi) <= 1)[1].id) FROM g JOIN t ON t.p_brand = g.p_brand AND t.k = g.k + 1)
  SELECT p_brand, t_id, f_id FROM g WHERE k > 0""")
def first_fit_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("lo"), (F.col("p_size") + F.col("p_retailprice") % 7).alias("hi"))
    t = p.where("p_partkey % 2 = 0").select("p_brand", F.col("p_partkey").alias("t_id"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"))
    f = p.where("p_partkey % 2 = 1").select("p_brand", F.col("p_partkey").alias("f_id"), F.col("lo").alias("f_lo"), F.col("hi").alias("f_hi"))
    return matching.first_fit(t, f, ["p_brand"], ["t_id", "t_lo", "t_hi"], ["f_id", "f_lo", "f_hi"], 1.0)


@query("""WITH RECURSIVE p AS (SELECT l_orderkey AS k, l_extendedprice AS x, l_linenumber % 3 AS v,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, CAST(l_linenumber % 3 AS VARCHAR)) AS rn FROM lineitem),
  g AS (SELECT k, rn, x, v, x AS first FROM p WHERE rn = 1
    UNION ALL SELECT p.k, p.rn, p.x, p.v, CASE WHEN p.x - g.first <= 5000 THEN g.first ELSE p.x END FROM g JOIN p ON p.k = g.k AND p.rn = g.rn + 1)
  SELECT k AS l_orderkey, round(avg(x), 4) AS at, count(DISTINCT v) AS voters FROM g GROUP BY k, first HAVING count(DISTINCT v) >= 2""")
def anchored_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumn("voter", F.col("l_linenumber") % 3)
    out = matching.vote(li, ["l_orderkey"], "l_extendedprice", "voter", 5000.0, 2)
    return out.select("l_orderkey", F.round("at", 4).alias("at"), "voters")


@query("""WITH m AS (SELECT o_custkey, o_orderkey AS mark, epoch_us(o_orderdate) / 86400000000.0 AS x FROM orders WHERE o_orderkey % 2 = 0),
  b AS (SELECT o_custkey, o_orderkey AS box, epoch_us(o_orderdate) / 86400000000.0 AS lo FROM orders WHERE o_orderkey % 2 = 1),
  p AS (SELECT o_custkey, mark, box, CASE WHEN x >= lo AND x < lo + 30 THEN 1 WHEN lo > x THEN 2 ELSE 3 END AS rule,
    CASE WHEN x >= lo AND x < lo + 30 THEN lo WHEN lo > x THEN lo - x ELSE x - lo END AS o FROM m JOIN b USING (o_custkey))
  SELECT o_custkey, mark, arg_min(box, (rule, o, box)) AS box, min(rule) AS rule FROM p GROUP BY o_custkey, mark""")
def interval_join_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("day", micros(F.col("o_orderdate")) / 86400000000.0)
    marks = o.where("o_orderkey % 2 = 0").select("o_custkey", F.col("o_orderkey").alias("mark"), F.col("day").alias("x"))
    boxes = o.where("o_orderkey % 2 = 1").select("o_custkey", F.col("o_orderkey").alias("box"), F.col("day").alias("lo"))
    return matching.owners(marks, boxes, ["o_custkey"], "mark", "box", "x", "lo", 30.0)


@query("""WITH b AS (SELECT p_partkey AS id, p_brand, p_type, p_size * 1.0 AS l, p_retailprice % 50 AS t, p_size + 10.0 AS r, p_retailprice % 50 + 10 AS d FROM part),
  p AS (SELECT a.id AS a, b.id AS b, greatest(least(a.r, b.r) - greatest(a.l, b.l), 0) * greatest(least(a.d, b.d) - greatest(a.t, b.t), 0) AS i
    FROM b a JOIN b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.id < b.id)
  SELECT a, b, round(i / (200 - i), 6) AS iou FROM p WHERE i / (200 - i) > 0.25""")
def box_iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("p_retailprice") % 50
    p = read(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey", F.col("p_size").cast("double").alias("l"), t.alias("t"), (F.col("p_size") + 10.0).alias("r"), (t + 10).alias("d"))
    out = matching.overlapping(p, ["p_brand", "p_type"], "p_partkey", ["l", "t", "r", "d"], 0.25, 10.0, 10.0)
    return out.select("a", "b", F.round("iou", 6).alias("iou"))


@query("""SELECT 'all' AS level, 'all' AS key, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity, count(*) FILTER (l_discount > 0.05) AS cheap FROM lineitem
  UNION ALL SELECT 'l_returnflag', l_returnflag, count(*), CAST(sum(l_quantity) AS BIGINT), count(*) FILTER (l_discount > 0.05) FROM lineitem GROUP BY l_returnflag
  UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), CAST(sum(l_quantity) AS BIGINT), count(*) FILTER (l_discount > 0.05) FROM lineitem GROUP BY l_linestatus""")
def score_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = {"n": F.lit(1).cast("long"), "quantity": F.col("l_quantity").cast("long"), "cheap": (F.col("l_discount") > 0.05).cast("long")}
    return evaluation.tally(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], m)


THRESHOLDS = [float(x) for x in range(250, 5000, 250)]
SWEEP = """r AS (SELECT n_chars AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
  t AS (SELECT CAST(unnest(range(250, 5000, 250)) AS DOUBLE) AS threshold),
  w AS (SELECT threshold, count(*) FILTER (s >= threshold AND y) AS found, count(*) FILTER (s >= threshold AND NOT y) AS "false",
    count(*) FILTER (s < threshold AND y) AS missed FROM r, t GROUP BY threshold)"""


def swept(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return evaluation.sweep(r.withColumn("y", F.col("quality") == 1), "n_chars", "y", THRESHOLDS)


@query(f"""WITH {SWEEP} SELECT threshold, found, "false", missed, round(2.0 * found / (2 * found + "false" + missed), 9) AS f1, "false" + missed AS errors FROM w""")
def f1_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swept(spark, sf_dir).withColumn("f1", F.round("f1", 9))


@query(f"""WITH {SWEEP} SELECT arg_max(threshold, (2.0 * found / (2 * found + "false" + missed), -threshold)) AS threshold FROM w""")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_f1(swept(spark, sf_dir)).select("threshold")


@query(f"""WITH {SWEEP} SELECT arg_min(threshold, ("false" + missed, threshold)) AS threshold, min("false" + missed) AS errors FROM w""")
def threshold_min_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.fewest_errors(swept(spark, sf_dir))


@query("""WITH r AS (SELECT doc_id, n_chars AS s, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
  k AS (SELECT s, row_number() OVER (ORDER BY s, doc_id) AS rn, count(*) OVER () AS n FROM r WHERE y), c AS (SELECT s AS cut FROM k WHERE rn = floor(n * 0.05) + 1)
  SELECT cut, count(*) FILTER (y AND s >= cut) AS kept, count(*) FILTER (NOT y AND s < cut) AS caught FROM r, c GROUP BY cut""")
def order_statistic_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return evaluation.order_statistic_cut(r.withColumn("y", F.col("quality") == 1), "n_chars", "y", 0.05)


@query("""WITH r AS (SELECT DISTINCT p_brand AS g, p_type AS i FROM part), n AS (SELECT g, count(*) AS n FROM r GROUP BY g),
  b AS (SELECT x.g AS a, y.g AS b, count(*) AS k FROM r x JOIN r y ON x.i = y.i AND x.g < y.g GROUP BY ALL)
  SELECT a, b, k AS "both", na.n + nb.n - k AS either, round(k / (na.n + nb.n - k), 9) AS jaccard FROM b JOIN n na ON na.g = a JOIN n nb ON nb.g = b""")
def pairwise_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = matching.pairwise_jaccard(read(spark, sf_dir, "part"), "p_brand", "p_type")
    return out.withColumn("jaccard", F.round("jaccard", 9))


@query("""WITH i AS (SELECT p_brand, p_partkey, p_size * 100.0 AS lo, p_size * 100.0 + p_retailprice % 40 AS hi FROM part)
  SELECT p_brand, p_partkey, round(greatest(lo - max(hi) OVER (PARTITION BY p_brand ORDER BY lo, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS above,
    round(greatest(lead(lo) OVER (PARTITION BY p_brand ORDER BY lo, p_partkey) - hi, 0), 6) AS below FROM i""")
def rooms_to_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").withColumn("lo", F.col("p_size") * 100.0).withColumn("hi", F.col("lo") + F.col("p_retailprice") % 40)
    out = matching.rooms(p, ["p_brand"], "p_partkey", "lo", "hi")
    first = lambda c: F.round(c, 6).alias(c)
    return out.select("p_brand", "p_partkey", first("above"), first("below"))


@query("""WITH g AS (SELECT o_orderpriority AS p, date_diff('day', CAST(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE), CAST(o_orderdate AS DATE)) AS v FROM orders),
  c AS (SELECT p, v, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY ALL),
  s AS (SELECT p, v, sum(n) OVER w AS s, sum(n * v) OVER w / sum(n) OVER w AS m FROM c WINDOW w AS (PARTITION BY p ORDER BY v RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING))
  SELECT p AS o_orderpriority, CAST(arg_max(v, (s, -v)) AS BIGINT) AS mode, round(arg_max(m, (s, -v)), 9) AS mean FROM s GROUP BY p""")
def staff_gap_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    gap = F.datediff(F.to_date("o_orderdate"), F.to_date(F.lag("o_orderdate").over(w)))
    o = read(spark, sf_dir, "orders").withColumn("gap", gap).where("gap is not null")
    return matching.histogram_mode(o, ["o_orderpriority"], "gap").withColumn("mean", F.round("mean", 9))


@query("""SELECT doc_id, CASE WHEN CAST(('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < 0.2 OR source IN ('src3', 'src7')
  THEN 'test' ELSE 'train' END AS split FROM documents""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source")
    return evaluation.hash_split(d, F.col("doc_id").cast("string"), 0.2, ["src3", "src7"], F.col("source")).select("doc_id", "split")


@query("""WITH f AS (SELECT CAST(floor(CAST(('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 * 5) AS BIGINT) AS fold,
    n_chars >= 500 AS said, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
  s AS (SELECT fold, count(*) FILTER (said AND y) / count(*) FILTER (y) AS r, count(*) FILTER (said AND y) / count(*) FILTER (said) AS p FROM f GROUP BY fold)
  SELECT count(*) AS folds, round(avg(r), 9) AS recall, round(stddev_pop(r), 9) AS recall_sd, round(avg(p), 9) AS precision, round(stddev_pop(p), 9) AS precision_sd FROM s""")
def crossval_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    d = evaluation.folds(d, F.col("doc_id").cast("string"), 5).withColumn("said", F.col("n_chars") >= 500).withColumn("y", F.col("quality") == 1)
    per = d.groupBy("fold").agg(
        (F.count_if(F.col("said") & F.col("y")) / F.count_if("y")).alias("r"), (F.count_if(F.col("said") & F.col("y")) / F.count_if("said")).alias("p")
    )
    return per.agg(
        F.count("*").alias("folds"), F.round(F.avg("r"), 9).alias("recall"), F.round(F.stddev_pop("r"), 9).alias("recall_sd"),
        F.round(F.avg("p"), 9).alias("precision"), F.round(F.stddev_pop("p"), 9).alias("precision_sd"),
    )


@query("""WITH r AS (SELECT n_chars AS t, CASE WHEN doc_id % 3 > 0 THEN n_chars + doc_id % 11 END AS a, CASE WHEN doc_id % 4 > 0 THEN n_chars - doc_id % 23 END AS b FROM documents),
  e AS (SELECT a, b, a IS NOT NULL AND b IS NOT NULL AND t IS NOT NULL AS k, abs(a - t) AS x, abs(b - t) AS y FROM r)
  SELECT count(*) FILTER (k) AS "both", CAST(median(x) FILTER (k) AS DOUBLE) AS a_median, count(*) FILTER (k AND x <= 5) AS a_near, count(*) FILTER (k AND x > 9) AS a_far,
    CAST(median(y) FILTER (k) AS DOUBLE) AS b_median, count(*) FILTER (k AND y <= 5) AS b_near, count(*) FILTER (k AND y > 9) AS b_far,
    count(*) FILTER (a IS NULL) AS a_none, count(*) FILTER (b IS NULL) AS b_none FROM e""")
def both_answer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(
        F.col("n_chars").alias("t"), F.expr("CASE WHEN doc_id % 3 > 0 THEN n_chars + doc_id % 11 END").alias("a"),
        F.expr("CASE WHEN doc_id % 4 > 0 THEN n_chars - doc_id % 23 END").alias("b"),
    )
    return evaluation.both_answer(d, "a", "b", "t", 5, 9)


@query("""WITH o AS (SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey % 10 > 0),
  n AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Brand#0' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 10 <> 3),
  j AS (SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added' WHEN n.p_partkey IS NULL THEN 'removed'
      WHEN o.p_brand <> n.p_brand OR o.p_size <> n.p_size THEN 'changed' END AS change,
    CASE WHEN o.p_partkey IS NULL OR n.p_partkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.p_brand <> n.p_brand THEN 'p_brand' END, CASE WHEN o.p_size <> n.p_size THEN 'p_size' END) END AS fields
    FROM o FULL JOIN n ON o.p_partkey = n.p_partkey)
  SELECT * FROM j WHERE change IS NOT NULL""")
def edit_diff_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    new = p.where("p_partkey % 10 <> 3").withColumn("p_brand", F.expr("CASE WHEN p_partkey % 7 = 0 THEN 'Brand#0' ELSE p_brand END"))
    new = new.withColumn("p_size", F.expr("CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END"))
    return evaluation.edits(p.where("p_partkey % 10 > 0"), new, "p_partkey", ["p_brand", "p_size"])


@query("""WITH a AS (SELECT doc_id, lang, n_chars % 5 AS n FROM documents WHERE doc_id % 9 > 0),
  b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 13 = 0 THEN 9 ELSE n_chars % 5 END AS n FROM documents WHERE doc_id % 8 > 0)
  SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'only second' WHEN b.doc_id IS NULL THEN 'only first'
    WHEN a.lang IS DISTINCT FROM b.lang THEN 'other lang' WHEN a.n IS DISTINCT FROM b.n THEN 'other n' ELSE 'agreed' END AS verdict FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def both_readers_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") % 5).alias("n"))
    b = d.where("doc_id % 8 > 0").withColumn("lang", F.expr("CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END"))
    b = b.withColumn("n", F.expr("CASE WHEN doc_id % 13 = 0 THEN 9 ELSE n END"))
    return evaluation.readers_agree(d.where("doc_id % 9 > 0"), b, "doc_id", ["lang", "n"])


@query("""SELECT coalesce(CASE WHEN url LIKE '%page=%' THEN 'paged' WHEN url LIKE '%utm_source%' THEN 'tracked' WHEN url LIKE '%.html%' THEN 'file' WHEN url LIKE '%#%' THEN 'anchor' END, 'plain') AS reason,
  count(*) AS n FROM pages GROUP BY 1""")
def reason_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    rules = [("paged", u.contains("page=")), ("tracked", u.contains("utm_source")), ("file", u.contains(".html")), ("anchor", u.contains("#"))]
    reason = F.coalesce(evaluation.first_reason(rules), F.lit("plain"))
    return read(spark, sf_dir, "pages").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'poor' WHEN b.item_id IS NOT NULL THEN 'tested' ELSE 'kept' END AS status
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def fourway_reason_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").withColumn("l", F.lit(1)), "doc_id", "left")
    d = d.join(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(1).alias("b")), "doc_id", "left")
    rules = [("unlabelled", F.col("l").isNull()), ("toxic", F.col("toxic") == 1), ("poor", F.col("quality") == 0), ("tested", F.col("b").isNotNull())]
    return d.select("doc_id", F.coalesce(evaluation.first_reason(rules), F.lit("kept")).alias("status"))


@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
  SELECT source, CAST(sum(n) AS BIGINT) AS n, arg_min(lang, (-n, lang)) AS kind FROM c GROUP BY source""")
def mark_text_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.popular(read(spark, sf_dir, "documents").select("source", "lang"), "source", "lang")


TURNS = """w AS (SELECT conv_id, turn, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS a FROM conversations),
  p AS (SELECT conv_id, turn, a, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each turn (a) and of the next (b)."""
    words = F.filter(F.split(F.lower("text"), " ", -1), lambda x: x != "")
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("a"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.withColumn("b", F.lead("a").over(w)).where("b is not null")


@query(f"""WITH RECURSIVE {TURNS}, r AS (SELECT conv_id, turn, a, b, 0 AS i, range(0, len(b) + 1) AS row FROM p WHERE b IS NOT NULL
    UNION ALL SELECT conv_id, turn, a, b, i + 1, list_transform(best, lambda x, j: list_min(list_transform(best[1:j], lambda y, k: y + j - k)))
    FROM (SELECT conv_id, turn, a, b, i, list_concat([CAST(i + 1 AS BIGINT)], list_transform(b, lambda y, j: least(row[j + 1] + 1,
      row[j] + CASE WHEN y = a[i + 1] THEN 0 ELSE 1 END))) AS best FROM r WHERE i < len(a)))
  SELECT conv_id, turn, CAST(row[len(b) + 1] AS BIGINT) AS distance FROM r WHERE i = len(a)""")
def edit_distance_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", alignment.whole_distance("a", "b").cast("long").alias("distance"))


@query(f"""WITH RECURSIVE {TURNS}, r AS (SELECT conv_id, turn, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: CAST(j AS DOUBLE)) AS row FROM p WHERE b IS NOT NULL
    UNION ALL SELECT conv_id, turn, a, b, i + 1, list_transform(best, lambda x, j: list_min(list_transform(best[1:j], lambda y, k: y + j - k)))
    FROM (SELECT conv_id, turn, a, b, i, list_concat([i + 1.0], list_transform(b, lambda y, j: least(row[j + 1] + 1,
      row[j] + CASE WHEN y = a[i + 1] THEN 0.0 WHEN y[1:1] = a[i + 1][1:1] THEN 0.5 ELSE 1.0 END))) AS best FROM r WHERE i < len(a)))
  SELECT conv_id, turn, round(row[len(b) + 1] / greatest(len(a), len(b), 1), 6) AS unlike FROM r WHERE i = len(a)""")
def token_unlike_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = lambda c: F.transform(c, lambda x: F.substring(x, 1, 1))
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(alignment.whole_unlikeness("a", "b", head("a"), head("b")), 6).alias("unlike"))


@query(f"""WITH {TURNS}, c AS (SELECT a = b AS exact, list_transform(a, lambda x: length(x)) = list_transform(b, lambda x: length(x)) AS rhythm,
    list_transform(a, lambda x: x[1:1]) = list_transform(b, lambda x: x[1:1]) AS pitch FROM p WHERE b IS NOT NULL)
  SELECT count(*) AS bars, count(*) FILTER (exact) AS exact, count(*) FILTER (rhythm) AS rhythm, count(*) FILTER (pitch) AS pitch FROM c""")
def bars_exact_rhythm_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda c: F.transform(c, F.length)
    head = lambda c: F.transform(c, lambda x: F.substring(x, 1, 1))
    return turns(spark, sf_dir).agg(
        F.count("*").alias("bars"), F.count_if(F.col("a") == F.col("b")).alias("exact"), F.count_if(size("a") == size("b")).alias("rhythm"),
        F.count_if(head("a") == head("b")).alias("pitch"),
    )


@query()
def banded_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next; a conversation's only turn with nothing."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.lower("text"), " ").alias("a"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = c.withColumn("b", F.lead("a").over(w)).withColumn("next", F.lead("turn").over(w)).withColumn("last", F.lag("turn").over(w))
    return alignment.align_arrays(pairs.where("next is not null or last is null"), ["conv_id", "turn"], "a", "b")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), s AS (SELECT vec_id, list_transform(a, lambda x: CAST(round(x * 10) AS BIGINT)) AS a FROM e),
  p AS (SELECT vec_id, a, lead(a) OVER (ORDER BY vec_id) AS b FROM s),
  d AS (SELECT vec_id, list_distinct(list_transform(range(1, len(a) + 1), lambda i: b[i] - a[i])) AS k FROM p WHERE b IS NOT NULL)
  SELECT vec_id, CASE WHEN len(k) = 1 THEN k[1] END AS shift FROM d""")
def step_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double") * 10).cast("long")).alias("a"))
    e = with_next(e, "vec_id", "a", "b").where("b is not null")
    return e.select("vec_id", evaluation.step_shift(F.col("a"), F.col("b")).alias("shift"))


@query("""WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, lead(CAST(embedding AS DOUBLE[])) OVER (ORDER BY vec_id) AS b FROM embeddings),
  u AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM p WHERE b IS NOT NULL)
  SELECT vec_id, round(corr(x, y), 6) AS r FROM u GROUP BY vec_id""")
def twin_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    e = with_next(e, "vec_id", "a", "b").where("b is not null")
    pairs = e.select("vec_id", F.explode(F.arrays_zip("a", "b")).alias("p"))
    return pairs.groupBy("vec_id").agg(F.round(F.corr("p.a", "p.b"), 6).alias("r"))


@query("""SELECT p_partkey, len(list_filter(string_split(p_type, ' '), lambda x: NOT list_contains(['STANDARD', 'SMALL', 'TIN', 'BRASS', 'PLATED'], x))) = 0 AS labellable FROM part""")
def labellable_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(*map(F.lit, ["STANDARD", "SMALL", "TIN", "BRASS", "PLATED"]))
    return read(spark, sf_dir, "part").select("p_partkey", (F.size(F.array_except(F.split("p_type", " "), allowed)) == 0).alias("labellable"))


@query("""SELECT page_id, row_number() OVER (PARTITION BY page_id // 500 ORDER BY page_id % 500 < 100, page_id) AS turn FROM pages""")
def wrap_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.floor(F.col("page_id") / 500)
    p = numbering.wrapped_order(read(spark, sf_dir, "pages").select("page_id", (F.col("page_id") - block * 500).alias("at"), block.alias("block")), "at", 100)
    return p.select("page_id", F.row_number().over(Window.partitionBy("block").orderBy("place")).cast("long").alias("turn"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) // 86400000000 AS d, lag(epoch_us(l_shipdate) // 86400000000) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS b FROM lineitem)
  SELECT l_orderkey, l_linenumber, b AS x0, d AS x1 FROM x WHERE b IS NOT NULL""")
def bar_x_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey")
    day = F.floor(micros(F.col("l_shipdate")) / 86400000000).cast("long")
    li = read(spark, sf_dir, "lineitem").withColumn("x1", day)
    return li.withColumn("x0", F.lag("x1").over(w)).where("x0 is not null").select("l_orderkey", "l_linenumber", "x0", "x1")


@query("""WITH a AS (SELECT p_partkey, p_size % 4 AS s FROM part), b AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 9 ELSE p_size % 4 END AS s FROM part)
  SELECT CASE WHEN b.s IS NULL THEN 'not kept' WHEN a.s = b.s THEN 'same' ELSE 'other' END AS status, count(*) AS n FROM a JOIN b USING (p_partkey) GROUP BY 1""")
def before_after_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("a"), "p_partkey")
    b = F.expr("CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 9 ELSE a END")
    status = evaluation.first_reason([("not kept", b.isNull()), ("same", b == F.col("a")), ("other", F.lit(True))])
    return p.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labels document per customer as JSON text: an order is a page, a line item a staff with one bar line."""
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    li = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("s-"), key).alias("id"), (F.col("l_linenumber") * 1.0).alias("top"), (F.col("l_linenumber") + 0.5).alias("bottom"), F.lit(0.0).alias("left"), F.lit(1.0).alias("right"),
        (F.col("l_linenumber") * 3 - 10).cast("int").alias("key"),
        F.array(F.struct(F.concat(F.lit("b-"), key).alias("id"), F.col("l_discount").alias("x0"), F.when(F.col("l_tax") < 0.08, F.col("l_discount") + 1).alias("x1"),
            F.when(F.col("l_returnflag") == "R", "final").otherwise("single").alias("kind"),
            (F.col("l_quantity").cast("int") % 3).alias("bar_count"), (F.col("l_returnflag") == "R").alias("ends_movement"))).alias("barlines"),
    ))).alias("systems"))
    o = read(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    mark = F.array(F.struct(
        F.concat_ws("-", F.lit("m"), "o_custkey").alias("id"), F.lit(0.1).alias("x"), F.lit(0.1).alias("y"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"),
        F.lit("clef").alias("kind"), F.col("o_orderpriority").alias("text"),
    ))
    page = F.struct(
        F.when(F.col("o_orderstatus") == "F", "reviewed").when(F.col("o_orderstatus") == "O", "edited").otherwise("pending").alias("status"),
        F.lit("music").alias("kind"), F.element_at(F.array(*map(F.lit, documents.PARTS)), (F.col("o_custkey") % 4 + 1).cast("int")).alias("part"), "systems",
        F.when(F.col("o_orderkey") % 5 == 0, mark).alias("marks"),
    )
    pages = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("key"), page.alias("value")))))
    docs = o.groupBy("o_custkey").agg(pages.alias("pages"))
    source = F.struct(F.concat(F.lit("c"), "o_custkey").alias("pdf"))
    raw = F.to_json(F.struct((F.col("o_custkey") % 7).cast("int").alias("schema"), source.alias("source"), "pages"))
    return docs.select("o_custkey", raw.alias("raw")).withColumn("doc", F.from_json("raw", documents.DOCUMENT))


@query("""SELECT o_custkey, o_orderkey AS page, count(l_orderkey) AS staves, CAST(coalesce(sum(CAST(l_quantity AS INT) % 3), 0) AS BIGINT) AS bars
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(l_orderkey) > 0""")
def json_doc_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents.pages(order_documents(spark, sf_dir), ["o_custkey"])
    lines = documents.barlines(documents.systems(pages, ["o_custkey"]), ["o_custkey"])
    return lines.groupBy("o_custkey", F.col("page").cast("long").alias("page")).agg(F.count("*").alias("staves"), F.sum("bar_count").cast("long").alias("bars"))


@query("""WITH b AS (SELECT o_custkey, l_orderkey AS page, 's-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS system, CAST(l_quantity AS INT) % 3 AS c, CAST(l_returnflag = 'R' AS INT) AS e,
    o_orderstatus = 'F' AS reviewed, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, 's-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey, l_discount,
      CASE WHEN l_tax < 0.08 THEN l_discount + 1 END NULLS FIRST, CASE WHEN l_returnflag = 'R' THEN 'final' ELSE 'single' END, CAST(l_quantity AS INT) % 3) AS k
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  m AS (SELECT *, CAST(1 + coalesce(sum(e) OVER (PARTITION BY o_custkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS mv FROM b)
  SELECT o_custkey, CAST(k - 1 AS BIGINT) AS "order", page, system, CASE WHEN mv <= 10 THEN ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'][mv] ELSE CAST(CAST(mv AS BIGINT) AS VARCHAR) END AS movement,
    CAST(1 + coalesce(sum(c) OVER (PARTITION BY o_custkey, mv ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - CASE WHEN c = 0 THEN 1 ELSE 0 END AS BIGINT) AS bar, reviewed FROM m""")
def bars_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents.pages(order_documents(spark, sf_dir), ["o_custkey"])
    out = bars.bars_export(pages, ["o_custkey"])
    return out.select("o_custkey", F.col("order").cast("long").alias("order"), F.col("page").cast("long").alias("page"), "system", "movement", "bar", "reviewed")


@query("""WITH l AS (SELECT o_custkey, l.*, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS k,
    'page ' || l_orderkey || ' system s-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS w,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey) AS copy FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
  m AS (SELECT o_custkey, 'page ' || o_orderkey || ' mark m-' || o_custkey AS w, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS copy FROM orders WHERE o_orderkey % 5 = 0),
  c AS (SELECT DISTINCT o_custkey, 'schema must be 5' AS p FROM orders WHERE o_custkey % 7 <> 5
    UNION ALL SELECT o_custkey, 'page ' || o_orderkey || ': bad status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT o_custkey, 'page 0: page keys are page numbers from 1' FROM orders WHERE o_orderkey = 0
    UNION ALL SELECT o_custkey, w || ': bad key' FROM l WHERE l_linenumber * 3 - 10 NOT BETWEEN -7 AND 7
    UNION ALL SELECT o_custkey, w || ' barline b-' || k || ': x0 and x1 must be numbers' FROM l WHERE NOT l_tax < 0.08
    UNION ALL SELECT o_custkey, w || ': duplicate id s-' || k FROM l WHERE copy > 1
    UNION ALL SELECT o_custkey, w || ' barline b-' || k || ': duplicate id b-' || k FROM l WHERE copy > 1
    UNION ALL SELECT o_custkey, w || ': bad kind' FROM m
    UNION ALL SELECT o_custkey, w || ': duplicate id m-' || o_custkey FROM m WHERE copy > 1)
  SELECT o.o_custkey, coalesce(string_agg(p, ';' ORDER BY p), '') AS problems FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN c ON c.o_custkey = o.o_custkey GROUP BY o.o_custkey""")
def validate_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents.problems(order_documents(spark, sf_dir).select("o_custkey", "raw"), ["o_custkey"])
    return out.select("o_custkey", F.array_join("problems", ";").alias("problems"))


@query("""WITH d AS (SELECT DISTINCT o_custkey, o_custkey % 7 AS v FROM orders),
  m AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY o_custkey)
  SELECT d.o_custkey, CASE WHEN v BETWEEN 1 AND 5 THEN 5 ELSE v END AS schema, CAST(CASE WHEN v BETWEEN 1 AND 2 THEN 0 ELSE coalesce(n, 0) END AS BIGINT) AS clefs FROM d LEFT JOIN m USING (o_custkey)""")
def schema_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = documents.lifted(order_documents(spark, sf_dir))
    kinds = F.flatten(F.transform(F.map_values("doc.pages"), lambda p: F.transform(F.coalesce(p["marks"], F.from_json(F.lit("[]"), f"array<struct<{documents.MARK}>>")), lambda m: m["kind"])))
    return both.select("o_custkey", F.col("doc.schema").cast("long").alias("schema"), F.size(F.filter(kinds, lambda k: k == "clef")).cast("long").alias("clefs"))


@query("""WITH t AS (SELECT p_partkey, p_size AS t, 192 // gcd(p_size, 192) AS under, p_size // gcd(p_size, 192) AS over, p_partkey % 3 + 1 AS n FROM part),
  d AS (SELECT *, CASE WHEN over = 1 AND under IN (1, 2, 4, 8, 16, 32) THEN CAST(under AS VARCHAR) WHEN over = 3 AND under IN (2, 4, 8, 16, 32, 64) THEN (under // 2) || '.' ELSE under || '*' || over END AS d FROM t)
  SELECT p_partkey, d AS name, 's' || CASE WHEN n = 1 THEN d WHEN contains(d, '*') THEN under || '*' || over * n ELSE d || '*' || n END AS spacer FROM d""")
def duration_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's size as ticks."""
    t = F.col("p_size").cast("int")
    return read(spark, sf_dir, "part").select("p_partkey", notation.duration_name(t).alias("name"), notation.spacer(t, F.col("p_partkey") % 3 + 1).alias("spacer"))


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey % 40 AS lo, o_orderkey % 40 + o_orderkey % 6 AS hi, o_orderpriority AS part FROM orders)
  SELECT o_custkey, page, arg_max(part, o_orderkey) AS part FROM (SELECT o_custkey, o_orderkey, part, CAST(unnest(range(lo, hi + 1)) AS INT) AS page FROM s) GROUP BY ALL""")
def page_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders in turn are the items of one text."""
    item = F.expr("concat(o_orderkey % 40, if(o_orderkey % 6 = 0, '', concat('-', o_orderkey % 40 + o_orderkey % 6)), ':', o_orderpriority)")
    each = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))).alias("s"))
    return notation.page_map(each.select("o_custkey", F.array_join("s.item", ",").alias("spec")), ["o_custkey"], "spec")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, CAST(l_quantity AS INT) AS q, l_linestatus, lead(struct_pack(f := l_returnflag, q := CAST(l_quantity AS INT), s := l_linestatus))
    OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS b FROM lineitem),
  d AS (SELECT *, (l_returnflag = 'R') AS ra, (b.f = 'R') AS rb FROM e WHERE b IS NOT NULL)
  SELECT CASE WHEN ra <> rb THEN CASE WHEN ra THEN 'note for rest' ELSE 'rest for note' END ELSE concat_ws(',',
    CASE WHEN NOT ra AND q % 14 <> b.q % 14 THEN CASE WHEN q % 7 = b.q % 7 THEN 'octave' ELSE 'pitch' END END,
    CASE WHEN q % 2 <> b.q % 2 OR q % 3 <> b.q % 3 THEN 'duration' END, CASE WHEN l_linestatus <> b.s THEN 'grace' END) END AS differs, count(*) AS n FROM d GROUP BY 1""")
def event_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as events, returned ones rests, each with the next of its order."""
    q = F.col("l_quantity").cast("int")
    rest = F.col("l_returnflag") == "R"
    pitches = F.when(rest, F.array().cast("array<string>")).otherwise(F.array(notation.pitch_name(q % 14 + 28)))
    event = F.struct(
        F.when(rest, "rest").otherwise("note").alias("kind"), pitches.alias("pitches"), (q % 2).cast("string").alias("dur"), (q % 3).alias("dots"),
        (F.col("l_linestatus") == "F").alias("grace"),
    )
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    pairs = read(spark, sf_dir, "lineitem").select(event.alias("a"), F.lead(event).over(w).alias("b")).where("b is not null")
    return pairs.groupBy(F.array_join(notation.what_differs(F.col("a"), F.col("b")), ",").alias("differs")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT unnest([CASE WHEN o_orderpriority LIKE '1%' THEN 'very soon' ELSE o_orderpriority END, 'by ' || o_clerk, 'status ' || o_orderstatus]) AS w FROM (SELECT *, 'x' || o_custkey % 5 AS o_clerk FROM orders)),
  p AS (SELECT CASE WHEN regexp_full_match(w, 'by x[0-3]') THEN 'one of ' || w[5:] WHEN regexp_full_match(w, 'status (F|O)') THEN 'whole: ' || w[8:] ELSE w END AS reason FROM w)
  SELECT reason, count(*) AS n FROM p GROUP BY reason""")
def explained_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array(F.concat(F.lit("reader-1: "), "o_orderpriority"), F.concat(F.lit("by x"), (F.col("o_custkey") % 5).cast("string")), F.concat(F.lit("status "), "o_orderstatus"))
    plain = notation.explained(given, [("by x([0-3])", "one of $1"), ("status (F|O)", "whole: $1"), ("1.*", "very soon")], "^reader-[0-9]+: ")
    return read(spark, sf_dir, "orders").select(F.explode(plain).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT lang, count(*) FILTER (toxic = 1 AND n_chars > 900) AS hits, count(*) FILTER (toxic = 1) AS there, count(*) FILTER (toxic = 0 AND n_chars > 900) AS "false", count(*) FILTER (toxic = 0) AS absent,
  round(count(*) FILTER (toxic = 1 AND n_chars > 900) / nullif(count(*) FILTER (toxic = 1), 0), 9) AS hit, round(count(*) FILTER (toxic = 0 AND n_chars > 900) / nullif(count(*) FILTER (toxic = 0), 0), 9) AS fa
  FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def hit_and_false_alarm_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    rates = comparison.detection_rates(rows, ["lang"], F.col("toxic") == 1, F.col("n_chars") > 900)
    return rates.withColumn("hit", F.round("hit", 9)).withColumn("fa", F.round("fa", 9)).drop("d")


@query("""WITH w AS (SELECT *, min(l_linenumber) OVER p AS lo, max(l_linenumber) OVER p AS hi FROM lineitem WINDOW p AS (PARTITION BY l_orderkey))
  SELECT l_orderkey, l_linenumber, l_partkey, greatest(lo, l_linenumber - 3) AS "from", least(hi, l_linenumber + 3) AS "to" FROM w""")
def clipped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return comparison.claim_windows(rows, ["l_orderkey"], "l_linenumber", "l_linenumber", n, n, 3)


@query("""WITH c AS (SELECT o_orderpriority AS kind, o_custkey % 3 = 0 AS t, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS r FROM orders)
  SELECT kind, count(*) FILTER (t) AS "true", count(*) FILTER (t AND r) AS accepted, count(*) FILTER (NOT t) AS moved, count(*) FILTER (NOT t AND NOT r) AS rejected FROM c GROUP BY kind""")
def claim_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return comparison.claims(read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "kind"), ["kind"], F.col("o_custkey") % 3 == 0, right)


@query("""WITH v AS (SELECT user_id, ts, event_id, event_type AS v, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events),
  s AS (SELECT user_id, array_to_string(list(v ORDER BY ts, event_id), ' ') AS sequence FROM v WHERE was IS DISTINCT FROM v GROUP BY user_id),
  c AS (SELECT user_id % 4 AS part, sequence, count(*) AS n FROM s GROUP BY ALL)
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY n DESC, sequence) AS rank, sequence, n FROM c QUALIFY rank <= 12""")
def top_merged_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent sequences of kinds of event of the users of a part, repeats merged."""
    s = comparison.merged_sequence(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    begun = s.select((F.col("user_id") % 4).alias("part"), "sequence")
    return comparison.top_sequences(begun, ["part"], 12).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH o AS (SELECT p_partkey, p_size, p_partkey % 4 > 0 AS kept, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS new FROM part)
  SELECT p_partkey, CASE WHEN NOT kept THEN 'not kept' WHEN new = p_size THEN 'same' ELSE 'other' END AS outcome,
    CASE WHEN NOT kept THEN CASE WHEN p_partkey % 8 = 0 THEN '?' ELSE p_brand END END AS reason, CASE WHEN NOT kept THEN p_partkey % 8 > 0 AND new = p_size END AS as_before FROM o JOIN part USING (p_partkey, p_size)""")
def version_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("new"))
    new = p.select("p_partkey", F.col("new").alias("p_size"), F.concat("p_brand", F.lit(" [3 at 4]")).alias("why"))
    return comparison.version_outcomes(p.select("p_partkey", "p_size"), new.where("p_partkey % 4 > 0"), new.where("p_partkey % 4 = 0 and p_partkey % 8 > 0"), "p_partkey", "p_size", "why")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS page, o_orderpriority AS method FROM orders), m AS (SELECT DISTINCT method FROM d)
  SELECT page, m.method FROM (SELECT DISTINCT page FROM d) CROSS JOIN m ANTI JOIN d USING (page, method)""")
def methods_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderpriority").alias("method"))
    return comparison.incomplete(done, done.select("method").distinct(), done, ["page"], "method")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 86400000000 AS x, o_totalprice AS sure FROM orders),
  p AS (SELECT f.o_custkey, f.o_orderkey AS f_id, t.o_orderkey AS t_id, abs(f.x - t.x) AS distance,
      row_number() OVER (PARTITION BY f.o_custkey ORDER BY f.sure DESC, f.x, f.o_orderkey, abs(f.x - t.x), t.x, t.o_orderkey) AS k
    FROM o f JOIN o t ON f.o_custkey = t.o_custkey AND f.o_orderkey % 3 > 0 AND t.o_orderkey % 3 = 0 AND abs(f.x - t.x) <= 60),
  g AS (SELECT *, true AS took, [f_id] AS fs, [t_id] AS ts FROM p WHERE k = 1
    UNION ALL SELECT p.*, NOT (list_contains(fs, p.f_id) OR list_contains(ts, p.t_id)),
      CASE WHEN list_contains(fs, p.f_id) OR list_contains(ts, p.t_id) THEN fs ELSE list_append(fs, p.f_id) END,
      CASE WHEN list_contains(fs, p.f_id) OR list_contains(ts, p.t_id) THEN ts ELSE list_append(ts, p.t_id) END FROM g JOIN p ON p.o_custkey = g.o_custkey AND p.k = g.k + 1)
  SELECT o_custkey, f_id, t_id, CAST(distance AS DOUBLE) AS distance FROM g WHERE took""")
def surest_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as found points on the days, every third as a true one."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("x"), F.col("o_totalprice").alias("sure"))
    f = o.where("o_orderkey % 3 > 0").select("o_custkey", F.col("o_orderkey").alias("f_id"), F.col("x").alias("f_at"), "sure")
    t = o.where("o_orderkey % 3 = 0").select("o_custkey", F.col("o_orderkey").alias("t_id"), F.col("x").alias("t_at"))
    return matching.surest_first(f, t, ["o_custkey"], "f_id", "t_id", "f_at", "t_at", "sure", 60.0)


@query("""SELECT n_nationkey, CASE WHEN n_nationkey + 1 BETWEEN 1 AND 10 THEN ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X'][n_nationkey + 1] ELSE CAST(n_nationkey + 1 AS VARCHAR) END AS movement FROM nation""")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", numbering.roman(F.col("n_nationkey") + 1).alias("movement"))


#: Names that the whole queries had beside partial ones; these are whole under their own names now.
for _old, _new in {
    "key_disagreement_runs_all": "key_disagreement_runs", "pairwise_jaccard_all": "pairwise_jaccard", "edit_distance_whole_turns": "edit_distance_turns",
    "whole_bars_exact_rhythm_pitch": "bars_exact_rhythm_pitch", "step_shift_whole": "step_shift",
}.items():
    QUERIES[_old] = QUERIES[_new]
    ORACLE[_old] = ORACLE[_new]
