"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed: blob = sha256 of the text. The ledger holds, for each blob and rule
version that has been scanned, the spans found. A scan takes the distinct blobs and rule versions that the ledger lacks,
scans each blob's text once, appends to the ledger, and joins the findings back to all paths that hold the blob. Changing
one rule's version rescans that rule alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import remove_at_exit, shared_dir
from .common import free_name, materialize

#: (kind, version, pattern, group whose length counts, least length), in the order in which kinds are listed.
RULES = [
    ("assign", 1, r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", 1, r"(AKIA[A-Z0-9]{12,})", 1, 16),
    ("hex", 1, r"([0-9a-f]{32,})", 1, 32),
    ("pem", 1, r"(-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)", 1, 1),
    ("jwt", 1, r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1),
]
#: Kinds of the base; the others are added by this operator.
BASE = ("assign", "access", "hex")
#: So many blobs with findings at most are broadcast (some MB) to their paths; more are joined by a shuffle.
BROADCAST_BLOBS = 20_000
LEDGER_SCHEMA = "blob string, kind string, version int, spans array<struct<start:int,end:int>>"


def matches_of(text: Column, pattern: str, group: int) -> Column:
    """The leftmost non-overlapping matches in turn: length of the text since the match before, of the match, of the group.

    The text between matches (split) and the matches (extract all) alternate, so running sums of lengths are offsets.
    """
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, p, 0), F.length)
    measured = F.transform(F.regexp_extract_all(text, p, group), F.length)
    found = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), measured.alias("by")), lambda m: m["size"].isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<gap:int,size:int,by:int>>"))


def scan_blobs(todo: DataFrame, rules: list = RULES) -> DataFrame:
    """Ledger rows of todo (blob, text, kinds to scan): a row for each blob and kind, with the code-point ranges of the
    matches whose group is long enough. Offsets are running sums over rows, linear in a text's matches."""
    each = []
    for kind, version, pattern, group, least in rules:
        found = F.struct(F.lit(kind).alias("kind"), F.lit(version).alias("version"), F.lit(least).alias("least"), matches_of(F.col("text"), pattern, group).alias("matches"))
        each.append(F.when(F.array_contains("kinds", kind), found))
    rows = todo.select("blob", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("r")).select("blob", "r.*")
    rows = materialize(rows, "matches")
    none = rows.where(F.size("matches") == 0).select("blob", "kind", "version", F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    some = rows.where(F.size("matches") > 0).select("blob", "kind", "version", "least", F.posexplode("matches").alias("at", "m"))
    upto = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(upto).cast("int")
    placed = some.withColumn("end", end).withColumn("start", F.col("end") - F.col("m.size"))
    span = F.when(F.col("m.by") >= F.col("least"), F.struct("start", "end"))
    spans = placed.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_list(span)).alias("spans"))  # one text's spans
    return none.unionByName(spans)


def scan_versions(versions: DataFrame, ledger: str | None = None, text: str = "text", rules: list = RULES, out: str = "findings") -> DataFrame:
    """versions with one more column `out`: array<struct<start, end, kind>>, by start, then kind as listed.

    versions: any table with a text column, a row for each path and version; its columns stay as they are, but for one of
    the name `out`, which is replaced. Null texts count as empty. ledger is the folder of the ledger (Parquet; made if it is
    not there); None starts an empty one in the shared folder, deleted when the process ends. Blobs whose kinds are all in
    the ledger at the current rule versions aren't scanned. Repeated rows share a blob; an empty table leaves the ledger
    unchanged.
    """
    spark = versions.sparkSession
    if ledger is None:
        ledger = f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
        remove_at_exit(spark, ledger)
    body = F.coalesce(F.col(text), F.lit(""))
    blob = F.sha2(body, 256)
    blobs = versions.select(blob.alias("blob"), body.alias("text"))
    now = [f"{k}:{v}" for k, v, *_ in rules]
    if _exists(spark, ledger):
        done = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).groupBy("blob").agg(
            F.collect_set(F.concat_ws(":", "kind", "version")).alias("done")
        )  # as many as there are rules and versions
        blobs = blobs.join(done, "blob", "left")
        missing = F.array_except(F.array(*map(F.lit, now)), F.coalesce("done", F.array().cast("array<string>")))
    else:
        missing = F.array(*map(F.lit, now))
    kinds = F.transform(missing, lambda x: F.substring_index(x, ":", 1))
    todo = blobs.select("blob", "text", kinds.alias("kinds")).where(F.size("kinds") > 0)
    todo = todo.groupBy("blob").agg(F.first("text").alias("text"), F.first("kinds").alias("kinds"))
    scan_blobs(todo, rules).write.mode("append").parquet(ledger)

    order = F.create_map(*[x for i, (k, *_) in enumerate(rules) for x in (F.lit(k), F.lit(i))])
    current = spark.read.schema(LEDGER_SCHEMA).parquet(ledger).where(F.concat_ws(":", "kind", "version").isin(now))
    hits = current.where(F.size("spans") > 0).select(
        "blob", F.explode(F.transform("spans", lambda s: F.struct(s["start"], order[F.col("kind")].alias("rank"), s["end"], F.col("kind")))).alias("s")
    )
    by_blob = hits.distinct().groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("s"))  # one text's spans
    findings = F.transform("s", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    at, found = free_name(versions, "blob"), free_name(versions, "found")
    by_blob = materialize(by_blob.select(F.col("blob").alias(at), findings.alias(found)), "findings")
    if by_blob.count() <= BROADCAST_BLOBS:
        by_blob = F.broadcast(by_blob)
    joined = versions.withColumn(at, blob).join(by_blob, at, "left")
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return joined.select(*[F.col(f"`{c}`") for c in versions.columns if c != out], F.coalesce(found, none).alias(out))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def redacted(text: Column, findings: Column, mark: str = "[REDACTED]") -> Column:
    """text with each run of overlapping findings replaced by mark; findings sorted by start."""
    nothing = F.array().cast("array<string>")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("pieces"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        pieces = F.when(fresh, F.concat(acc["pieces"], F.array(gap, F.lit(mark)))).otherwise(acc["pieces"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), pieces.alias("pieces"))

    rest = lambda acc: F.array(F.substring(text, acc["at"] + 1, F.length(text)))
    whole = F.aggregate(findings, start, step, lambda acc: F.array_join(F.concat(acc["pieces"], rest(acc)), ""))
    return F.when(F.size(findings) > 0, whole).otherwise(text)
