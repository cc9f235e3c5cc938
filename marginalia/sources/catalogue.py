"""What sources there are: labels and logs of several editions, manuscripts of an archive, and the list of all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.texts import labelled_pdf
from .documents import DOCUMENT, read_activity

#: The kinds of archive records that are sources.
MANUSCRIPTS = ("manuscript", "autograph")


def read_sources(spark: SparkSession, data: str, folders: dict[str, str], under: str = "sources") -> DataFrame:
    """(edition, file, pdf, raw, doc): the labels files of editions, which lie in data by the editions' names; doc is null where a
    text is no document. folders: each edition's name and its folder, where the PDFs are. Files of other names, and in other
    folders than `under`, are left out; order them by edition and file."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.labels.json").text([f"{data}/{name}/{under}" for name in folders])
    file = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    rows = files.select(file.alias("file"), F.col("value").alias("raw"), F.when(F.get_json_object("value", "$").startswith("{"), F.from_json("value", DOCUMENT)).alias("doc"))
    folder = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair])
    name, _ = labelled_pdf(F.col("file"), data, F.lit(""))
    rows = rows.withColumn("edition", name)
    return rows.select("edition", "file", labelled_pdf(F.col("file"), data, folder[F.col("edition")])[1].alias("pdf"), "raw", "doc")


def read_logs(spark: SparkSession, folders: dict[str, str], since: float | None = None, until: float | None = None, source: str | None = None) -> DataFrame:
    """The events of several editions' logs (a folder of JSON lines each), with `edition`; source keeps those whose file's name holds
    it. Malformed lines and those without a time are dropped; order them by t."""
    logs = None
    for name, folder in folders.items():
        one = read_activity(spark, folder, since, until).withColumn("edition", F.lit(name))
        logs = one if logs is None else logs.unionByName(one)
    return logs.where(F.coalesce("file", F.lit("")).contains(source)) if source else logs


def archive_manuscripts(files: DataFrame, left_out: list[int], part: str) -> DataFrame:
    """The PDFs of an archive that are manuscripts: pdf, folder and metadata (JSON text; null or no object: none).

    Kept are records of type (or, without one, medium) manuscript or autograph, unless all their work numbers are of left_out,
    or the PDF is a part (its name fits `part`) cut from a whole one in the same folder. Work numbers are the metadata's, else
    those in the name of the folder above.
    """
    meta = lambda path: F.get_json_object("metadata", path)
    stem = F.regexp_replace(F.regexp_extract("pdf", r"([^/]*)$", 1), r"\.[^.]*$", "")
    is_part = stem.rlike(part)
    whole = F.max((~is_part).cast("int")).over(Window.partitionBy("folder")) == 1
    stated = F.from_json(meta("$.gerard_numbers"), "array<int>")
    named = F.transform(F.regexp_extract_all(F.element_at(F.split("folder", "/"), -2), F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))
    numbers = F.when(F.size(F.coalesce(stated, F.array().cast("array<int>"))) > 0, stated).otherwise(F.coalesce(named, F.array().cast("array<int>")))
    others = F.array_except(numbers, F.array(*map(F.lit, left_out)).cast("array<int>"))
    kind = F.coalesce(F.nullif(meta("$.record_type"), F.lit("")), meta("$.medium"))
    rows = files.withColumn("__cut", is_part & whole).withColumn("__gone", (F.size(numbers) > 0) & (F.size(others) == 0)).withColumn("__kind", kind)
    return rows.where(F.col("__kind").isin(*MANUSCRIPTS) & ~F.col("__gone") & ~F.col("__cut")).select(*files.columns)


def page_statuses(sources: DataFrame, key: str) -> DataFrame:
    """(key, statuses): how many pages of each source have which status ("?" without one), as a map; {unreadable: 1} for a file that
    is no document."""
    pages = sources.where("doc is not null").select(key, F.explode(F.map_values("doc.pages")).alias("p"))
    counts = pages.groupBy(key, F.coalesce("p.status", F.lit("?")).alias("s")).agg(F.count("*").alias("n"))
    counts = counts.unionByName(sources.where("doc is null").select(key, F.lit("unreadable").alias("s"), F.lit(1).cast("long").alias("n")))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("statuses"))


def listed(edition: DataFrame, archive: DataFrame, paired: DataFrame, statuses: DataFrame) -> DataFrame:
    """(pdf, group, is_paired, statuses): the edition's PDFs, the archive's, and paired ones that aren't among these; each with its
    pages' statuses. edition, archive and paired have pdf; statuses: pdf, statuses. Order them by group and pdf."""
    tagged = lambda df, group, n: df.select("pdf", F.lit(group).alias("group"), F.lit(n).alias("n"))
    every = tagged(edition, "edition", 0).unionByName(tagged(archive, "archive", 1)).unionByName(tagged(paired, "paired", 2))
    first = every.groupBy("pdf").agg(F.min_by("group", "n").alias("group"), F.max(F.col("group") == "paired").alias("is_paired"))
    return first.join(statuses.select("pdf", "statuses"), "pdf", "left").select("pdf", "group", "is_paired", F.coalesce("statuses", F.create_map().cast("map<string,bigint>")).alias("statuses"))


def mark_texts(pages: DataFrame, order: list[str]) -> DataFrame:
    """(text, n, kind, kinds): the texts that marks have, how often, the kind most have (of several the one seen first, by `order`
    and place on the page), and all kinds, sorted. A text that a machine read counts on reviewed pages only. Order them by n
    downwards and by the text in lower case."""
    marks = pages.select(*order, "status", F.posexplode("marks").alias("__at", "m"))
    said: Column = F.trim(F.coalesce("m.text", F.lit("")))
    unread = F.coalesce(F.col("m.text_auto"), F.lit(False)) & ~F.coalesce(F.col("status") == "reviewed", F.lit(False))
    rows = marks.where((said != "") & ~unread).select(said.alias("text"), F.coalesce("m.kind", F.lit("text")).alias("kind"), F.struct(*order, "__at").alias("first"))
    counts = rows.groupBy("text", "kind").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("less"), "first", "kind"))
    return counts.groupBy("text").agg(F.sum("n").alias("n"), best.alias("b"), F.array_sort(F.collect_list("kind")).alias("kinds")).select("text", "n", "b.kind", "kinds")
