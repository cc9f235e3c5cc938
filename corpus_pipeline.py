"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, decontam, ngram_join, quality, secrets
from marginalia.llm.common import free_name, materialize, text_key, with_unique, without
from marginalia.llm.queries import KEEP_SCORE, table
from marginalia.session import ship


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least KEEP_SCORE; null and empty texts are scored too. Rows of one id, or of none,
    are judged each by its own text."""
    found = quality.quality_scores(docs, table(spark, sf_dir, "labels"), learn=quality.not_in_fold("id", 5))
    return without(docs, found.where(F.col("score") < KEEP_SCORE))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, null ids last. Blank documents are no copies.

    Of rows that have that id, or of a group without ids, the one with the least hash of its text stays; of rows equal in
    both, the least by all its columns.
    """
    ship(spark)
    members, _ = ngram_join.ngram_jaccard_groups(docs)
    members = materialize(members.where("n_shingles > 0"), "members")
    first = F.col("id").eqNullSafe(F.col("component_id"))
    others = members.where(~first).select("id", "text_key")
    # Nearly always one row of a component is its first; where there are more, they are told apart by their texts.
    tied = members.where(first).groupBy("component_key").agg(F.count("*").alias("rows"), F.min("text_key").alias("keep"))
    tied = materialize(tied.where("rows > 1"), "tied")
    size = tied.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    again = with_unique(members.where(first), tied, "component_key", size)
    kept = without(docs, others.unionByName(again.where("text_key <> keep").select("id", "text_key")))
    same = again.where("text_key = keep").groupBy("id", "text_key").count().where("count > 1").select("id", "text_key")
    return one_of_each(kept, materialize(same, "same"))


def one_of_each(docs: DataFrame, same: DataFrame) -> DataFrame:
    """docs with one row of each (id, text_key) of same, the least by all columns; the other rows as they are."""
    if same.isEmpty():
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("text_key"))
    match = keyed["id"].eqNullSafe(same["id"]) & (keyed["text_key"] == same["text_key"])
    least = keyed.join(same, match, "left_semi").groupBy("id", "text_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return keyed.join(same, match, "left_anti").select("row.*").unionByName(least.select("row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated; rows of one id, or of none, are judged each by its own text."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("contaminated"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and n_chars counted anew; null texts stay null and have null n_chars."""
    ship(spark)
    names = docs.columns
    out = free_name(docs, "findings")
    found = secrets.scan_versions(docs, out=out)
    text = secrets.redacted(F.col("text"), F.col(out))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in names])


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the hash of the bytes that they decode to, which is that of its text.

    Of the documents' columns doc_id, lang, source and n_chars stay, where they are there; the text and all others go."""
    ship(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    kept = [c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns]
    coded = bpe.encoded(docs.select(*kept, "text"), path, pattern, back="bytes")
    return coded.select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", byte_bpe),
]
#: Neither the classifier nor BPE can be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
