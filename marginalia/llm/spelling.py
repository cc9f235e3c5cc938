"""Spelling variants of a word list by a symmetric-delete join.

Every word emits itself and its distinct single deletions as keys. Two words that differ by one inserted, deleted or replaced
code point share exactly one key, so an equi-join finds them, and an exact distance verifies each pair. Per word only a count
and the most frequent neighbour are kept. A key of k code points belongs to at most 1 + (k + 1) * A words, A being the number
of letters, so no key's group grows with the corpus.

Words of more than `longest` code points emit 64-bit hashes of their deletions instead of their texts, worked out from prefix
hashes, so that a word of a million letters costs a million short rows and not a million copies of itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import materialize

#: What a word is made of, and A-Z with what they become.
LETTERS, UPPER, LOWER = "[A-Za-zÀ-ÿ]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST = 100
#: Two moduli below 2^31 and their bases for the hashes of long words.
MODULI, BASES = (2147483647, 2147483629), (1000003, 69069)


def words_of(text: Column, shortest: int = 1) -> Column:
    """Maximal runs of letters of at least `shortest` code points, A-Z lower-cased; null has none."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LETTERS), F.lit(0))
    return F.transform(F.filter(runs, lambda w: F.length(w) >= shortest), lambda w: F.translate(w, UPPER, LOWER))


def counted(words: DataFrame, word: str = "word", shortest: int = 7, least: int = 2) -> DataFrame:
    """word, n: words of at least `shortest` code points that occur at least `least` times."""
    long_enough = words.select(F.col(word).alias("word")).where(F.length("word") >= shortest)
    return long_enough.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def deletion_hashes(codes: np.ndarray) -> np.ndarray:
    """Hashes of a word, given by its code points, and of its distinct single deletions; equal texts have equal hashes."""
    n = len(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))[:n]  # deleting any of a run gives the same text
    out = np.zeros(len(first) + 1, np.int64)
    for m, b in zip(MODULI, BASES, strict=True):
        power = [1] * (n + 1)
        prefix = [0] * (n + 1)
        for i, c in enumerate(codes.tolist()):
            power[i + 1] = power[i] * b % m
            prefix[i + 1] = (prefix[i] * b + c + 1) % m
        prefix, power = np.array(prefix), np.array(power)
        # What stands after a place, hashed alone, is the whole less the part up to it.
        after = (prefix[n] - prefix[first + 1] * power[n - 1 - first]) % m
        one = (prefix[first] * power[n - 1 - first] + after) % m
        out = out << 31 | np.concatenate(([prefix[n]], one))
    return out


def _long_pairs(words: DataFrame, longest: int) -> DataFrame:
    """word, other, n: near words of which one at least has more than `longest` code points."""
    ship(words.sparkSession)
    listed = words.where(F.length("word") >= longest).withColumn("id", F.sha2("word", 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, w in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys = deletion_hashes(np.frombuffer(w.as_py().encode("utf-32-le"), "<u4").astype(np.int64))
                for at in range(0, len(keys), 1 << 16):
                    part = keys[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(part)), pa.array(part)], names=["id", "key"])

    keyed = materialize(listed.select("id", "word").mapInArrow(run, "id string, key long"), "long-keys")
    met = keyed.alias("a").join(keyed.alias("b"), "key").where("a.id <> b.id")
    met = met.select(F.col("a.id").alias("id"), F.col("b.id").alias("other_id")).distinct()
    other = listed.select(F.col("id").alias("other_id"), F.col("word").alias("other"), "n")
    pairs = met.join(listed.select("id", "word"), "id").join(other, "other_id").select("word", "other", "n")
    return pairs.where(F.greatest(F.length("word"), F.length("other")) > longest)


def near_pairs(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """word, other, n: each word with each word that differs from it by one code point, and how often the other occurs.

    words: unique by word, with n. Pairs come both ways.
    """
    at = F.sequence(F.lit(1), F.length("word"))
    cut = F.transform(at, lambda i: F.concat(F.substring("word", 1, i - 1), F.substring("word", i + 1, F.length("word"))))
    keys = F.array_distinct(F.concat(F.array("word"), F.when(F.length("word") > 0, cut).otherwise(F.array().cast("array<string>"))))
    keyed = words.where(F.length("word") <= longest).select(F.explode(keys).alias("key"), "word", "n")
    pairs = keyed.alias("a").join(keyed.alias("b"), "key").where("a.word <> b.word")
    pairs = pairs.select(F.col("a.word").alias("word"), F.col("b.word").alias("other"), F.col("b.n").alias("n"))
    if not words.where(F.length("word") > longest).isEmpty():
        pairs = pairs.unionByName(_long_pairs(words, longest))
    return pairs.where(F.levenshtein("word", "other", 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached from each word of forms (unique by word; word, form; free of cycles).

    Each round joins every word with its root's root, so a chain of c steps takes about log2(c) rounds.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(step, "root", "left")
        moved = materialize(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("led")), "roots")
        now = moved.drop("led")
        if moved.where("led").isEmpty():
            return now


def spelling_variants(words: DataFrame, times: int = 10, longest: int = LONGEST) -> DataFrame:
    """word, form, root, n, n_near, form_n, one row per word.

    words: word, n; unique by word, null words left out, further columns ignored. Near words differ by exactly one inserted,
    deleted or replaced code point; n_near counts them. form is the near word of largest n, the least in code-point order of
    several, if that n is at least `times` (over 1) the word's own, else null, and form_n its n; root is the last word
    reached by forms, the word itself where it has none. An empty table gives an empty result.
    """
    if times <= 1:
        raise ValueError("forms may go round in a circle unless times is over 1")
    words = materialize(words.select(F.col("word").cast("string"), F.col("n").cast("long")).where("word is not null"), "words")
    near = near_pairs(words, longest).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best")
    )
    of = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best"))
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), of["other"].alias("form"), (-of["less"]).alias("form_n")
    )
    known = materialize(known, "forms")
    led = roots(known.where("form is not null"))
    return known.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
