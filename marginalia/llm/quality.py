"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

A document becomes a fixed vector of statistics of its whole text. Random Fourier features approximate a Gaussian kernel
over the standardised statistics. Tasks sum their rows' normal equations; the sums are added in streams and solved once.
Calibration labels that the regression has not seen are counted per score bin and made monotone (pool adjacent
violators). All that reaches the driver has a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, crc_bucket, lean, materialize, text_key

FEATURES, RIDGE, SEED, BINS, BLOCKS = 256, 1e-3, 7, 400, 16
#: Rows that are scored together.
ROWS = 256
#: Kernel width in standard deviations of the statistics, times the square root of their number.
WIDTH = 1.0
SYMBOLS = b"#$%&*|<>{}[]^~@_=+\\"
STATISTICS = (
    "log_bytes", "log_words", "word_mean", "word_sd", "long_words", "short_words", "distinct_words", "top_word",
    "distinct_pairs", "upper", "digits", "symbols", "exclaim", "bars", "punctuation", "newlines", "other_bytes",
    "symbol_words", "end_marks", "echoed_words", "upper_words", "repeated_lines", "entropy", "longest_run",
)
_symbol = re.compile(rb"[#$%&*|<>{}\[\]^~@_=+\\!]$")
_run = re.compile(rb"(.)\1{3,}", re.S)


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one text; all 0 for null or empty ones."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda chars: float(counts[list(chars)].sum()) / n
    words = text.split()
    m = max(1, len(words))
    lens = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    upper = counts[65:91].sum()
    letters = max(1, upper + counts[97:123].sum())
    lines = [x for x in text.split(b"\n") if x]
    p = counts[counts > 0] / n
    return [
        np.log1p(n), np.log1p(len(words)), lens.mean(), lens.std(), (lens > 15).mean(), (lens <= 3).mean(), len(seen) / m,
        max(seen.values(), default=0) / m, len(set(zip(words, words[1:]))) / m, upper / letters, share(b"0123456789"),
        share(SYMBOLS), share(b"!"), share(b"|"), share(b".,;:?'\"()-"), share(b"\n"), float(counts[128:].sum()) / n,
        sum(1 for w in words if _symbol.search(w)) / m, sum(1 for w in words if w[-1:] in (b".", b"!", b"?")) / m,
        sum(1 for v, w in zip(words, words[1:]) if v.lower() == w.lower()) / m, sum(1 for w in words if w.isupper()) / m, 1 - len(set(lines)) / max(1, len(lines)), float(-(p * np.log2(p)).sum()),
        max((x.end() - x.start() for x in _run.finditer(text)), default=0) / n,
    ]


def measured(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, text_key, stats) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, texts in byte_chunks(b.column(1)):
                stats = pa.array([statistics(x) for x in texts], pa.list_(pa.float64()))
                own = b.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), stats], names=["id", "text_key", "stats"])

    rows = docs.select(F.col(id_col).cast("long"), text, text_key(F.col(text)))
    return rows.mapInArrow(lean(run), "id long, text_key long, stats array<double>")


def fourier(stats: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardised statistics, and a constant."""
    x = np.clip((stats - mean) / sd, -8, 8)
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(x.shape[1], FEATURES)) / (WIDTH * np.sqrt(x.shape[1]))
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(x @ w + phase), np.ones((len(x), 1))])


def predicted(stats: np.ndarray, mean: np.ndarray, sd: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The regression's values. Each row is summed by itself, in one order, so equal rows have equal values wherever they stand;
    a product of matrices rounds by a row's place."""
    out = np.zeros(len(stats))
    rng = np.random.default_rng(SEED)
    w = np.ascontiguousarray((rng.normal(size=(stats.shape[1], FEATURES)) / (WIDTH * np.sqrt(stats.shape[1]))).T)
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    for at in range(0, len(stats), ROWS):
        x = np.clip((stats[at : at + ROWS] - mean) / sd, -8, 8)
        angle = (x[:, None, :] * w).sum(axis=2) + phase
        out[at : at + ROWS] = (np.cos(angle) * (np.sqrt(2 / FEATURES) * weights[:-1])).sum(axis=1) + weights[-1]
    return out


def added(parts: DataFrame, width: int) -> np.ndarray:
    """The sum of the tasks' (block, values) rows, in block order; one stream per block, no group is gathered."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(0)
        for b in batches:
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw)
                if k != block and block is not None:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "cells": [total.tobytes()]})
                total = total + own if k == block else own
                block = k
        if block is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "cells": [total.tobytes()]})

    sums = parts.repartition(BLOCKS, "block").sortWithinPartitions("block").mapInArrow(lean(add), "block int, cells binary")
    rows = {r["block"]: np.frombuffer(r["cells"]) for r in sums.collect()}  # BLOCKS rows of a fixed size
    flat = np.concatenate([rows[k] for k in sorted(rows)]) if rows else np.zeros(0)
    return flat[:width] if len(flat) else np.zeros(width)


def normal_equations(rows: DataFrame, mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A'A, A'y) over rows (stats, y)."""
    d = FEATURES + 1
    size = -(-d * (d + 1) // BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for b in batches:
            stats = b.column(0).flatten().to_numpy().reshape(-1, len(STATISTICS))
            a = fourier(stats, mean, sd)
            total += a.T @ np.hstack([a, b.column(1).to_numpy()[:, None]])
        if total.any():
            flat = np.zeros(size * BLOCKS)
            flat[: d * (d + 1)] = total.ravel()
            cells = [flat[i * size : (i + 1) * size].tobytes() for i in range(BLOCKS)]
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "cells": cells})

    total = added(rows.select("stats", "y").mapInArrow(lean(run), "block int, cells binary"), d * (d + 1)).reshape(d, d + 1)
    return total[:, :d], total[:, d]


def isotonic(at: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit to the sums y of n labels at ascending scores: (scores, rates)."""
    blocks: list[list[float]] = []
    for a, s, k in zip(at, y, n, strict=True):
        blocks.append([a * k, s, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [x + z for x, z in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def scored(stats: DataFrame, mean: np.ndarray, sd: np.ndarray, weights: np.ndarray, knots: tuple) -> DataFrame:
    """(id, text_key, score): the calibrated rate, from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(-1, len(STATISTICS))
            raw = predicted(x, mean, sd, weights)
            score = np.clip(np.interp(raw, *knots), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], names=["id", "text_key", "score"])

    return stats.select("id", "text_key", "stats").mapInArrow(lean(run), "id long, text_key long, score double")


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
    learn: Column | None = None,
) -> DataFrame:
    """(id, text_key, score), one row per row of docs; score estimates the chance that the label is 1, from the text alone.

    labels: id_col and label (0 or 1); rows with null ids or labels teach nothing, repeated labels count again. learn
    restricts the ids that are learnt from. A quarter of them, by crc32 of the id, calibrates, the rest fits. Null and
    empty texts are scored by their all-zero statistics; texts of any length are read whole; repeated rows score alike;
    without labels every score is 0.5. Other columns are ignored.
    """
    stats = materialize(measured(docs, id_col, text), "statistics")
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("double").alias("y"))
    known = known.where("id is not null and y is not null")
    if learn is not None:
        known = known.where(learn)
    rows = materialize(stats.join(known, "id").withColumn("fold", F.crc32(F.concat(F.lit("c"), F.col("id").cast("string"))) % 4), "labelled")
    k = len(STATISTICS)
    # Sums of each statistic, one row.
    at = [F.element_at("stats", i + 1) for i in range(k)]
    fit = rows.where("fold <> 0")
    sums = fit.agg(F.count("*"), *[F.sum(c) for c in at], *[F.sum(c * c) for c in at]).first()
    n = sums[0]
    if not n:
        return stats.select("id", "text_key", F.lit(0.5).alias("score"))
    mean = np.array(sums[1 : k + 1], float) / n
    sd = np.sqrt(np.maximum(np.array(sums[k + 1 :], float) / n - mean**2, 0))
    sd[sd < 1e-9] = 1.0
    a, y = normal_equations(fit, mean, sd)
    weights = np.linalg.solve(a + RIDGE * n * np.eye(len(a)) / FEATURES, y)
    held = _with_label(rows.where("fold = 0"), mean, sd, weights)
    cell = F.floor((F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) + 0.5) / 2 * BINS)
    bins = held.groupBy(cell.alias("bin")).agg(F.avg("raw").alias("at"), F.sum("y").alias("y"), F.count("*").alias("n"))
    bins = sorted(bins.collect())  # BINS + 1 rows at most
    knots = isotonic(*(np.array([r[c] for r in bins], float) for c in ("at", "y", "n"))) if bins else None
    return scored(stats, mean, sd, weights, knots or (np.array([0.0, 1.0]), np.array([0.0, 1.0])))


def _with_label(rows: DataFrame, mean: np.ndarray, sd: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(raw, y): the regression's value beside the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([pa.array(predicted(x, mean, sd, weights)), b.column(1)], names=["raw", "y"])

    return rows.select("stats", "y").mapInArrow(lean(run), "raw double, y double")


def not_in_fold(id_col: str, modulus: int) -> Column:
    """Ids whose crc32 as text, modulo modulus, is not 0."""
    return crc_bucket(F.col(id_col), modulus) != 0
