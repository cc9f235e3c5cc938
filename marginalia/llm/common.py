"""Helpers shared by the training-data operators: written tables, hot keys, row identity and chunked text batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage as materialize

#: Bytes A-Z to a-z, all others unchanged.
LOWER_ASCII = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
#: Keys that each hold over one in so many rows are hot; so there are fewer of them than that.
HOT = 1000


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which its worker gives freed memory back to the system: workers live on between stages, and what one holds
    idle counts beside what the next one needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    return run


def crc_bucket(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def byte_chunks(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, list[bytes | None]]]:
    """Slices (first row, raw UTF-8 values) of a string column, each of about limit bytes or a single row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    start, size = 0, 0
    sizes = [x or 0 for x in pa.compute.binary_length(raw).to_pylist()]
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, raw.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, raw.slice(start).to_pylist()


def text_key(text: Column) -> Column:
    """A 64-bit hash that, with the id, tells rows apart whose id is null or repeated; the decisions on them follow the text."""
    return F.xxhash64(text)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 200_000) -> DataFrame:
    """docs without the rows that have the id and the text_key of a row of gone (columns id and text_key); null ids are equal.

    Up to `most` rows (some MB, counted first) are broadcast, so that the texts need no shuffle; more are joined by one. Any
    other columns docs may have stay, whatever their names.
    """
    gone = materialize(gone.select(F.col("id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct(), "gone")
    side = F.broadcast(gone) if gone.count() <= most else gone
    same = docs[id_col].cast("long").eqNullSafe(gone["gone_id"]) & (text_key(docs[text]) == gone["gone_key"])
    return docs.join(side, same, "left_anti")


def with_unique(left: DataFrame, right: DataFrame, key: str | list[str], size: int, how: str = "inner") -> DataFrame:
    """left joined with right, which is unique by key and whose column `rows` tells how many of left's `size` rows have it.

    Keys of over size / HOT rows, fewer than HOT of them, are broadcast; a shuffle deals the others only, so no task gets a
    hot key's rows. how: inner or left. `rows` isn't returned.
    """
    hot = right.where(F.col("rows") > size / HOT).drop("rows")
    cold = right.where(F.col("rows") <= size / HOT).drop("rows")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
