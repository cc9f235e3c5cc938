"""Work on the rows of one key at a time, where Spark deals and sorts the keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import ship

#: Rows of keys that are worked on together, so far as a key has fewer.
TOGETHER = 8192


def values(col: pa.Array) -> list:
    """col.to_pylist(), by whole columns."""
    kind = col.type
    if pa.types.is_struct(kind) and kind.num_fields:
        names = [f.name for f in kind]
        out = [dict(zip(names, x, strict=True)) for x in zip(*map(values, col.flatten()), strict=True)]
    elif pa.types.is_list(kind):
        flat = values(col.flatten())
        ends = np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    elif pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind):
        out = (col.fill_null(False if pa.types.is_boolean(kind) else 0) if col.null_count else col).to_numpy(zero_copy_only=False).tolist()
    elif pa.types.is_string(kind):
        return col.to_numpy(zero_copy_only=False).tolist()
    else:
        return col.to_pylist()
    if col.null_count:
        out = [x if there else None for x, there in zip(out, col.is_valid().to_numpy(zero_copy_only=False).tolist(), strict=True)]
    return out


def each_part(rows: DataFrame, keys: list[str], order: list[str], made: StructType, work: Callable[[list[dict]], Iterator[tuple]]) -> DataFrame:
    """work's rows for each key: keys are dealt by a shuffle and sorted by `order`; work gets the rows of a key as dicts and yields
    tuples of the columns after the keys. A task holds the rows of one key, or of several with TOGETHER rows in all."""
    return each_parts(rows, keys, order, made, lambda parts: map(work, parts))


def each_parts(rows: DataFrame, keys: list[str], order: list[str], made: StructType, work: Callable[[list[list[dict]]], Iterable[Iterable[tuple]]]) -> DataFrame:
    """each_part where work gets the rows of several keys, a list for each, and gives the tuples of each in turn."""
    types = [to_arrow_type(f.dataType) for f in made]
    dealt = rows.select(*keys, *[c for c in rows.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, held = [], [], 0

        def batch() -> pa.RecordBatch:
            out = [(*key, *x) for key, found in zip(names, work(parts), strict=True) for x in found] if names else []
            cols = zip(*out, strict=True) if out else [[] for _ in types]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=made.names)

        for b in batches:
            cols = [values(c) for c in b.columns]
            for key, x in zip(zip(*cols[: len(keys)], strict=True), zip(*cols, strict=True), strict=True):
                if not names or key != names[-1]:
                    if held >= TOGETHER:
                        yield batch()
                        names, parts, held = [], [], 0
                    names.append(key)
                    parts.append([])
                parts[-1].append(dict(zip(b.schema.names, x, strict=True)))
                held += 1
        yield batch()

    ship(rows.sparkSession)
    return dealt.mapInArrow(run, made)


def each_block(rows: DataFrame, keys: list[str], order: list[str], made: StructType, work: Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, list[np.ndarray]]]) -> DataFrame:
    """each_parts by whole columns of numbers: work gets the columns of several keys and where each key begins, and gives, of each
    row that it makes, the place of its key and the columns after the keys."""
    types = [to_arrow_type(f.dataType) for f in made]
    dealt = rows.select(*keys, *[c for c in rows.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys, *order)

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(len(table) - 1, 0), bool)
        for c in (table.column(k) for k in keys):
            a, b = c.slice(0, len(new)), c.slice(1)
            differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(a.is_null(), b.is_null()))
            new |= differs.to_numpy().astype(bool)
        return np.concatenate([[0], np.flatnonzero(new) + 1])[: len(table)]

    def worked(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, cols = work({c: table.column(c).to_numpy() for c in table.column_names if c not in keys}, starts)
        held = table.select(keys).take(pa.array(starts[key])).combine_chunks()
        arrays = [*held.columns, *(pa.chunked_array([pa.array(c)]) for c in cols)]
        yield from pa.Table.from_arrays([c.cast(t) for c, t in zip(arrays, types, strict=True)], names=made.names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            new = pa.Table.from_batches([b])
            held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
            starts = begins(held)
            if len(held) >= TOGETHER and len(starts) > 1:  # the last key may go on
                yield from worked(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None and len(held):
            yield from worked(held, begins(held))

    ship(rows.sparkSession)
    return dealt.mapInArrow(run, made)
