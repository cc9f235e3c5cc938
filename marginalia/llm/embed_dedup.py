"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A vector is rotated by three rounds of random signs and a Walsh-Hadamard transform; its hash is the signed axis of the
largest coordinate. Two such axes make a cell; each of several tables has its own rotations. A vector is stored in its own
cell of each table and probes the next best cells, ranked by how little the rotated vector falls short of them. Vectors
that meet in a cell are compared in double precision. Equal unit vectors are one, with a weight.

A cell with many vectors is dealt into blocks and compared block by block, so that no task holds more than two blocks. A
pair that meets several times counts at its first meeting only, which every task works out from the two vectors alone. A
task returns degrees and a spanning forest, never its pairs: the output stays linear in a group's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_unique
from .components import forest, labelled

TABLES, AXES, PROBES, RUNNERS_UP = 8, 2, 4, 3
BLOCK = 1024
#: So many hot cells at most are broadcast (some MB); more are joined by a shuffle.
BROADCAST_CELLS = 100_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform along the last axis (a power of two long), not scaled."""
    shape, n, h = x.shape, x.shape[-1], 1
    while h < n:
        pair = x.reshape(-1, n // (2 * h), 2, h)
        x = np.concatenate([pair[:, :, :1] + pair[:, :, 1:], pair[:, :, :1] - pair[:, :, 1:]], axis=2)
        h *= 2
    return x.reshape(shape)


def cells(unit: np.ndarray, tables: int, axes: int, probes: int) -> np.ndarray:
    """Cell codes (rows, tables, probes) of unit vectors; the first probe is a vector's own cell."""
    n, d = unit.shape
    width = 1 << max(1, (d - 1).bit_length())
    y = np.zeros((n, 1, width))
    y[:, 0, :d] = unit
    signs = np.random.default_rng([tables, axes, width]).choice([-1.0, 1.0], (3, tables * axes, width))
    for s in signs:
        y = hadamard(y * s) / np.sqrt(width)
    size = np.abs(y)
    best = np.argsort(-size, axis=2, kind="stable")[:, :, : min(RUNNERS_UP, width)]
    at = np.take_along_axis(size, best, 2)
    short_of = ((at[:, :, :1] - at) ** 2).reshape(n, tables, axes, -1)
    axis = (best * 2 + (np.take_along_axis(y, best, 2) > 0)).reshape(n, tables, axes, -1)
    short, code = np.zeros((n, tables, 1)), np.zeros((n, tables, 1), np.int64)
    for a in range(axes):
        short = (short[:, :, :, None] + short_of[:, :, a, None, :]).reshape(n, tables, -1)
        code = (code[:, :, :, None] * (2 * width) + axis[:, :, a, None, :]).reshape(n, tables, -1)
    order = np.argsort(short, axis=2, kind="stable")[:, :, :probes]
    got = np.take_along_axis(code, order, 2)
    fill = np.repeat(got[:, :, :1], probes - got.shape[2], axis=2)
    return np.concatenate([got, fill], axis=2)


def normalised(v: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision, free of overflow."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def keyed(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id, key (equal for equal unit vectors; null where a vector can't link) and the vector's raw values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, raw = [], []
            for x in b.column(1):
                v = np.asarray(x.values) if x.is_valid and len(x) and not x.values.null_count else None
                if v is None or not np.isfinite(v).all() or not v.any():
                    keys.append(None)
                    raw.append(None)
                    continue
                unit = normalised(v[None]) + 0.0  # no negative zeros
                keys.append(int.from_bytes(hashlib.blake2b(unit.tobytes(), digest_size=8).digest(), "little", signed=True))
                raw.append(v.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.int64()), pa.array(raw, pa.binary())], names=["id", "key", "raw"]
            )

    return vectors.select(F.col(id_col).cast("long"), vector).mapInArrow(run, "id long, key long, raw binary")


def hashed(distinct: DataFrame, kind: str, tables: int, axes: int, probes: int) -> DataFrame:
    """A row for each vector, table and probed cell: dim, t, cell, own, key, weight, raw."""
    schema = "dim int, t int, cell long, own boolean, key long, weight long, raw binary"
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                raw = part.column(2).to_pylist()
                dims = np.array([len(x) // width for x in raw])
                for d in np.unique(dims):
                    rows = np.flatnonzero(dims == d)
                    values = np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(-1, d)
                    code = cells(normalised(values), tables, axes, probes)
                    take = np.repeat(rows, tables * probes)
                    n = len(take)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, d, np.int32)),
                            pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), probes), len(rows))),
                            pa.array(code.ravel()),
                            pa.array(np.tile(np.arange(probes) == 0, len(rows) * tables)),
                            part.column(0).take(pa.array(take)),
                            part.column(1).take(pa.array(take)),
                            part.column(2).take(pa.array(take)),
                        ],
                        names=["dim", "t", "cell", "own", "key", "weight", "raw"],
                    )

    return distinct.select("key", "weight", "raw").mapInArrow(run, schema)


def first_meeting(pa_: np.ndarray, pb: np.ndarray, t: int, cell: int) -> np.ndarray:
    """Whether (t, cell) is where pairs of vectors, given by their cells, meet first: by table, then by cell."""
    left = np.arange(len(pa_))
    out = np.zeros(len(pa_), bool)
    none = np.iinfo(np.int64).max
    for u in range(t + 1):
        a, b = pa_[left, u], pb[left, u]
        at_a = np.where((b == a[:, :1]).any(axis=1), a[:, 0], none)
        at_b = np.where((a == b[:, :1]).any(axis=1), b[:, 0], none)
        at = np.minimum(at_a, at_b)
        if u == t:
            out[left[at == cell]] = True
        left = left[at == none]
    return out


def compared(cell: tuple, keys: np.ndarray, weights: np.ndarray, own: np.ndarray, side: np.ndarray, unit: np.ndarray, least: float, shape: tuple) -> pa.RecordBatch | None:
    """Degrees and forest of the pairs that first meet in a block pair of a cell. cell: t, code, whether the blocks differ."""
    t, code, cross = cell
    own_at = np.flatnonzero(own)
    found_i, found_j = [], []
    for at in range(0, len(own_at), 256):
        rows = own_at[at : at + 256]
        hit = unit[rows] @ unit.T >= least
        i, j = np.nonzero(hit)
        i = rows[i]
        keep = (i != j) & (~own[j] | (i < j))
        if cross:
            keep &= side[i] != side[j]
        found_i.append(i[keep])
        found_j.append(j[keep])
    if not found_i or not sum(map(len, found_i)):
        return None
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    some, back = np.unique(np.concatenate([i, j]), return_inverse=True)
    probed = cells(unit[some], *shape)
    i, j = back[: len(i)], back[len(i) :]
    keep = np.concatenate([first_meeting(probed[i[a : a + 65536]], probed[j[a : a + 65536]], t, code) for a in range(0, len(i), 65536)])
    i, j = i[keep], j[keep]
    if not len(i):
        return None
    w, k = weights[some], keys[some]
    degree = np.bincount(i, w[j], len(some)) + np.bincount(j, w[i], len(some))
    label = forest(i, j, len(some))
    use = degree > 0
    return pa.RecordBatch.from_pydict(
        {"key": pa.array(k[use]), "links": pa.array(degree[use].astype(np.int64)), "other": pa.array(k[label[use]])}
    )


def meetings(rows: DataFrame, kind: str, least: float, shape: tuple[int, int, int]) -> DataFrame:
    """key, links, other: parts of the degrees, and a forest's edges, of vectors that meet in a cell."""
    place = ["dim", "t", "cell"]
    hot = rows.groupBy(place).count().where(F.col("count") > BLOCK)
    hot = materialize(hot.select(*place, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "hot-cells")
    dealt = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_CELLS else hot, place, "left")
    dealt = dealt.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.least("side", "with").alias("lo"), F.greatest("side", "with").alias("hi")
    dealt = dealt.select(*place, *pair, "side", "own", "key", "weight", "raw")
    group = [*place, "lo", "hi"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group, "key", F.desc("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, ...] | None = None
        parts: list[list] = []

        def close() -> Iterator[pa.RecordBatch]:
            if now is None:
                return
            key, weight, own, side = (np.concatenate([p[k] for p in parts]) if len(parts) > 1 else parts[0][k] for k in range(4))
            new = np.concatenate(([True], key[1:] != key[:-1]))  # a vector may probe a cell that is its own
            if new.sum() < 2 or not own.any():
                return
            values = np.frombuffer(b"".join(p[4] for p in parts), kind).reshape(-1, now[0])
            cell = (now[1], now[2], now[3] != now[4])
            out = compared(cell, key[new], weight[new], own[new], side[new], normalised(values[new]), least, shape)
            if out is not None:
                yield out

        for b in batches:
            ids = [b.column(k).to_numpy() for k in range(5)]
            cols = [b.column(k).to_numpy(zero_copy_only=False) for k in (7, 8, 6, 5)]
            raw = b.column(9)
            offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + b.num_rows + 1]
            data = memoryview(raw.buffers()[2])
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
            for start, end in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                at = tuple(int(x[start]) for x in ids)
                if at != now:
                    yield from close()
                    now, parts = at, []
                parts.append([*(c[start:end] for c in cols), data[offsets[start] : offsets[end]]])
        yield from close()

    return dealt.mapInArrow(run, "key long, links long, other long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", least: float = 0.95,
    tables: int = TABLES, axes: int = AXES, probes: int = PROBES,
) -> DataFrame:
    """id, n_links, component_id, one row per row of vectors.

    Pairs found by hashing whose cosine is at least `least` link; with the default tables a pair at cosine 0.95 is missed
    about 5 times in a million, closer pairs less often. n_links counts the other rows linked directly (equal vectors
    too); component_id is the least id reachable. Null, empty and zero vectors and those with null or non-finite parts
    link with nothing; vectors of different lengths don't link; rows with a null id count as vectors and are returned
    with what they reach; an empty table gives an empty result; further columns are ignored.
    """
    if vectors.schema[vector].dataType.elementType.typeName() != "float":
        vectors = vectors.withColumn(vector, F.col(vector).cast("array<double>"))
    rows = materialize(keyed(vectors, id_col, vector), "vectors")
    distinct = rows.where("key is not null").groupBy("key").agg(
        F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("raw").alias("raw")
    )
    distinct = materialize(distinct, "vectors")
    kind = "<f4" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "<f8"
    dealt = hashed(distinct, kind, tables, axes, probes)
    met = materialize(meetings(dealt, kind, least, (tables, axes, probes)), "meetings")
    links = met.groupBy("key").agg(F.sum("links").alias("links"))
    reach = labelled(distinct.select("key", "rep", "weight"), met.select(F.col("key").alias("a"), F.col("other").alias("b")), "key", "rep")
    of_key = reach.join(links, "key", "left").select(
        "key", F.col("least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("weight").alias("rows")
    )
    out = with_unique(rows.select("id", "key"), materialize(of_key, "classes"), "key", rows.count(), "left")
    return out.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
