"""Exact search for the highest inner products of whole-number vectors, by a KD-tree per shard.

Distinct vectors are dealt to shards by the cells of a shallow tree that is fitted on a bounded sample; every shard builds
its own KD-tree: median splits of the widest coordinate, and tight bounding boxes. A block of queries goes through a tree best
first: nodes wait in a heap by the most that their box allows a query beyond its kth best score, a node is opened only for
queries whose bound reaches their kth score, and a leaf is one matrix product. Queries search the shard of their own cell
first; the kth scores found there go with them to the other shards, and only to those whose box can reach them. Nothing is
approximate: a bound that equals the kth score is followed, as a smaller id wins a tie.

In many dimensions boxes tell little (of 51,282 random unit vectors of 64 components over 98 % of the leaves are opened), so
the cost comes near a product of the query blocks with all rows; clustered vectors cost less.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import materialize, with_unique

#: Rows of a shard's tree, of a leaf, of a block of queries.
SHARD, LEAF, QUERIES = 4096, 256, 256
#: The tree that deals rows to shards: fitted on so many rows at most, and the shards' boxes take so many bytes at most, as
#: every task gets them. Beyond that number of shards a shard has several trees.
SAMPLE, BOX_BYTES = 20_000, 8 << 20
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
HITS = "key binary, score long, id long, other binary"


def whole_vectors(vectors: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """id, key, at, raw: floor(scale * x) of each vector as bytes of 64-bit whole numbers, 16 bytes that tell vectors apart
    and a place in 0..2^32 drawn from them. Vectors that are null or hold null or non-finite components are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, places, raws = [], [], [], []
            for i, x in zip(b.column(0), b.column(1), strict=True):
                if not x.is_valid or x.values.null_count:
                    continue
                v = np.asarray(x.values).astype(np.float64)
                if not np.isfinite(v).all():
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * v)
                whole = np.where(v >= 2.0**63, HIGH, np.where(v < -(2.0**63), LOW, np.clip(v, -(2.0**63), 2.0**63 - 1024).astype(np.int64)))
                raw = whole.astype("<i8").tobytes()
                key = hashlib.blake2b(raw, digest_size=16).digest()
                ids.append(i.as_py())
                keys.append(key)
                places.append(int.from_bytes(key[:4], "little"))
                raws.append(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.int64()), pa.array(raws, pa.binary())],
                names=["id", "key", "at", "raw"],
            )

    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "id long, key binary, at long, raw binary")


def matrix(raws: list[bytes]) -> np.ndarray:
    """Vectors of one length as rows."""
    return np.frombuffer(b"".join(raws), "<i8").reshape(len(raws), len(raws[0]) // 8 if raws else 0)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b (whole numbers), held within 64 bits."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if not x.size or not y.size or np.abs(x).sum(axis=1).max() * np.abs(y).max() < 2.0**53:
        return (x @ y.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LOW, HIGH).astype(np.int64)


class Tree:
    """KD-tree over rows of whole numbers; node 0 is the root and every node has its tight box."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        lo, hi, self.span, self.below = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, above = todo.pop()
            part = points[self.order[a:b]]
            low, high = part.min(axis=0, initial=HIGH), part.max(axis=0, initial=LOW)
            lo.append(low)
            hi.append(high)
            self.span.append((a, b))
            self.below.append([])
            if above >= 0:
                self.below[above].append(len(lo) - 1)
            wide = high.astype(np.float64) - low.astype(np.float64)
            if b - a <= leaf or not wide.any():
                continue
            self.order[a:b] = self.order[a:b][np.argsort(part[:, wide.argmax()], kind="stable")]
            todo += [(a, (a + b) // 2, len(lo) - 1), ((a + b) // 2, b, len(lo) - 1)]
        self.lo, self.hi, self.points = np.array(lo), np.array(hi), points[self.order]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that an inner product of each query with a point of each node can be."""
        return bounds(q, self.lo, self.hi)


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    big = [np.abs(x.astype(np.float64)) for x in (q, lo, hi)]
    if not q.size or not lo.size or big[0].sum(axis=1).max() * max(big[1].max(), big[2].max()) < 2.0**52:
        return products(up, hi) + products(down, lo)
    exact = up.astype(object) @ hi.astype(object).T + down.astype(object) @ lo.astype(object).T
    return np.clip(exact, LOW, HIGH).astype(np.int64)


def search(tree: Tree, ids: list[np.ndarray], q: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query number, score, id and row of the k best (score, least id) of each query with a score of at least `least`.

    ids: of each row of the tree, in the tree's order, the ids that have this vector.
    """
    many = np.array([len(x) for x in ids])
    first = np.concatenate(([0], np.cumsum(many)))
    flat = np.concatenate(ids)
    found = [np.zeros(0, np.int64)] * 4
    kth, bound = least.copy(), tree.bounds(q)
    reach = lambda n: float((bound[:, n].astype(np.float64) - np.where(kth == LOW, 0, kth)).max())
    heap = [(-reach(0), 0)]
    while heap:
        _, node = heapq.heappop(heap)
        opened = np.flatnonzero(bound[:, node] >= kth)
        if not len(opened):
            continue
        if tree.below[node]:
            for n in tree.below[node]:
                heapq.heappush(heap, (-reach(n), n))
            continue
        a, b = tree.span[node]
        score = products(q[opened], tree.points[a:b])
        i, j = np.nonzero(score >= kth[opened, None])
        if not len(i):
            continue
        s, i, j = score[i, j], opened[i], j + a
        copies = many[j]
        if (copies > 1).any():
            i, s, start, j = (np.repeat(x, copies) for x in (i, s, first[j], j))
            at = start + np.arange(len(i)) - np.repeat(np.cumsum(copies) - copies, copies)
        else:
            at = first[j]
        found = [np.concatenate(x) for x in zip(found, (i, s, flat[at], j), strict=True)]
        order = np.lexsort((found[3], found[2], -1 - found[1], found[0]))  # -1 - s is the reverse of s without overflow
        found = [x[order] for x in found]
        start = np.searchsorted(found[0], np.arange(len(q)))
        rank = np.arange(len(order)) - start[found[0]]
        full = rank == k - 1
        kth[found[0][full]] = np.maximum(kth[found[0][full]], found[1][full])
        found = [x[rank < k] for x in found]
    return tuple(found)


def _searched(points: DataFrame, queries: DataFrame, k: int, leaf: int, boxes: bool) -> DataFrame:
    """Hits of queries (shard, sub, key, raw, kth) among the points (shard, sub, key, raw, ids) of their shard and sub; with
    boxes, also a row for each shard and sub whose key is null: score is the shard, other holds the box."""
    both = points.select("shard", "sub", F.lit(0).alias("kind"), "key", "raw", "ids", F.lit(None).cast("long").alias("kth"))
    asked = queries.select("shard", "sub", F.lit(1).alias("kind"), "key", "raw", F.lit(None).cast("array<long>").alias("ids"), "kth")
    group = ["shard", "sub"]
    # A group's points come before its queries.
    dealt = both.unionByName(asked).repartition(*group).sortWithinPartitions(*group, "kind", "key")

    def answers(tree: Tree, ids: list, keys: list, asked: list) -> pa.RecordBatch:
        q = matrix([x[1] for x in asked])
        least = np.array([LOW if x[2] is None else x[2] for x in asked], np.int64)
        i, s, d, row = search(tree, ids, q, least, k)
        return pa.RecordBatch.from_arrays(
            [pa.array([asked[n][0] for n in i], pa.binary()), pa.array(s), pa.array(d), pa.array([keys[n] for n in row], pa.binary())],
            names=["key", "score", "id", "other"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree, ids, keys, waiting = None, [], None, [], [], []

        def grown() -> Iterator[pa.RecordBatch]:
            """The tree of what is held, once the last point of the group has come."""
            nonlocal tree, ids, keys, held
            if held:
                points = matrix([x[1] for x in held])
                tree = Tree(points, leaf)
                ids = [np.sort(np.array(held[n][2], np.int64)) for n in tree.order]
                keys = [held[n][0] for n in tree.order]
                held = []
                if boxes:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None], pa.binary()), pa.array([now[0]]), pa.array([None], pa.int64()), pa.array([tree.lo[0].tobytes() + tree.hi[0].tobytes()], pa.binary())],
                        names=["key", "score", "id", "other"],
                    )

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if waiting and tree is not None:
                yield answers(tree, ids, keys, waiting)
            waiting = []

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for shard, sub, kind, key, raw, own, kth in zip(*cols, strict=True):
                if (shard, sub) != now:
                    yield from grown()
                    yield from flush()
                    now, tree = (shard, sub), None
                if kind == 0:
                    held.append((key, raw, own))
                    continue
                yield from grown()
                waiting.append((key, raw, kth))
                if len(waiting) >= QUERIES:
                    yield from flush()
        yield from grown()
        yield from flush()

    return dealt.mapInArrow(run, HITS)


def _cells(sample: list[bytes], shards: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Length in bytes of the most frequent kind of vector, and median splits (coordinate, value, lower, upper) of the sample
    into so many cells; a negative child -1 - c is cell c."""
    sizes = Counter(len(x) for x in sample)
    width = max(sizes, key=lambda n: (sizes[n], n), default=0)
    points = matrix([x for x in sample if len(x) == width])
    splits, made = [], 0

    def cut(rows: np.ndarray, parts: int) -> int:
        nonlocal made
        wide = rows.max(axis=0, initial=LOW).astype(float) - rows.min(axis=0, initial=HIGH) if len(rows) > 1 else np.zeros(0)
        if parts < 2 or not wide.size or not wide.max() > 0:
            made += 1
            return -made
        d = int(wide.argmax())
        value = int(np.sort(rows[:, d])[len(rows) // 2])
        lower = rows[:, d] < value
        if not lower.any():
            value, lower = value + 1, rows[:, d] <= value
        splits.append([d, value, 0, 0])
        at = len(splits) - 1
        splits[at][2], splits[at][3] = cut(rows[lower], parts // 2), cut(rows[~lower], parts - parts // 2)
        return at

    cut(points, shards)
    return width, [tuple(s) for s in splits]


def _dealt(distinct: DataFrame, width: int, splits: list) -> DataFrame:
    """distinct with its shard: the cell of the splits, or for vectors of another length a shard of their length's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = b.column(b.schema.get_field_index("raw")).to_pylist()
            shard = np.array([-1 - len(x) // 8 for x in raws], np.int64)
            rows = np.array([i for i, x in enumerate(raws) if len(x) == width and width], np.int64)
            if len(rows):
                v = matrix([raws[i] for i in rows])
                at = np.full(len(rows), 0 if splits else -1)
                while splits and (at >= 0).any():
                    on = np.flatnonzero(at >= 0)
                    d, value, lower, upper = np.array(splits, dtype=object)[at[on]].T
                    at[on] = np.where(v[on, d.astype(int)] < value.astype(np.int64), lower, upper).astype(int)
                shard[rows] = -1 - at
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=[*b.schema.names, "shard"])

    return distinct.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in distinct.schema)}, shard long")


def _kth(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query."""
    best = Window.partitionBy("key").orderBy(F.desc("score"), "id", "other")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def top_inner_products(
    vectors: DataFrame, is_query, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0,
    shard: int = SHARD, leaf: int = LEAF,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is_query (a function of a column) accepts, the k rows with the
    highest inner product of floor(scale * x), all if fewer; ties go to the smaller id.

    Candidates are all rows but the query's own; rows equal in id and in the whole vector count once, rows that share an id
    otherwise are candidates of each other. Vectors that are null or hold null or non-finite components take no part; only
    vectors of equal length are compared, empty ones too (score 0). A row without an id is a candidate, last of equals, given
    back as a null vec_id (as is the id 2^63 - 1), and never a query. Components and scores stay within 64 bits (the nearest
    such number stands for others). An empty table gives an empty result; further columns are ignored.

    Copies cost nothing: of each distinct vector k + 1 least ids suffice for all results, and equal queries are asked once.
    """
    spark = vectors.sparkSession
    rows = materialize(whole_vectors(vectors, id_col, vector, scale), "vectors")
    some = Window.partitionBy("key").orderBy("place")
    places = rows.select("key", F.coalesce("id", F.lit(int(HIGH))).alias("place")).distinct()
    # A rank's limit is taken before the shuffle too, so a vector that many rows share stays small.
    places = places.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k + 1)
    listed = places.groupBy("key").agg(F.collect_list("place").alias("ids"))
    distinct = rows.groupBy("key").agg(F.first("at").alias("at"), F.first("raw").alias("raw")).join(listed, "key")
    distinct = materialize(distinct, "distinct")
    asked = rows.where(F.col("id").isNotNull() & is_query(F.col("id"))).select("id", "key").distinct()
    of_key = materialize(asked.groupBy("key").agg(F.count("*").alias("rows")), "asked")

    size = distinct.count()
    share = int(min(1.0, SAMPLE / max(size, 1)) * 2**32)
    sample = [bytes(r[0]) for r in distinct.where(F.col("at") < share).select("raw").take(2 * SAMPLE)]
    most = max(1, BOX_BYTES // max(16, 2 * max(map(len, sample), default=0)))
    width, splits = _cells(sample, min(most, -(-size // shard)))
    points = _dealt(distinct, width, splits)
    subs = points.groupBy("shard").agg(F.ceil(F.count("*") / shard).cast("int").alias("subs"))
    subs = materialize(subs, "subs")
    points = points.join(F.broadcast(subs) if subs.count() <= 4 * most else subs, "shard")
    points = materialize(points.withColumn("sub", F.pmod(F.xxhash64("key"), F.col("subs")).cast("int")), "points")
    asking = points.join(of_key.select("key"), "key", "left_semi").select("key", "raw", "shard", "subs")
    asking = materialize(asking, "asking")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")

    home = asking.select("shard", everywhere, "key", "raw", F.lit(None).cast("long").alias("kth"))
    found = materialize(_searched(points, home, k + 1, leaf, boxes=True), "home")
    near = materialize(_kth(found.where("key is not null"), k + 1), "near")
    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The boxes of a shard's trees as one."""
        box: dict = {}
        for b in batches:
            for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lo, hi = np.frombuffer(raw, "<i8").reshape(2, -1)
                low, high = box.get(n, (lo, hi))
                box[n] = np.minimum(low, lo), np.maximum(high, hi)
        yield pa.RecordBatch.from_arrays([pa.array(list(box), pa.int64()), pa.array([a.tobytes() + b.tobytes() for a, b in box.values()], pa.binary())], names=["shard", "box"])

    box = found.where("key is null and score >= 0").select("score", "other").repartition("score").mapInArrow(boxed, "shard long, box binary").collect()
    number = [r[0] for r in box]
    lows, highs = (matrix([bytes(r[1])[half * width : (half + 1) * width] for r in box]) for half in (0, 1))
    kth = near.groupBy("key").agg(F.count("*").alias("c"), F.min("score").alias("kth")).where(F.col("c") == k + 1)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with each other shard whose box reaches its kth score."""
        for b in batches:
            raws, kths, own = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            rows = np.array([i for i in range(b.num_rows) if own[i] >= 0], np.int64)
            for at in range(0, len(rows), QUERIES):
                part = rows[at : at + QUERIES]
                q = matrix([raws[i] for i in part])
                least = np.array([LOW if kths[i] is None else kths[i] for i in part], np.int64)
                i, j = np.nonzero(bounds(q, lows, highs) >= least[:, None])
                use = np.array([own[n] for n in part])[i] != np.array(number)[j]
                i, j = part[i[use]], j[use]
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).take(pa.array(i)) for c in range(3)] + [pa.array(np.array(number, np.int64)[j])], names=["key", "raw", "kth", "shard"]
                )

    away = asking.join(kth.select("key", "kth"), "key", "left").select("key", "raw", "kth", "shard")
    away = away.mapInArrow(sent, "key binary, raw binary, kth long, shard long")
    away = away.join(F.broadcast(subs) if subs.count() <= 4 * most else subs, "shard").select("shard", everywhere, "key", "raw", "kth")
    rest = materialize(_searched(points, away, k + 1, leaf, boxes=False), "away") if number else near.limit(0)
    best = _kth(near.unionByName(rest), k + 1).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct((-1 - F.col("score")).alias("less"), "id", "other"))).alias("best")
    )
    best = materialize(best.join(of_key, "key"), "best")
    out = with_unique(asked, best, "key", asked.count())
    # Of equal (score, id), which may be one id's several vectors, only the query's own row goes.
    others = F.filter("best", lambda x: ~((x["id"] == F.col("id")) & (x["other"] == F.col("key"))))
    out = out.select(F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("rank", "hit"))
    vec = F.when(F.col("hit.id") != int(HIGH), F.col("hit.id"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), vec.alias("vec_id"), (-1 - F.col("hit.less")).alias("score"))
