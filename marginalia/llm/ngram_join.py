"""Jaccard join of documents on word n-grams, with token-combination prefixes.

A document is the set of its distinct n-word shingles, as 64-bit hashes. One order over all shingles, rarest first, is
fixed by a hashed frequency table of constant size. A document's prefix is the least part of its ordered set that any
partner must touch: rare shingles are indexed singly; frequent ones are dealt into classes and indexed as pairs within a
class, for which the prefix is extended until the pairs make up for what singles would have caught. Documents that share
an index entry are candidates; each candidate pair is verified on the whole sets.

Why nothing is missed: let R = |x| - ceil(t |x|) + 1. A partner y with J >= t lacks at most R - 1 shingles of x. Of the
rare shingles in x's prefix each missing one counts 1; of c frequent ones of one class y must lack at least c - 1 if they
share no pair. So if rare + sum(max(0, c - 1)) >= R, x and y share an entry that lies in x's prefix, and, taking for x the
one whose prefix ends first in the global order, also in y's. The number of classes grows with the size of the set, so it
is fixed per size band, and a document is indexed for its own band and the next: partners are at most one band apart.

Copies are one set. Entries of up to SMALL sets are joined pair by pair, which is linear in the number of entries. An
entry of more goes to a cell, that of its leader: the member that most such entries share. All sets of a cell are compared,
in blocks of bounded size, by products of incidence matrices; a task returns a spanning forest of the links and each set's
number of links, never the pairs, so that a group of many near copies yields rows in proportion to its size, and no
connection is lost. Sets of a large cell meet only those whose size is near theirs. A pair is counted once: in the least
cell that both sets are in, or where they share none, as a pair.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, byte_chunks, lean, materialize, text_key, with_unique
from .components import forest, labelled

TABLE_BITS = 22
#: Entries of so many sets at most are joined pair by pair; sets in a block of a cell; columns of an incidence matrix.
SMALL, BLOCK, COLUMNS = 32, 512, 2048
#: Shingles in a block of a cell, about: long sets make smaller blocks.
VALUES = 1 << 19
#: More bands than sets of 2**31 shingles need at the least useful similarity steps (1.25 ** 97 > 2 ** 31).
LAST_BAND = 100
#: So many document ids at most are broadcast (some MB); more are joined by a shuffle of the texts.
BROADCAST_IDS = 200_000
BLOCKS = 16
#: A frequency-table cell is frequent from this count, and from this many times the mean cell.
FREQUENT_LEAST, FREQUENT_TIMES = 64, 8
#: Levels of the frequency table for each doubling. Most cells hold a like number of shingles, the more the larger the corpus;
#: coarse levels would take them for equal, and shingles that many documents share for rare ones.
FINE = 256
MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles; of the whole sequence if it has fewer words; none without."""
    words: list[bytes] = []
    counts = []
    for x in texts:
        own = x.translate(LOWER_ASCII).split() if x else []
        words += own
        counts.append(len(own))
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)
    rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        rolled = rolled * MULT + h[j : len(h) - n + 1 + j] if len(rolled) else rolled
    rolled = mix(rolled)
    out, at = [], 0
    for k in counts:
        if k >= n:
            s = np.sort(rolled[at : at + k - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif k:
            one = np.uint64(k)
            for w in h[at : at + k]:
                one = np.uint64((int(one) * int(MULT) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += k
    return out


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit key of a whole set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        folded = np.add.reduce(mix(s ^ MULT)) * MULT + np.uint64(len(s)) + np.bitwise_xor.reduce(s)
    return int(mix(np.array([folded], np.uint64)).view(np.int64)[0])


def packed(counts: np.ndarray) -> bytes:
    """Counts as a byte each, most of which are small, then places and rests of those of 255 and more, compressed."""
    over = np.flatnonzero(counts >= 255)
    rest = np.stack([over, counts[over].astype(np.int64) - 255])
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + rest.tobytes(), 1)


def unpacked(data: bytes, size: int) -> np.ndarray:
    raw = zlib.decompress(data)
    counts = np.frombuffer(raw, np.uint8, size).astype(np.int64)
    over, rest = np.frombuffer(raw, np.int64, offset=size).reshape(2, -1)
    counts[over] += rest
    return counts


def frequency_levels(docs: DataFrame, text: str, n: int) -> tuple[np.ndarray, int]:
    """log2 levels (FINE for each doubling, two bytes a cell) of a table of 2**TABLE_BITS shingle counts over all texts, and the
    frequent level.

    Tasks sum whole tables, sent as a byte a cell and what is above that; cells of all tasks are added in BLOCKS streams, so what
    reaches the driver has a fixed size.
    """
    size = 1 << TABLE_BITS
    part = size // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.uint32)
        for b in batches:
            for _, texts in byte_chunks(b.column(0), 1 << 20):
                cells = np.concatenate([s >> np.uint64(64 - TABLE_BITS) for s in shingle_sets(texts, n)])
                np.add.at(table, cells.astype(np.int64), np.uint32(1))
        if table.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "cells": [packed(x) for x in np.split(table, BLOCKS)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for b in batches:
            for k, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = unpacked(cells, part)
                if k == block:
                    total = total + own
                    continue
                if block is not None:
                    yield summed(block, total)
                block, total = k, own
        if block is not None:
            yield summed(block, total)

    def summed(block: int, total: np.ndarray) -> pa.RecordBatch:
        level = (np.log2(np.maximum(total, 1)) * FINE).astype(np.uint16)
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([block], pa.int32()), "cells": [level.tobytes()], "total": [int(total.sum())]}
        )

    parts = docs.select(text).mapInArrow(lean(count), "block int, cells binary")
    sums = parts.repartition(BLOCKS, "block").sortWithinPartitions("block")
    levels, total = np.zeros(size, np.uint16), 0
    for row in sums.mapInArrow(lean(add), "block int, cells binary, total long").collect():  # BLOCKS rows, 8 MB in all
        levels[row["block"] * part : (row["block"] + 1) * part] = np.frombuffer(row["cells"], np.uint16)
        total += row["total"]
    least = max(FREQUENT_LEAST, FREQUENT_TIMES * total / size)
    return levels, FINE * (math.ceil(math.log2(least)) - 1)


def band(n: int, t: float) -> int:
    return int(math.log(n) / math.log(1 / t))


def needed(n: int, num: int, den: int) -> int:
    """R: so many of the first shingles of a set of n can't all be missing from a partner."""
    return n - -(-n * num // den) + 1


def classes(b: int, num: int, den: int) -> int:
    """How many classes deal out the frequent shingles of band b."""
    t = num / den
    return max(1, int(needed(max(1, math.ceil(t ** -b)), num, den) / 3))


def entries(s: np.ndarray, levels: np.ndarray, frequent: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set: 64-bit signatures, and places.

    A single shingle's place is its number in the order; a pair's is -(what the prefix leaves of the set * 128 + band + 1).
    """
    n, need = len(s), needed(len(s), num, den)
    level = levels[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    order = np.argsort(level, kind="stable")
    rare = int((level < frequent).sum())
    singles = s[order[: min(rare, need)]]
    if rare >= need:
        return singles, np.arange(len(singles), dtype=np.int64)
    sigs, places = [singles], [np.arange(len(singles), dtype=np.int64)]
    hot = s[order[rare:]]
    for b in (band(n, num / den), band(n, num / den) + 1):
        m = classes(b, num, den)
        kind = (mix(hot) % np.uint64(m)).astype(np.int64)
        _, first, where = np.unique(kind, return_index=True, return_inverse=True)
        new = np.zeros(len(hot), bool)
        new[first] = True
        gained = np.cumsum(~new)  # what the first i + 1 frequent shingles make up for
        end = int(np.searchsorted(gained, need - rare)) + 1
        by = np.argsort(where[:end], kind="stable")
        bounds = np.flatnonzero(np.diff(where[:end][by])) + 1
        for group in np.split(hot[:end][by], bounds):
            i, j = np.triu_indices(len(group), 1)
            x, y = np.minimum(group[i], group[j]), np.maximum(group[i], group[j])
            sigs.append(mix(mix(x * MULT + y) + np.uint64(b + 1)))
            places.append(np.full(len(i), -((n - rare - end) * 128 + b + 1), np.int64))
    return np.concatenate(sigs), np.concatenate(places)


def indexed(docs: DataFrame, id_col: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """Per document: id, n_shingles, set_key, and its index entries."""
    levels, frequent = frequency_levels(docs, text, n)
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # 2**TABLE_BITS levels, whatever the input
    schema = "id long, n_shingles int, set_key long, text_key long, sigs array<long>, places array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # keys of this task's sets: only the first of its copies is indexed
        for b in batches:
            for start, texts in byte_chunks(b.column(1), 1 << 20):
                sets = shingle_sets(texts, n)
                keys, found = [set_key(s) for s in sets], []
                for s, key in zip(sets, keys, strict=True):
                    new = len(s) > 1 and key not in seen
                    found.append(entries(s, shared.value, frequent, num, den) if new else (s[:0], s[:0]))
                    seen.add(key)
                offsets = pa.array(np.cumsum([0, *(len(x) for x, _ in found)]).astype(np.int32))
                sigs, places = (np.concatenate([x[k] for x in found]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(start, len(texts)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array(keys, pa.int64()),
                        b.column(2).slice(start, len(texts)),
                        pa.ListArray.from_arrays(offsets, pa.array(sigs.view(np.int64))),
                        pa.ListArray.from_arrays(offsets, pa.array(places.astype(np.int64))),
                    ],
                    names=["id", "n_shingles", "set_key", "text_key", "sigs", "places"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text), text_key(F.col(text))).mapInArrow(lean(run), schema)


def whole_sets(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(set_key, shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, texts in byte_chunks(b.column(0), 1 << 20):
                sets = shingle_sets(texts, n)
                offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                values = pa.array(np.concatenate(sets).view(np.int64))
                keys = pa.array([set_key(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.ListArray.from_arrays(offsets, values)], names=["set_key", "shingles"]
                )

    return docs.select(text).mapInArrow(lean(run), "set_key long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) of set keys whose sets reach the similarity."""
    of = lambda k: sets.select(F.col("set_key").alias(k), F.col("shingles").alias(f"s_{k}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    inter = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - inter
    return both.where(den * inter >= num * union).select("a", "b")


def candidates(met: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that may be similar, of rows x and y that share a small entry.

    At every shared single shingle a similar pair has enough left: at most min(places) before it and min(rest) from it
    on. All that two sets share of the prefix that ends first, together with the rest of that set, bounds their
    intersection. Of single shingles the shared ones are counted; s shared pairs in m classes come from at most
    m (1 + sqrt(1 + 8 s / m)) / 2 shared shingles. Sets that both have larger entries may share more than is counted here
    and aren't bounded so.
    """
    nx, ny, px, py = (F.col(c) for c in ("x.n", "y.n", "x.place", "y.place"))
    enough = lambda most: most * (num + den) >= num * F.col("n")
    sizes = den * F.least(nx, ny) >= num * F.greatest(nx, ny)
    most = F.least(px, py) + F.least(nx - px, ny - py)
    met = met.where(sizes & ((px < 0) | (most * (num + den) >= num * (nx + ny))))
    rest = lambda n: F.ceil(n * num / den) - 1  # noqa: E731  of a set that is indexed by singles alone
    left = F.greatest(F.shiftright(-px, 7), F.shiftright(-py, 7))
    by = F.when(px < 0, (-px).bitwiseAND(F.lit(127))).otherwise(0)
    met = met.groupBy(F.col("x.k").alias("a"), F.col("y.k").alias("b"), by.alias("by")).agg(
        F.first(nx + ny).alias("n"), F.first(F.greatest(rest(nx), rest(ny))).alias("rest"), F.max(left).alias("left"),
        F.first(F.col("x.single") & F.col("y.single")).alias("single"), F.count("*").alias("shared"),
        F.first(F.col("x.larger") & F.col("y.larger")).alias("larger"),
    )
    m = F.element_at(F.array(*[F.lit(classes(b, num, den)) for b in range(LAST_BAND)]), F.greatest("by", F.lit(1)).cast("int"))
    of_pairs = m * (1 + F.sqrt(1 + 8 * F.col("shared") / m)) / 2 + F.col("left") + 1e-6
    both = met.groupBy("a", "b").agg(
        F.first("n").alias("n"), F.first("rest").alias("rest"), F.first("single").alias("single"),
        F.coalesce(F.sum(F.when(F.col("by") == 0, F.col("shared"))), F.lit(0)).alias("singles"),
        F.min(F.when(F.col("by") > 0, of_pairs)).alias("of_pairs"), F.first("larger").alias("larger"),
    )
    by_singles = enough(F.col("singles") + F.col("rest"))
    by_pairs = F.col("of_pairs").isNull() | enough(F.col("singles") + F.col("of_pairs"))
    return both.where(F.col("larger") | F.when(F.col("single"), by_singles).otherwise(by_pairs)).select("a", "b")


def dealt_blocks(cells: DataFrame, num: int, den: int) -> DataFrame:
    """cells with lo, hi and side: a row for each pair of blocks that a set is compared in; side is its own block.

    A cell of up to BLOCK sets with up to VALUES shingles is one block. The sets of a larger one are dealt into bands of size, a
    factor den / num wide, and each band into blocks by a hash: partners are at most one band apart, so other pairs of bands
    never meet.
    """
    band_of = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("long")
    banded = cells.withColumn("band", band_of)
    sizes = banded.groupBy("cell", "band").agg(F.count("*").alias("m"), F.sum(F.col("n").cast("long")).alias("values"))
    count = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("values") / VALUES)).cast("int")
    blocks = F.map_from_entries(F.collect_list(F.struct("band", count.alias("k"))))  # LAST_BAND at most
    of_cell = sizes.groupBy("cell").agg(F.sum("m").alias("rows"), F.sum("values").alias("values"), blocks.alias("blocks"))
    large = of_cell.where((F.col("rows") > BLOCK) | (F.col("values") > VALUES)).drop("values")
    known = with_unique(banded, large, "cell", cells.count(), "left")
    in_band = lambda b: F.coalesce(F.try_element_at("blocks", b), F.lit(0))
    code = lambda b, k: b * (1 << 32) + k
    own = F.pmod(F.xxhash64("k"), in_band(F.col("band")).cast("long"))
    known = known.withColumn("side", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(code(F.col("band"), own)))
    others = lambda b: F.transform(F.filter(F.sequence(F.lit(0), in_band(b)), lambda k: k < in_band(b)), lambda k: code(b, k.cast("long")))
    every = F.concat(others(F.col("band") - 1), others(F.col("band")), others(F.col("band") + 1))
    known = known.withColumn("with", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(every)))
    return known.withColumn("lo", F.least("side", "with")).withColumn("hi", F.greatest("side", "with")).drop("with", "band", "blocks")


def cell_links(cells: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """key, links, other: parts of the degrees, and a forest's edges, of the similar sets of each cell.

    cells: cell, k, n (size of the set), weight (copies of the set) and held (all cells of the set); other is key itself
    where there's no edge.
    """
    dealt = dealt_blocks(cells, num, den)
    dealt = dealt.select("cell", "lo", "hi", "side", F.col("k").alias("set_key"), "weight", "held").join(sets, "set_key")
    dealt = dealt.select("cell", "lo", "hi", "side", "set_key", "shingles", "weight", "held").repartition("cell", "lo", "hi")
    dealt = dealt.sortWithinPartitions("cell", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, ...] | None = None
        parts: list[tuple[int, int, np.ndarray, int, np.ndarray]] = []

        def close() -> Iterator[pa.RecordBatch]:
            if len(parts) < 2:
                return
            side = np.array([p[0] for p in parts])
            keys = np.array([p[1] for p in parts])
            i, j = similar([p[2] for p in parts], num, den)
            if now[1] != now[2]:
                apart = side[i] != side[j]
                i, j = i[apart], j[apart]
            if not len(i):
                return
            label = forest(i, j, len(keys))
            first = shared_counts([p[4][p[4] < now[0]] for p in parts])[i, j] == 0
            i, j = i[first], j[first]
            weight = np.array([p[3] for p in parts], np.float64)  # whole numbers below 2**53
            degree = np.bincount(i, weight[j], len(keys)) + np.bincount(j, weight[i], len(keys))
            use = np.flatnonzero((label != np.arange(len(keys))) | (degree > 0))
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array(keys[use]), "links": pa.array(degree[use].astype(np.int64)), "other": pa.array(keys[label[use]])}
            )

        for b in batches:
            cell, lo, hi, side, key = (b.column(c).to_pylist() for c in range(5))
            column = b.column(5)
            ends = column.offsets.to_numpy()
            values = column.values.to_numpy()
            weight, held = b.column(6).to_pylist(), b.column(7)
            held_ends, held_values = held.offsets.to_numpy(), held.values.to_numpy()
            for r in range(b.num_rows):
                at = (cell[r], lo[r], hi[r])
                if at != now:
                    yield from close()
                    now, parts = at, []
                own = held_values[held_ends[r] : held_ends[r + 1]]
                parts.append((side[r], key[r], values[ends[r] : ends[r + 1]], weight[r], own))
        yield from close()

    return dealt.mapInArrow(lean(run), "key long, links long, other long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share; on the diagonal only values of several sets count."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    found, column = np.unique(np.concatenate(sets), return_inverse=True)
    several = np.bincount(column, minlength=len(found)) > 1
    place = np.cumsum(several) - 1
    row, column = row[several[column]], place[column[several[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers below 2**24
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        shared += part @ part.T
    return shared


def similar(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i < j) of the pairs of sets that reach the similarity."""
    size = np.array([len(s) for s in sets], np.int64)
    shared = shared_counts(sets)
    i, j = np.nonzero(np.triu((den + num) * shared.astype(np.int64) >= num * (size[:, None] + size), 1))
    return i, j


def ngram_jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, num: int = 4, den: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(members, links). members: id, n_shingles, set_key, text_key, component_key, component_id, n_links, one row per row
    of docs. links: pairs (a, b) of set keys that are similar or connected through similar sets; copies share a set key and
    aren't paired.

    Two texts link when den * |intersection| >= num * |union| of their n-word shingle sets. links holds enough pairs to
    connect whatever is connected, not every link. n_links counts all other rows that link with the row, copies too.
    component_id is the least id that is reachable, component_key names the component even where all its ids are null
    (component_id is null then). Null and blank texts have no shingles and link with nothing; repeated rows are copies;
    other columns are ignored. Words are split at [\\x20\\x09-\\x0D]+ after A-Z are lower-cased.
    """
    index = materialize(indexed(docs, id_col, text, n, num, den), "ngram-index")
    classes_of = index.where("n_shingles > 0").groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    rows = index.select(
        F.col("set_key").alias("k"), F.col("n_shingles").alias("n"), (F.array_min("places") >= 0).alias("single"),
        F.explode(F.arrays_zip("sigs", "places")).alias("e"),
    )
    rows = rows.select("k", "n", "single", F.col("e.sigs").alias("sig"), F.col("e.places").alias("place"))
    shared = rows.groupBy("sig").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("rows"))
    shared = materialize(shared.where("lo < hi").select("sig", "rows"), "ngram-shared")
    total, documents = index.agg(F.coalesce(F.sum(F.size("sigs")), F.lit(0)), F.count("*")).first()
    entry = materialize(with_unique(rows, shared, "sig", total).dropDuplicates(["sig", "k"]), "ngram-entries")
    sizes = entry.groupBy("sig").agg(F.count("*").alias("rows")).select("sig", "rows", F.col("rows").alias("size"))
    entry = materialize(with_unique(entry, materialize(sizes, "ngram-counts"), "sig", total), "ngram-sizes")
    large = entry.where(F.col("size") > SMALL)
    degree = large.groupBy("k").agg(F.count("*").alias("degree"))
    small = entry.where(F.col("size") <= SMALL).join(degree, "k", "left").withColumn("larger", F.col("degree").isNotNull())
    pairs = small.alias("x").join(small.alias("y"), "sig").where(F.col("x.k") < F.col("y.k"))
    pairs = materialize(candidates(pairs, num, den), "ngram-pairs")

    ranked = large.join(degree, "k")
    leader = materialize(ranked.groupBy("sig").agg(F.max_by("k", F.struct("degree", "k")).alias("cell"), F.count("*").alias("rows")), "ngram-leaders")
    cells = with_unique(large, leader, "sig", total).select("cell", "k", "n").distinct()
    cells = materialize(cells, "ngram-cells")
    held = cells.groupBy("k").agg(F.collect_list("cell").alias("held"))
    weights = classes_of.select("set_key", "weight")

    keys = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).unionByName(cells.select(F.col("k").alias("set_key")))
    sets = materialize(_sets_of(docs, index, keys.distinct(), id_col, text, n), "ngram-sets")
    direct = materialize(verified(pairs, sets, num, den), "ngram-direct")
    known = cells.join(held.join(weights, F.col("k") == F.col("set_key")).drop("set_key"), "k")
    met = materialize(cell_links(known, sets, num, den), "ngram-met")
    linked = direct.unionByName(met.where("key <> other").select(F.col("key").alias("a"), F.col("other").alias("b")))
    of = lambda c: held.select(F.col("k").alias(c), F.col("held").alias(f"held_{c}"))
    apart = direct.join(of("a"), "a", "left").join(of("b"), "b", "left")
    apart = apart.where(~F.coalesce(F.arrays_overlap("held_a", "held_b"), F.lit(False)))
    ends = apart.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("set_key")), F.struct(F.col("b").alias("key"), F.col("a").alias("set_key")))).alias("e"))
    counted = ends.select("e.*").join(weights, "set_key").select("key", F.col("weight").alias("links")).unionByName(met.select("key", "links"))
    degrees = counted.groupBy(F.col("key").alias("set_key")).agg(F.sum("links").alias("links"))

    reach = labelled(classes_of, linked, "set_key", "rep")
    of_set = reach.join(degrees, "set_key", "left").select(
        "set_key", F.col("least").alias("component_id"), F.col("c").alias("component_key"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("weight").alias("rows"),
    )
    of_set = materialize(of_set, "ngram-classes")
    members = with_unique(index.select("id", "n_shingles", "set_key", "text_key"), of_set, "set_key", documents, "left")
    members = members.select(
        "id", "n_shingles", "set_key", "text_key", "component_key",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    return members, linked


def _sets_of(docs: DataFrame, index: DataFrame, keys: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """The whole sets of the keys: the texts of one row each, shingled again."""
    rep = index.where("n_shingles > 1").groupBy("set_key").agg(F.min(F.coalesce("id", F.lit(-1))).alias("rep"))
    ids = materialize(rep.join(keys, "set_key", "left_semi").select("rep").distinct(), "ngram-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("rep"), F.col(text).alias("text"))
    found = whole_sets(rows.join(ids, "rep", "left_semi"), "text", n)
    return found.groupBy("set_key").agg(F.first("shingles").alias("shingles"))
