"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A text is cut by the tokenizer's pattern; each match is merged on its own. A leaf of the tree stands for a byte position
that starts a live token and holds (rank of the pair with the next live token, position); inner nodes hold minima, so the
root is the leftmost pair of least rank. A merge changes three leaves (the pair, its right token, the left neighbour),
each a logarithmic update. Short matches are merged side by side in numpy, one tree per row; long ones one by one.
Matches repeat, so each worker keeps a bounded cache: the ids of all matches in one flat array, and where each has its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_chunks, lean

NONE = np.int64(1) << np.int64(60)
#: Matches of up to so many bytes are merged side by side.
SIDE_BY_SIDE = 64
CACHE = 150_000


class Bpe:
    """Tables of one vocabulary, built once in a worker."""

    def __init__(self, ranks_file: bytes, pattern: str) -> None:
        pairs = [line.split() for line in ranks_file.splitlines() if line]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = {r: t for t, r in self.rank.items()}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.bits = max(self.token).bit_length()
        merges = {}
        for t, r in self.rank.items():
            for i in range(1, len(t)):
                a, b = self.rank.get(t[:i]), self.rank.get(t[i:])
                if a is not None and b is not None:
                    merges[a << self.bits | b] = r
        self.merges = merges
        self.keys = np.array(sorted(merges), np.int64)
        self.values = np.array([merges[int(k)] for k in self.keys], np.int64)
        self.byte_pairs = self.pair_ranks(np.repeat(self.byte, 256), np.tile(self.byte, 256))
        tokens = [self.token.get(i, b"") for i in range(max(self.token) + 1)]
        self.token_size = np.array([len(t) for t in tokens], np.int32)
        self.token_start = np.cumsum(self.token_size, dtype=np.int64) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Empty the cache."""
        self.place: dict[str, int] = {}  # number of each match; where its ids start in flat, and how many they are
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of token ids; -1 where they don't merge."""
        key = left << self.bits | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merged_rows(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids, and how many each has, of pieces that are alike in length (2 to SIDE_BY_SIDE bytes), one tree per row."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        w = 1 << int(size.max() - 1).bit_length()
        raw = np.frombuffer(b"".join(p.ljust(w, b"\0") for p in pieces), np.uint8).reshape(n, w)
        place = np.arange(w)
        tok = np.where(place < size[:, None], self.byte[raw], -1)
        live = tok >= 0
        after = np.where(place + 1 < size[:, None], place + 1, w)  # w: none
        before = np.broadcast_to(place - 1, (n, w)).copy()  # -1: none
        tree = np.full((n, 2 * w), NONE)
        rank = self.byte_pairs[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
        rank[~live[:, 1:]] = -1
        tree[:, w : 2 * w - 1] = np.where(rank >= 0, rank * w + place[:-1], NONE)
        for level in range(w.bit_length() - 2, -1, -1):
            a = 1 << level
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])

        def update(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray | np.int64) -> None:
            node = leaf + w
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def leaf_value(rows: np.ndarray, at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
            r = self.pair_ranks(tok[rows, at], tok[rows, np.minimum(nxt, w - 1)])
            return np.where((nxt < w) & (r >= 0), r * w + at, NONE)

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            least = tree[rows, 1]
            at = least % w
            right = after[rows, at]
            then = after[rows, right]
            tok[rows, at] = least // w
            live[rows, right] = False
            after[rows, at] = then
            has = then < w
            before[rows[has], then[has]] = at[has]
            update(rows, right, NONE)
            update(rows, at, leaf_value(rows, at, then))
            left = before[rows, at]
            has = left >= 0
            if has.any():
                update(rows[has], left[has], leaf_value(rows[has], left[has], at[has]))
            rows = rows[tree[rows, 1] < NONE]
        return tok[live], live.sum(axis=1)

    def merged_long(self, piece: bytes) -> list[int]:
        """Token ids of one piece of any length."""
        n = len(piece)
        w = 1 << (n - 1).bit_length()
        tok = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none, get, bits = int(NONE), self.merges.get, self.bits
        tree = [none] * (2 * w)
        for i in range(n - 1):
            r = get(tok[i] << bits | tok[i + 1])
            if r is not None:
                tree[w + i] = r * w + i
        for i in range(w - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def update(leaf: int, value: int) -> None:
            node = leaf + w
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                low = a if a < b else b
                if tree[node] == low:
                    return
                tree[node] = low

        live = [True] * n
        while tree[1] < none:
            rank, at = divmod(tree[1], w)
            right = after[at]
            then = after[right]
            tok[at] = rank
            live[right] = False
            after[at] = then
            if then < n:
                before[then] = at
            update(right, none)
            r = get(rank << bits | tok[then]) if then < n else None
            update(at, none if r is None else r * w + at)
            left = before[at]
            if left >= 0:
                r = get(tok[left] << bits | rank)
                update(left, none if r is None else r * w + left)
        return [t for t, x in zip(tok, live, strict=True) if x]

    def learn(self, pieces: set[str]) -> None:
        """Put the token ids of new pieces into the cache."""
        raws = [p.encode() for p in pieces]
        ranks = np.array([-1 if r is None else r for r in map(self.rank.get, raws)], np.int32)
        names = list(pieces)
        width = np.fromiter(map(len, raws), np.int64, len(raws))
        kind = np.where(ranks >= 0, 0, np.where(width > SIDE_BY_SIDE, 1 << 30, width))
        order = np.argsort(kind, kind="stable")
        named = [names[i] for i in order.tolist()]
        whole = int((ranks >= 0).sum())
        short = int((kind <= SIDE_BY_SIDE).sum())
        ids, sizes = [self.flat, ranks[order[:whole]]], [self.size, np.ones(whole, np.int32)]
        bounds = np.searchsorted(kind[order], [1 << k for k in range(SIDE_BY_SIDE.bit_length())], side="right")
        for lo, hi in zip([whole, *bounds], [*bounds, short], strict=True):
            for at in range(lo, hi, 4096):
                got, size = self.merged_rows([raws[i] for i in order[at : min(at + 4096, hi)].tolist()])
                ids.append(got.astype(np.int32))
                sizes.append(size.astype(np.int32))
        for i in order[short:].tolist():
            got = self.merged_long(raws[i])
            ids.append(np.array(got, np.int32))
            sizes.append(np.array([len(got)], np.int32))
        names = named
        self.place.update(zip(names, range(len(self.place), len(self.place) + len(names)), strict=True))
        self.flat, self.size = np.concatenate(ids), np.concatenate(sizes)
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after another, and where each text's ids end."""
        pieces: list[str] = []
        ends = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            pieces += self.find(t)
            ends[i] = len(pieces)
        at = list(map(self.place.get, pieces))
        new = {p for p, k in zip(pieces, at, strict=True) if k is None}
        if new:
            if len(self.place) + len(new) > CACHE:
                self.forget()
                new = set(pieces)
            self.learn(new)
            at = map(self.place.__getitem__, pieces)
        at = np.fromiter(at, np.int64, len(pieces))
        ids, reach = spread(self.flat, self.start[at], self.size[at])
        return ids, np.concatenate(([0], reach))[ends]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, one after another, and where the bytes end of each run of ids, given by its end."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token_size) or not self.token_size[ids].all()):
            raise KeyError("an id that the vocabulary lacks")
        out, reach = spread(self.token_bytes, self.token_start[ids], self.token_size[ids])
        return out, np.concatenate(([0], reach))[ends]


def spread(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of flat that begin at start and have size values, one after another, and where each ends in the result."""
    reach = np.cumsum(size, dtype=np.int64)
    at = np.repeat(start - (reach - size), size)
    at += np.arange(len(at))
    return flat[at], reach


_loaded: dict[str, Bpe] = {}


def tables(ranks_file: bytes, pattern: str) -> Bpe:
    """The vocabulary's tables, one in each worker."""
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(ranks_file, pattern)
    return _loaded[key]


def vocabulary(spark: SparkSession, path: str, pattern: str):  # noqa: ANN201
    """A broadcast of a tiktoken rank file: about 1 MB, whatever the input."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern))


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", back: str | None = None) -> DataFrame:
    """docs with a column `out`: array<int> of token ids, no special tokens; a column of that name is replaced.

    Each match of pattern is merged separately, by the ranks in the tiktoken file at path, a path on the driver. Null
    texts are empty and give no ids; white space, controls and characters of any script are covered by their bytes; texts
    and matches may be of any length; repeated rows are encoded alike; an empty table gives an empty one. Other columns
    stay as they are. back names one more column, the bytes that the ids decode to: worked out from the ids alone, as by
    decoded(), but in the same worker, so that a task holds the vocabulary once.
    """
    shared = vocabulary(docs.sparkSession, path, pattern)
    docs = docs.drop(out, *([back] if back else []))
    at = docs.columns.index(text)
    more = [F.lit(b"").alias(back)] if back else []
    schema = docs.select("*", F.array().cast("array<int>").alias(out), *more).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(*shared.value)
        for b in batches:
            for start, raw in byte_chunks(b.column(at), 1 << 20):
                ids, ends = bpe.encode([x.decode() if x else "" for x in raw])
                offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                made = [pa.ListArray.from_arrays(offsets, pa.array(ids))]
                if back:
                    made.append(binary_column(*bpe.decode(ids, ends)))
                yield pa.RecordBatch.from_arrays([*b.slice(start, len(raw)).columns, *made], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def binary_column(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes, cut at ends, as a column."""
    offsets = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(raw)])


def decoded(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """docs with a column `out`: the bytes that the ids stand for; null ids give none. Unknown ids fail. A column named out
    is replaced."""
    shared = vocabulary(docs.sparkSession, path, pattern)
    docs = docs.drop(out)
    at = docs.columns.index(ids)
    schema = docs.select("*", F.lit(b"").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(*shared.value)
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                got = part.column(at)
                sizes = pc.fill_null(pc.list_value_length(got), 0).to_numpy(zero_copy_only=False)
                values = pc.list_flatten(got)
                if values.null_count:
                    raise KeyError("a null among the ids")
                column = binary_column(*bpe.decode(values.to_numpy(), np.cumsum(sizes)))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*b.schema.names, out])

    return docs.mapInArrow(lean(run), schema)
