"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored from memory-mapped sorted hash arrays.

Tasks count the pairs of neighbouring tokens they see and send them, packed, to shards of the pair's hash. A shard adds up
its pairs, writes them as a sorted array of 64-bit hashes with counts, and passes on what it has of each word: occurrences,
how many different words precede it, how many of its successors occur once, twice or more. Word shards add that up and
write sorted arrays in turn. Shards are uniform whatever the corpus, so no word is hot, and they grow in number with it.
The files lie in the shared folder; scoring workers map them and look up sorted queries, so a machine holds the pages in
use once. A lost task writes the same file again under the same name. Where there are more shards than a worker can keep
mapped, the distinct queries of some MB of text are sent to the shards instead, so that each shard is opened once and by one
task, and what it answers is sent back to the texts.

p(w | v) = (c(v w) - D) / c(v) + gamma(v) p1(w),  p1(w) = (k(w) - D') / K + gamma' / (V + 1), where k(w) counts the
different words before w, K their sum, and D and D' depend on whether the count is 1, 2 or more.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_at_exit, shared_dir
from .common import LOWER_ASCII, byte_chunks, materialize
from .ngram_join import MULT, mix

#: Hashes of the text's begin and end, which no word has but by chance.
BEGIN, END = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
#: Bytes of text for each pair shard; tokens that a task counts at once; words of tallies that are held before they are added up.
SHARD_BYTES, AT_ONCE, HELD_WORDS = 16 << 20, 2_000_000, 4_000_000
#: Bits of word shards: as many as of pair shards up to the first, one more for each doubling beyond 1024 pair shards, up to the last.
WORD_BITS = 8, 12
#: With more pair shards than this, queries are sent to the shards; below, workers map them all. The second is for folders that
#: can't be mapped, whose files take a worker's own memory.
OPEN, FETCHED = 4096, 8


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that every score needs."""

    folder: str
    pair_bits: int
    word_bits: int
    tokens: int
    words: int
    discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_total: int
    word_gamma: float


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in turn, each text's end included, and the number of tokens of each text."""
    words: list[bytes] = []
    counts = []
    for x in texts:
        own = x.translate(LOWER_ASCII).split() if x else []
        words += own
        counts.append(len(own) + 1)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if counts else 0, np.uint64)
    at_end = np.zeros(len(out), bool)
    at_end[ends - 1] = True
    out[at_end] = END
    out[~at_end] = h
    return out, np.array(counts, np.int64)


def contexts(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each token; BEGIN at the start of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(counts) - counts] = BEGIN
    return before


def pair_key(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(mix(before) * MULT + tokens)


def small(x: np.ndarray) -> bytes:
    """Whole numbers as one byte each; 255 and over follow with their places."""
    big = np.flatnonzero(x >= 255)
    return len(big).to_bytes(4, "little") + big.astype("<u4").tobytes() + x[big].astype("<u8").tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes()


def unsmall(raw: memoryview) -> tuple[np.ndarray, int]:
    """(numbers, bytes read): raw holds small() of as many numbers as are left in it."""
    n = int.from_bytes(raw[:4], "little")
    places = np.frombuffer(raw[4 : 4 + 4 * n], "<u4")
    values = np.frombuffer(raw[4 + 4 * n : 4 + 12 * n], "<u8")
    x = np.frombuffer(raw[4 + 12 * n :], np.uint8).astype(np.int64)
    x[places] = values
    return x, len(raw)


def pack_pairs(before: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> bytes:
    """Pairs by a dictionary of their words: successors in runs by the first word."""
    words, where = np.unique(np.concatenate([before, tokens]), return_inverse=True)
    a, b = where[: len(before)], where[len(before) :]
    order = np.argsort(a, kind="stable")
    runs = small(np.bincount(a, minlength=len(words)))
    wide = "<u2" if len(words) < 65536 else "<u4"
    head = np.array([len(words), len(a), len(runs)], "<u4").tobytes()
    return head + words.astype("<u8").tobytes() + runs + b[order].astype(wide).tobytes() + small(counts[order])


def unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    view = memoryview(raw)
    n, m, r = np.frombuffer(view[:12], "<u4").tolist()
    at = 12 + 8 * n
    words = np.frombuffer(view[12:at], "<u8")
    runs, _ = unsmall(view[at : at + r])
    at += r
    width = 2 if n < 65536 else 4
    b = np.frombuffer(view[at : at + width * m], f"<u{width}")
    counts, _ = unsmall(view[at + width * m :])
    return np.repeat(words, runs), words[b], counts


def _shared(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder and the folder's path in it."""
    for scheme in ("s3a://", "s3n://"):  # the names that Spark's readers give S3
        if folder.startswith(scheme):
            folder = "s3://" + folder.removeprefix(scheme)
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or ":/" in folder else "file://" + folder)


def _open_out(folder: str, name: str, parts: list[np.ndarray]) -> None:
    """Write arrays one after the other to a file of the shared folder, whole or not at all."""
    fs, root = _shared(folder)
    fs.create_dir(root, recursive=True)
    temporary = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        for p in parts:
            out.write(np.ascontiguousarray(p).view(np.uint8).data)
    fs.move(temporary, f"{root}/{name}")


def _mapped(folder: str, name: str) -> np.ndarray:
    """The bytes of a file of the shared folder, memory-mapped; where the folder is no file system path they are fetched
    into an anonymous map, no local file."""
    fs, root = _shared(folder)
    path = f"{root}/{name}"
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with fs.open_input_file(path) as found:
        size = found.size()
        if not size:
            return np.zeros(0, np.uint8)
        held = mmap.mmap(-1, size)
        while block := found.read(8 << 20):
            held.write(block)
    return np.frombuffer(held, np.uint8)


def pair_rows(docs: DataFrame, text: str, bits: int) -> DataFrame:
    """(shard, pairs): packed counts of neighbouring tokens, as often as a task fills its buffer."""

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        before, tokens = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        key, first, counts = np.unique(pair_key(before, tokens), return_index=True, return_counts=True)
        cuts = np.searchsorted(key >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
        shards, blobs = [], []
        for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                shards.append(s)
                blobs.append(pack_pairs(before[first[a:b]], tokens[first[a:b]], counts[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            for _, texts in byte_chunks(b.column(0)):
                tokens, counts = token_hashes(texts)
                held.append((contexts(tokens, counts), tokens))
                size += len(tokens)
                if size >= AT_ONCE:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return docs.select(text).mapInArrow(run, "shard int, pairs binary")


def pair_shards(rows: DataFrame, folder: str, bits: int, word_bits: int) -> DataFrame:
    """Write pairs-<shard>; return (shard, words, tallies): what each word shard gets, and with shard -1 counts of counts."""

    def close(shard: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        before, tokens, counts = (np.concatenate([x[k] for x in held]) for k in range(3))
        key = pair_key(before, tokens)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total = np.add.reduceat(counts[order], first)
        key, before, tokens = key[first], before[order[first]], tokens[order[first]]
        big = np.flatnonzero(total >= 255)
        head = np.array([len(key), len(big)], np.uint64)
        _open_out(folder, f"pairs-{shard}", [head, key, big.astype(np.uint64), total[big].astype(np.uint64), np.minimum(total, 255).astype(np.uint8)])
        words, where = np.unique(np.concatenate([before, tokens]), return_inverse=True)
        a, b = where[: len(before)], where[len(before) :]
        n = len(words)
        tally = [np.bincount(b, total, n), np.bincount(b, minlength=n), *(np.bincount(a[x], minlength=n) for x in (total == 1, total == 2, total > 2))]
        tally = [x.astype(np.int64) for x in tally]
        cuts = np.searchsorted(words >> np.uint64(64 - word_bits), np.arange((1 << word_bits) + 1).astype(np.uint64))
        for s, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if j > i:
                parts = [small(x[i:j]) for x in tally]
                sizes = np.array([j - i, *map(len, parts)], "<u4").tobytes()
                yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "words": [sizes + words[i:j].astype("<u8").tobytes() + b"".join(parts)]})
        seen = np.bincount(np.minimum(total, 5), minlength=6)[1:5]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([-1], pa.int32()), "words": [seen.astype("<i8").tobytes()]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for shard, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shard != now and held:
                    yield from close(now, held)
                    held = []
                now = shard
                held.append(unpack_pairs(raw))
        if held:
            yield from close(now, held)

    dealt = rows.repartition(1 << bits, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard int, words binary")


def word_shards(rows: DataFrame, folder: str, bits: int, discounts: tuple[float, float, float]) -> DataFrame:
    """Write words-<shard>; return per shard: tokens, words, begins, and counts of counts of the words' predecessors."""

    def summed(held: list[tuple]) -> tuple:
        words, where = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return words, [np.bincount(where, np.concatenate([x[1][i] for x in held]), len(words)).astype(np.int64) for i in range(5)]

    def close(shard: int, held: list[tuple]) -> pa.RecordBatch:
        words, (c, k, n1, n2, n3) = summed(held)
        seen = c > 0  # all but BEGIN
        weight = discounts[0] * n1 + discounts[1] * n2 + discounts[2] * n3
        head = np.array([len(words)], np.uint64)
        _open_out(folder, f"words-{shard}", [head, words, c.astype(np.uint64), k.astype(np.uint64), weight.astype(np.float64)])
        of = np.bincount(np.minimum(k[seen], 5), minlength=6)[1:6]
        row = {"tokens": [int(c.sum())], "words": [int(seen.sum())], "preceding": [int(k.sum())]}
        return pa.RecordBatch.from_pydict(row | {f"k{i + 1}": [int(x)] for i, x in enumerate(of)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for b in batches:
            for shard, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shard != now and held:
                    yield close(now, held)
                    held, size = [], 0
                elif held and size > HELD_WORDS + 2 * len(held[0][0]):
                    held = [summed(held)]
                    size = len(held[0][0])
                now = shard
                view = memoryview(raw)
                n, *sizes = np.frombuffer(view[:24], "<u4").tolist()
                at, tally = 24 + 8 * n, []
                for size in sizes:
                    tally.append(unsmall(view[at : at + size])[0])
                    at += size
                held.append((np.frombuffer(view[24 : 24 + 8 * n], "<u8"), tally))
                size += n
        if held:
            yield close(now, held)

    dealt = rows.repartition(1 << bits, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "tokens long, words long, preceding long, " + ", ".join(f"k{i} long" for i in range(1, 6)))


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2 and more from how many counts are 1, 2, 3 and 4 (Chen and Goodman); 0.5, 0.75 and 0.9
    where a count of counts is 0 or an estimate falls outside (0, count)."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
    for i, fallback in ((1, 0.5), (2, 0.75), (3, 0.9)):
        d = i - (i + 1) * y * n[i] / n[i - 1] if y is not None and n[i - 1] and n[i] else fallback
        out.append(d if 0 < d < i else fallback)
    return tuple(out)


def trained(docs: DataFrame, text: str = "text") -> Model:
    """A model of all rows of docs; null texts count as empty, which have one token, their end."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    bits = max(4, (size // SHARD_BYTES).bit_length())
    word_bits = min(bits, WORD_BITS[0] + max(0, bits - 10), WORD_BITS[1])
    folder = f"{shared_dir(docs.sparkSession)}/kneser-ney-{uuid.uuid4().hex}"
    remove_at_exit(docs.sparkSession, folder)
    sent = materialize(pair_shards(pair_rows(docs, text, bits), folder, bits, word_bits), "word-tallies")
    # One row for each shard, a few numbers each.
    seen = [np.frombuffer(r[0], "<i8") for r in sent.where("shard = -1").select("words").collect()]
    discounts = discounts_of(np.sum(seen, axis=0).tolist() if seen else [0] * 4)
    tallies = word_shards(sent.where("shard >= 0"), folder, word_bits, discounts)
    total = tallies.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tallies.columns]).first()
    k = [total[f"k{i}"] for i in range(1, 6)]
    low = discounts_of(k[:4])
    gamma = (low[0] * k[0] + low[1] * k[1] + low[2] * sum(k[2:])) / total["preceding"] if total["preceding"] else 1.0
    return Model(folder, bits, word_bits, total["tokens"], total["words"], discounts, low, total["preceding"], gamma)


class Arrays:
    """The mapped arrays of a model, opened shard by shard as they are asked for."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.held: dict[str, tuple | None] = {}
        fs, root = _shared(model.folder)
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
        self.names = {info.base_name for info in found}

    def _kept(self, name: str, parsed) -> tuple | None:  # noqa: ANN001
        if name not in self.held:
            self.held[name] = parsed(_mapped(self.model.folder, name)) if name in self.names else None
        return self.held[name]

    def closed(self) -> None:
        """Let go of all maps; a map is closed when nothing refers to it any more."""
        self.held.clear()

    def _looked_up(self, keys: np.ndarray, bits: int, get) -> Iterator[tuple[np.ndarray, np.ndarray, tuple]]:  # noqa: ANN001
        """For sorted keys, by shard: the keys' range, places in the shard's arrays, and the arrays."""
        cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
        for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            arrays = get(s) if b > a else None
            if arrays is not None and len(arrays[0]):
                at = np.minimum(np.searchsorted(arrays[0], keys[a:b]), len(arrays[0]) - 1)
                hit = np.flatnonzero(arrays[0][at] == keys[a:b])
                yield a + hit, at[hit], arrays

    def pair_shard(self, s: int) -> tuple | None:
        def parsed(raw: np.ndarray) -> tuple:
            n, big = raw[:16].view(np.uint64).tolist()
            at = 16 + 8 * n
            return raw[16:at].view(np.uint64), raw[at + 16 * big :], raw[at : at + 8 * big].view(np.uint64), raw[at + 8 * big : at + 16 * big].view(np.uint64)

        return self._kept(f"pairs-{s}", parsed)

    def word_shard(self, s: int) -> tuple | None:
        def parsed(raw: np.ndarray) -> tuple:
            n = int(raw[:8].view(np.uint64)[0])
            cols = [raw[8 + 8 * n * i : 8 + 8 * n * (i + 1)] for i in range(4)]
            return (*(c.view(np.uint64) for c in cols[:3]), cols[3].view(np.float64))

        return self._kept(f"words-{s}", parsed)

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for rows, at, (_, counts, big, values) in self._looked_up(keys, self.model.pair_bits, self.pair_shard):
            c = counts[at].astype(np.int64)
            more = np.flatnonzero(c == 255)
            c[more] = values[np.searchsorted(big, at[more])]
            out[rows] = c
        return out

    def word_values(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences, different predecessors and discounted weight of sorted words."""
        out = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys))
        for rows, at, (_, *columns) in self._looked_up(keys, self.model.word_bits, self.word_shard):
            for x, c in zip(out, columns, strict=True):
                x[rows] = c[at]
        return out


_opened: dict[str, Arrays] = {}


def opened(model: Model) -> Arrays:
    if model.folder not in _opened:
        _opened.clear()
        _opened[model.folder] = Arrays(model)
    return _opened[model.folder]


def queries(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the scores of texts ask: sorted distinct words with the places of tokens and then of contexts in them, and sorted
    distinct pair keys with the tokens' places in them."""
    before = contexts(tokens, counts)
    words, where = np.unique(np.concatenate([tokens, before]), return_inverse=True)
    keys, place = np.unique(pair_key(before, tokens), return_inverse=True)
    return words, where, keys, place


def log_probabilities(model: Model, asked: tuple, values: tuple, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log10 p of each token, occurrences of each token in training), from the answers to queries: the words' values and the
    pairs' counts."""
    words, where, _, place = asked
    c, k, weight = values
    n = len(place)
    own, ahead, pair = where[:n], where[n:], pair[place]
    low = np.array([0.0, *model.word_discounts])
    p1 = np.maximum(k - low[np.minimum(k, 3)], 0) / max(1, model.word_total) + model.word_gamma / (model.words + 1)
    high = np.array([0.0, *model.discounts])
    total = c.copy()
    total[words == BEGIN] = c[words == END]  # as many begins as ends; every text has both
    of = total[ahead]
    known = of > 0
    p = p1[own]
    share = np.maximum(pair[known] - high[np.minimum(pair[known], 3)], 0) / of[known]
    p[known] = share + weight[ahead[known]] / of[known] * p[known]
    return np.log10(p), c[own]


#: The columns of a scored row after its id.
SCORES = "n_tokens long, n_known long, base_score double, score double, perplexity double"


def _rows(model: Model, ids: pa.Array, counts: np.ndarray, logp: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
    base = np.log10((c + 1) / (model.tokens + model.words + 1))
    first = np.cumsum(counts) - counts
    score = np.add.reduceat(logp, first)
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array(counts), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
            pa.array(np.add.reduceat(base, first)), pa.array(score), pa.array(10 ** np.minimum(-score / counts, 300)),
        ],
        names=["id", "n_tokens", "n_known", "base_score", "score", "perplexity"],
    )


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity), one row per row of docs.

    Tokens are the words between [\\x20\\x09-\\x0D]+ after A-Z are lower-cased, then one end; null and empty texts have the
    end alone. n_known counts tokens that occur in training; score is the log10 probability of the whole text, perplexity
    10 ** (-score / n_tokens). base_score adds up log10((c + 1) / (N + V + 1)) with c, N and V the token's, all and the
    distinct training tokens. With an empty training table every probability is 1. Repeated rows score alike.
    """
    rows = docs.select(F.col(id_col).cast("long"), text)
    mapped = isinstance(_shared(model.folder)[0], pyarrow.fs.LocalFileSystem)
    if 1 << model.pair_bits > (OPEN if mapped else FETCHED):
        return _scored_by_shards(rows, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = opened(model)
        for b in batches:
            for start, texts in byte_chunks(b.column(1)):
                tokens, counts = token_hashes(texts)
                asked = queries(tokens, counts)
                logp, c = log_probabilities(model, asked, arrays.word_values(asked[0]), arrays.pair_counts(asked[2]))
                yield _rows(model, b.column(0).slice(start, len(texts)), counts, logp, c)

    return rows.mapInArrow(run, f"id long, {SCORES}")


#: Kinds of rows that chunks of texts send: questions to pair and word shards, and what puts the answers together.
PAIRS, WORDS, FRAME = 0, 1, 2


def _scored_by_shards(rows: DataFrame, model: Model) -> DataFrame:
    """scored, with the queries sent to the shards. A chunk of texts, named by its task and number, asks each shard for its
    distinct sorted keys; shards are uniform, so no task gets more than a few of them; the answers of a chunk meet its frame."""
    schema = "chunk long, kind int, shard int, blob binary"

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["chunk", "kind", "shard", "blob"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            for start, texts in byte_chunks(b.column(1)):
                tokens, counts = token_hashes(texts)
                words, where, keys, place = queries(tokens, counts)
                out = []
                for kind, sorted_keys, bits in ((PAIRS, keys, model.pair_bits), (WORDS, words, model.word_bits)):
                    cuts = np.searchsorted(sorted_keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1).astype(np.uint64))
                    out += [(chunk, kind, s, sorted_keys[i:j].tobytes()) for s, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
                ids = b.column(0).slice(start, len(texts)).to_pylist()
                parts = [np.array([x is None for x in ids]), np.array([x or 0 for x in ids], np.int64), counts.astype(np.int64), words, where.astype(np.int32), place.astype(np.int32)]
                head = np.array([len(ids), len(words), len(tokens)], np.int64)
                out.append((chunk, FRAME, -1, head.tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)))
                yield batch(out)
                chunk += 1

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, now = Arrays(model), None
        for b in batches:
            out = []
            for chunk, kind, shard, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (kind, shard) != now:
                    arrays.closed()
                    now = kind, shard
                keys = np.frombuffer(blob, np.uint64)
                found = [arrays.pair_counts(keys)] if kind == PAIRS else arrays.word_values(keys)
                out.append((chunk, kind, shard, b"".join(x.tobytes() for x in found)))
            yield batch(out)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pairs, words = None, [], []
        for b in batches:
            for chunk, kind, _, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != now:
                    now, pairs, words = chunk, [], []
                if kind == PAIRS:
                    pairs.append(np.frombuffer(blob, np.int64))
                elif kind == WORDS:
                    third = len(blob) // 3
                    words.append((np.frombuffer(blob[:third], np.int64), np.frombuffer(blob[third : 2 * third], np.int64), np.frombuffer(blob[2 * third :])))
                else:  # the frame comes last, shards in the order of their keys before it
                    n, w, t = np.frombuffer(blob[:24], np.int64).tolist()
                    sizes = [(n, np.bool_), (n, np.int64), (n, np.int64), (w, np.uint64), (2 * t, np.int32), (t, np.int32)]
                    at, parts = 24, []
                    for k, kind_of in sizes:
                        size = k * np.dtype(kind_of).itemsize
                        parts.append(np.frombuffer(blob[at : at + size], kind_of))
                        at += size
                    none, ids, counts, keys, where, place = parts
                    values = tuple(np.concatenate([x[k] for x in words]) for k in range(3))
                    logp, c = log_probabilities(model, (keys, where, None, place), values, np.concatenate(pairs))
                    yield _rows(model, pa.array(ids, mask=none), counts, logp, c)

    sent = materialize(rows.mapInArrow(ask, schema), "questions")
    asked = sent.where(F.col("kind") < FRAME).repartition("kind", "shard").sortWithinPartitions("kind", "shard")
    back = asked.mapInArrow(answer, schema).unionByName(sent.where(F.col("kind") == FRAME))
    met = back.repartition("chunk").sortWithinPartitions("chunk", "kind", "shard")
    return met.mapInArrow(put_together, f"id long, {SCORES}")
