"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, one scan of each text.

A text is normalised to its words, lower-cased in A-Z and joined by single spaces. An item's windows are its runs of 13
words (the whole item if it has fewer). The automaton is built once per worker over the distinct windows of all items,
over UTF-8 bytes, so that a scan is one pass in C; only documents with a match are looked at further, to map matches to
word numbers and word numbers to offsets in the original text.

The benchmark is small by nature, and that is checked: beyond WINDOW_BYTES of windows it is cut into parts by window
hash, each part is an automaton, and the documents are scanned once for each part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, lean, materialize, text_key

WINDOW = 13
#: Bytes of distinct windows that one automaton may hold; it takes some ten times that in memory.
WINDOW_BYTES = 8 << 20
#: Word bytes are 0-9, a-z (A-Z lower-cased) and all bytes from 0x80; every other byte separates.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_automata: dict[str, ahocorasick.Automaton] = {}


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def window_table(benchmark: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(item, win): the distinct windows of each item, as normalised words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items, wins = [], []
            for item, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                w = words(raw)
                for win in {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ():
                    items.append(item)
                    wins.append(win)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(wins, pa.binary())], names=["item", "win"])

    return benchmark.select(F.col(id_col).cast("string"), text).mapInArrow(lean(run), "item string, win binary")


def automaton(key: str, wins: list[bytes]) -> ahocorasick.Automaton:
    """The automaton of a window list, one in each worker. Strings are bytes seen as Latin-1."""
    if key not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for k, w in enumerate(wins):
            made.add_word(f" {w.decode('latin-1')} ", (k, w.count(b" ") + 1, len(w)))
        made.make_automaton()
        _automata[key] = made
    return _automata[key]


def word_starts(text: bytes) -> list[tuple[int, int]]:
    """Byte range of each word of the original text."""
    return [m.span() for m in re.finditer(rb"[^ ]+", text.translate(WORD_BYTES))]


def spans_of(raw: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code-point ranges of the runs of hit words in the original text."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    at = word_starts(raw)
    chars = np.cumsum(np.concatenate(([0], (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[at[a][0]]), int(chars[at[b - 1][1]])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def scanned(docs: DataFrame, id_col: str, text: str, wins: list[bytes], items: list[list[str]]) -> DataFrame:
    """Per row: id, n_words, hit words as numbers, item ids."""
    key = hashlib.sha256(b"\n".join(wins)).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((key, wins, items))
    schema = "id long, text_key long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, words array<int>, items array<string>"
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wins, items = shared.value
        auto = automaton(key, wins) if wins else None
        for b in batches:
            for start, texts in byte_chunks(b.column(1)):
                counts, hits, spans, at_words, found = [], [], [], [], []
                for raw in texts:
                    own = words(raw)
                    counts.append(len(own))
                    joined = f" {b' '.join(own).decode('latin-1')} " if own else ""
                    matches = list(auto.iter(joined)) if own and auto else ()
                    if not matches:
                        hits.append(0)
                        spans.append([])
                        at_words.append([])
                        found.append([])
                        continue
                    starts = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 0x20)
                    hit, which = np.zeros(len(own), bool), set()
                    for end, (k, n, length) in matches:
                        first = int(np.searchsorted(starts, end - length - 1))
                        hit[first : first + n] = True
                        which.add(k)
                    hits.append(int(hit.sum()))
                    spans.append([{"start": x, "end": y} for x, y in spans_of(raw, hit)])
                    at_words.append(np.flatnonzero(hit).tolist())
                    found.append(sorted({i for k in which for i in items[k] if i is not None}))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(start, len(texts)), b.column(2).slice(start, len(texts)), pa.array(counts, pa.int64()), pa.array(hits, pa.int64()),
                        pa.array(spans, pa.list_(kind)), pa.array(at_words, pa.list_(pa.int32())),
                        pa.array(found, pa.list_(pa.string())),
                    ],
                    names=["id", "text_key", "n_words", "n_hit", "spans", "words", "items"],
                )

    return docs.select(F.col(id_col).cast("long"), text, text_key(F.col(text))).mapInArrow(lean(run), schema)


def _joined(spans: Column) -> Column:
    """Sorted spans with overlapping ones joined."""

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wide = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        apart = (F.size(acc) == 0) | (s["start"] > last["end"])
        return F.when(apart, F.concat(acc, F.array(s))).otherwise(F.concat(head, F.array(wide)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)


def _merged(found: DataFrame, parts: int) -> DataFrame:
    """The parts' rows of each document as one; a document's rows of one part are equal."""
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    one = found.groupBy("id", "text_key", "n_words").agg(
        F.size(united("words")).cast("long").alias("n_hit"), _joined(united("spans")).alias("spans"),
        united("items").alias("items"), (F.count("*") / parts).cast("int").alias("copies"),
    )
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
    item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, share: int = 20,
) -> DataFrame:
    """id, text_key, n_words, n_hit, spans, items, contaminated, one row per row of docs.

    A word inside any occurrence of a window is hit; contaminated if share * n_hit >= n_words and n_hit > 0. spans are the
    runs of hit words as code-point ranges of the original text; items the ids, as strings, of the items whose windows
    occur, sorted. Null and wordless texts have no words and no hits; items without words have no windows; items with a
    null id hit but aren't named; repeated items count once; repeated rows of docs are each returned; an empty benchmark
    hits nothing; further columns are ignored.
    """
    table = materialize(window_table(benchmark, item_col, item_text, size), "windows")
    table = table.groupBy("win").agg(F.collect_set("item").alias("items"))
    volume = table.agg(F.coalesce(F.sum(F.length("win")), F.lit(0))).first()[0]
    parts = max(1, -(-volume // WINDOW_BYTES))
    found = None
    for p in range(parts):
        rows = table.where(F.pmod(F.xxhash64("win"), F.lit(parts)) == p).collect()  # at most about WINDOW_BYTES
        rows.sort(key=lambda r: bytes(r["win"]))
        one = scanned(docs, id_col, text, [bytes(r["win"]) for r in rows], [list(r["items"]) or [None] for r in rows])
        found = one if found is None else found.unionByName(one)
    if parts > 1:  # the parts' hits of a document overlap; equal rows come back as often as they stood
        found = _merged(found, parts)
    verdict = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return found.select("id", "text_key", "n_words", "n_hit", "spans", "items", verdict.alias("contaminated"))
