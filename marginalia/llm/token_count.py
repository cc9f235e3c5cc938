"""Token counts by a count-only Viterbi search over a unigram vocabulary.

The pieces and scores of a sentencepiece model are taken as a unigram vocabulary. An Aho-Corasick automaton enumerates all
pieces that end at each position; dynamic programming carries the best score and its number of pieces, no path. Scores are
added in double precision and ties go to the piece that starts first, as the tokenizers library's Unigram model decides
them. No piece crosses the start of a run of word marks, so a text is the sum of its chunks, and each worker keeps a
bounded cache of chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks

MARK = "▁"
#: Fixed value: an unknown character scores so much less than the least piece.
UNKNOWN_PENALTY = 10.0
CACHE = 400_000
_chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Counter:
    """Automaton and scores of one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool) -> None:
        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = byte_fallback
        self.cache: dict[str, int] = {}

    def search(self, chunk: str) -> int:
        """Pieces of the best segmentation of a chunk."""
        n = len(chunk)
        best, pieces = [0.0] + [None] * n, [0] * (n + 1)
        single, done = self.single, 0

        def unknown(end: int) -> None:
            c = chunk[end - 1]
            if c not in single:
                score = best[end - 1] + self.unknown
                if best[end] is None or score > best[end]:
                    best[end] = score
                    pieces[end] = pieces[end - 1] + (len(c.encode()) if self.bytes else 1)

        for last, (length, score) in self.auto.iter(chunk):  # by end, the longest first
            end = last + 1
            while done < end - 1:
                done += 1
                unknown(done)
            score += best[end - length]
            if best[end] is None or score > best[end]:
                best[end] = score
                pieces[end] = pieces[end - length] + 1
        while done < n:
            done += 1
            unknown(done)
        return pieces[n]

    def count(self, text: str) -> int:
        """Pieces of a text, after a word mark is put before it and for each space."""
        if not text:
            return 0
        total, cache = 0, self.cache
        for chunk in _chunks.findall(MARK + text.replace(" ", MARK)):
            k = cache.get(chunk)
            if k is None:
                k = self.search(chunk)
                if len(cache) >= CACHE:
                    cache.clear()
                cache[chunk] = k
            total += k
        return total


_loaded: dict[str, Counter] = {}


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """(pieces with scores, byte fallback) of a sentencepiece model, without unknown, control and byte pieces."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(m.get_piece_size())
    plain = [i for i in ids if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
    return [(m.id_to_piece(i), m.get_score(i)) for i in plain], any(m.is_byte(i) for i in ids)


def counter(made_from: tuple[list[tuple[str, float]], bool]) -> Counter:
    key = hashlib.sha256(repr(made_from).encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Counter(*made_from)
    return _loaded[key]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens), one row per row of docs, for the sentencepiece model at path, a path on the driver.

    Whole texts are counted; null and empty texts have 0 tokens; characters outside the vocabulary count by their UTF-8
    bytes if the model has byte pieces, else 1 each; repeated rows count alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(shared.value)
        for b in batches:
            for start, texts in byte_chunks(b.column(1)):
                counts = pa.array([c.count(x.decode()) if x else 0 for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), counts], names=["id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long"), text).mapInArrow(run, "id long, n_tokens long")
