"""Language identification by cross-parsing entropy over suffix automata.

For every labelled language a suffix automaton is built over the whole texts of a bounded sample of its rows. A text is
parsed against it: from each point the longest match in the sample is one phrase, the next phrase starts where it ends. The
number of phrases a byte, times the logarithm of the sample's length, estimates the cross entropy; the language that needs the
fewest normalised phrases wins. Texts are folded to lower case and runs of other bytes to one separator, and parsed whole, many
side by side: one step of every text and language is a table lookup. Languages are dealt into groups whose automata fit a
worker; every text is parsed against each group, and the groups' best are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_chunks, materialize

#: The sample of a language: rows whose texts have at most SAMPLE_TEXT characters, so many rows and characters at most.
SAMPLE_ROWS, SAMPLE_TEXT, SAMPLE_CHARS = 400, 20_000, 50_000
#: Characters of the samples of a group of languages, which bound a worker's tables (some 400 bytes a character).
GROUP_CHARS = 400_000
#: Below so many texts they are stepped through one by one.
FEW = 64
#: A-Z to a-z, bytes from 0x80 kept, all others to a space.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: UTF-8 of capital letters of the Latin-1 block (C3 80 to C3 9E, but for the sign C3 97) folds to the small ones.
_capital = regex.compile(rb"\xc3[\x80-\x96\x98-\x9e]")
_letter = regex.compile(r"\p{L}")


def folded(text: bytes | None) -> bytes:
    if not text:
        return b""
    text = _capital.sub(lambda m: bytes((0xC3, m[0][1] + 32)), text)
    return b" ".join(text.translate(FOLD).split())


def suffix_automaton(s: bytes) -> list[dict[int, int]]:
    """Transitions of the least automaton of all substrings of s; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in s:
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """Dense transition tables of all languages over the bytes that occur in any sample."""

    def __init__(self, samples: list[tuple[str, bytes]]) -> None:
        self.names = [name for name, _ in samples]
        used = sorted(set(b"".join(s for _, s in samples)))
        self.code = np.zeros(256, np.uint8)  # 0: in no sample
        self.code[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        rows, start = [], []
        for _, s in samples:
            base = sum(map(len, rows))
            states = suffix_automaton(s)
            table = np.full((len(states), self.width), -1, np.int32)
            for k, moves in enumerate(states):
                for c, to in moves.items():
                    table[k, self.code[c]] = base + to
            rows.append(table)
            start.append(base)
        table = np.concatenate(rows).ravel()
        # States are kept as row offsets of the table.
        self.table = np.where(table < 0, -1, table * self.width).astype(np.int32)
        self.root = np.array(start, np.int32) * np.int32(self.width)
        self.weight = np.array([np.log2(max(2, len(s))) for _, s in samples])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases (texts, languages)."""
        n, k = len(texts), len(self.names)
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        codes = self.code[np.frombuffer(b"".join(texts), np.uint8)]
        offset = np.concatenate(([0], np.cumsum(sizes)))[:-1][order]
        longest_first = sizes[order]
        out = np.zeros(n * k, np.int64)
        state = np.tile(self.root, n)
        live = np.searchsorted(-longest_first, -np.arange(longest_first[0] if n else 0), side="left")
        for t, m in enumerate(live.tolist()):  # m texts are longer than t
            if m < FEW:
                break
            c = codes[offset[:m] + t].astype(np.int32)
            to = self.table[(state[: m * k].reshape(m, k) + c[:, None]).ravel()]
            failed = np.flatnonzero(to < 0)
            root = self.root[failed % k]
            out[failed] += state[failed] != root  # the phrase so far ends
            again = self.table[root + c[failed // k]]  # the byte starts the next phrase
            alone = again < 0  # or, in no sample, is one
            out[failed] += alone
            to[failed] = np.where(alone, root, again)
            state[: m * k] = to
        else:
            m = 0
        for i in range(m):
            rest = codes[offset[i] + t : offset[i] + longest_first[i]].tobytes()
            for j in range(k):
                more, state[i * k + j] = self.stepped(rest, int(state[i * k + j]), int(self.root[j]))
                out[i * k + j] += more
        out = (out + (state != np.tile(self.root, n))).reshape(n, k)
        back = np.empty_like(out)
        back[order] = out
        return back


    def stepped(self, codes: bytes, state: int, root: int) -> tuple[int, int]:
        """Phrases that end while codes are read from a state on, and the state then."""
        table, ended = memoryview(self.table), 0
        for c in codes:
            to = table[state + c]
            if to < 0:
                ended += state != root
                to = table[root + c]
                if to < 0:
                    ended += 1
                    to = root
            state = to
        return ended, state


_parsers: dict[str, Parser] = {}


def parser(samples: list[tuple[str, bytes]]) -> Parser:
    key = hashlib.sha256(repr(samples).encode()).hexdigest()
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(samples)
    return _parsers[key]


def learned_samples(labelled: DataFrame, id_col: str, text: str, lang: str) -> DataFrame:
    """(lang, texts, group): the sample of every language that has a row to learn from, and the group it is dealt to.

    A language's rows are taken in the order of a hash of id and text as long as SAMPLE_ROWS rows and SAMPLE_CHARS characters
    allow, the first in any case, always with their whole texts. Rows of over SAMPLE_TEXT characters aren't taken, so no sample
    exceeds SAMPLE_CHARS + SAMPLE_TEXT; a language that has no others isn't learnt. Groups are filled in the order of names.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.length(text).between(1, SAMPLE_TEXT))
    rows = known.select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(F.col(id_col).cast("string"), text).alias("h"))
    rows = rows.withColumn("u", F.pmod("h", F.lit(1 << 32)))
    # Of languages with over a thousandth of all rows, fewer than a thousand, only rows whose hash is low enough to be among the
    # first are sent on, five times as many as are taken; that fewer than those taken are among them doesn't happen.
    counts = materialize(known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = counts.where(F.col("n") > max(5 * SAMPLE_ROWS, total / 1000)).select("lang", (5 * SAMPLE_ROWS * (1 << 32) / F.col("n")).alias("below"))
    rows = rows.join(F.broadcast(many), "lang", "left").where("below is null or u < below").drop("below")
    by = Window.partitionBy("lang").orderBy("u", "h", "t")
    # The limit of rows is taken before the shuffle too.
    rows = rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= SAMPLE_ROWS)
    so_far = F.sum(F.length("t")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    taken = rows.withColumn("so_far", so_far).where((F.col("so_far") <= SAMPLE_CHARS) | (F.col("r") == 1))
    each = taken.groupBy("lang").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("texts"), F.max("so_far").alias("chars")
    )
    each = materialize(each, "samples")
    # A language takes at most GROUP_CHARS of its group's room, so groups by running totals hold at most two shares.
    before = F.coalesce(F.sum("chars").over(Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = each.select("lang", F.floor(before / (GROUP_CHARS - SAMPLE_CHARS - SAMPLE_TEXT)).alias("group"))
    return each.join(dealt, "lang").select("lang", "texts", "group")


def joined(rows: list) -> list[tuple[str, bytes]]:
    """(language, folded sample) of rows of learned_samples, by name."""
    return sorted((r["lang"], b" ".join(folded(t.encode()) for t in r["texts"]).strip() or b" ") for r in rows)


def parsed(docs: DataFrame, samples: list[tuple[str, bytes]]) -> DataFrame:
    """docs (id, row, text) as id, row, lang, low, second: the language of the samples with the fewest normalised phrases, their
    number, and that of the next; nulls where the text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # at most GROUP_CHARS characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(shared.value) if shared.value else None
        for b in batches:
            for start, texts in byte_chunks(b.column(2), 24 << 20):
                known = [x is not None and bool(_letter.search(x.decode())) for x in texts]
                names, low, second = [None] * len(texts), [None] * len(texts), [None] * len(texts)
                if p is not None and any(known):
                    at = np.flatnonzero(known)
                    bits = p.phrases([folded(texts[i]) or b" " for i in at]) * p.weight
                    first = bits.argmin(axis=1)
                    rest = np.sort(bits, axis=1)
                    for j, i in enumerate(at):
                        names[i], low[i] = p.names[first[j]], float(rest[j, 0])
                        second[i] = float(rest[j, 1]) if len(p.names) > 1 else None
                own = b.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(names, pa.string()), pa.array(low, pa.float64()), pa.array(second, pa.float64())],
                    names=["id", "row", "lang", "low", "second"],
                )

    return docs.mapInArrow(run, "id long, row long, lang string, low double, second double")


def identified(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, lang, score), one row per row of docs, judged by the text alone.

    labelled: rows to learn from, of which a bounded sample is (learned_samples); null languages and null or empty texts
    teach nothing. lang is the learned language that needs the fewest normalised phrases (ties: the first by name), `und` if
    the text is null or has no letter or nothing was learnt. score is (w2 - w1) / w2 for the normalised phrases of the best and
    the next language, 0 for `und`, 1 if only one language is known. Whole texts are parsed; repeated rows are judged alike;
    other columns are ignored. Every group of languages reads the documents once.
    """
    samples = learned_samples(labelled, id_col, text, lang)
    samples = materialize(samples, "languages")
    groups = samples.agg(F.coalesce(F.max("group"), F.lit(-1))).first()[0] + 1
    of = lambda g: joined(samples.where(F.col("group") == g).collect())  # noqa: E731  GROUP_CHARS characters at most
    score = F.when(F.col("lang").isNull(), 0.0).when(F.col("second").isNull(), 1.0).otherwise(
        (F.col("second") - F.col("low")) / F.greatest("second", F.lit(1e-9))
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(None).cast("long").alias("row"), F.col(text).alias("text"))
    if groups <= 1:
        found = parsed(rows, of(0) if groups else [])
    else:
        # Rows are told apart by a number, which has to be written to stay the same for all groups.
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        every = parsed(rows, of(0))
        for g in range(1, groups):
            every = every.unionByName(parsed(rows, of(g)))
        # The next best of all is the second of the best's group or the best of another group.
        two = F.array_sort(F.collect_list(F.struct("low", "lang", "second")))  # one of each group
        best = every.groupBy("row").agg(F.first("id").alias("id"), two.alias("all"))
        found = best.select(
            "id", F.col("all")[0]["lang"].alias("lang"), F.col("all")[0]["low"].alias("low"),
            F.least(F.col("all")[0]["second"], F.try_element_at("all", F.lit(2))["low"]).alias("second"),
        )
    return found.select("id", F.coalesce("lang", F.lit("und")).alias("lang"), score.alias("score"))
