"""Edge cases and brute force for the training-data operators, on a small table with nulls, blanks and repeats."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from marginalia.llm import bpe, decontam, embed_dedup, kneser_ney, langid, ngram_join, quality, queries, secrets, token_count, url_filter
from marginalia.llm.components import connected_components

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
rng = random.Random(5)
WORDS = ["the", "of", "and", "river", "stone", "Über", "naïve", "x1", "don't", "日本", "é", "a"]
BASE = [" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(6)]


def changed(text: str, k: int) -> str:
    w = text.split()
    for i in rng.sample(range(len(w)), k):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


TEXTS = [
    None, "", "   \t\n", "one", "One", "one two three", *BASE, BASE[0], BASE[0].upper(), BASE[1] + "  \n", *(changed(BASE[2], k) for k in (1, 1, 2, 3)),
    *(changed(BASE[3], 1) for _ in range(40)), "long " * 30000 + "end", "#" * 3000, "🙂🙂 \x00 \x7f", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x',
    "password: short7 secret=longenough1 AKIAABCDEFGHIJKL", "éé token=secret:abcdefgh api_key=\"0123456789abcdef0123456789abcdef\"",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[i % 3], "src0", 7, -1) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "src0", 7, -1), (None, BASE[4], "fr", "src1", 7, -1), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_shingles long, set_key long").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def shingles(text):
    w = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(5, 5), (None, 3), (200, 199), (199, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 130), 100), 199: 199, 200: 199}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ngram_groups_equal_brute_force(docs, empty):
    members, _ = ngram_join.ngram_jaccard_groups(docs)
    got = [(r.id, r.n_shingles, r.component_id) for r in members.collect()]
    assert len(got) == docs.count()
    sets = {i: shingles(t) for i, t in enumerate(TEXTS)}
    want = groups(list(sets), lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    for i, n, c in got:
        if i is not None:
            assert (n, c) == (len(sets[i]), want[i])
    nameless = {(n, c) for i, n, c in got if i is None}
    assert nameless == {(0, None), (len(shingles(BASE[4])), want[TEXTS.index(BASE[4])])}
    assert ngram_join.ngram_jaccard_groups(empty)[0].count() == 0


def test_entries_of_any_similar_sets_meet():
    levels = np.full(1 << ngram_join.TABLE_BITS, 9, np.uint8)
    levels[::2] = 1
    gen = np.random.default_rng(3)
    for _ in range(300):
        n = int(gen.integers(2, 120))
        a = gen.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        drop = int(gen.integers(0, max(1, n // 9) + 1))
        b = np.unique(np.concatenate([a[drop:], gen.integers(0, 2**63, drop).astype(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 5 * both >= 4 * (len(a) + len(b) - both) and len(a) > 1 and len(b) > 1:
            x, y = (set(ngram_join.entries(s, levels, 5, 4, 5)[0].tolist()) for s in (a, b))
            assert x & y


def test_shared_shingles_come_last_within_a_doubling_too(spark):
    own, common = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("own", 60), ("common", 24)))
    df = spark.createDataFrame([(own,)] * 17 + [(common,)] * 30, "text string")
    levels, frequent = ngram_join.frequency_levels(df, "text", 5)
    both, shared = (set(ngram_join.shingle_sets([t.encode()], 5)[0].tolist()) for t in (f"{own} {common}", common))
    sigs, places = ngram_join.entries(np.array(sorted(both), np.uint64), levels, frequent, 4, 5)
    assert len(sigs) == ngram_join.needed(80, 4, 5) and (places >= 0).all() and not shared & set(sigs.tolist())
    counts = np.array([0, 254, 255, 2**32 - 1], np.uint32)
    assert (ngram_join.unpacked(ngram_join.packed(counts), 4) == counts).all()


def test_cells_find_the_pairs_that_sets_do():
    gen = np.random.default_rng(1)
    base = gen.integers(0, 2**62, 60)
    sets = [np.unique(np.concatenate([base[: int(gen.integers(40, 60))], gen.integers(0, 2**62, int(gen.integers(0, 9)))])) for _ in range(60)]
    i, j = ngram_join.similar(sets, 4, 5)
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_near_duplicate_vectors(spark):
    gen = np.random.default_rng(2)
    rows = [v.tolist() for v in gen.normal(size=(300, 64))]
    for k in range(60):
        v = np.array(rows[k % 5])
        rows.append((v + gen.normal(size=64) * np.linalg.norm(v) * 0.1 / 8).tolist())
    rows += [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, rows[0], [2 * x for x in rows[0]], [1.0, 2.0], [2.0, 4.0], [1.0]]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, key long")
    got = {r.id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(df).collect()}
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for v in rows]

    def cos(a, b):
        if not (ok[a] and ok[b]) or len(rows[a]) != len(rows[b]):
            return False
        x, y = np.array(rows[a]), np.array(rows[b])
        return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95

    want = groups(range(len(rows)), cos)
    for i in range(len(rows)):
        assert got[i] == (sum(cos(i, j) for j in range(len(rows)) if j != i), want[i]), i
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_hot_cells_are_compared_in_blocks(spark, monkeypatch):
    gen = np.random.default_rng(4)
    v = gen.normal(size=32)
    rows = [(i, (v + gen.normal(size=32) * 0.02).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(embed_dedup, "BLOCK", 40)
    got = embed_dedup.near_duplicates(df).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(199, 0)}


def test_quality_is_learnt_from_text(spark):
    good = [(i, " ".join(rng.choice(WORDS) for _ in range(60)) + ".", 1) for i in range(150)]
    bad = [(1000 + i, " ".join(rng.choice(WORDS) + "$$$" for _ in range(60)), 0) for i in range(150)]
    rows = good + bad
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(5000, None, "x"), (5001, "", "x"), (None, "a b", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = {r.id: r.score for r in quality.quality_scores(docs, labels, learn=quality.not_in_fold("id", 5)).collect()}
    held = [(i, q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (q == 1) for i, q in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001] and len(got) == 303
    again = spark.createDataFrame([(k, rows[k % 7][1], "x") for k in range(700)], "doc_id long, text string, score string").repartition(13)
    same = quality.quality_scores(docs.unionByName(again.withColumn("doc_id", F.col("doc_id") + 9000)), labels, learn=quality.not_in_fold("id", 5)).collect()
    assert len({(r.id - 9000) % 7 for r in same if (r.id or 0) >= 9000}) == 7 == len({((r.id - 9000) % 7, r.score) for r in same if (r.id or 0) >= 9000})
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_isotonic_is_monotone_and_keeps_the_mean():
    at, y, n = np.arange(6.0), np.array([1.0, 0.0, 2.0, 1.0, 3.0, 4.0]), np.array([2.0, 2.0, 4.0, 2.0, 4.0, 4.0])
    x, r = quality.isotonic(at, y, n)
    assert (np.diff(r) > 0).all() and (np.diff(x) > 0).all() and r[0] == 0.25


def hits(text, items):
    w = decontam.words((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        own = decontam.words((t or "").encode())
        size = min(13, len(own))
        wins = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(w) - size + 1):
            if own and tuple(w[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(w), len(hit), sorted(x for x in map(str, found) if x != "None")


@pytest.mark.parametrize("limit", [1 << 23, 200])
def test_decontamination_equals_brute_force(spark, docs, empty, monkeypatch, limit):
    monkeypatch.setattr(decontam, "WINDOW_BYTES", limit)
    items = [(1, BASE[5][20:260]), (2, "ONE, Two"), (3, None), (4, "!!"), (2, "ONE, Two"), (10, BASE[5][100:330]), (None, "river stone river")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    rows = docs.select("doc_id", "text").collect()
    assert sorted(map(str, ((r.id, r.n_words, r.n_hit, r["items"]) for r in got))) == sorted(map(str, ((r.doc_id, *hits(r.text, items)) for r in rows)))
    for r in got:
        text = TEXTS[r.id] if r.id is not None else BASE[4]
        assert sum(len(decontam.words(text[s.start : s.end].encode())) for s in r.spans) == r.n_hit if r.n_hit else not r.spans
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    assert decontam.contaminated(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contaminated(empty, bench).count() == 0


def test_bpe_equals_tiktoken_and_decodes(docs, empty):
    ranks = bpe.Bpe(open(BPE, "rb").read(), public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("ab cé#\n1 ☃") for _ in range(rng.randrange(300))) for _ in range(200)] + ["ab" * 4000, "é" * 700]
    values, ends = ranks.encode(texts)
    for t, ids in zip(texts, (x.tolist() for x in np.split(values, ends[:-1])), strict=True):
        assert ids == ref.encode_ordinary(t)
    out = bpe.decoded(bpe.encoded(docs, BPE, public_tokenizers.PATTERN), BPE, public_tokenizers.PATTERN)
    assert all(bytes(r.bytes) == (r.text or "").encode() for r in out.collect())
    once = bpe.encoded(docs, BPE, public_tokenizers.PATTERN, back="bytes")
    assert once.columns == out.columns and sorted(map(str, once.collect())) == sorted(map(str, out.collect()))
    assert out.columns[: len(docs.columns)] == docs.columns and bpe.encoded(empty, BPE, public_tokenizers.PATTERN).count() == 0


def test_kneser_ney_sums_to_one_and_counts_exactly(docs, empty):
    model = kneser_ney.trained(docs)
    rows = docs.select("doc_id", "text").collect()
    tokens = [w for r in rows for w in [*(r.text or "").encode().translate(kneser_ney.LOWER_ASCII).split(), "END"]]
    assert (model.tokens, model.words) == (len(tokens), len(set(tokens)))
    words = np.array(sorted({int(x) for x in kneser_ney.token_hashes([(r.text or "").encode() for r in rows])[0]} | {12345}), np.uint64)
    for before in (b"the", b"nowhere"):
        h = kneser_ney.token_hashes([before])[0][0]
        seq = np.stack([np.full(len(words), h), words], axis=1).ravel()
        asked, arrays = kneser_ney.queries(seq, np.full(len(words), 2)), kneser_ney.Arrays(model)
        p = kneser_ney.log_probabilities(model, asked, arrays.word_values(asked[0]), arrays.pair_counts(asked[2]))[0][1::2]
        assert abs((10**p).sum() - 1) < 1e-9
    got = kneser_ney.scored(docs, model).collect()
    assert len(got) == len(rows) and all(r.score < 0 and r.perplexity > 1 for r in got) and {r.n_tokens for r in got if r.id == 0} == {1}
    none = kneser_ney.trained(empty)
    assert {(r.n_known, r.base_score, r.score) for r in kneser_ney.scored(docs, none).collect()} == {(0, 0.0, 0.0)}
    assert kneser_ney.scored(empty, model).count() == 0


def test_small_numbers_round_trip():
    x = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert (kneser_ney.unsmall(memoryview(kneser_ney.small(x)))[0] == x).all()


def base_spans(text):
    import re

    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for rank, (kind, p, n) in enumerate([("access", "AKIA[A-Z0-9]+", 16), ("hex", "[0-9a-f]+", 32)], 1):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m[0]) >= n]
    return [x[2] for x in sorted(out)]


def test_secrets_and_the_ledger(spark, docs, empty, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    got = secrets.scan_versions(docs, ledger).collect()
    assert len(got) == docs.count() and got[0].asDict().keys() == {*docs.columns, "findings"}
    for r in got:
        assert [f"{f.kind}:{f.start}:{f.end}" for f in r.findings if f.kind in secrets.BASE] == base_spans(r.text or "")
    rows = spark.read.parquet(ledger).count()
    assert rows == len(secrets.RULES) * docs.select(F.sha2(F.coalesce("text", F.lit("")), 256)).distinct().count()
    assert secrets.scan_versions(docs, ledger).count() == docs.count() and spark.read.parquet(ledger).count() == rows
    bumped = [(k, v + (k == "hex"), *x) for k, v, *x in secrets.RULES]
    secrets.scan_versions(docs, ledger, rules=bumped)
    assert spark.read.parquet(ledger).count() == rows + rows // len(secrets.RULES)
    assert secrets.scan_versions(empty).count() == 0


def test_names_that_clash_are_kept_or_replaced(spark):
    df = spark.createDataFrame([(1, "secret=abcdefgh1", "f", "b", "c")], "doc_id long, text string, findings string, blob string, found string")
    got = secrets.scan_versions(df).first()
    assert (got.blob, got.found, len(got.findings)) == ("b", "c", 1)
    got = secrets.scan_versions(df, out="spans").first()
    assert (got.findings, len(got.spans)) == ("f", 1)
    df = spark.createDataFrame([(1, "http://a.org/x", "h", "r", 5)], "page_id long, url string, host string, _rule string, rows long")
    got = url_filter.judged(df).first()
    assert (got.host, got._host, got._rule, got.rows) == ("h", "a.org", "org/", 5)
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, ids string, bytes string")
    got = bpe.decoded(bpe.encoded(df, BPE, public_tokenizers.PATTERN), BPE, public_tokenizers.PATTERN).first()
    assert bytes(got.bytes) == b"a b" and len(got.ids) == 2


def test_many_matches_in_one_text(spark):
    text = "token=abcdefgh1 x " * 3000
    got = secrets.scan_versions(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(f.start, f.end) for f in got.findings] == [(18 * k, 18 * k + 15) for k in range(3000)]


@pytest.mark.parametrize(
    ("host", "domain", "suffix"),
    [("a.b.co.uk", "b.co.uk", "co.uk"), ("b.co.uk:8080", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("x.y.com", "y.com", "com"), ("10.1.2.3", "10.1.2.3", "ip"), ("10.1.2.3:80", "10.1.2.3", "ip"), ("localhost", "localhost", "localhost"), ("", "", "")],
)
def test_registered_domains(spark, host, domain, suffix):
    args = F.lit(host), url_filter.SUFFIXES
    assert spark.range(1).select(url_filter.domain_of(*args), url_filter.suffix_of(*args)).first()[:] == (domain, suffix)


def test_redaction(spark):
    df = spark.createDataFrame([("abcdefghij", [(2, 5, "a"), (3, 4, "b"), (7, 9, "a")]), ("xyz", []), (None, [])], "t string, f array<struct<start:int,end:int,kind:string>>")
    assert [r[0] for r in df.select(secrets.redacted(F.col("t"), F.col("f"), "*")).collect()] == ["ab*fg*j", "xyz", None]


def test_token_counts_equal_the_library(docs, empty):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ref = Tokenizer(models.Unigram([(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())], 0, True))
    got = token_count.token_counts(docs, PIECES).collect()
    for r in got:
        t = TEXTS[r.id] if r.id is not None else None
        if r.id is not None:
            assert r.n_tokens == (len(ref.encode("▁" + t.replace(" ", "▁")).ids) if t else 0)
    assert token_count.token_counts(empty, PIECES).count() == 0


def phrases(text, sample):
    i = n = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample and text[i:j] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_language_by_cross_parsing(spark, docs, empty):
    samples = [("aa", b"abracadabra abra"), ("bb", b"banana bandana cabana"), ("cc", "été à la mer".encode())]
    p = langid.Parser(samples)
    texts = [b"", b"a", b"banana", b"zzz abra zz", b"banabraca" * 50, "été".encode(), *[t.encode() for t in BASE]] * 8
    want = [[phrases(t, s) for _, s in samples] for t in texts]
    assert p.phrases(texts).tolist() == want
    en = [(i, " ".join(rng.choice(["the", "with", "house", "thing"]) for _ in range(30)), "en") for i in range(30)]
    fr = [(100 + i, " ".join(rng.choice(["le", "maison", "été", "chose"]) for _ in range(30)), "fr") for i in range(30)]
    learn = spark.createDataFrame(en + fr + [(7, None, "en"), (8, "x", None)], "doc_id long, text string, lang string")
    got = {r.id: (r.lang, r.score) for r in langid.identified(docs.where("doc_id is not null"), learn).collect()}
    assert got[0] == ("und", 0.0) and got[1] == ("und", 0.0) and got[TEXTS.index("#" * 3000)] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    clear = spark.createDataFrame([(1, "thing house the with"), (2, "maison chose été")], "doc_id long, text string")
    assert [r.lang for r in langid.identified(clear, learn).orderBy("id").collect()] == ["en", "fr"]
    assert {r.lang for r in langid.identified(docs, learn.limit(0)).collect()} == {"und"}
    assert langid.identified(empty, learn).count() == 0


def test_url_rules_and_reputation(spark):
    urls = [
        "http://a.example.org/en/12?x", "http://example.org/es/", "https://EXAMPLE.org", "https://b.com/fr/1", "https://b.com/de/1", "https://b.com/en/1",
        "https://c.com/de/1", "https://c.com/en/9", "nothing", None, "", "ftp://d.net/x#://e.org/", "http://notexample.org/en/1", "http://b.com/en/1",
    ]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = {r.page_id: r for r in url_filter.judged(df).collect()}
    assert [got[i]._rule for i in range(5)] == ["example.org/en/1", "example.org/es/", None, "com/fr/", "com/de/"]
    assert (got[0]._host, got[0]._path, got[2]._host, got[2]._path) == ("a.example.org", "/en/12", "example.org", "")
    assert got[8]._host == "" == got[9]._path and got[11]._host == "d.net" and got[11]._path == "/x" and got[12]._rule == "org/"
    assert {r._verdict for r in got.values()} <= {"allow", "block"} and len(got) == len(urls)
    assert got[5]._bound > got[7]._bound and url_filter.judged(df.limit(0)).count() == 0


def test_pages_that_repeat_are_judged_alike(spark):
    urls = ["http://a.org/x", "http://b.net/en/1", "http://b.net/en/1", "http://c.com/fr/", "http://c.com/other"]
    df = spark.createDataFrame([(i % 3, u) for i, u in enumerate(urls * 4)] + [(None, urls[1])], "page_id long, url string")
    got = url_filter.judged(df).select("url", "_verdict", "_bound").collect()
    assert len(got) == 21 and len({tuple(r) for r in got}) == 4


def test_vectors_without_an_id_and_with_one_that_repeats(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(None, v), (None, [0.0, 0.0, 1.0]), (5, v), (5, [2.0, 4.0, 6.1]), (9, [9.0, -1.0, 0.0])]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=repr) == sorted([(None, 2, 5), (None, 0, None), (5, 2, 5), (5, 2, 5), (9, 0, 9)], key=repr)


def test_registered_domains_by_rules(spark):
    rules = ["co.uk", "uk", "*.ck", "!www.ck", "a.b.example", "*.kobe.jp", "jp", "!city.kobe.jp"]
    hosts = {
        "www.shop.co.uk:80": ("co.uk", "shop.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.uk": ("uk", "x.uk"), "y.x.uk": ("uk", "x.uk"), "deep.x.any.ck": ("any.ck", "x.any.ck"), "any.ck": ("any.ck", "any.ck"),
        "q.www.ck": ("ck", "www.ck"), "z.q.a.b.example": ("a.b.example", "q.a.b.example"), "q.b.example": ("example", "b.example"), "p.q.c.kobe.jp": ("c.kobe.jp", "q.c.kobe.jp"), "p.city.kobe.jp": ("kobe.jp", "city.kobe.jp"),
        "10.0.0.1": ("ip", "10.0.0.1"), "lone": ("lone", "lone"), "": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r.h: (r.s, r.d) for r in df.select("h", url_filter.suffix_of(F.col("h"), rules).alias("s"), url_filter.domain_of(F.col("h"), rules).alias("d")).collect()}
    assert got == hosts
    few = {r.h: r.d for r in df.select("h", url_filter.domain_of(F.col("h"), []).alias("d")).collect()}
    assert few["www.shop.co.uk:80"] == "co.uk"


def test_digest_queries_have_the_contract_columns(spark):
    d = "/root/testdata/sf0.001"
    want = {
        "op1": {"doc_id", "n_shingles", "component_id"}, "op2": {"vec_id", "n_links", "component_id", "kept"}, "op4": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
        "op5": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op7": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, "op10": {"page_id", "host", "path", "rule", "verdict"},
    }
    for name, f in queries.QUERIES.items():
        cols = want.get(name.split("_")[0])
        if cols and name.split("_")[0] in ("op4", "op5", "op7", "op10"):
            assert cols <= set(f(spark, d).columns)
    row = queries.QUERIES["op5_byte_bpe"](spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").first()
    assert row.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()
