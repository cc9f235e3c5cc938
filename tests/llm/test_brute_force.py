"""Operators without SQL against plain brute force, and links of random near copies against all pairs."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from marginalia.llm import bpe, embed_dedup, kneser_ney, langid, ngram_join, quality, queries

SF = "/root/testdata/sf0.001"
rng = random.Random(11)


def pooled(at, y, n):
    """Isotonic means by the minimax formula: (mean score, rate) of each run of equal rates."""
    rate = [max(min(sum(y[a : b + 1]) / sum(n[a : b + 1]) for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    runs = [list(g) for _, g in itertools.groupby(range(len(y)), key=lambda i: round(rate[i], 12))]
    return [sum(at[i] * n[i] for i in r) / sum(n[i] for i in r) for r in runs], [rate[r[0]] for r in runs]


def brute_scores(rows, labels, learn):
    """Scores of (id, text) rows: features, ridge and calibration in one go, without sums of parts."""
    stats = np.array([quality.statistics(t.encode() if t is not None else None) for _, t in rows], float)
    known = [(k, labels[i]) for k, (i, _) in enumerate(rows) if i in labels and learn(i)]
    fold = lambda k: zlib.crc32(f"c{rows[k][0]}".encode()) % 4
    fit, held = [x for x in known if fold(x[0])], [x for x in known if not fold(x[0])]
    a = stats[[k for k, _ in fit]]
    mean, sd = a.mean(axis=0), a.std(axis=0)
    sd[sd < 1e-9] = 1
    gen = np.random.default_rng(quality.SEED)
    w = gen.normal(size=(a.shape[1], quality.FEATURES)) / (quality.WIDTH * math.sqrt(a.shape[1]))
    phase = gen.uniform(0, 2 * np.pi, quality.FEATURES)
    f = lambda x: np.c_[math.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - mean) / sd, -8, 8) @ w + phase), np.ones(len(x))]
    z = f(a)
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * len(fit) / quality.FEATURES * np.eye(z.shape[1]), z.T @ np.array([y for _, y in fit], float))
    raw = f(stats) @ beta
    bins: dict = {}
    for k, y in held:
        bins.setdefault(math.floor((min(max(raw[k], -0.5), 1.5) + 0.5) / 2 * quality.BINS), []).append((raw[k], y))
    at, y, n = zip(*((np.mean([r for r, _ in b]), sum(q for _, q in b), len(b)) for _, b in sorted(bins.items())), strict=True)
    return np.clip(np.interp(raw, *pooled(at, y, n)), 0, 1)


def test_quality_scores_equal_one_solve_over_all_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.id: r.score for r in quality.quality_scores(docs, labels, learn=quality.not_in_fold("id", 5)).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_scores(rows, {r.doc_id: r.quality for r in labels.collect()}, lambda i: zlib.crc32(str(i).encode()) % 5 != 0)
    assert len(got) == len(rows) and max(abs(got[i] - s) for (i, _), s in zip(rows, want, strict=True)) < 1e-5


def test_kneser_ney_scores_equal_counting_by_dictionary(spark):
    texts = [" ".join(rng.choice("the The of river stone x y z".split()) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "", " \t", "never seen words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens = lambda t: [*(t or "").lower().split(), "</s>"]
    pairs: dict = {}
    count: dict = {}
    for i, t in enumerate(texts):
        if i % 3:
            for v, w in zip(["<s>", *tokens(t)], tokens(t), strict=False):
                pairs[v, w] = pairs.get((v, w), 0) + 1
                count[w] = count.get(w, 0) + 1
    before: dict = {}
    for _, w in pairs:
        before[w] = before.get(w, 0) + 1
    of = lambda values: kneser_ney.discounts_of([sum(x == k for x in values) for k in (1, 2, 3, 4)])
    high, low = of(list(pairs.values())), of(list(before.values()))
    cut = lambda d, n: d[min(n, 3) - 1] if n else 0.0
    kinds, n, v_size = sum(before.values()), sum(count.values()), len(count)
    gamma1 = sum(cut(low, k) for k in before.values()) / kinds

    def p(v, w):
        one = (before[w] - cut(low, before[w])) / kinds if w in before else 0.0
        one += gamma1 / (v_size + 1)
        after = {x: c for (u, x), c in pairs.items() if u == v}
        total = sum(after.values())
        if not total:
            return one
        c = after.get(w, 0)
        return (c - cut(high, c)) / total + sum(cut(high, k) for k in after.values()) / total * one

    model = kneser_ney.trained(docs.where("doc_id % 3 > 0"))
    for r in kneser_ney.scored(docs, model).collect():
        own = tokens(texts[r.id])
        want = sum(math.log10(p(v, w)) for v, w in zip(["<s>", *own], own, strict=False))
        base = sum(math.log10((count.get(w, 0) + 1) / (n + v_size + 1)) for w in own)
        assert (r.n_tokens, r.n_known) == (len(own), sum(w in count for w in own))
        assert abs(r.score - want) < 1e-9 and abs(r.base_score - base) < 1e-9 and abs(r.perplexity / 10 ** (-want / len(own)) - 1) < 1e-9
    assert (model.tokens, model.words) == (n, v_size)


def test_base_score_by_the_contract(spark):
    got = queries.QUERIES["op6_lm_scoring"](spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lower = lambda t: [*(t or "").encode().translate(kneser_ney.LOWER_ASCII).split(), None]
    count: dict = {}
    for i, t in text.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in lower(t):
                count[w] = count.get(w, 0) + 1
    n = sum(count.values())
    for r in got:
        own = lower(text[r.doc_id])
        want = sum(math.log10((count.get(w, 0) + 1) / (n + len(count) + 1)) for w in own)
        assert (r.train_tokens, r.n_tokens, r.n_known) == (n, len(own), sum(w in count for w in own)) and abs(r.base_score - want) < 1e-6 * len(own)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    assert len(got) == len(text) and sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_queries_sent_to_shards_score_alike(spark, monkeypatch):
    texts = [(i % 37 if i % 5 else None, " ".join(f"w{j * j % 97}" for j in range(i, i + rng.randrange(80)))) for i in range(80)] + [(1, None), (1, ""), (2, "w1"), (2, "w1")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    model = kneser_ney.trained(docs.where("doc_id % 3 > 0"))
    rows = lambda: sorted((tuple(r) for r in kneser_ney.scored(docs, model).collect()), key=repr)
    mapped = rows()
    monkeypatch.setattr(kneser_ney, "OPEN", 2)
    sent = rows()
    assert len(mapped) == len(texts) and [r[:3] for r in sent] == [r[:3] for r in mapped]
    assert all(abs(x - y) < 1e-9 for r, q in zip(sent, mapped, strict=True) for x, y in zip(r[3:], q[3:], strict=True))
    assert kneser_ney.scored(docs.limit(0), model).count() == 0


def test_the_winning_language_equals_brute_force(spark):
    words = {"aa": "kala mato suri penu".split(), "bb": "brok strun glif drem".split(), "cc": "été mère où naître".split()}
    learn = [(100 * k + i, " ".join(rng.choice(w) for _ in range(20)), lang) for k, (lang, w) in enumerate(words.items()) for i in range(6)]
    tests = [" ".join(rng.choice([x for w in words.values() for x in w]) for _ in range(rng.randrange(1, 25))) for _ in range(40)] + ["KALA, mato!", "123", None]
    learned = spark.createDataFrame(learn, "doc_id long, text string, lang string")
    samples = langid.joined(langid.learned_samples(learned, "doc_id", "text", "lang").collect())
    assert [n for n, _ in samples] == list(words)
    docs = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")

    def phrases(text, sample):
        i = n = 0
        while i < len(text):
            j = i + 1
            while j < len(text) and text[i:j] in sample and text[i : j + 1] in sample:
                j += 1
            n, i = n + 1, j
        return n

    for r in langid.identified(docs, learned).collect():
        t = tests[r.id]
        if t is None or not any(c.isalpha() for c in t):
            assert (r.lang, r.score) == ("und", 0.0)
            continue
        bits = [phrases(langid.folded(t.encode()), s) * math.log2(max(2, len(s))) for _, s in samples]
        best, other = sorted(bits)[:2]
        assert r.lang == samples[bits.index(best)][0] and abs(r.score - (other - best) / other) < 1e-12


def test_every_language_is_learnt_within_bounds(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 900)
    monkeypatch.setattr(langid, "SAMPLE_TEXT", 600)
    monkeypatch.setattr(langid, "GROUP_CHARS", 9000)
    many = [(i, f"w{i % 400} " * rng.randrange(1, 90), f"l{i % 400:03}") for i in range(2400)]
    odd = [(0, "other text of id 0", "l000"), (7, None, "m1"), (8, "", "m2"), (9, "long " * 200, "m3"), (None, "no id", "m4")]
    rows = spark.createDataFrame(many + odd, "doc_id long, text string, lang string")
    got = langid.learned_samples(rows, "doc_id", "text", "lang").collect()
    assert sorted(r.lang for r in got) == [f"l{i:03}" for i in range(400)] + ["m4"]
    texts = {(t, lang) for _, t, lang in many + odd}
    assert all((t, r.lang) in texts for r in got for t in r.texts)  # whole texts
    size = {}
    for r in got:
        n = sum(map(len, r.texts))
        assert n <= 900 + 600
        size[r.group] = size.get(r.group, 0) + n
    assert max(size.values()) <= 9000 and len(size) > 20


def test_languages_in_groups_are_judged_as_in_one(spark, monkeypatch):
    words = {f"l{k}": ["".join(rng.choice("abcdefgh"[k : k + 4]) for _ in range(5)) for _ in range(30)] for k in range(5)}
    learned = [(i, " ".join(rng.choice(words[f"l{i % 5}"]) for _ in range(40)), f"l{i % 5}") for i in range(60)]
    asked = [(i, " ".join(rng.choice(words[f"l{rng.randrange(5)}"]) for _ in range(k))) for i, k in enumerate([1, 2, 3, 30, 30, 300] * 4)] + [(1, None), (None, "--"), (1, "abc")]
    learned, asked = spark.createDataFrame(learned, "doc_id long, text string, lang string"), spark.createDataFrame(asked, "doc_id long, text string")
    one = sorted(map(tuple, langid.identified(asked, learned).collect()), key=repr)
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 1500)
    monkeypatch.setattr(langid, "SAMPLE_TEXT", 500)
    limited = sorted(map(tuple, langid.identified(asked, learned).collect()), key=repr)
    monkeypatch.setattr(langid, "GROUP_CHARS", 4500)
    assert langid.learned_samples(learned, "doc_id", "text", "lang").agg({"group": "max"}).first()[0] > 0
    assert sorted(map(tuple, langid.identified(asked, learned).collect()), key=repr) == limited and len(one) == len(limited) == 27


@pytest.mark.parametrize(("dim", "pairs"), [(64, 6000), (768, 800)])
def test_vectors_at_the_bound_meet(dim, pairs):
    gen = np.random.default_rng(dim)
    a, b = gen.normal(size=(2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    shape = embed_dedup.TABLES, embed_dedup.AXES, embed_dedup.PROBES
    x, y = (np.concatenate([embed_dedup.cells(v[i : i + 500], *shape) for i in range(0, pairs, 500)]) for v in (a, b))
    met = (x[:, :, :1] == y).any(axis=(1, 2)) | (y[:, :, :1] == x).any(axis=(1, 2))
    assert (~met).sum() <= 1


def near_copies(n):
    """Texts that share a long passage, near copies of several sizes, and copies."""
    common = [f"c{k}" for k in range(80)]
    out = []
    for k in range(n):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 20, 60, 200]))]
        base = (common + own) if k % 3 else own
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 4])):
            w = list(base)
            for i in rng.sample(range(len(w)), min(len(w), rng.choice([1, 1, 2, 5]))):
                w[i] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(w[: len(w) - rng.choice([0, 0, 3])]))
    return out + out[:5]


@pytest.mark.parametrize(("small", "block", "least"), [(32, 512, 64), (3, 6, 3)])
def test_links_of_random_near_copies_equal_all_pairs(spark, monkeypatch, small, block, least):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", least)
    texts = near_copies(50)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.ngram_jaccard_groups(docs)[0].collect()}
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    links = [[j for j in range(len(sets)) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(sets))]
    label = list(range(len(sets)))
    for _ in sets:
        label = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(sets))]
    assert got == {i: (len(sets[i]), len(links[i]), label[i]) for i in range(len(sets))}


def test_every_document_has_the_ids_of_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.Bpe(open(path, "rb").read(), public_tokenizers.PATTERN).rank
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.QUERIES["op5_byte_bpe"](spark, SF).collect():
        ids = ref.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
