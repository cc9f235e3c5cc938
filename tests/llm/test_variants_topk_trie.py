"""Spelling variants, exact top-k search and the prefix trie against plain brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import prefix_trie, queries, spelling, topk

rng = random.Random(29)


def near(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(n, times=10):
    forms, out = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        top = min(close, key=lambda x: (-n[x], x), default=None)
        if top is not None and n[top] >= times * n[w]:
            forms[w] = top
        out[w] = [len(close)]
    for w in n:
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (w, forms.get(w), root, n[w], *out[w], n[forms[w]] if w in forms else None)
    return sorted(out.values())


def found(df):
    return sorted(tuple(r) for r in df.collect())


def word_table(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def test_random_words_have_the_neighbours_of_all_pairs(spark):
    n = {"".join(rng.choice("abé") for _ in range(rng.randrange(0, 7))): 10 ** rng.randrange(5) + rng.randrange(3) for _ in range(300)}
    for longest in (spelling.LONGEST, 3, 0):  # texts as keys; hashes as keys, and both
        assert found(spelling.spelling_variants(word_table(spark, n), longest=longest)) == variants(n)


def test_chains_ties_and_very_long_words(spark):
    chain = {"a" * k: 10**k for k in range(1, 9)}
    ties = {"river": 2, "riven": 20, "rivet": 20, "rivér": 19, "driver": 20}
    long = "x" * 30_000
    n = chain | ties | {long: 3, long + "x": 40, "y" + long[1:]: 2, long[:-1] + "y": 2}
    got = {r.word: r for r in spelling.spelling_variants(word_table(spark, n)).collect()}
    assert got["a"].root == "a" * 8 and got["a" * 7].form == "a" * 8 and got["a" * 8].form is None
    assert (got["river"].form, got["river"].n_near, got["river"].form_n) == ("driver", 4, 20) and got["riven"].form is None
    assert (got[long].form, got[long].n_near) == (long + "x", 3) and got["y" + long[1:]].n_near == 1 and got[long + "x"].root == long + "x"
    assert got[long[:-1] + "y"].n_near == 1 and got[long[:-1] + "y"].form is None and len(got) == len(n)


def test_words_without_rows_nulls_and_clashing_columns(spark):
    odd = spark.createDataFrame([(None, 5, "k"), ("alone", 5, "k")], "word string, n long, key string")
    assert found(spelling.spelling_variants(odd)) == [("alone", None, "alone", 5, 0, None)]
    assert spelling.spelling_variants(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(odd, times=1)


def test_variants_of_documents(spark, tmp_path):
    words = ["ändérung", "Änderung", "rivers", "Riverside", "riverside", "x×y÷zabc", "stones1stonesq", "naïveté"]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(40)] + [None, "", "'-'", "river" * 2000, "river" * 2000]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(0, texts[0], "en"), (None, texts[1], "de")]
    spark.createDataFrame(rows, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    n = Counter()
    for i, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    assert found(queries.op11_spelling_variants(spark, str(tmp_path))) == variants(n) and len(n) > 6


def test_hashes_of_deletions_are_those_of_the_shorter_texts():
    of = lambda w: spelling.deletion_hashes(np.array([ord(c) for c in w], np.int64)).tolist()
    for w in ("a", "aa", "aab", "abca", "été" * 50):
        assert sorted(of(w)[1:]) == sorted({of(w[:i] + w[i + 1 :])[0] for i in range(len(w))})


def best_scores(rows, k=20, step=20):
    """(query, rank, id, score) by all pairs of distinct rows, sorted."""
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = list(dict.fromkeys((i, tuple(math.floor(64 * float(x)) for x in v)) for i, v in rows if ok(v)))
    out = []
    for i, q in whole:
        if i is None or i % step:
            continue
        scores = [(-sum(x * y for x, y in zip(q, v, strict=True)), j is None, j or 0) for j, v in whole if (j, v) != (i, q) and len(v) == len(q)]
        out += [(i, r + 1, None if no else j, -s) for r, (s, no, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def top(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted((tuple(r) for r in topk.top_inner_products(table, lambda i: i % 20 == 0, **options).collect()), key=repr)


@pytest.mark.parametrize("dim", [2, 16])
def test_best_products_equal_all_pairs(spark, dim):
    gen = np.random.default_rng(dim)
    centres = gen.normal(size=(8, dim)) * 4
    v = np.concatenate([gen.normal(size=(700, dim)) / 3, centres[gen.integers(0, 8, 700)] + gen.normal(size=(700, dim)) / 20])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(2000 + i, [0.5] * dim) for i in range(120)]  # a common vector, asked by several queries too
    assert top(spark, rows, shard=128, leaf=16) == best_scores(rows)


def test_odd_vectors_have_defined_results(spark):
    v = [0.25, -1.0, 3.0]
    rows = [(0, v), (0, v), (0, [1.0, 1.0, 1.0]), (1, None), (20, None), (2, [None, 1.0, 1.0]), (3, [math.nan, 0.0, 0.0]), (40, [math.inf, 0.0, 0.0])]
    rows += [(4, []), (60, []), (5, [1.0]), (80, [0.0, 0.0, 0.0]), (None, v), (7, v), (6, v), (-20, [-0.01, 0.0, 1e6])]
    assert top(spark, rows) == best_scores(rows)
    assert top(spark, []) == [] and top(spark, [(0, v)]) == [] and top(spark, [(0, v), (1, v)], k=1) == [(0, 1, 1, 256 + 64 * 64 + 192 * 192)]
    big = [(0, [1e15, 1e15]), (1, [1e15, -1e15]), (2, [3e15, 1.0]), (3, [1e300, 0.0])]
    assert [r[2] for r in top(spark, big)] == [2, 3, 1]  # 2 and 3 pass 64 bits


def test_a_tree_bounds_every_score():
    gen = np.random.default_rng(3)
    points = gen.integers(-50, 50, (500, 6))
    tree = topk.Tree(points, 20)
    q = gen.integers(-50, 50, (40, 6))
    bound = tree.bounds(q)
    for node, (a, b) in enumerate(tree.span):
        assert (bound[:, node] >= (q @ tree.points[a:b].T).max(axis=1)).all() and (b - a <= 20 or tree.below[node])
    assert sorted(tree.order.tolist()) == list(range(500)) and (tree.points == points[tree.order]).all()


def trie(rows):
    turns: dict = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    nodes: dict = {}
    for c, p in rebuilt.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    inner = {p[:-1] for p in nodes if p}
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(p))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(len(q) == len(p) + 1 for q in below),
            sum(q not in inner for q in below), sum((len(nodes[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def grown(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return sorted((tuple(r) for r in queries.op13_prefix_trie(spark, path).collect()), key=repr)


@pytest.mark.parametrize("block", [prefix_trie.BLOCK, 2])
def test_trie_equals_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    says = [("user", "hello there  you"), ("bot", "a b"), (None, None), ("", ""), ("user:1", "x"), ("user", ":1x")]
    rows = [(c, t, *rng.choice(says[: rng.choice([1, 2, 6])])) for c in range(-45, 90) if c % 7 for t in range(rng.randrange(8))]
    rows += [(c, t, "user", "hello there  you") for c in range(200, 260) for t in range(5)] + [(300, t, "user", f"turn {t}") for t in range(60)]
    rows += [(400, None, "b", "last of equals"), (400, None, "a", "first"), (400, 3, "z", "y"), (400, 3, "z", "y"), (None, 0, "user", "no conversation")]
    rng.shuffle(rows)
    assert grown(spark, f"{tmp_path}", rows) == trie(rows)


def test_tries_without_turns(spark, tmp_path):
    assert grown(spark, f"{tmp_path}/none", []) == [] and grown(spark, f"{tmp_path}/null", [(None, 1, "a", "b")]) == []
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # its base is absent, its one turn is replaced
    got = grown(spark, f"{tmp_path}/one", [(lone, 0, "a", "b")])
    assert got == trie([(lone, 0, "a", "b")]) and got[0][:7] == (lone, 0, None, 1, 0, 1, 0) and len(got) == 1
