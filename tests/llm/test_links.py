"""Numbers of links of the n-gram join against brute force."""

from __future__ import annotations

import random

import pytest

from marginalia.llm import ngram_join

rng = random.Random(7)
BASE = [[f"w{rng.randrange(10**6)}" for _ in range(90)] for _ in range(4)]


def changed(words, k):
    w = list(words)
    for i in rng.sample(range(len(w)), k):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


#: Near copies, of which many are connected but not similar; fewer near copies; exact copies; texts without a link.
TEXTS = [changed(BASE[0], k % 3 + 1) for k in range(45)] + [changed(BASE[1], 1) for _ in range(7)] + [" ".join(BASE[0])] * 3
TEXTS += ["one", "ONE", None, "", " ", " ".join(BASE[2]), changed(BASE[2], 1), " ".join(BASE[2]), " ".join(BASE[3])]


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize(("small", "block"), [(32, 512), (4, 8)])
def test_links_are_all_counted_once(spark, monkeypatch, small, block):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.id: r.n_links for r in ngram_join.ngram_jaccard_groups(docs)[0].collect()}
    sets = [shingles(t) for t in TEXTS]
    linked = lambda a, b: bool(a) and 5 * len(a & b) >= 4 * len(a | b)
    want = {i: sum(linked(a, b) for j, b in enumerate(sets) if i != j) for i, a in enumerate(sets)}
    assert len({want[i] for i in range(45)}) > 3 and got == want
