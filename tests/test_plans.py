"""Registered queries on small tables against brute force."""

from __future__ import annotations

import pytest

from marginalia.plans import queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def distance(a, b, cost):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + cost(x, y)))
        row = new
    return row[-1]


LONG = " ".join(f"w{i}" for i in range(40))
TURNS = {
    (1, 0): LONG, (1, 1): LONG + " tail", (1, 3): LONG.replace("w30", "v30"), (1, 4): LONG.replace("w30", "w31  extra"), (1, 5): LONG,
    (2, 0): "", (2, 1): "One two", (3, 7): "alone", (4, 0): LONG.upper(), (4, 1): LONG, (5, 0): LONG, (5, 1): LONG.replace("w39", "wxy"),
}


@pytest.fixture(scope="module")
def conversations(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("conversations")
    spark.createDataFrame([(*k, "user", t) for k, t in TURNS.items()], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return str(at)


def following():
    """((conversation, turn), words, words of the next turn)."""
    at = sorted(TURNS)
    words = lambda k: [x for x in TURNS[k].lower().split(" ") if x]
    return [(k, words(k), words(n)) for k, n in zip(at, at[1:], strict=False) if k[0] == n[0]]


def test_turns_are_compared_whole(spark, conversations):
    alike = lambda x, y: 0.0 if x == y else 0.5 if x[0] == y[0] else 1.0
    want = [(*k, round(distance(a, b, alike) / max(len(a), len(b)), 6)) for k, a, b in following()]
    assert rows(queries.QUERIES["token_unlike_weighted"](spark, conversations)) == want
    want = [(*k, distance(a, b, lambda x, y: float(x != y))) for k, a, b in following()]
    assert rows(queries.QUERIES["edit_distance_turns"](spark, conversations)) == want
    equal = lambda f: sum([f(x) for x in a] == [f(x) for x in b] for _, a, b in following())
    want = (len(following()), equal(str), equal(len), equal(lambda x: x[0]))
    assert rows(queries.QUERIES["bars_exact_rhythm_pitch"](spark, conversations)) == [want]


def test_runs_and_overlaps_read_all_keys(spark, tmp_path):
    # Only keys that the partial queries leave out: o_orderkey % 7 >= 3, p_partkey % 3 > 0.
    orders = [(200 * k + slot, part, "5-LOW" if part == 3 else "1-URGENT") for slot in (4, 5, 6) for part, k in enumerate((0, 7, 14, 21))]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    parts = [(1, "A", "x"), (2, "A", "y"), (4, "B", "x"), (5, "B", "z"), (7, "B", "y"), (8, "C", "w")]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = queries.QUERIES["key_disagreement_runs"](spark, str(tmp_path))
    assert rows(got.select("part", "value", "others", "first", "last")) == [(3, "5-LOW", "1-URGENT", 4, 6)]
    assert rows(queries.QUERIES["pairwise_jaccard"](spark, str(tmp_path))) == [("A", "B", 2, 3, round(2 / 3, 9))]


def test_every_turn_is_aligned_with_the_next(spark, conversations):
    got = queries.QUERIES["banded_align"](spark, conversations).collect()
    at = sorted(TURNS)
    split = lambda k: TURNS[k].lower().split(" ")
    nexts = {k: split(n) if k[0] == n[0] else [] for k, n in zip(at, [*at[1:], (None, None)], strict=True) if k[0] == n[0] or k == (3, 7)}
    assert {(r.conv_id, r.turn) for r in got} == set(nexts)
    for k, b in nexts.items():
        a, own = split(k), [r for r in got if (r.conv_id, r.turn) == k]
        assert [r.l for r in own if r.l is not None] == list(range(len(a))) and [r.r for r in own if r.r is not None] == list(range(len(b)))
        cost = sum((a[r.l] != b[r.r]) if r.op == "one" else 0.45 for r in own)
        row = [0.45 * j for j in range(len(b) + 1)]
        for i, x in enumerate(a):
            new = [0.45 * (i + 1)]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 0.45, new[j] + 0.45, row[j] + (x != y)))
            row = new
        assert abs(cost - row[-1]) < 1e-9


def test_a_shift_holds_for_the_whole_vector(spark, tmp_path):
    a = [0.1 * i for i in range(6)]
    vectors = [(0, a), (1, [x + 0.5 for x in a]), (2, [*(x + 1 for x in a[:5]), 9.0]), (64, a)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows(queries.QUERIES["step_shift"](spark, str(tmp_path))) == [(0, 5), (1, None), (2, None)]
