"""Any-key dedupe where rounds alone would take as many as a chain is long."""

import random

import pytest

from gazette.operators import dedupe
from gazette.operators.components import components


def sequential(rows):
    claimed, kept = {}, []
    for g, pos, keys in sorted(rows):
        mine = claimed.setdefault(g, set())
        if mine.isdisjoint(keys):
            kept.append((g, pos))
            mine |= set(keys)
    return kept


def kept_of(spark, rows, **params):
    df = spark.createDataFrame(rows, "g string, pos long, keys array<string>").repartition(3)
    return sorted((r.g, r.pos) for r in dedupe.greedy_dedupe(df, "pos", "keys", group_cols=["g"], **params).where("kept").collect())


def test_a_chain_of_ten_thousand_rows(spark, monkeypatch):
    calls = []
    real = dedupe._round
    monkeypatch.setattr(dedupe, "_round", lambda *a: calls.append(1) or real(*a))
    n = 10_000
    shuffled = list(range(n + 1))
    random.Random(1).shuffle(shuffled)
    rows = [("a", i, [f"k{i}", f"k{i + 1}"]) for i in range(n)] + [("b", i, [f"k{shuffled[i]}", f"k{shuffled[i + 1]}"]) for i in range(n)]
    assert kept_of(spark, rows) == sequential(rows)
    assert len(calls) < 10


@pytest.mark.parametrize("params", [{}, {"rounds": 0}, {"rounds": 1, "fold_pairs": 12}])
def test_random_keys_against_the_sequential_rule(spark, params):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i, [f"k{rng.randrange(60)}" for _ in range(rng.randrange(4))]) for i in range(120)]
    assert kept_of(spark, rows, **params) == sequential(rows)


@pytest.mark.parametrize("local", [0, 5, 1 << 19])
def test_components(spark, local):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)]
    root = {x: x for e in links for x in e}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), local).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == linked
    assert {frozenset(x for x in linked if got[x] == t) for t in set(got.values())} == \
        {frozenset(x for x in linked if root[x] == t) for t in {root[x] for x in linked}}
