"""Mixing against quotas made seat by seat, and the rows of a mix."""

import re

import pytest

from gazette.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, target string"


def seats(votes, total):
    """Sainte-Laguë, one seat at a time; ties go to the first party."""
    got = [0] * len(votes)
    for _ in range(total):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def targets(sizes, share=1.5, cap=2.0):
    weight = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    fixed = {}
    while True:
        rest = share * sum(sizes) - sum(fixed.values())
        free = [i for i in range(len(sizes)) if i not in fixed]
        level = rest / sum(weight[i] for i in free) if free else 0
        over = [i for i in free if weight[i] * level > cap * sizes[i]]
        if not over:
            return [fixed.get(i, weight[i] * level) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def rows_of(spec):
    out, doc = [], 0
    for source, sizes in spec:
        for n in sizes:
            out.append((doc, source, " ".join(f"w{doc}x{i}" for i in range(n)) if n is not None else None, "a", "b"))
            doc += 1
    return out


SPEC = [("b", [10, 500, 30] * 9), ("a", [3] * 7), ("é", [100] * 40), (None, [9, 80, 0, None] * 5), ("c", [0, None])]


@pytest.mark.parametrize("shard_words", [2_000_000, 700])
def test_targets_quotas_and_taken(spark, shard_words):
    rows = rows_of(SPEC)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, mixing.text_size(df["text"]), block_words=16, shard_words=shard_words).collect()
    assert len(got) == len(rows)
    order = ["a", "b", "c", "é", None]
    size = {s: sum(len((r[2] or "").split()) for r in rows if r[1] == s) for s in order}
    want = targets([size[s] for s in order])
    ideal = [t / 16 for t in want]
    quota = seats(ideal, round(sum(want) / 16))
    for i, s in enumerate(order):
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {size[s]}
        assert all(abs(r.target - want[i]) < 1e-6 for r in mine)
        taken = sum(r.taken for r in mine)
        shards = len({r.shard for r in mine})
        assert abs(taken - min(quota[i] * 16, 2 * size[s])) <= 16 * shards
        if shards == 1:
            assert taken == min(quota[i] * 16, 2 * size[s])
        assert all(0 <= r.taken <= 2 * r.size for r in mine)
    if shard_words > 1000:
        return
    again = mixing.mix(df.repartition(7), mixing.text_size(df["text"]), block_words=16, shard_words=shard_words).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_documents_of_a_mix(spark):
    rows = rows_of(SPEC) + [(900, "a", "\n two  words\t", "a", "b")] * 3 + [(None, "a", "x y z", "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = mixing.mixed_documents(df, block_words=4)
    assert kept.columns == df.columns
    texts = {(r[0], r[1]): r[2] for r in rows}
    for r in kept.collect():
        whole = texts[r.doc_id, r.source]
        assert r.text and whole.startswith(r.text)
        assert re.search(r"[^\x20\x09-\x0D]$", r.text) or r.text == whole


def test_rows_without_an_id_keep_their_words_and_spread(spark):
    rows = [(d, "a", "w " * 50, "x", "y") for d in range(40)] + [(None, "b", "one two three", "x", "y")] * 4000 + [(5, "c", "p q", "x", "y")] * 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    params = {"block_words": 4, "shard_words": 600}
    got = mixing.mix(df, mixing.text_size(df["text"]), **params).collect()
    assert len(got) == len(rows) and len({r.shard for r in got if r.source == "b"}) == 20
    kept = mixing.mixed_documents(df, **params).collect()
    for s in "abc":
        taken = sum(r.taken for r in got if r.source == s)
        assert taken > 0 and taken == sum(len(r.text.split()) for r in kept if r.source == s)


def test_a_source_of_empty_texts_is_spread_by_rows(spark):
    df = spark.createDataFrame([(d, "e", None, "x", "y") for d in range(50)] + [(99, "f", "a b", "x", "y")], SCHEMA)
    got = mixing.mix(df, mixing.text_size(df["text"]), shard_rows=10).collect()
    assert len(got) == 51 and len({r.shard for r in got if r.source == "e"}) > 1


def test_a_long_text_among_short_ones(spark):
    rows = [(1, "a", "word " * 400_000, "x", "y"), (2, "a", "b", "x", "y"), (3, "b", "c d", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in mixing.mix(df, mixing.text_size(df["text"])).collect()}
    assert got[1]["size"] == 400_000 and all(r.taken <= 2 * r["size"] for r in got.values())


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(df, mixing.text_size(df["text"])).collect() == []
    assert mixing.mixed_documents(df).collect() == []
