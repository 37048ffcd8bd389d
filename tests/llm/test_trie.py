"""The prefix trie against building it in a dictionary."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gazette.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, nth string, len string, a string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def head(conv):
    return zlib.crc32(str(conv).encode()) % 9


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {c: tuple(turns.get(c - c % 5, [])[:head(c)] + own[head(c):]) for c, own in turns.items()}
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    kids = {}
    for n in nodes:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1].encode()) if n else 0
    ends = lambda n: ",".join(map(str, sorted(c for c in nodes[n] if rebuilt[c] == n)))
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n],
                   hashlib.sha256(ends(n).encode()).hexdigest()) for n, m in nodes.items())


def found(spark, rows, cells=None):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    turns = trie.rebuilt(trie.numbered(df), F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(9)), F.col("conv") - F.col("conv") % 5)
    return sorted(tuple(r) for r in trie.prefix_trie(turns, cells).select(*COLUMNS).collect())


def conversations():
    rng = random.Random(2)
    openings = [[(rng.choice("ua"), f"text {rng.randrange(4)} ä" * rng.randrange(1, 4)) for _ in range(12)] for _ in range(3)]
    rows = []
    for c in range(60):
        seq = openings[rng.randrange(3)][:rng.randrange(13)] if c % 3 else openings[0]
        seq = seq + [(rng.choice("ua"), f"own {rng.randrange(3)}") for _ in range(rng.randrange(4))]
        rows += [(c + 1000 * (c % 7 == 0), t, *s) for t, s in enumerate(seq)]
    # a long conversation, its copy's copy, ties, nulls, repeated rows
    rows += [(c, t, "u", f"step {t % 7}") for c in (500, 501, 502) for t in range(150)]
    rows += [(70, 1, "u", "b"), (70, 1, "u", "a"), (70, 1, None, "c"), (70, None, "u", None), (70, 2, "u", "a"), (70, 2, "u", "a")]
    rows += [(None, 1, "u", "lost"), (71, None, None, None), (72, 1, "u", "x" * 200_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("cells", [None, 4, 1 << 10])
def test_against_a_dictionary(spark, cells):
    rows = conversations()
    assert found(spark, rows, cells) == brute(rows)


def test_one_conversation_and_none(spark):
    rows = [(5, t, "u", str(t)) for t in range(3)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_numbers_are_carried_over_partitions(spark):
    from gazette.session import cut_lineage
    df = cut_lineage(spark.range(1000).select((F.col("id") >= 30).cast("long").alias("k"), F.col("id").alias("v")).repartitionByRange(8, "v")
                     .sortWithinPartitions("v"))
    got = trie.running(df, "k", (), ("v",))
    for r in got.collect():
        first = 30 * r.k
        assert r.nth == r.v - first + 1 and r.v_upto == sum(range(first, r.v + 1))


def test_numbers_stay_where_partitions_run_under_other_numbers(spark):
    from gazette.session import cut_lineage
    df = cut_lineage(spark.range(1000).select((F.col("id") / 90).cast("long").alias("k"), F.col("id").alias("v")).repartitionByRange(8, "v")
                     .sortWithinPartitions("v"))
    got = trie.running(df, "k", (), ("v",))
    alone = sorted(map(tuple, got.collect()))
    first = spark.range(3).select(*[F.lit(0).cast("long").alias(c) for c in got.columns])
    assert sorted(map(tuple, first.union(got).where("nth > 0").collect())) == alone
    assert sorted(map(tuple, got.coalesce(3).collect())) == alone


def test_conversations_cut_by_partitions(spark):
    rows = [(c, t, "u", f"{c % 5} {t}") for c in range(40) for t in range(30 + c % 4)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_screening_emits_singletons_where_they_are(spark):
    rows = [(c, t, "u", f"{c}:{t}" if t else "hello") for c in range(0, 100, 5) for t in range(9)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    turns = trie.rebuilt(trie.numbered(df), F.lit(0), F.col("conv"))
    counts = {r[0]: r[1] for r in trie.screened(trie.prefixes(turns)).groupBy(F.col("proven_upto") == 0).count().collect()}
    assert counts == {True: 40, False: 160}  # the roots and the common first turn are shared
