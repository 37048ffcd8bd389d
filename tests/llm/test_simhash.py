"""SimHash against a plain computation, and the edge cases of its contract."""

import random
import re

import numpy as np
import xxhash

from gazette.llm import simhash
from gazette.llm.xxh import xxh64_spans

SCHEMA = "doc_id long, text string, fp string, component_id string"


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def found(spark, rows, **params):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    got = simhash.near_duplicate_groups(df, **params).collect()
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got), key=repr)


def test_xxh64_of_all_lengths():
    data = np.frombuffer(random.Random(3).randbytes(500), np.uint8)
    start = np.arange(120)
    length = np.arange(120)
    want = [xxhash.xxh64_intdigest(data[s:s + n].tobytes(), seed=42) for s, n in zip(start, length)]
    assert xxh64_spans(data, start, length, 42).tolist() == want


def test_groups_and_edge_cases(spark):
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(300)]
    rows = [(None, "a b c d"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "ONE two"), (7, "x y z\x0bq")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 2000]))]
        for _ in range(5):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows) + 10, " ".join(copy)))
    rows.append(rows[-1])
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)
    # shards of any size have the same links
    assert found(spark, rows, shard_limit=4) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_trees_find_every_pair():
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres] + [c ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for c in centres]))
    rng.shuffle(fps)
    sizes = np.array([1, 7, len(fps) - 8])
    trees = simhash.BKTrees(fps, sizes)
    got = {(int(a), int(b)) for q, n in trees.within(np.arange(len(fps)), 3) for a, b in zip(q, n)}
    shard = np.repeat([0, 1, 2], sizes)
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps))
            if i != j and shard[i] == shard[j] and int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert got == want


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c"), (1, "a b c"), (2, "other words here"), (None, "a b c")]
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    kept = simhash.one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2]


def test_rows_are_judged_by_their_own_texts(spark):
    a, b, c, d = ("alpha beta gamma delta", "one two three four", "red green blue pink", "north south east west")
    rows = [(5, a), (5, b), (3, b), *[(8, c)] * 3, *[(None, d)] * 3, (9, a), (None, None), (None, "")]
    kept = simhash.one_per_group(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(3))
    got = sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=repr)
    assert got == sorted([(5, a), (3, b), (8, c), (None, d), (None, "")], key=repr)
