"""Extendible hashing against splitting buckets one by one."""

import hashlib

from gazette.llm import sharding

SCHEMA = "doc_id long, text string, shard string, h string"


def brute(rows, limit):
    items = []
    for i, (doc, text) in enumerate(rows):
        digest = hashlib.md5(f"{'' if doc is None else doc}:{text or ''}".encode()).hexdigest()[:15]
        items.append((f"{int(digest, 16):060b}", len((text or "").encode()), doc))
    out, todo = [], [("", items)] if items else []
    while todo:
        prefix, mine = todo.pop()
        size = sum(n for _, n, _ in mine)
        if size <= limit or len({h for h, _, _ in mine}) == 1:
            out += [(doc, n, prefix, len(prefix), size) for _, n, doc in mine]
        else:
            for bit in "01":
                if part := [x for x in mine if x[0][len(prefix)] == bit]:
                    todo.append((prefix + bit, part))
    return sorted(out, key=repr)


def found(spark, rows, limit):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    got = sharding.sharded(df, limit)
    assert got.columns == ["doc_id", "text", "h", "n_bytes", "shard", "depth", "shard_bytes"]
    return sorted(((r.doc_id, r.n_bytes, r.shard, r.depth, r.shard_bytes) for r in got.collect()), key=repr)


ROWS = [(i, "é" * (i % 37)) for i in range(300)] + [(None, None), (None, "a"), (1000, None), (1001, ""),
                                                     (7, "same" * 30), (7, "same" * 30), (8, "long" * 900)]


def test_splits(spark):
    for limit in (100, 10 ** 9):
        assert found(spark, ROWS, limit) == brute(ROWS, limit)


def test_empty_table(spark):
    assert found(spark, [], 100) == []


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in ROWS], SCHEMA)
    sharding.write_shards(df.drop("shard"), str(tmp_path / "out"), 3000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS)
    assert {r.shard for r in back.select("shard").distinct().collect()} == {"b" + x[2] for x in brute(ROWS, 3000)}
