"""Periodic runs against comparing every word with every later one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gazette.llm import queries, runs

SCHEMA = "doc_id long, text string, runs string, doc string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(
                    all(w[t] == w[t + p] for t in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, q, length))
            i = max(j, i + 1)
    return sorted(out)


def collapsed(w, found):
    gone = {i for s, q, n in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts():
    rng = random.Random(3)
    out = []
    for _ in range(150):
        w, k = [], rng.choice([1, 2, 3, 9])
        while len(w) < rng.choice([5, 40, 160]):
            part = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(1, 12))]
            w += (part * rng.randrange(1, 9))[:rng.randrange(1, 90)] if rng.random() < 0.6 else part
        out.append(rng.choice([" ", "\n", " \t "]).join(w) + rng.choice(["", " "]))
    return out


def found(spark, rows, **params):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA).repartition(3)
    got = runs.periodic_runs(df, **params)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    return sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=repr)


def expected(rows):
    out = []
    for doc, text in rows:
        w = words_of(text)
        out.append((doc, len(w), brute(w), collapsed(w, brute(w))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("tile_words", [16, 1 << 16])
def test_against_all_pairs_of_words(spark, tile_words):
    rows = list(enumerate(texts()))
    rows += [(None, rows[0][1]), (None, rows[1][1]), (4, rows[2][1]), (4, rows[2][1]), (900, None), (901, ""), (902, " \n"), (903, "a " * 6)]
    assert found(spark, rows, tile_words=tile_words) == expected(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_no_run_in_a_text_that_defeats_wrapping_hashes():
    n = 1 << 14  # no block of this sequence stands three times in a row
    word = np.array([bin(i).count("1") & 1 for i in range(n)], np.uint64) + np.uint64(9)
    assert not any(len(runs.solve(word, np.array([0, n]), k)[0]) for k in range(runs.octaves(n)))


def test_long_text_of_one_word_and_a_long_period(spark):
    rng = random.Random(5)
    block = [f"b{rng.randrange(1000)}" for _ in range(30_000)]
    rows = [(1, "a " * 200_000), (2, " ".join(block * 5))]
    got = found(spark, rows)
    assert got[0][2] == [(0, 1, 200_000)] and got[0][3] == "a"
    assert got[1][2] == [(0, 30_000, 150_000)] and got[1][3] == " ".join(block)


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())] + [(200, None), (10, "one"), (None, "a a a a a a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc, text in rows:
        w = words_of(text)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        b = brute(w)
        top = min(b, key=lambda r: (-r[2], r[0], r[1]), default=None)
        listed = "".join(f"{s},{n},{q}\n" for s, q, n in b)
        want.append((doc, len(b), *((top[0], top[2], top[1], 1000 * top[2] // top[1]) if top else (None,) * 4),
                     hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w, b).encode()).hexdigest()))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
