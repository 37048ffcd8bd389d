"""Word and byte windows that occur elsewhere, against counting all of them."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gazette.llm import substring, suffix

SCHEMA = "doc_id long, text string, n_words string, start string"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)


def gone(sequences, size):
    seen = Counter(tuple(s[i:i + size]) for s in sequences for i in range(len(s) - size + 1))
    out = []
    for s in sequences:
        mask = [False] * len(s)
        for i in range(len(s) - size + 1):
            if seen[tuple(s[i:i + size])] > 1:
                mask[i:i + size] = [True] * size
        out.append(mask)
    return out


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(unit, joint):
    rng = random.Random(8)
    fresh = lambda n: [unit(rng) for _ in range(n)]
    passages = [fresh(n) for n in (12, 20, 45, 90)]
    rows = [(None, joint(passages[2])), (None, None), (1, None), (2, ""), (3, " \n "), (4, joint(["a"] * 60)), (5, joint(["a", "b"] * 40))]
    for doc in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts += rng.choice([p, p[cut:], p[:cut], fresh(rng.randrange(30))])
        rows.append((10 + doc, joint(parts)))
    rows += [rows[-1], (80, rows[-2][1])]
    return rows


def test_words(spark):
    rows = corpus(lambda r: f"w{r.randrange(25)}é", " \t".join)
    sequences = [words_of(t) for _, t in rows]
    want = sorted(((d, len(s), sum(m), " ".join(w for w, g in zip(s, m) if not g))
                   for (d, _), s, m in zip(rows, sequences, gone(sequences, 14))), key=repr)
    got = substring.dedup_substrings(frame(spark, rows), window=14, gram=3).collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_bytes(spark):
    rows = corpus(lambda r: r.choice("abcdé"), "".join)
    sequences = [(t or "").encode() for _, t in rows]
    masks = gone(sequences, 16)
    want = []
    for (d, _), s, m in zip(rows, sequences, masks):
        runs = sum(g and not (i and m[i - 1]) for i, g in enumerate(m))
        want.append((d, len(s), sum(m), runs, bytes(b for b, g in zip(s, m) if not g)))
    got = suffix.dedup_bytes(frame(spark, rows), window=16, trigger=4).collect()
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=repr) == sorted(want, key=repr)


def test_factors_copy_from_their_reference(spark):
    passage = [f"p{i}" for i in range(50)]
    rows = [(1, " ".join(["x1"] + passage + ["x2"])), (2, " ".join(["y1", "y2"] + passage))]
    d = frame(spark, rows).selectExpr("doc_id as doc", "cast(xxhash64(text) & 65535 as int) as sig", "text")
    whole = substring.repeats.repeated_blocks(d, substring.word_blocks(14, 3), 14, (1,))
    texts = {doc: t.split() for doc, t in rows}
    made = substring.factors(whole, 14).collect()
    assert {r.doc for r in made} == {1, 2}
    for r in made:
        n = r.end - r.start
        assert n >= 14 and texts[r.doc][r.start:r.end] == texts[r.ref_doc][r.ref_start:r.ref_start + n]


def test_empty_table(spark):
    assert substring.dedup_substrings(frame(spark, [])).collect() == []
    assert suffix.dedup_bytes(frame(spark, [])).collect() == []


def colliding(made, clean):
    """Two texts whose xxhash64 agree in their lower 31 bits."""
    low = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) & (1 << 31) - 1
    seen = {low(t): t for t in (f"{made} m{i}" for i in range(1 << 17))}
    return next((seen[low(t)], t) for t in (f"{clean} c{i}" for i in range(1 << 18)) if low(t) in seen)


def test_texts_under_one_id_keep_their_own_runs(spark):
    passage, clean = " ".join(f"p{i}" for i in range(20)), " ".join(f"q{i}" for i in range(12))
    a, b = colliding(passage, clean)
    for doc in (None, 5):
        rows = [(doc, a), (doc, b), (7, passage)]
        got = substring.dedup_substrings(frame(spark, rows), window=14, gram=3).collect()
        assert sorted((r.kept_text for r in got)) == sorted([a.split()[-1], b, ""])
        kept = suffix.dedup_bytes(frame(spark, rows), window=16, trigger=4).collect()
        assert sorted(bytes(r.kept) for r in kept) == sorted([a[len(passage):].encode(), b.encode(), b""])


def test_a_run_past_its_document_is_an_error():
    lists = lambda *x: pa.array(x, pa.list_(pa.int32()))
    mask = lambda end: substring.repeats.run_mask(6, lists([0], []), lists([end], []), np.array([0, 3]))
    assert mask(3).tolist() == [True] * 3 + [False] * 3
    with pytest.raises(ValueError):
        mask(4)
