"""Token counts against encoding whole texts."""

import random

import pytest

from gazette.llm import encoders, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, n_bytes string, block string"


def found(spark, rows, **params):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    return sorted(map(tuple, tokens.token_counts(df, **params).collect()), key=repr)


def brute(rows):
    tok = encoders.load(public_tokenizers.path("word_bpe_49k.json"))
    return sorted(((a, len((b or "").encode()), len(tok.encode(b or "", add_special_tokens=False).ids)) for a, b in rows), key=repr)


def test_against_whole_texts(spark):
    rng = random.Random(6)
    odd = ["It's", "İstanbul", "ΣΑΣ", "a b", "x\u0085y", "é", "<|startoftext|>", "<|STARTOFTEXT|>", "a<|endoftext|>B<",
           "<|", "12,345.6", "’s", "日本語", "…,", "don't'll", "\x1c\x1d", "ẞ", "ﬁ", "--", "🙂🙂"]
    rows = [(None, "a b"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "the " * 5000), (4, "the " * 5000)]
    for doc in range(80):
        words = [rng.choice(odd) if rng.random() < 0.4 else "".join(rng.choice("abcdeXYZ") for _ in range(rng.randrange(1, 9)))
                 for _ in range(rng.randrange(0, 120))]
        rows.append((10 + doc, "".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for w in words)))
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, buckets=1) == brute(rows)


def test_capitals_with_combining_marks(spark):
    rows = [(c, f"x {chr(c)}{chr(m)} abc {chr(c)}{chr(m)}ak\n{chr(m)}{chr(c)}") for c in range(0x41, 0x5B) for m in range(0x300, 0x370)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []
