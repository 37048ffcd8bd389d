"""Quality rules against a plain computation of every measure."""

import random
import re
from collections import Counter

from gazette.llm import quality

SCHEMA = "doc_id long, text string, kept string, n_words string, lang string"


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(8)}
    n = len(words)
    chars = sum(map(len, words))
    base = n < 20 or 100 * len(covered) > 30 * n
    stops = sum(w.lower() in quality.STOP_WORDS for w in words)
    dup = len(lines) - len(set(lines))
    bad = (n and chars < 2 * n) or chars > 20 * n or 100 * sum(c in "#*$%&|<>" for c in text) > 5 * chars
    bad = bad or (n >= 60 and 100 * stops < 2 * n) or 100 * dup > 60 * len(lines)
    bad = bad or 100 * sum(a == b for a, b in zip(words, words[1:])) > 30 * n
    bad = bad or 100 * sum(c.isupper() for c in text) > 50 * chars or 100 * text.count("!") > 30 * n
    return n, chars, sum(c in "#*$%&|<>" for c in text), dup, len(covered), base, not (base or bad)


def rows():
    rng = random.Random(2)
    words = ["the", "de", "und", "plain", "words", "über", "x", "LOUD!!", "a|b", "<tag>", "longer"]
    out = [(None, "the of " * 20), (1, None), (2, ""), (3, " \n\t\n"), (4, "the " * 30), (5, "one\ntwo\none\n\none"), (6, "word " * 5000)]
    for doc in range(150):
        pool = rng.sample(words, rng.randrange(3, len(words)))
        text = "".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randrange(200)))
        out.append((10 + doc, text * rng.choice([1, 1, 2])))
    return out + [out[-1]]


def test_measures_and_verdicts(spark):
    data = rows()
    df = spark.createDataFrame([(a, b, "x", "y", "z") for a, b in data], SCHEMA)
    got = quality.apply_rules(df)
    assert got.columns == ["doc_id", "text", "lang", *quality.MEASURES, "base_failed", "failed_rules", "kept"]
    found = got.select("doc_id", *quality.MEASURES, "base_failed", "kept").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(((d, *measures(t)) for d, t in data), key=repr)
    passing = quality.passing(df)
    assert passing.columns == df.columns
    assert sorted((r.doc_id or -1) for r in passing.collect()) == sorted((d or -1) for d, t in data if measures(t)[-1])


def test_one_projection_without_python(spark):
    df = spark.createDataFrame([], SCHEMA)
    plan = quality.apply_rules(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert quality.apply_rules(df).collect() == []
