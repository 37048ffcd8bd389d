"""Every stage of the pipeline against brute force, on what it was given."""

import random

import pytest

import corpus_pipeline
import test_lines
import test_packing
import test_quality
import test_simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    words = ["the", "of", "and", "de", "la", "und", "der"] * 4 + [f"word{i}" for i in range(400)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(30) for _ in range(4)]
    rows = []
    for doc in range(60):
        parts = [line(rng.randrange(5, 60)) for _ in range(rng.randrange(1, 5))] + rng.sample(shared, rng.randrange(2))
        rows.append((doc, "\n".join(parts), "en", rng.choice(["b", "a", "c", None])))
    long, other = line(900), line(600).split()
    # the same words in other lines: no line repeats, but the documents do
    rows += [(150 + w, "\n".join(" ".join(other[i:i + w]) for i in range(0, 600, w)), "en", "b") for w in (17, 23, 31)]
    rows += [(100 + k, long.replace("word7 ", f"w{k} ", 1), "en", "a") for k in range(5)]
    rows += [(200, None, None, None), (201, "", "en", "a"), (202, "THE!! " * 50, "en", "a"), (203, rows[3][1], "en", "b"), (None, line(40), "en", "c")]
    return [(d, t, g, s, None if t is None else len(t)) for d, t, g, s in rows]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{n}")
        out.append((docs, spark.read.parquet(f"{folder}/{n}")))
        docs = out[-1][1]
    return folder, out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(tables):
    for before, after in tables[1][:-1]:
        assert after.columns == before.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_quality_stage(tables):
    before, after = tables[1][0]
    assert sorted(pairs(after), key=repr) == sorted((p for p in pairs(before) if test_quality.measures(p[1])[-1]), key=repr)


def test_line_stage(tables):
    before, after = tables[1][1]
    want = sorted(((d, t) for d, t, _, _ in test_lines.brute(pairs(before))), key=repr)
    assert sorted(pairs(after), key=repr) == want
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_simhash_stage(tables):
    before, after = tables[1][2]
    want = [d for d, _, c in test_simhash.brute(pairs(before)) if d is None or d == c]
    assert sorted((d for d, _ in pairs(after)), key=repr) == sorted(want, key=repr)
    assert len(want) < before.count()


def test_mixing_stage(tables):
    before, after = tables[1][3]
    texts, words = dict(pairs(before)), lambda t: len((t or "").split())
    size = {}
    for r in before.collect():
        size[r.source] = size.get(r.source, 0) + words(r.text)
    order = sorted(size, key=lambda s: (s is None, s))
    from test_mixing import targets
    goal = dict(zip(order, targets([size[s] for s in order])))
    taken, by_doc = dict.fromkeys(order, 0), {}
    for r in after.collect():
        assert texts[r.doc_id].startswith(r.text)
        taken[r.source] += words(r.text)
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + words(r.text)
    assert all(abs(taken[s] - goal[s]) <= 96 for s in order)
    assert all(n <= 2 * words(texts[d]) for d, n in by_doc.items())


def test_packing_stage(tables):
    before, after = tables[1][4]
    n = test_packing.check(pairs(before), after.collect(), 2048)
    assert n <= -(-sum(r.length for r in after.collect()) // 2048) + 1


def test_run_is_the_stages(spark, tables):
    folder, out = tables
    got = corpus_pipeline.run(spark, folder)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(map(tuple, out[-1][1].select(columns).collect()), key=repr)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").collect() == []
