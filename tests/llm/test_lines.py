"""Line dedup against comparing every pair of lines."""

import random
import re

import numpy as np
import pytest
import xxhash

from gazette.llm import buckets, lines, text

SCHEMA = "doc_id long, text string, n_lines string, place string"


def tokens(line, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, threshold=0.8, shingle=5):
    places = []
    for r, (doc, text) in enumerate(rows):
        tag = xxhash.xxh64_intdigest((text or "").encode(), seed=42) & (1 << 31) - 1
        for n, line in enumerate([] if text is None else text.split("\n")):
            places.append(((lines.LAST if doc is None else doc, tag, n), r, tokens(line, shingle)))
    gone = set()
    for at, r, t in places:
        for other, _, u in places:
            if other < at and t and u and len(t & u) >= threshold * len(t | u) - 1e-9:
                gone.add((r, at[2]))
                break
    out = []
    for r, (doc, text) in enumerate(rows):
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        own = text.split("\n")
        out.append((doc, "\n".join(x for n, x in enumerate(own) if (r, n) not in gone), len(own),
                    sum((r, n) in gone for n in range(len(own)))))
    return sorted(out, key=repr)


def found(spark, rows, **params):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], SCHEMA)
    got = lines.dedup_lines(df, **params)
    assert got.columns == ["doc_id", "text", "place", "n_lines", "n_removed"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr)


def documents():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.choice([2, 8, 30, 60]))] for _ in range(25)]
    rows = []
    for doc in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line[rng.randrange(len(line))] = rng.choice(words + ["odd"])
            text.append(" ".join(line))
        rows.append((doc, "\n".join(text)))
    rows += [(None, "a b c d e f\n\nx"), (None, "x\n"), (70, None), (71, ""), (72, "\n \n"), (73, rows[0][1]), (73, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shingle", [1, 5])
def test_against_all_pairs(spark, shingle):
    rows = documents()
    assert found(spark, rows, shingle=shingle) == brute(rows, shingle=shingle)
    assert shingle == 1 or found(spark, rows) == brute(rows)


def test_one_changed_word_in_twenty(spark):
    line = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(line)), (2, "kept\n" + " ".join(line[:7] + ["odd"] + line[8:])), (3, " ".join(line[10:] + line[:10]))]
    assert [r[1] for r in found(spark, rows, shingle=1)] == [rows[0][1], "kept", ""]
    many = [(d, " ".join(line[:7] + [f"x{d}"] + line[8:])) for d in range(50)] + [(99, "word " * 300_000)]
    assert sum(r[3] for r in found(spark, many, shingle=1)) == 49


def test_tokens_that_share_upper_bits():
    token = np.array([5, 3, 5, 1 << 40, 5], np.uint64)
    owner, magnitude = np.zeros(5, np.int64), np.ones(5, np.uint8)
    assert (token[lines._by_rarity(owner, magnitude, token)] == [3, 5, 5, 5, 1 << 40]).all()



def test_one_first_line_a_list_is_enough(spark):
    rows = documents()
    assert found(spark, rows, firsts=1, threshold=0.6) == brute(rows, 0.6)


def near_copies(count, n_words, changes, seed=2):
    """Lines that differ from one that is not there by ``changes`` words of their own."""
    rng = random.Random(seed)
    out = []
    for d in range(count):
        line = [f"w{i}" for i in range(n_words)]
        for at in changes(rng):
            line[at] = f"x{d}_{at}"
        out.append((d, " ".join(line)))
    return out


def test_near_copies_below_the_threshold_are_not_paired(spark):
    rows = near_copies(200, 60, lambda rng: (rng.randrange(5, 25), rng.randrange(32, 55)))
    docs = spark.createDataFrame([(d, 0, t) for d, t in rows], "doc long, tag long, text string")
    rarity = buckets.hashed_counts(docs, lambda buf, offs: lines.Tokens(buf, offs, 5).every)
    posted = lines.posted_lines(lines.postings(docs, 5, 0.8, rarity), 0.8).cache()
    assert posted.count() >= 2 * len(rows)
    assert lines.candidates(posted, posted, 0.8).count() <= len(rows)


def test_near_copies_without_their_original_are_met_step_by_step(spark, monkeypatch):
    met, candidates = [], lines.candidates
    monkeypatch.setattr(lines, "candidates", lambda *a: met.append(candidates(*a)) or met[-1])
    rows = near_copies(300, 80, lambda rng: (rng.randrange(5, 75),))
    got = found(spark, rows)
    assert got == brute(rows) and sum(r[3] for r in got) > 200
    assert len(met) > 2 and sum(pairs.count() for pairs in met) < len(rows) ** 2 / 4


@pytest.mark.parametrize("hot", [True, False])
def test_steps_meet_all_lines(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "hot_entries", lambda counts: np.full(len(counts), hot))
    monkeypatch.setattr(lines, "PAIRS_A_POSTING", 0)
    rows = documents()
    assert found(spark, rows, firsts=1) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_texts_under_one_id_lose_their_own_lines(spark):
    from test_repeats import colliding
    a, b = colliding("some line that is here twice\nand", "another line that is here once\nor")
    for doc in (None, 5):
        rows = [(1, "some line that is here twice"), (doc, a), (doc, b)]
        assert found(spark, rows) == sorted([(1, rows[0][1], 1, 0), (doc, a.split("\n")[1], 2, 1), (doc, b, 2, 0)], key=repr)


def sliced(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data])


def test_lists_are_numbered_where_they_are_gathered(spark):
    common = " ".join(f"w{i}" for i in range(20))
    rows = [(d, 0, f"{common} odd{d}") for d in range(9, 0, -1)]
    docs = spark.createDataFrame(rows, "doc long, tag long, text string")
    lists = {}
    for r in lines.postings(docs, 5, 0.8, np.zeros(buckets.TABLE, np.int64)).where(f"kind = {lines.POSTING}").collect():
        lists.setdefault(r.token, []).append((r.doc, r.n))
    assert max(map(len, lists.values())) > 2
    assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in lists.values())


@pytest.mark.parametrize("shingle", [1, 5])
def test_spread_lists_are_numbered_by_the_window(spark, shingle, monkeypatch):
    monkeypatch.setattr(lines, "hot_entries", lambda counts: np.ones(len(counts), bool))
    rows = documents()
    assert found(spark, rows, shingle=shingle) == brute(rows, shingle=shingle)


@pytest.mark.parametrize("shingle", [1, 5, 80])
def test_only_the_lines_asked_for_are_cut_into_words(shingle):
    long = "ä" * 32 + " " + "x" * 64 + " " + "x" * 65 + " " + "y" * 200
    buf, offs = sliced(["", f"a b c\n\n {long} d e f\nlast one here", "\n", "a b c", f"x\n{long} d e f\n", " "])
    none = np.zeros(buckets.TABLE, np.uint8)
    whole = lines.Tokens(buf, offs, shingle, none)
    assert list(zip(whole.row.tolist(), whole.line.tolist(), strict=True)) == [(1, 0), (1, 2), (1, 3), (3, 0), (4, 0), (4, 1)]
    asked = np.array([1, 2, 5])
    part_buf, part_offs = lines._lines_of(buf, offs, whole.row[asked], whole.line[asked])
    assert [part_buf[a:b].tobytes().decode() for a, b in zip(part_offs[:-1], part_offs[1:], strict=True)] == [
        f" {long} d e f", "last one here", f"{long} d e f"]
    part = lines.Tokens(part_buf, part_offs, shingle, none)
    assert (part.key == whole.key[asked]).all() and (part.size == whole.size[asked]).all()
    assert whole.key[0] == whole.key[3] and whole.key[1] == whole.key[5] and len(set(whole.key.tolist())) == 4


def test_equal_words_and_only_those_have_equal_hashes():
    rng = random.Random(1)
    words = ["".join(rng.choice("ab\0") for _ in range(n)) for n in [*range(1, 140)] * 4]
    buf, offs = sliced([" ".join(words)])
    start, end, _ = text.word_spans(buf, offs)
    h = text.stepped_hashes(buf, start, end).tolist()
    assert len(h) == len(words) and len(set(zip(words, h, strict=True))) == len(set(words)) == len(set(h))
