"""Exact and proximity matches against looking at every window."""

import random
import re

import pytest

from gazette.llm import phrases

DOCS = "doc_id long, text string, item_id string, n_words string, segment string"
ITEMS = "item_id long, text string, doc_id string, spans string"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows_of(text, size):
    w = words_of(text)
    return [tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def brute(docs, items, size):
    out = []
    for doc, text in docs:
        w, hit, ids = words_of(text), set(), set()
        for item, t in items:
            for win in windows_of(t, size):
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i:i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        ids.add(item)
        out.append((doc, len(w), len(hit), len(ids), tuple(sorted(str(i) for i in ids if i is not None))))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(6)
    vocabulary = [f"W{i}" for i in range(12)] + ["é1", "Straße", "x-y", "a_b"]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [fresh(n) for n in (1, 2, 3, 5, 8, 12, 30)]
    items = [(i, " ".join(rng.choice(passages) + fresh(rng.randrange(3)))) for i in range(25)]
    items += [(3, "another W1 W2 W3 W4"), (None, "W5 é1 W6 W7 W8"), (40, None), (41, ""), (42, " .,"), (43, items[0][1]), (3, items[0][1]),
              (44, "a B c d e f g h i j k l m")]
    docs = [(d, ", ".join(fresh(rng.randrange(30)) + rng.choice(passages) + fresh(rng.randrange(10)))) for d in range(60)]
    docs += [(None, docs[0][1]), (None, docs[1][1]), (7, docs[0][1]), (7, docs[0][1]), (90, None), (91, ""), (92, "\n .;"),
             (93, "A b c d e\x00f g"), (94, "b C d E f g h i j k l")]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "x", "y", "z") for d in docs], DOCS).repartition(3),
            spark.createDataFrame([(*i, "x", "y") for i in items], ITEMS))


@pytest.mark.parametrize(("size", "block"), [(4, 1 << 20), (4, 60), (10, 1 << 20)])
def test_against_every_window(spark, size, block):
    docs, items = corpus()
    got = phrases.decontaminate(*frames(spark, docs, items), window=size, block_bytes=block)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items", "spans"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r["items"])) for r in rows), key=repr) == brute(docs, items, size)
    for r in rows:  # stretches are apart and in order
        ends = [x for s in r.spans for x in (s.start, s.end)]
        assert ends == sorted(ends) and sum(s.end - s.start for s in r.spans) == r.n_hit
    assert any(r.n_hit for r in rows)


def test_empty_tables(spark):
    docs, items = corpus()
    d, i = frames(spark, docs, items)
    assert phrases.decontaminate(d.limit(0), i).collect() == []
    clean = phrases.decontaminate(d, i.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r.n_hit or r.n_items for r in clean)


def near(w, win, reach):
    wanted, found = set(win), []
    for i in range(len(w)):
        for j in range(i + 1, min(i + reach, len(w)) + 1):
            if wanted <= set(w[i:j]):
                found.append((i, j))
                break
    return {s for s in found if not any(o != s and o[0] >= s[0] and o[1] <= s[1] for o in found)}


def test_proximity_matches(spark):
    docs, items = corpus()
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    d, i = frames(spark, docs, items)
    got = phrases.near_matches(phrases.build_index(d), i, slop=3, window=4).collect()
    assert len(got) == len(set(got))
    expected = {(doc, s) for doc, text in docs for _, t in items for win in windows_of(t, 4) for s in near(words_of(text), win, len(win) + 3)}
    assert {(r.doc_id, (r.start, r.end)) for r in got} == expected and expected


def test_a_long_text_is_one_segment(spark):
    rng = random.Random(1)
    text = " ".join(f"v{rng.randrange(5000)}" for _ in range(400_000))
    place = 300_000
    words = text.split()
    docs = [(1, text), (2, "short text"), (3, "q" * (phrases.SEGMENT_BYTES + 10) + " " + " ".join(words[place:place + 12]))]
    items = [(1, " ".join(words[place:place + 12])), (2, "q" * (phrases.SEGMENT_BYTES + 10))]
    got = {r.doc_id: r for r in phrases.decontaminate(*frames(spark, docs, items)).collect()}
    assert [tuple(s) for s in got[1].spans] == [(place, place + 12)] and got[1]["items"] == ["1"]
    assert got[2].n_hit == 0 and got[3].n_hit == 13 and got[3]["items"] == ["1", "2"]
