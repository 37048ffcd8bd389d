"""Elements of JSON documents, read by ranges of bytes, against the standard parser."""

import json
import os
import random

import pytest

from gazette.operators.history import read_history_json
from gazette.sources.files import read_personas_json, write_history_json, write_personas_json
from gazette.sources.json_elements import _Reader, depth_states, key_states
from gazette.streaming.incremental import scratch_dir

TEXTS = ["", "plain", 'quo"te', "back\\slash", "\\\\\"", "br{ac[ke]ts}", "a: b, c", "line\nend", "ação", "\U0001F600", "\\u0041", "x" * 40]


def rows_of(path, size, name):
    """What ``read_elements`` reads, range by range, without a session."""
    def read(stage, states):
        r = _Reader({"path": path, "stage": stage, "rangebytes": str(size), "name": name or "", "states": json.dumps(states)})
        return [row for part in r.partitions() for row in r.read(part)]

    scan = ["file", "start", "odd", "outside", "inside", "low_outside", "low_inside"]
    states = depth_states(dict(zip(scan, r)) for r in read("scan", {}))
    keys = ["file", "start", "k1", "k2", "listed", "n"]
    states = key_states([dict(zip(keys, r)) for r in read("keys", states)], states, name)
    return read("elements", states)


def value(rng, depth=0):
    kind = rng.randrange(6 if depth < 3 else 3)
    if kind < 2:
        return rng.choice(TEXTS)
    if kind == 2:
        return rng.choice([None, True, 1.5, -3])
    if kind == 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(TEXTS): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def element(rng):
    return {k: value(rng) for k in rng.sample(TEXTS, 3)}


def written(path, doc, rng):
    with open(path, "w") as fh:
        json.dump(doc, fh, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)


@pytest.mark.parametrize("seed", range(20))
def test_any_cut_gives_the_same_elements(tmp_path, seed):
    rng = random.Random(seed)
    lists = [[element(rng) for _ in range(rng.randrange(1, 6))] for _ in range(2)]
    os.mkdir(tmp_path / "lists")
    for i, doc in enumerate(lists):
        written(tmp_path / "lists" / f"{i}.json", doc, rng)
    history = {"version": 1, "other": {"p": [{"x": {"personas": [[{}]]}}]},
               "personas": {rng.choice(TEXTS) + str(i): rng.choice([[element(rng) for _ in range(rng.randrange(5))],
                                                                    {"k": [{}]}, "text", None]) for i in range(5)},
               "after": [[[{"a": 1}]], {"b": [{}]}]}
    written(tmp_path / "h.json", history, rng)
    expected = [(k, i, e) for k, es in history["personas"].items() if isinstance(es, list) for i, e in enumerate(es)]
    for size in (1, 2, 3, 7, 16, 61, 1000, 1 << 20):
        got = rows_of(str(tmp_path / "lists"), size, None)
        assert [(p, json.loads(e)) for _, p, e in got] == list(enumerate(lists[0] + lists[1]))
        got = rows_of(str(tmp_path / "h.json"), size, "personas")
        assert [(k, p, json.loads(e)) for k, p, e in got] == expected


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": 1}}]', '[{"a": "x]', '[{"a": 1} {"b": 2}]', '[{"a": 1},, {"b": 2}]',
                                  '[{"a": 1}, 5]', '[{"a": 1}, [2]]', '{"a": 1}', "]["])
def test_malformed_lists_fail(tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(ValueError):
        rows_of(str(tmp_path / "x.json"), 1 << 20, None)


def test_empty_files_and_lists_have_no_elements(tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text(" [ ] ")
    (tmp_path / "_SUCCESS").write_text("no json")
    assert rows_of(str(tmp_path), 2, None) == []
    (tmp_path / "b.json").write_text('{"version": 1, "personas": {}}')
    assert rows_of(str(tmp_path), 3, "personas") == []


def test_lists_and_histories_written_by_partition_read_back(spark):
    base = scratch_dir(spark, "json-test")
    people = [(f"p{i}", f'Na"me {i}', None if i % 3 else "d", ["a", TEXTS[i % len(TEXTS)]], []) for i in range(40)]
    ddl = "id string, nome string, descricao string, prioridades array<string>, evitar array<string>"
    write_personas_json(spark.createDataFrame(people, ddl).repartition(3), f"{base}/people")
    back = read_personas_json(spark, f"{base}/people", range_bytes=100)
    assert sorted(tuple(r)[1:] for r in back.collect()) == sorted(people)
    assert sorted(r["persona_idx"] for r in back.collect()) == list(range(40))
    # one persona holds most entries: its list goes through no group
    entries = [("hot" if i % 4 else f"p{i}", i, TEXTS[i % len(TEXTS)], f"https://site.com/{i}") for i in range(400)]
    write_history_json(spark.createDataFrame(entries, "persona_id string, entry_pos long, title string, link string"), f"{base}/history")
    h = read_history_json(spark, f"{base}/history", range_bytes=500)
    expected, seen = [], {}
    for persona, _, title, link in entries:
        expected.append((persona, seen.setdefault(persona, 0), title, link))
        seen[persona] += 1
    assert sorted(tuple(r) for r in h.select("persona_id", "entry_pos", "title", "link").collect()) == sorted(expected)
