"""Repeat suppression on the state store against the rule in plain Python."""

import datetime as dt
import random

import pytest

from gazette.streaming import incremental as inc
from gazette.streaming import state as st

START = dt.datetime(2026, 5, 1, 12)
HISTORY = "persona_id string, entry_pos long, normalized_link string, source_title_key string, source_title_keys array<string>, sent_at timestamp_ntz"


def expected(runs, history, most, days):
    sent, out = dict(history), []
    for at, rows in runs:
        for persona in sorted({r[0] for r in rows}):
            claimed, kept = set(), 0
            for _, rank, ord_, keys in sorted(r for r in rows if r[0] == persona):
                live = {k for k in keys if (persona, k) in sent and (sent[persona, k] is None or sent[persona, k] >= at - dt.timedelta(days))}
                if kept >= most:
                    out.append((persona, at, rank, ord_, "unexamined", None))
                elif live - claimed:
                    out.append((persona, at, rank, ord_, "history", None))
                elif claimed & set(keys):
                    out.append((persona, at, rank, ord_, "duplicate", None))
                else:
                    kept += 1
                    out.append((persona, at, rank, ord_, "kept", kept))
                    claimed |= set(keys)
                    sent |= {(persona, k): at for k in keys}
    return sorted(out, key=repr)


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_replay_and_expiry(spark, one_partition):
    rng = random.Random(7)
    work = inc.scratch_dir(spark, "state-test")
    runs = []
    for n in range(4):
        rows = [(f"p{p}", rank, 100 * n + rank, [f"L{rng.randrange(25)}", f"T{rng.randrange(25)}"]) for p in range(3) for rank in range(8)]
        runs.append((START + dt.timedelta(days=5 * n), rows))
    runs[1][1].append(("p9", 1, 7, []))
    old = [("p0", 0, "3", "4", ["4", "5"], None), ("p1", 0, "3", "", [], START - dt.timedelta(days=2)),
           ("p1", 1, "6", "", [], START - dt.timedelta(days=30))]
    history = spark.createDataFrame(old, HISTORY)
    known = {("p0", k): None for k in ("L3", "T4", "T5")} | {("p1", "L3"): old[1][-1], ("p1", "L6"): old[2][-1]}
    got = None
    for n, (at, rows) in enumerate(runs):
        st.write_selection(spark.createDataFrame([(p, at, r, o, k) for p, r, o, k in rows], st.SELECTION_DDL), f"{work}/selections", 1)
        if n in (1, 3):  # two calls; a batch a file
            got = st.run_stateful(spark, f"{work}/selections", work, history, max_per_persona=5, lookback_days=10)
    want = expected(runs, known, 5, 10)
    rows = lambda: sorted(map(tuple, got.collect()), key=repr)
    assert rows() == want
    assert {r[4] for r in want} == {"kept", "history", "duplicate", "unexamined"}
    # nothing new in the source: nothing is emitted again
    got = st.run_stateful(spark, f"{work}/selections", work, history, max_per_persona=5, lookback_days=10)
    assert rows() == want
