from pyspark.sql import functions as F

from gazette.operators import history as hist
from gazette.plans import queries as Q
from gazette.sources.derived import AS_OF, listings_from_pages
from gazette.sources.tables import read_table
from gazette.streaming import incremental as inc

SF = "/root/testdata/sf0.001"


def entries(history):
    return sorted((r["persona_id"], r["entry_pos"], r["normalized_link"], str(r["sent_at"])) for r in history.collect())


def test_stream_run_is_idempotent(spark):
    work = inc.scratch_dir(spark, "stream-test")
    personas, start = Q.v_personas(spark, SF), Q.v_history(spark, SF)
    run = lambda: inc.run_incremental(spark, f"{SF}/pages.parquet", work, personas, AS_OF,
                                      initial_history=start, listing=listings_from_pages)
    first = entries(run())
    assert len(first) > start.count()
    # same files, same stream checkpoint: nothing new is emitted
    assert entries(run()) == first
    # no article is recorded twice for a persona
    links = [(p, link) for p, _, link, _ in first if link]
    assert len(links) == len(set(links))


def test_replayed_batch_writes_the_same_entries(spark):
    state = inc.scratch_dir(spark, "replay-test")
    pages = listings_from_pages(read_table(spark, SF, "pages"))
    personas, start = Q.v_personas(spark, SF), Q.v_history(spark, SF)
    half = [pages.where(f"page_id % 2 = {k}") for k in (0, 1)]
    for epoch in (0, 1):
        inc.process_batch(spark, half[epoch], epoch, state, personas, AS_OF, start)
    after = entries(inc.history_before(spark, state, 2, start, AS_OF))
    before = entries(inc.history_before(spark, state, 1, start, AS_OF))
    assert len(before) > start.count() and len(after) > len(before)
    for epoch in (0, 1, 1):  # a batch sees the state before it, not its own output
        inc.process_batch(spark, half[epoch], epoch, state, personas, AS_OF, start)
    assert entries(inc.history_before(spark, state, 1, start, AS_OF)) == before
    assert entries(inc.history_before(spark, state, 2, start, AS_OF)) == after


def test_snapshots_replace_deltas(spark, monkeypatch):
    monkeypatch.setattr(inc, "SNAPSHOT_EVERY", 1)
    state = inc.scratch_dir(spark, "snapshot-test")
    pages = listings_from_pages(read_table(spark, SF, "pages"))
    personas, start = Q.v_personas(spark, SF), Q.v_history(spark, SF)
    for epoch in range(3):
        inc.process_batch(spark, pages.where(f"page_id % 3 = {epoch}"), epoch, state, personas, AS_OF, start)
    assert inc._epochs(spark, f"{state}/snapshot") == [1, 2]
    assert inc._epochs(spark, f"{state}/delta") == [2]
    assert inc.history_before(spark, state, 3, start, AS_OF).count() > start.count()


SENT_DDL = "persona_id string, seq long, title string, chamada string, resumo string, link string, site string"


def sent_rows(spark, rows):
    """rows: (persona, seq, n), article n."""
    return spark.createDataFrame([(p, s, f"Article number {n}", None, None, f"https://site.com/{n}", "site.com") for p, s, n in rows], SENT_DDL)


def test_deltas_are_read_where_they_lie_and_replaced_entries_go(spark):
    state = inc.scratch_dir(spark, "delta-test")

    def add(epoch, rows):
        before = inc.history_before(spark, state, epoch, None, AS_OF)
        new = hist.upserts(before, sent_rows(spark, rows), AS_OF, as_delta=True)
        new.withColumn("epoch", F.lit(epoch).cast("bigint")).write.parquet(f"{state}/delta/e={epoch}")
        return inc.history_before(spark, state, epoch + 1, None, AS_OF)
    add(0, [("p1", 1, 1), ("p1", 2, 2), ("p2", 1, 1)])
    found = add(1, [("p1", 1, 3), ("p2", 1, 4)])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    held = lambda df: sorted((r["persona_id"], r["entry_pos"], r["link"][-1]) for r in df.collect())
    assert held(found) == [("p1", 0, "1"), ("p1", 1, "2"), ("p1", 2, "3"), ("p2", 0, "1"), ("p2", 1, "4")]
    # article 2 again: its entry is replaced where it is, and each place is held once
    found = add(2, [("p1", 1, 2), ("p1", 1, 2), ("p1", 2, 5)])
    assert held(found) == [("p1", 0, "1"), ("p1", 1, "2"), ("p1", 2, "3"), ("p1", 3, "5"), ("p2", 0, "1"), ("p2", 1, "4")]
    assert held(inc.history_before(spark, state, 3)) == held(found)


def test_only_personas_whose_keys_meet_are_folded(spark, monkeypatch):
    folded, real = [], hist.places
    monkeypatch.setattr(hist, "places", lambda h, s: folded.extend(r[0] for r in s.select("persona_id").collect()) or real(h, s))
    empty = spark.createDataFrame([], inc.HISTORY_DDL)
    first = hist.record_sent(empty, sent_rows(spark, [("a", 1, 1), ("b", 1, 1), ("b", 2, 2)]), AS_OF)
    assert folded == []
    then = hist.record_sent(first, sent_rows(spark, [("a", 1, 2), ("a", 2, 3), ("b", 1, 3), ("b", 2, 2), ("c", 1, 4), ("c", 2, 4)]), AS_OF)
    assert set(folded) == {"b", "c"}
    assert sorted((r["persona_id"], r["entry_pos"], r["link"][-1]) for r in then.collect()) == [
        ("a", 0, "1"), ("a", 1, "2"), ("a", 2, "3"), ("b", 0, "1"), ("b", 1, "2"), ("b", 2, "3"), ("c", 0, "4")]
