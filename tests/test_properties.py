"""Brute-force checks: the parallel operators against sequential scans."""

import random

from pyspark.sql import functions as F

from gazette.operators import docs as dc
from gazette.operators import history as hist
from gazette.operators import render as rd
from gazette.operators.dedupe import greedy_dedupe


def sequential_dedupe(rows):
    seen, kept = set(), []
    for pos, keys in sorted(rows):
        if any(k in seen for k in keys):
            continue
        seen.update(keys)
        kept.append(pos)
    return kept


def test_greedy_dedupe_matches_sequential_scan(spark):
    rng = random.Random(7)
    cases = []
    for case in range(25):
        n = rng.randint(1, 30)
        universe = rng.randint(1, 12)
        for pos in range(n):
            keys = sorted({f"k{rng.randrange(universe)}" for _ in range(rng.randint(0, 3))})
            cases.append((f"c{case}", pos, keys))
    # an adversarial chain: A{1}, B{1,2}, C{2,3}, ... needs many rounds
    for pos in range(12):
        cases.append(("chain", pos, [f"x{pos}", f"x{pos + 1}"] if pos else ["x0"]))
    df = spark.createDataFrame(cases, "grp string, pos long, keys array<string>")
    got = greedy_dedupe(df, "pos", "keys", group_cols=["grp"]).filter("kept").collect()
    by_grp = {}
    for r in got:
        by_grp.setdefault(r["grp"], []).append(r["pos"])
    for grp in {c[0] for c in cases}:
        rows = [(p, k) for g, p, k in cases if g == grp]
        assert sorted(by_grp.get(grp, [])) == sequential_dedupe(rows), grp


def test_non_transitive_rule(spark):
    df = spark.createDataFrame([(1, ["1"]), (2, ["1", "2"]), (3, ["2"])], "pos long, keys array<string>")
    assert sorted(r["pos"] for r in greedy_dedupe(df, "pos", "keys").filter("kept").collect()) == [1, 3]


def sequential_upsert(entries, sent):
    """entries: list of (pos, link, set(keys)); sent: list of (seq, link, set(keys))."""
    state = [list(e) + [None] for e in sorted(entries)]
    nxt = max([e[0] for e in entries], default=-1)
    for seq, link, keys in sorted(sent):
        if not link and not keys:
            continue
        hit = next((e for e in state if (link and e[1] == link) or (e[2] & keys)), None)
        if hit is None:
            nxt += 1
            state.append([nxt, link, keys, seq])
        else:
            hit[1], hit[2], hit[3] = link, keys, seq
    return {e[0]: e[3] for e in state}


def test_record_sent_matches_sequential_upsert(spark):
    rng = random.Random(3)
    hosts = ["a.com", "b.com"]
    titles = [f"titulo numero {i}" for i in range(6)]
    hist_rows, sent_rows = [], []
    for pos in range(8):
        t, h = rng.choice(titles), rng.choice(hosts)
        hist_rows.append(("p", pos, t, None, None, f"https://{h}/{rng.randrange(5)}", "2026-05-06T10:00:00Z"))
    for seq in range(1, 7):
        t, h = rng.choice(titles), rng.choice(hosts)
        sent_rows.append(("p", seq, t, None, None, f"https://{h}/{rng.randrange(7)}", None))
    raw = spark.createDataFrame(hist_rows, "persona_id string, entry_pos long, title string, chamada string, "
                                           "resumo string, link string, sentAt string")
    for c in ("titulo", "summaryTitle", "normalizedLink", "titleKey", "sourceTitleKey", "source",
              "docTitle", "docLink"):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    for c in ("titleKeys", "sourceTitleKeys"):
        raw = raw.withColumn(c, F.lit(None).cast("array<string>"))
    h = hist.repair_entries(raw, "2026-05-06 15:00:00")
    sent = spark.createDataFrame(sent_rows, "persona_id string, seq long, title string, chamada string, "
                                            "resumo string, link string, site string")
    out = hist.record_sent(h, sent, sent_at="2026-05-06 15:00:00")
    got = {r["entry_pos"]: r["link"] for r in out.collect()}

    def keyset(link, title):
        host = link.split("/")[2]
        return link, {f"{host}::{title}"}
    entries = [(p, *keyset(lk, t)) for _, p, t, _, _, lk, _ in hist_rows]
    sends = [(s, *keyset(lk, t)) for _, s, t, _, _, lk, _ in sent_rows]
    expected = sequential_upsert(entries, sends)
    links = {s: lk for _, s, _, _, _, lk, _ in sent_rows}
    olds = {p: lk for _, p, _, _, _, lk, _ in hist_rows}
    assert got == {p: (links[s] if s is not None else olds[p]) for p, s in expected.items()}


def test_render_then_parse_returns_items(spark):
    items = spark.createDataFrame([("p", 1, 10, "Primeira chamada", "Resumo um.", "https://a.com/1"),
                                   ("p", 2, 11, "Segunda chamada", "Resumo dois.", "https://a.com/2")],
                                  "persona_id string, item_no long, ord long, chamada string, resumo string, "
                                  "link string")
    personas = spark.createDataFrame([("p", "Cliente")], "id string, nome string")
    doc = rd.render_digest(items, personas, "2026-05-06 12:00:00")
    parsed = dc.parse_doc_items(doc.select(F.col("persona_id").alias("id"), F.col("body").alias("text")))
    got = [(r["item_no"], r["title"], r["resumo"], r["link"]) for r in parsed.orderBy("item_no").collect()]
    assert got == [(1, "Primeira chamada", "Resumo um.", "https://a.com/1"),
                   (2, "Segunda chamada", "Resumo dois.", "https://a.com/2")]
    spans = rd.digest_spans(items, "2026-05-06 12:00:00").orderBy("span_no").collect()
    body = doc.first()["body"]
    first_link = spans[2]
    # document indexes start at 1 and span ends are exclusive
    assert body[first_link["start"] - 1:first_link["end"] - 1] == "https://a.com/1"
    assert body[spans[1]["start"] - 1:spans[1]["end"] - 1] == "1. Primeira chamada"
    assert body[spans[0]["start"] - 1:spans[0]["end"] - 1] == "CLIPPING DE NOTICIAS - 06-05-2026\n"


def test_parse_items_rules(spark):
    text = ("CLIPPING DE NOTICIAS - 06-05-2026\n\n1. Titulo A\nlinha a1\r\nCLIPPING DE NOTICIAS extra\n"
            "linha a2\nLink: https://x.com/a\ndepois\n2. Titulo B sem link\nlinha b\n"
            "3. Titulo C\nLink: https://x.com/c\n")
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = [(r["item_no"], r["title"], r["resumo"], r["link"])
           for r in dc.parse_doc_items(df).orderBy("item_no").collect()]
    assert got == [(1, "Titulo A", "linha a1 linha a2", "https://x.com/a"),
                   (2, "Titulo C", "", "https://x.com/c")]


def test_chains_match_sequential(spark):
    cases = [("chain", pos, [f"x{pos}", f"x{pos + 1}"] if pos else ["x0"]) for pos in range(15)]
    cases += [("mix", 1, ["a"]), ("mix", 2, ["a", "b"]), ("mix", 3, ["b"]), ("mix", 4, [])]
    df = spark.createDataFrame(cases, "grp string, pos long, keys array<string>")
    got = greedy_dedupe(df, "pos", "keys", group_cols=["grp"]).filter("kept").collect()
    for grp in ("chain", "mix"):
        rows = [(p, k) for g, p, k in cases if g == grp]
        assert sorted(r["pos"] for r in got if r["grp"] == grp) == sequential_dedupe(rows)
    plain = spark.createDataFrame([(p, k) for _, p, k in cases[:15]], "pos long, keys array<string>")
    kept = sorted(r["pos"] for r in greedy_dedupe(plain, "pos", "keys").filter("kept").collect())
    assert kept == sequential_dedupe([(p, k) for _, p, k in cases[:15]])


def test_hydrate_history_older_document_overwrites(spark):
    """History import on a small fixture, checked against the sequential
    rule: newest document first, an older document's matching item replaces
    the entry in place, personas that already have history are skipped,
    documents outside the lookback are ignored."""
    personas = spark.createDataFrame([("pa", "Ana Souza"), ("pb", "Bia Lima")], "id string, nome string")
    hist_raw = spark.createDataFrame([("pb", 0, "Antiga", None, None, "https://s.com/old",
                                       "2026-05-05T10:00:00Z")],
                                     "persona_id string, entry_pos long, title string, chamada string, "
                                     "resumo string, link string, sentAt string")
    for c in ("titulo", "summaryTitle", "normalizedLink", "titleKey", "sourceTitleKey", "source",
              "docTitle", "docLink"):
        hist_raw = hist_raw.withColumn(c, F.lit(None).cast("string"))
    for c in ("titleKeys", "sourceTitleKeys"):
        hist_raw = hist_raw.withColumn(c, F.lit(None).cast("array<string>"))
    now = "2026-05-06 15:00:00"
    history = hist.repair_entries(hist_raw, now)
    docs = spark.createDataFrame([
        (1, "06-05-2026 | Ana Souza", "2026-05-06 09:00:00",
         "1. Titulo X\nresumo x\nLink: https://s.com/x\n2. Titulo Y\nLink: https://s.com/y\n"),
        (2, "Clipping Ana Souza - 04/05/2026", "2026-05-04 09:00:00",
         "1. Titulo X\nLink: https://s.com/x-outro\n"),
        (3, "06-05-2026 | Bia Lima", "2026-05-06 09:00:00", "1. Nova\nLink: https://s.com/n\n"),
        (4, "01-01-2026 | Ana Souza", "2026-01-01 09:00:00", "1. Velha\nLink: https://s.com/v\n")],
        "id long, name string, t string, text string")
    docs = (docs.withColumn("modified_time", F.to_timestamp("t"))
            .withColumn("web_view_link", F.concat(F.lit("https://d/"), F.col("id").cast("string"))))
    bodies = docs.select("id", F.expr(
        "transform(split(text, '\\n'), l -> named_struct('paragraph', named_struct('elements', "
        "array(named_struct('textRun', named_struct('content', concat(l, '\\n')))))))").alias("content"))
    out = dc.hydrate_history(history, personas, docs, bodies, now)
    got = sorted((r["persona_id"], r["entry_pos"], r["title"], r["link"], r["doc_title"])
                 for r in out.collect())
    assert got == [
        ("pa", 0, "Titulo X", "https://s.com/x-outro", "Clipping Ana Souza - 04/05/2026"),
        ("pa", 1, "Titulo Y", "https://s.com/y", "06-05-2026 | Ana Souza"),
        ("pb", 0, "Antiga", "https://s.com/old", None)]
