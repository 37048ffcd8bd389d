import json
import os
import tempfile

from pyspark.sql import functions as F

from gazette.operators import history as hist
from gazette.operators import personas as pers
from gazette.sources.files import read_personas_json, select_personas, write_digests


def _tmp(spark):
    from gazette.session import ensure_checkpoint_dir
    return tempfile.mkdtemp(dir=ensure_checkpoint_dir(spark).replace("file:", ""))


def test_read_personas_file(spark):
    d = _tmp(spark)
    path = os.path.join(d, "personas.json")
    with open(path, "w") as fh:
        json.dump([{"id": "north", "nome": "Northwind Desk", "descricao": "Covers ports",
                    "prioridades": ["shipping", "grain"], "evitar": ["sport"]},
                   {"id": "south", "nome": "Southgate Desk", "descricao": "Covers rail",
                    "prioridades": ["freight"], "evitar": [" "]}], fh)
    p = read_personas_json(spark, path)
    assert [r["id"] for r in p.orderBy("persona_idx").collect()] == ["north", "south"]
    v = pers.persona_violations(p).collect()
    assert [(r["persona_id"], r["violation"]) for r in v] == [("south", "evitar")]
    assert select_personas(p, ["south"]).count() == 1


def test_read_history_file_repairs_and_prunes(spark):
    d = _tmp(spark)
    path = os.path.join(d, "news-history.json")
    with open(path, "w") as fh:
        json.dump({"version": 1, "personas": {"marcos": [
            {"titulo": "  Empresa   anuncia aquisicao ", "link": "https://www.site.com/a?utm_source=x",
             "sentAt": "2026-05-06T12:00:00Z"},
            {"title": "Antiga", "link": "https://site.com/b", "sentAt": "2026-01-01T00:00:00Z"},
            {"title": "Sem data", "summaryTitle": "Chamada", "resumo": "   ", "link": "https://site.com/c",
             "normalizedLink": ""}]}}, fh)
    raw = hist.read_history_json(spark, path)
    h = hist.repair_entries(raw, "2026-05-06 15:00:00").orderBy("entry_pos").collect()
    assert [r["title"] for r in h] == ["Empresa anuncia aquisicao", "Sem data"]
    assert h[0]["normalized_link"] == "https://www.site.com/a"
    assert h[0]["source_title_keys"] == ["site.com::empresa anuncia aquisicao"]
    assert h[1]["normalized_link"] == ""          # a stored empty key is kept
    assert h[1]["chamada"] == "Chamada" and h[1]["resumo"] is None
    assert h[1]["title_keys"] == ["sem data", "chamada"]


def test_history_save_roundtrip_and_digest_sink(spark):
    d = _tmp(spark)
    rows = [("p1", 0, "T", None, None, "https://a.com/1", "https://a.com/1", "t", ["t"], "a.com::t",
             ["a.com::t"], None, None, None, None)]
    h = spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(hist.HISTORY_COLS, [
        "string", "long", "string", "string", "string", "string", "string", "string", "array<string>",
        "string", "array<string>", "string", "timestamp", "string", "string"])))
    path = hist.save_history(h, d)
    assert hist.load_saved_history(spark, path).collect()[0]["title"] == "T"
    docs = spark.createDataFrame([("p1", "01-02-2024 | X", 1, "body"), ("p2", "01-02-2024 | Y", 0, "")],
                                 "persona_id string, doc_title string, n_items long, body string")
    write_digests(docs, os.path.join(d, "digests"), "2024-02-01")
    back = spark.read.json(os.path.join(d, "digests"))
    assert [r["persona_id"] for r in back.collect()] == ["p1"]


def test_composed_run_writes_digests_and_history(spark):
    from gazette.plans import queries as Q
    from gazette.plans.digest_run import run_digest
    from gazette.sources.derived import AS_OF, listings_from_pages
    from gazette.sources.tables import read_table
    sf = "/root/testdata/sf0.001"
    pages = read_table(spark, sf, "pages")
    out = run_digest(listings_from_pages(pages), Q.v_personas(spark, sf), Q.v_history(spark, sf),
                     AS_OF, _tmp(spark), article_pages=pages)
    written = spark.read.json(out.digests_path)
    assert written.count() == out.digests.count() > 0
    assert out.history.count() >= Q.v_history(spark, sf).count()
    # the run's counters were taken while its stages ran
    assert out.counters["docs_created"] == written.count()
    assert out.counters["summaries"] == out.counters["selected_unique"] > 0
    assert out.counters["titles_collected"] >= out.counters["selected_unique"]


def test_counters_see_rows_once_and_empty_stages(spark):
    from gazette.operators.report import RunCounters
    from gazette.session import cut_lineage
    run = RunCounters()
    rows = spark.range(1000).repartition(7)
    cut_lineage(run.of("some", rows.groupBy((rows.id % 10).alias("k")).count()))
    cut_lineage(run.of("none", rows.filter("id < 0")))
    run.of("written", rows).write.parquet(os.path.join(_tmp(spark), "rows"))
    assert run.values() == {"some": 10, "none": 0, "written": 1000}
