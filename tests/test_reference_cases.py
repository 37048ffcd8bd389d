"""The surveyed project's unit cases, restated as DataFrame tests."""

from pyspark.sql import functions as F

from gazette.functions.dates import digest_date, digest_title, is_within_days, parse_date
from gazette.functions.links import normalize_link
from gazette.functions.identity import dedupe_keys, with_identity
from gazette.operators import docs as dc
from gazette.operators import history as hist
from gazette.operators import personas as pers
from gazette.operators import requests as rq
from gazette.operators.dedupe import greedy_dedupe
from gazette.operators.quality import is_valid_title

NOW = "2026-05-06 15:00:00"


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_link_drops_tracking_and_fragment(spark):
    assert one(spark, normalize_link(F.lit("https://site.com/path/?utm_source=x&b=2#top"))) == \
        "https://site.com/path?b=2"


def test_link_params_sorted_case_insensitive_tracking(spark):
    got = one(spark, normalize_link(F.lit(" HTTPS://WWW.Site.com:443/a//?z=1&REF=q&a=2&fbclid=9 ")))
    assert got == "https://www.site.com/a?a=2&z=1"
    assert one(spark, normalize_link(F.lit("not a url"))) == "not a url"
    assert one(spark, normalize_link(F.lit(None).cast("string"))) == ""


def articles(spark, rows):
    return spark.createDataFrame(rows, "pos long, title string, link string")


def test_dedupe_three_in_two_kept(spark):
    a = articles(spark, [(1, "Mercado sobe com corte de juros", "https://site.com/m1?utm_source=x"),
                         (2, "Mercado sobe com corte de juros", "https://site.com/m1?utm_medium=y"),
                         (3, "Empresa anuncia aquisicao", "https://site.com/m2")])
    a = with_identity(a).withColumn("keys", dedupe_keys("normalized_link", "source_title_keys"))
    d = greedy_dedupe(a, "pos", "keys")
    assert d.filter("kept").count() == 2
    assert d.filter("NOT kept").count() == 1


def _history(spark, rows):
    raw = spark.createDataFrame(rows, "persona_id string, entry_pos long, title string, chamada string, "
                                      "resumo string, link string, sentAt string")
    for c in ("titulo", "summaryTitle", "normalizedLink", "titleKey", "sourceTitleKey", "source",
              "docTitle", "docLink"):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    for c in ("titleKeys", "sourceTitleKeys"):
        raw = raw.withColumn(c, F.lit(None).cast("array<string>"))
    return hist.repair_entries(raw, NOW)


def test_already_sent_item_removed_for_persona(spark):
    h = _history(spark, [("marcos", 0, "Mercado sobe com corte de juros", None, None,
                          "https://site.com/m1", "2026-05-06T12:00:00Z")])
    arts = spark.createDataFrame([(0, "Mercado sobe com corte de juros", "https://site.com/m1"),
                                  (1, "Empresa anuncia aquisicao", "https://site.com/m2")],
                                 "ord long, title string, link string")
    sel = spark.createDataFrame([("marcos", 1, 0), ("marcos", 2, 1)], "persona_id string, rank long, ord long")
    s = hist.suppress_repeats(sel, arts, h, 10)
    assert [r["ord"] for r in s.filter("status = 'kept'").collect()] == [1]
    counts = hist.selection_counts(s).first()
    assert (counts["kept"], counts["removed"]) == (1, 1)


def test_original_title_matches_after_headline_change(spark):
    h = _history(spark, [("marcos", 0, "Empresa anuncia aquisicao bilionaria no setor de energia",
                          "Gigante fecha acordo historico", None,
                          "https://site.com/energia/aquisicao-antiga", "2026-05-06T12:00:00Z")])
    arts = spark.createDataFrame([(0, "Empresa anuncia aquisicao bilionaria no setor de energia",
                                   "https://site.com/energia/aquisicao-nova")],
                                 "ord long, title string, link string")
    sel = spark.createDataFrame([("marcos", 1, 0)], "persona_id string, rank long, ord long")
    s = hist.suppress_repeats(sel, arts, h, 10)
    assert s.filter("status = 'kept'").count() == 0
    assert hist.selection_counts(s).first()["removed"] == 1


def test_record_sent_stores_all_fields(spark):
    empty = _history(spark, [("x", 0, "t", None, None, "", None)]).filter("false")
    sent = spark.createDataFrame([("marcos", 1, "Empresa anuncia aquisicao bilionaria no setor de energia",
                                   "Gigante fecha acordo historico",
                                   "A companhia confirmou a compra e detalhou impacto financeiro esperado.",
                                   "https://site.com/energia/aquisicao", None)],
                                 "persona_id string, seq long, title string, chamada string, resumo string, "
                                 "link string, site string")
    r = hist.record_sent(empty, sent, sent_at=NOW).first().asDict()
    assert r["title"] == "Empresa anuncia aquisicao bilionaria no setor de energia"
    assert r["chamada"] == "Gigante fecha acordo historico"
    assert r["normalized_link"] == "https://site.com/energia/aquisicao"
    assert r["title_key"] == "empresa anuncia aquisicao bilionaria no setor de energia"
    assert r["title_keys"] == ["empresa anuncia aquisicao bilionaria no setor de energia",
                               "gigante fecha acordo historico"]
    assert r["source_title_key"] == "site.com::empresa anuncia aquisicao bilionaria no setor de energia"
    assert r["source_title_keys"] == ["site.com::empresa anuncia aquisicao bilionaria no setor de energia",
                                      "site.com::gigante fecha acordo historico"]
    assert r["source"] is None and r["doc_title"] is None and r["doc_link"] is None
    assert len(hist.HISTORY_COLS) - 2 == 13  # 13 entry fields besides persona_id, entry_pos


def test_history_context_line(spark):
    h = _history(spark, [("marcos", 0, "Empresa anuncia aquisicao bilionaria no setor de energia",
                          "Gigante fecha acordo historico",
                          "A companhia confirmou a compra e detalhou impacto financeiro esperado.",
                          "https://site.com/energia/aquisicao", "2026-05-06T12:00:00Z")])
    line = hist.history_context(h).first()["line"]
    assert line == ("Titulo original: Empresa anuncia aquisicao bilionaria no setor de energia | "
                    "Chamada enviada: Gigante fecha acordo historico | "
                    "Resumo enviado: A companhia confirmou a compra e detalhou impacto financeiro esperado. | "
                    "Link: https://site.com/energia/aquisicao")


TOOL = "ord long, error string, articles_found long, reason string, title string, link string"


def test_filter_keeps_original_index(spark):
    rows = spark.createDataFrame([(0, "portal indisponivel", None, None, None, None),
                                  (1, None, 0, "nenhum item", None, None),
                                  (2, None, None, None, "Empresa anuncia aquisicao", "https://site.com/m1")], TOOL)
    comp = spark.createDataFrame([("marcos", '{"selecionados":[2]}')], "request_id string, content string")
    got = rq.parse_filter(comp, rq.usable_rows(rows)).collect()
    assert [r["ord"] for r in got] == [2]


def test_no_usable_rows_no_request(spark):
    rows = spark.createDataFrame([(0, "portal indisponivel", None, None, None, None),
                                  (1, None, 0, "nenhum item", None, None)], TOOL)
    ctx = spark.createDataFrame([("marcos", "### Marcos")], "id string, context string")
    assert rq.filter_requests(rows, ctx).count() == 0


def test_duplicate_persona_ids_rejected(spark):
    p = spark.createDataFrame([(0, "marcos", "Marcos", "Executivo", [], []),
                               (1, " marcos ", "Marcos 2", "Outro executivo", [], [])],
                              "persona_idx long, id string, nome string, descricao string, "
                              "prioridades array<string>, evitar array<string>")
    v = pers.persona_violations(p).collect()
    assert [(r["persona_idx"], r["violation"]) for r in v] == [(1, "id_duplicado")]
    try:
        pers.validate_personas(p)
        raise AssertionError("expected a violation")
    except ValueError as e:
        assert "duplicado" in str(e)


def test_digest_date_and_title(spark):
    ts = F.to_timestamp(F.lit("2026-05-06 12:00:00"))
    assert one(spark, digest_date(ts)) == "06-05-2026"
    assert one(spark, digest_title(F.lit("Marcos Fernandes"), ts)) == "06-05-2026 | Marcos Fernandes"


def test_doc_title_forms(spark):
    assert one(spark, dc.is_doc_for_persona(F.lit("06-05-2026 | Marcos Fernandes"), F.lit("Marcos Fernandes")))
    assert one(spark, dc.is_doc_for_persona(F.lit("Clipping Marcos Fernandes - 06/05/2026"),
                                            F.lit("Marcos Fernandes")))
    assert not one(spark, dc.is_doc_for_persona(F.lit("06-05-2026 | Outro Cliente"), F.lit("Marcos Fernandes")))


def test_docs_within_lookback_newest_first(spark):
    files = spark.createDataFrame([
        (1, "06-05-2026 | Marcos Fernandes", "2026-05-06 12:00:00"),
        (2, "Clipping Marcos Fernandes - 02/05/2026", "2026-05-02 12:00:00"),
        (3, "28-04-2026 | Marcos Fernandes", "2026-04-28 12:00:00"),
        (4, "06-05-2026 | Outro Cliente", "2026-05-06 12:00:00")], "id long, name string, t string") \
        .withColumn("modified_time", F.to_timestamp("t")).withColumn("web_view_link", F.lit(None).cast("string"))
    personas = spark.createDataFrame([("marcos", "Marcos Fernandes")], "id string, nome string")
    got = dc.docs_for_persona(dc.candidate_docs(files, personas), NOW, 7).orderBy("doc_rank").collect()
    assert [r["name"] for r in got] == ["06-05-2026 | Marcos Fernandes",
                                        "Clipping Marcos Fernandes - 02/05/2026"]


def test_relative_dates(spark):
    two_hours = parse_date(F.lit("há 2 horas"), NOW)
    three_days = parse_date(F.lit("há 3 dias"), NOW)
    assert one(spark, two_hours) is not None
    assert one(spark, is_within_days(two_hours, NOW, 1))
    assert not one(spark, is_within_days(three_days, NOW, 1))
    assert one(spark, is_within_days(parse_date(F.lit("sem hora"), NOW), NOW, 1))


def test_ticker_titles(spark):
    assert not one(spark, is_valid_title(F.lit("PETR4R$49,641,14%")))
    assert not one(spark, is_valid_title(F.lit("ABEV3R$14,520,07%")))
    assert one(spark, is_valid_title(F.lit("WEG amplia fabrica e acelera expansao global")))


def test_english_and_slash_dates(spark):
    from gazette.functions.dates import ts_text
    got = lambda v: one(spark, ts_text(parse_date(F.lit(v), NOW)))
    assert got("Mon, 06 May 2026 12:00:00 GMT") == "2026-05-06 12:00:00"
    assert got("May 6, 2026 10:30") == "2026-05-06 10:30:00"
    assert got("05/06/2026") == "2026-05-06 00:00:00"      # bare: month first
    assert got("Publicado em 13/06/26") == "2026-06-13 00:00:00"  # embedded: day first
    assert got("31 Feb 2026") == "2026-03-03 00:00:00"     # runs into the next month


def test_small_helpers(spark):
    from gazette.functions.links import doc_id_from_link, site_label
    from gazette.functions.text import date_tag, strip_fences, truncate_text
    assert one(spark, doc_id_from_link(F.lit("https://docs.example.com/document/d/abc123/edit"))) == "abc123"
    assert one(spark, site_label(F.lit("https://www.g1.globo.com/economia"))) == "g1.globo.com"
    assert one(spark, truncate_text(F.lit("  abcdef   ghij  "), 8)) == "abcde..."
    assert one(spark, strip_fences(F.lit(' ```JSON\n{"a":1}\n``` '), "{}")) == '{"a":1}'
    assert one(spark, strip_fences(F.lit(None).cast("string"), "{}")) == "{}"
    assert one(spark, date_tag(F.lit("2026-05-06T12:00:00.000Z"))) == "2026-05-06T12:00"
    assert one(spark, date_tag(F.lit(""))) == "sem data"
