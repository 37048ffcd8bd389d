"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Outputs are flat (scalar columns, timestamps as 'yyyy-MM-dd HH:mm:ss'
text) so they compare cell by cell with the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.functions.constants import LOOKBACK_DAYS
from gazette.functions.dates import is_within_days, parse_date, ts_text, with_parsed_date
from gazette.functions.identity import dedupe_keys, with_identity
from gazette.functions.links import site_label
from gazette.functions.text import normalize_title, normalize_whitespace
from gazette.operators import quality
from gazette.operators.dedupe import greedy_dedupe
from gazette.sources.derived import AS_OF, articles_from_pages, date_spellings, link_spellings
from gazette.session import cut_lineage
from gazette.sources.history_store import HistoryStore
from gazette.sources.tables import read_table, scan_pages

REGISTRY: dict = {}


def query(name):
    def wrap(fn):
        REGISTRY[name] = fn
        return fn
    return wrap


def v_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_from_pages(read_table(spark, sf_dir, "pages"))


@query("scan_pages")
def q_scan_pages(spark, sf_dir):
    p = scan_pages(spark, sf_dir)
    return p.select("page_id", "url", site_label("url").alias("site"),
                    F.char_length("html").cast("bigint").alias("html_chars"))


@query("valid_titles")
def q_valid_titles(spark, sf_dir):
    a = v_articles(spark, sf_dir)
    return a.select("ord", "title", quality.is_valid_title("title").alias("title_ok"))


@query("parse_dates")
def q_parse_dates(spark, sf_dir):
    a = v_articles(spark, sf_dir)
    return a.select("ord", "date_str", ts_text(parse_date("date_str", AS_OF)).alias("published_at"))


@query("recent_articles")
def q_recent_articles(spark, sf_dir):
    r = quality.recent_articles(v_articles(spark, sf_dir), AS_OF)
    return r.select("ord", "site", "title", "link", ts_text("published_at").alias("published_at"))


@query("normalize_links")
def q_normalize_links(spark, sf_dir):
    a = with_identity(v_articles(spark, sf_dir))
    return a.select("ord", "link", "normalized_link", "id_host")


@query("link_spellings")
def q_link_spellings(spark, sf_dir):
    a = with_identity(link_spellings(v_articles(spark, sf_dir)).withColumn("title", F.lit("")))
    return a.select("ord", "spelling", "normalized_link", "id_host")


@query("date_spellings")
def q_date_spellings(spark, sf_dir):
    a = with_parsed_date(date_spellings(v_articles(spark, sf_dir)), "date_str", AS_OF)
    return a.select("ord", "spelling", ts_text("published_at").alias("published_at"))


@query("title_keys")
def q_title_keys(spark, sf_dir):
    a = v_articles(spark, sf_dir)
    return a.select("ord", normalize_whitespace("title").alias("title_ws"),
                    normalize_title("title").alias("title_key"))


@query("article_keys")
def q_article_keys(spark, sf_dir):
    a = with_identity(v_articles(spark, sf_dir))
    keys = F.concat(
        F.array(F.struct(F.lit("link").alias("kind"), F.col("normalized_link").alias("key"))),
        F.transform("source_title_keys",
                    lambda k: F.struct(F.lit("source_title").alias("kind"), k.alias("key"))))
    return (a.select("ord", F.explode(keys).alias("k"))
            .select("ord", "k.kind", "k.key").filter(F.col("key") != ""))


@query("top_per_site")
def q_top_per_site(spark, sf_dir):
    r = quality.top_per_site(quality.recent_articles(v_articles(spark, sf_dir), AS_OF))
    return r.select("site", F.col("site_rank").cast("bigint").alias("site_rank"), "ord", "title",
                    ts_text("published_at").alias("published_at"))


def collected(spark, sf_dir) -> DataFrame:
    return quality.collect_articles(v_articles(spark, sf_dir), AS_OF)


@query("collect_articles")
def q_collect_articles(spark, sf_dir):
    c = collected(spark, sf_dir)
    return c.select(F.col("pos").cast("bigint").alias("pos"), "ord", "site", "title", "link",
                    "date_str")


def deduped(spark, sf_dir) -> DataFrame:
    c = with_identity(collected(spark, sf_dir))
    c = c.withColumn("keys", dedupe_keys("normalized_link", "source_title_keys"))
    return greedy_dedupe(c, "pos", "keys")


@query("dedupe_articles")
def q_dedupe_articles(spark, sf_dir):
    d = deduped(spark, sf_dir).filter("kept")
    return d.select(F.col("pos").cast("bigint").alias("pos"), "ord", "site", "title",
                    "normalized_link")


@query("dedupe_removed")
def q_dedupe_removed(spark, sf_dir):
    d = deduped(spark, sf_dir).filter(~F.col("kept"))
    return d.select(F.col("pos").cast("bigint").alias("pos"), "ord", "site", "title",
                    "normalized_link")


@query("site_report")
def q_site_report(spark, sf_dir):
    f = quality.site_funnel(v_articles(spark, sf_dir), AS_OF)
    return f.select("site", *[F.col(c).cast("bigint").alias(c) for c in (
        "raw_count", "title_filtered", "date_filtered", "kept", "over_limit", "undated")], "reason")


@query("run_totals")
def q_run_totals(spark, sf_dir):
    d = deduped(spark, sf_dir)
    return d.agg(
        F.count("*").cast("bigint").alias("raw_collected"),
        F.count_if(~F.col("kept")).cast("bigint").alias("removed"),
        F.count_if(F.col("kept")).cast("bigint").alias("unique_titles"),
        F.count_if(F.col("kept") & F.col("date_str").isNull()).cast("bigint").alias("undated"),
        F.countDistinct("site").cast("bigint").alias("sites"))


# --- personas and history ---------------------------------------------------
from gazette.operators import history as hist  # noqa: E402
from gazette.operators import personas as pers  # noqa: E402
from gazette.operators.select import lexical_select  # noqa: E402
from gazette.sources.derived import (history_from_articles,  # noqa: E402
                                     personas_from_conversations,
                                     raw_personas_from_conversations)


def v_personas(spark, sf_dir) -> DataFrame:
    return personas_from_conversations(read_table(spark, sf_dir, "conversations"))


def v_history(spark, sf_dir) -> DataFrame:
    """The loaded history state, materialised once per run (a table in the
    checkpoint folder), as the reference loads it once per run."""
    return cut_lineage(hist.repair_entries(history_from_articles(v_articles(spark, sf_dir)), AS_OF))


def _join(c):
    return F.array_join(F.col(c), " | ")


@query("personas_valid")
def q_personas_valid(spark, sf_dir):
    p = v_personas(spark, sf_dir)
    ok = p.join(pers.persona_violations(p).select("persona_idx"), "persona_idx", "left_anti")
    return ok.select("persona_idx", "id", "nome", "descricao",
                     _join("prioridades").alias("prioridades"), _join("evitar").alias("evitar"))


@query("persona_violations")
def q_persona_violations(spark, sf_dir):
    raw = raw_personas_from_conversations(read_table(spark, sf_dir, "conversations"))
    return pers.persona_violations(raw)


@query("history_load")
def q_history_load(spark, sf_dir):
    h = v_history(spark, sf_dir)
    return h.select("persona_id", "entry_pos", "title", "chamada", "resumo", "link",
                    "normalized_link", "title_key", F.array_join("title_keys", "|").alias("title_keys"),
                    F.array_join("source_title_keys", "|").alias("source_title_keys"),
                    ts_text("sent_at").alias("sent_at"))


@query("history_context")
def q_history_context(spark, sf_dir):
    return hist.history_context(v_history(spark, sf_dir))


@query("persona_context")
def q_persona_context(spark, sf_dir):
    lines = hist.history_context(v_history(spark, sf_dir))
    return pers.persona_context(v_personas(spark, sf_dir), lines)


def unique_articles(spark, sf_dir) -> DataFrame:
    """Deduplicated run articles with their parsed dates (D1 kept rows)."""
    return deduped(spark, sf_dir).filter("kept").select(
        "pos", "ord", "site", "title", "link", "date_str", "published_at")


def lexical(spark, sf_dir, articles=None) -> DataFrame:
    a = articles if articles is not None else unique_articles(spark, sf_dir)
    return lexical_select(a, v_personas(spark, sf_dir))


@query("lexical_select")
def q_lexical_select(spark, sf_dir):
    return lexical(spark, sf_dir)


def suppressed(spark, sf_dir, articles=None) -> DataFrame:
    a = articles if articles is not None else unique_articles(spark, sf_dir)
    return hist.suppress_repeats(lexical(spark, sf_dir, a), a, v_history(spark, sf_dir))


@query("suppress_repeats")
def q_suppress_repeats(spark, sf_dir):
    s = suppressed(spark, sf_dir).filter(F.col("status") == "kept")
    return s.select("persona_id", F.col("slot").cast("bigint").alias("slot"), "rank", "ord")


@query("selection_counts")
def q_selection_counts(spark, sf_dir):
    return hist.selection_counts(suppressed(spark, sf_dir))


def sent_rows(spark, sf_dir, articles=None) -> DataFrame:
    a = articles if articles is not None else unique_articles(spark, sf_dir)
    s = suppressed(spark, sf_dir, a).filter(F.col("status") == "kept")
    return s.join(a.select("ord", "title", "link", "site"), "ord").select(
        "persona_id", F.col("slot").cast("bigint").alias("seq"), "title",
        F.lit(None).cast("string").alias("chamada"), F.lit(None).cast("string").alias("resumo"),
        "link", "site")


@query("record_sent")
def q_record_sent(spark, sf_dir):
    """U1 after a run: each persona's digest items are recorded with the
    summary's headline, text and (possibly model-returned) link, in a store
    that holds the history; the entries inside the lookback of its new version."""
    a = unique_articles(spark, sf_dir)
    kept = cut_lineage(kept_selection(spark, sf_dir, a))
    it = rd.digest_items(kept, a, summaries(spark, sf_dir, a, kept))
    sent = it.join(a.select("ord", "title", "site"), "ord").select(
        "persona_id", F.col("item_no").alias("seq"), "title", "chamada", "resumo", "link", "site")
    store = HistoryStore(spark, inc.scratch_dir(spark, "history-record"))
    store.save(v_history(spark, sf_dir))
    store.record(sent, sent_at=AS_OF, as_of=AS_OF)
    out = store.read().where(is_within_days("sent_at", AS_OF, LOOKBACK_DAYS))
    return out.select("persona_id", "entry_pos", "title", "chamada", "link", "normalized_link",
                      "title_key", ts_text("sent_at").alias("sent_at"))


# --- extraction and digest ----------------------------------------------------
from gazette.operators import extract as ex  # noqa: E402
from gazette.operators import render as rd  # noqa: E402
from gazette.sources.derived import listings_from_pages  # noqa: E402


@query("extract_cards")
def q_extract_cards(spark, sf_dir):
    return ex.extract_cards(listings_from_pages(read_table(spark, sf_dir, "pages")))


# The navigation links of the driver's pages are single path segments with
# short texts, so this binding relaxes the portal rule's two parameters
# (path parts >= 1, title >= 3 chars); the operator's defaults are 2 and 20.
ANCHOR_MIN_PARTS = 1
ANCHOR_MIN_TITLE = 3


@query("extract_anchors")
def q_extract_anchors(spark, sf_dir):
    return ex.extract_anchors(read_table(spark, sf_dir, "pages"), min_parts=ANCHOR_MIN_PARTS,
                              min_title_chars=ANCHOR_MIN_TITLE)


def kept_selection(spark, sf_dir, articles=None) -> DataFrame:
    a = articles if articles is not None else unique_articles(spark, sf_dir)
    return suppressed(spark, sf_dir, a).filter(F.col("status") == "kept")


def selected_texts(spark, sf_dir, kept) -> DataFrame:
    return ex.texts_for_selected(read_table(spark, sf_dir, "pages"), kept.select("ord"))


@query("article_text")
def q_article_text(spark, sf_dir):
    t = selected_texts(spark, sf_dir, kept_selection(spark, sf_dir))
    return t.select("ord", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def summaries(spark, sf_dir, articles, kept) -> DataFrame:
    texts = selected_texts(spark, sf_dir, kept)
    return rd.lead_summary(articles.join(texts, "ord").select("ord", "title", "link", "text"))


@query("lead_summary")
def q_lead_summary(spark, sf_dir):
    a = unique_articles(spark, sf_dir)
    return summaries(spark, sf_dir, a, kept_selection(spark, sf_dir, a))


def items(spark, sf_dir) -> DataFrame:
    a = unique_articles(spark, sf_dir)
    kept = cut_lineage(kept_selection(spark, sf_dir, a))
    return rd.digest_items(kept, a, summaries(spark, sf_dir, a, kept))


@query("digest_items")
def q_digest_items(spark, sf_dir):
    return items(spark, sf_dir)


@query("persona_articles")
def q_persona_articles(spark, sf_dir):
    it = items(spark, sf_dir)
    names = v_personas(spark, sf_dir).select(F.col("id").alias("persona_id"), "nome")
    per = it.groupBy("persona_id").agg(
        F.count("*").cast("bigint").alias("n_articles"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_no", "ord"))),
                                 lambda s: s["ord"].cast("string")), ",").alias("ords"))
    return per.join(names, "persona_id").select("persona_id", "nome", "n_articles", "ords")


@query("render_digest")
def q_render_digest(spark, sf_dir):
    return rd.render_digest(items(spark, sf_dir), v_personas(spark, sf_dir), AS_OF)


@query("digest_spans")
def q_digest_spans(spark, sf_dir):
    return rd.digest_spans(items(spark, sf_dir), AS_OF)


# --- stored digests -----------------------------------------------------------
from gazette.operators import docs as dc  # noqa: E402
from gazette.sources.derived import clip_docs, nested_doc_bodies  # noqa: E402


def v_docs(spark, sf_dir) -> DataFrame:
    return clip_docs(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "events"))


@query("candidate_docs")
def q_candidate_docs(spark, sf_dir):
    c = dc.candidate_docs(v_docs(spark, sf_dir), v_personas(spark, sf_dir))
    return c.select("persona_id", F.col("cand_rank").cast("bigint").alias("cand_rank"),
                    F.col("id").alias("doc_id"), "name", ts_text("modified_time").alias("modified_time"))


@query("docs_for_persona")
def q_docs_for_persona(spark, sf_dir):
    c = dc.candidate_docs(v_docs(spark, sf_dir), v_personas(spark, sf_dir))
    d = dc.docs_for_persona(c, AS_OF)
    return d.select("persona_id", F.col("doc_rank").cast("bigint").alias("doc_rank"),
                    F.col("id").alias("doc_id"), "name", ts_text("modified_time").alias("modified_time"))


@query("latest_doc")
def q_latest_doc(spark, sf_dir):
    d = dc.latest_doc(v_docs(spark, sf_dir), v_personas(spark, sf_dir))
    return d.select("persona_id", F.col("id").alias("doc_id"), "name",
                    ts_text("modified_time").alias("modified_time"))


@query("doc_text")
def q_doc_text(spark, sf_dir):
    return dc.doc_text(nested_doc_bodies(v_docs(spark, sf_dir))).select(
        F.col("id").alias("doc_id"), "text")


@query("parse_doc_items")
def q_parse_doc_items(spark, sf_dir):
    t = dc.doc_text(nested_doc_bodies(v_docs(spark, sf_dir)))
    return dc.parse_doc_items(t).select(F.col("id").alias("doc_id"), "item_no", "title", "resumo", "link")


@query("hydrate_history")
def q_hydrate_history(spark, sf_dir):
    docs = v_docs(spark, sf_dir)
    h = dc.hydrate_history(v_history(spark, sf_dir), v_personas(spark, sf_dir), docs,
                           nested_doc_bodies(docs), AS_OF)
    return h.select("persona_id", "entry_pos", "title", "resumo", "link", "normalized_link",
                    ts_text("sent_at").alias("sent_at"), "doc_title")


# --- requests, responses and reports -------------------------------------------
from gazette.operators import report as rp  # noqa: E402
from gazette.operators import requests as rq  # noqa: E402
from gazette.operators.select import preselection_limit  # noqa: E402
from gazette.sources.derived import (filter_completions, selection_completions,  # noqa: E402
                                     summary_completions)


@query("preselect_request")
def q_preselect_request(spark, sf_dir):
    a = unique_articles(spark, sf_dir)
    p = v_personas(spark, sf_dir)
    ctx = pers.persona_context(p, hist.history_context(v_history(spark, sf_dir)))
    return rq.preselect_request(a, ctx, p, preselection_limit())


def v_listings(spark, sf_dir) -> DataFrame:
    return listings_from_pages(read_table(spark, sf_dir, "pages"))


@query("collect_listings")
def q_collect_listings(spark, sf_dir):
    """The run's collect step over all candidates of the listing pages."""
    listings = v_listings(spark, sf_dir)
    c = quality.collect_articles(ex.articles_from_listings(listings), AS_OF, sites=ex.listing_order(listings))
    return c.select("ord", "page_id", "site", F.col("site_rank").cast("bigint").alias("site_rank"), "title", "link", "date_str")


def tool_rows(spark, sf_dir) -> DataFrame:
    listings = v_listings(spark, sf_dir)
    return rp.fetch_report(listings, cut_lineage(ex.articles_from_listings(listings)),
                           read_table(spark, sf_dir, "pages"), AS_OF)


@query("fetch_report")
def q_fetch_report(spark, sf_dir):
    r = tool_rows(spark, sf_dir)
    # nullable counts as DOUBLE so both engines hand back the same column type
    return r.select("ord", "site", "kind", "title", "link",
                    F.char_length("text").cast("double").alias("text_chars"),
                    F.col("articles_found").cast("double").alias("articles_found"), "reason", "error")


@query("filter_requests")
def q_filter_requests(spark, sf_dir):
    ctx = pers.persona_context(v_personas(spark, sf_dir))
    return rq.filter_requests(tool_rows(spark, sf_dir), ctx)


@query("filter_prompts")
def q_filter_prompts(spark, sf_dir):
    """A5: the filter prompts as a sender posts them, by their digests."""
    ctx = pers.persona_context(v_personas(spark, sf_dir))
    prompts = rq.assemble_prompts(rq.filter_requests(cut_lineage(tool_rows(spark, sf_dir)), ctx))
    return prompts.select("request_id", "page_no", F.char_length("prompt").cast("bigint").alias("n_chars"),
                          F.md5("prompt").alias("prompt_md5"), "temperature", "max_tokens")


@query("summary_requests")
def q_summary_requests(spark, sf_dir):
    a = unique_articles(spark, sf_dir)
    kept = cut_lineage(kept_selection(spark, sf_dir, a))
    texts = selected_texts(spark, sf_dir, kept)
    return rq.summary_requests(a.join(texts, "ord").select("ord", "title", "link", "text"))


@query("parse_selection")
def q_parse_selection(spark, sf_dir):
    a = unique_articles(spark, sf_dir)
    p = v_personas(spark, sf_dir)
    comp = selection_completions(lexical(spark, sf_dir, a), p)
    req = comp.select("request_id", F.col("request_id").alias("persona_id"))
    return rq.parse_selection(comp, req, a, preselection_limit())


@query("parse_filter")
def q_parse_filter(spark, sf_dir):
    rows = cut_lineage(tool_rows(spark, sf_dir))
    listed = rq.usable_rows(rows).select("ord", "title", F.lit(None).cast("timestamp_ntz").alias("published_at"))
    comp = filter_completions(lexical(spark, sf_dir, listed), v_personas(spark, sf_dir))
    return rq.parse_filter(comp, rows)


@query("parse_summaries")
def q_parse_summaries(spark, sf_dir):
    a = unique_articles(spark, sf_dir)
    kept = cut_lineage(kept_selection(spark, sf_dir, a))
    s = summaries(spark, sf_dir, a, kept)
    return rq.parse_summaries(summary_completions(s, a), a)


@query("warning_digest")
def q_warning_digest(spark, sf_dir):
    a = unique_articles(spark, sf_dir)
    kept = cut_lineage(kept_selection(spark, sf_dir, a))
    texts = selected_texts(spark, sf_dir, kept)
    return rp.warning_digest(rp.run_warnings(read_table(spark, sf_dir, "pages"), texts, a))


@query("run_counters")
def q_run_counters(spark, sf_dir):
    """A whole run up to the digest sink; its stages count themselves."""
    run = rp.RunCounters()
    a = cut_lineage(run.of("titles_collected", unique_articles(spark, sf_dir)))
    kept = cut_lineage(kept_selection(spark, sf_dir, a))
    chosen = cut_lineage(run.of("selected_unique", a.join(kept.select("ord"), "ord", "left_semi")))
    sums = cut_lineage(run.of("summaries", summaries(spark, sf_dir, a, chosen)))
    digests = rd.render_digest(rd.digest_items(kept, a, sums), v_personas(spark, sf_dir), AS_OF)
    fl.write_digests(digests, inc.scratch_dir(spark, "counted-run"), AS_OF[:10], lambda rows: run.of("docs_created", rows))
    counts = run.values()
    return spark.range(1).select(*[F.lit(counts[c]).cast("bigint").alias(c) for c in (
        "titles_collected", "selected_unique", "docs_created", "summaries")])


# --- sinks, streaming and import totals -------------------------------------------
from gazette.streaming import incremental as inc, state  # noqa: E402


@query("history_roundtrip")
def q_history_roundtrip(spark, sf_dir):
    path = hist.save_history(v_history(spark, sf_dir), inc.scratch_dir(spark, "history-save"))
    h = hist.load_saved_history(spark, path)
    return h.select("persona_id", "entry_pos", "title", "chamada", "resumo", "link",
                    "normalized_link", "title_key", F.array_join("title_keys", "|").alias("title_keys"),
                    F.array_join("source_title_keys", "|").alias("source_title_keys"),
                    ts_text("sent_at").alias("sent_at"))


@query("stream_suppress")
def q_stream_suppress(spark, sf_dir):
    final = inc.run_incremental(spark, f"{sf_dir}/pages.parquet", inc.scratch_dir(spark, "stream"),
                                v_personas(spark, sf_dir), AS_OF, initial_history=v_history(spark, sf_dir),
                                listing=listings_from_pages)
    return final.select("persona_id", "entry_pos", "title", "normalized_link",
                        ts_text("sent_at").alias("sent_at"))


STATE_RUNS, STATE_RUN_DAYS = 4, 5


def run_selections(spark, sf_dir) -> DataFrame:
    """The selections of STATE_RUNS runs, STATE_RUN_DAYS apart: run r has the
    candidates with ``ord % STATE_RUNS = r``, ranked and cut for each persona."""
    a = with_identity(collected(spark, sf_dir).select("ord", "title", "link", "published_at"))
    every = lexical_select(a, v_personas(spark, sf_dir), preselection_limit(), run=F.col("ord") % STATE_RUNS)
    w = Window.partitionBy("persona_id", "run").orderBy("rank")  # a persona's rows that come twice have places of their own
    every = every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= preselection_limit())
    at = F.lit(AS_OF).cast("timestamp_ntz") + F.make_dt_interval((F.col("run") * STATE_RUN_DAYS).cast("int"))
    return every.join(a, "ord").select("persona_id", at.alias("run_at"), F.col("rank").cast("bigint").alias("rank"), "ord",
                                       state.row_keys("normalized_link", "source_title_keys").alias("keys"), "run")


@query("stream_state")
def q_stream_state(spark, sf_dir):
    """The runs as a stream, one micro-batch a run, against the state store."""
    work = inc.scratch_dir(spark, "stream-state")
    runs = cut_lineage(run_selections(spark, sf_dir))
    history = cut_lineage(v_history(spark, sf_dir))
    for r in range(STATE_RUNS):
        state.write_selection(runs.where(F.col("run") == r), f"{work}/selections")
        found = state.run_stateful(spark, f"{work}/selections", work, history, files_per_batch=None)
    return found.select("persona_id", ts_text("run_at").alias("run_at"), "rank", "ord", "status", F.col("slot").cast("bigint").alias("slot"))


@query("import_totals")
def q_import_totals(spark, sf_dir):
    docs = v_docs(spark, sf_dir)
    h = v_history(spark, sf_dir)
    fresh = v_personas(spark, sf_dir).join(h.select(F.col("persona_id").alias("id")).distinct(),
                                           "id", "left_anti")
    mine = dc.docs_for_persona(dc.candidate_docs(docs, fresh), AS_OF)
    its = dc.parse_doc_items(dc.doc_text(nested_doc_bodies(docs).join(
        mine.select("id").distinct(), "id", "left_semi")))
    per_doc = its.groupBy("id").agg(F.count("*").alias("n"))
    used = mine.join(per_doc, "id")
    return used.agg(F.countDistinct("persona_id").cast("bigint").alias("personas"),
                    F.count("*").cast("bigint").alias("documents"),
                    F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("articles"))


@query("dedupe_documents")
def q_dedupe_documents(spark, sf_dir):
    from gazette.sources.derived import articles_from_documents
    d = with_identity(articles_from_documents(read_table(spark, sf_dir, "documents")))
    d = d.withColumn("keys", dedupe_keys("normalized_link", "source_title_keys"))
    out = greedy_dedupe(d, "ord", "keys")
    return out.select("ord", "site", "title", "normalized_link", "kept")


# --- files ------------------------------------------------------------------------
from gazette.functions.links import doc_id_from_link  # noqa: E402
from gazette.sources import files as fl  # noqa: E402


@query("personas_file")
def q_personas_file(spark, sf_dir):
    """S5 + P9: the persona list written as JSON and read back; requested are
    the personas with a history."""
    path = inc.scratch_dir(spark, "personas-json")
    fl.write_personas_json(v_personas(spark, sf_dir), path)
    p = fl.read_personas_json(spark, path)
    ids = history_from_articles(v_articles(spark, sf_dir)).select(F.col("persona_id").alias("id")).distinct()
    asked = fl.select_personas(p, ids).select("id", F.lit(True).alias("asked"))
    return p.join(asked, "id", "left").select(
        "id", "nome", "descricao", _join("prioridades").alias("prioridades"), _join("evitar").alias("evitar"),
        F.coalesce("asked", F.lit(False)).alias("requested"))


@query("history_file")
def q_history_file(spark, sf_dir):
    """The raw history written in its stored layout, read and repaired."""
    path = inc.scratch_dir(spark, "history-json")
    fl.write_history_json(history_from_articles(v_articles(spark, sf_dir)), path)
    h = hist.repair_entries(hist.read_history_json(spark, path), AS_OF)
    return h.select("persona_id", "entry_pos", "title", "chamada", "resumo", "link", "normalized_link", "title_key",
                    ts_text("sent_at").alias("sent_at"))


@query("digest_sink")
def q_digest_sink(spark, sf_dir):
    """K4: the rendered digests written and read back."""
    path = inc.scratch_dir(spark, "digests")
    fl.write_digests(rd.render_digest(items(spark, sf_dir), v_personas(spark, sf_dir), AS_OF), path, AS_OF[:10])
    back = spark.read.schema("persona_id string, doc_title string, n_items long, body string, run_date string").json(path)
    return back.select("persona_id", "doc_title", "n_items", "body", "run_date")


@query("doc_ids")
def q_doc_ids(spark, sf_dir):
    """document ids out of the catalogue's links."""
    return v_docs(spark, sf_dir).select("id", doc_id_from_link("web_view_link").alias("doc_id"))
