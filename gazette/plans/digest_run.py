"""The composed batch run: one call from raw pages to digests and history.

run_digest(listings, personas, history, ...): check the personas, collect
(extract the candidates of every listing page with their own dates, filter,
per-site cut), dedupe, preselect (lexical stand-in), suppress repeats, article
text, summaries (stand-in), render, upsert history. It writes the digest
documents and the new history version under ``out_dir`` and returns their
paths; every stage is a DataFrame job and the intermediate tables are
checkpoints in the shared checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions import constants as K
from gazette.functions.identity import dedupe_keys, with_identity
from gazette.operators import history as hist
from gazette.operators import quality
from gazette.operators import render as rd
from gazette.operators.dedupe import greedy_dedupe
from gazette.operators.extract import articles_from_listings, listing_order, texts_for_links
from gazette.operators.personas import validate_personas
from gazette.operators.report import RunCounters
from gazette.operators.select import lexical_select
from gazette.session import cut_lineage
from gazette.sources.files import write_digests


@dataclass
class RunOutput:
    digests_path: str
    history_path: str
    digests: DataFrame
    history: DataFrame
    counters: dict[str, int]


def unique_articles(listings: DataFrame, as_of, max_per_site: int = K.MAX_PER_SITE,
                    days_back: int = K.DAYS_BACK) -> DataFrame:
    """S2/S3 -> P1/F9/P2 -> W1/W7 -> D1: the run's articles, each once."""
    arts = quality.collect_articles(articles_from_listings(listings), as_of, max_per_site, days_back, listing_order(listings))
    arts = with_identity(arts).withColumn("keys", dedupe_keys("normalized_link", "source_title_keys"))
    return cut_lineage(greedy_dedupe(arts, "pos", "keys").filter("kept").select(
        "pos", "ord", "site", "title", "link", "date_str", "published_at"))


def kept_selection(unique: DataFrame, personas: DataFrame, history: DataFrame,
                   max_per_persona: int = K.MAX_PER_PERSONA) -> DataFrame:
    """M7 -> J1/D2/W3: the slots of each persona's digest."""
    selection = lexical_select(unique, personas, max(max_per_persona, max_per_persona * K.PRESELECT_MULTIPLIER),
                               n_articles=unique.count())  # a checkpoint already
    return cut_lineage(hist.suppress_repeats(selection, unique, history, max_per_persona)
                       .filter(F.col("status") == "kept"))


def run_digest(listings: DataFrame, personas: DataFrame, history: DataFrame, as_of: str,
               out_dir: str, article_pages: DataFrame | None = None, days_back: int = K.DAYS_BACK,
               max_per_site: int = K.MAX_PER_SITE, max_per_persona: int = K.MAX_PER_PERSONA) -> RunOutput:
    """listings, article_pages: (page_id, url, html), the pages that list
    articles and those the links lead to (default: the same table); personas:
    (persona_idx, id, nome, descricao, prioridades, evitar); history: the
    repaired history (``repair_entries``)."""
    personas = validate_personas(personas)
    unique = unique_articles(listings, as_of, max_per_site, days_back)
    kept = kept_selection(unique, personas, history, max_per_persona)
    run = RunCounters()
    chosen = cut_lineage(run.of("selected_unique", unique.join(kept.select("ord"), "ord", "left_semi")))
    texts = texts_for_links(listings if article_pages is None else article_pages, chosen.select("link"))
    texts = chosen.join(texts, "link", "left").select(
        "ord", "title", "link", F.coalesce("text", F.lit(K.ARTICLE_TEXT_FAILED)).alias("text"))
    summaries = cut_lineage(run.of("summaries", rd.lead_summary(texts)))
    items = cut_lineage(rd.digest_items(kept, unique, summaries))
    digests = rd.render_digest(items, personas, as_of)
    digests_path = f"{out_dir.rstrip('/')}/digests"
    write_digests(digests, digests_path, as_of[:10], lambda rows: run.of("docs_created", rows))
    sent = items.join(unique.select("ord", "title", "site"), "ord").select(
        "persona_id", F.col("item_no").alias("seq"), "title", "chamada", "resumo", "link", "site")
    new_history = hist.record_sent(history, sent, sent_at=as_of, as_of=as_of)
    history_path = hist.save_history(new_history, out_dir)
    counters = {"titles_collected": unique.count()} | run.values()  # the first is a checkpoint already
    return RunOutput(digests_path, history_path, digests,
                     hist.load_saved_history(listings.sparkSession, history_path), counters)
