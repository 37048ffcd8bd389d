"""Summaries and digest documents: M8 lead summary (stand-in), J3 reuse of
one summary per article, K2/K4 render, K3 style spans (W5 cursor)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions import constants as K
from gazette.functions.dates import as_ts, digest_date, digest_title
from gazette.functions.text import squash, utf16_length

SENTENCE = r"[^.!?]+[.!?]*"


def lead_summary(articles: DataFrame, max_words: int = 15, max_sentences: int = 3) -> DataFrame:
    """M8 (declared stand-in for the model's summary): headline = first
    ``max_words`` words of the title, summary = first ``max_sentences``
    sentences of the text, link kept.
    Input (ord, title, link, text) - one row per distinct article (J3)."""
    words = F.split(squash(F.coalesce("title", F.lit(""))), " ")
    sentences = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(SENTENCE), 0),
                            lambda s: F.trim(s))
    return articles.select(
        "ord",
        F.array_join(F.slice(words, 1, max_words), " ").alias("chamada"),
        F.array_join(F.slice(F.filter(sentences, lambda s: s != ""), 1, max_sentences), " ").alias("resumo"),
        F.col("link").alias("link"))


def digest_items(kept: DataFrame, articles: DataFrame, summaries: DataFrame) -> DataFrame:
    """J3 + A7: (persona_id, item_no, chamada, resumo, link, ord). Each article
    is summarised once and joined back to every persona that picked it; the
    summary's link overrides the article's, its headline defaults to the title."""
    a = articles.select("ord", "title", F.col("link").alias("article_link"))
    s = summaries.select("ord", F.col("chamada").alias("s_chamada"),
                         F.col("resumo").alias("s_resumo"), F.col("link").alias("s_link"))
    return (kept.select("persona_id", F.col("slot").alias("item_no"), "ord")
            .join(a, "ord").join(s, "ord", "left")
            .select("persona_id", F.col("item_no").cast("bigint").alias("item_no"), "ord",
                    F.coalesce("s_chamada", "title").alias("chamada"),
                    F.coalesce("s_resumo", F.lit("")).alias("resumo"),
                    F.coalesce("s_link", "article_link").alias("link")))


def _parts(items: DataFrame) -> DataFrame:
    return items.select(
        "*",
        F.concat(F.col("item_no").cast("string"), F.lit(". "), F.col("chamada"), F.lit("\n"))
        .alias("chamada_text"),
        F.concat(F.col("resumo"), F.lit("\n")).alias("resumo_text"),
        F.concat(F.lit("Link: "), F.col("link"), F.lit("\n\n")).alias("link_text"))


def render_digest(items: DataFrame, personas: DataFrame, run_ts) -> DataFrame:
    """K2 + K4: one document per persona with at least one item:
    (persona_id, doc_title, n_items, body). Items are concatenated in
    item order (at most the per-persona cap, so each group is small)."""
    ts = as_ts(run_ts)
    p = _parts(items)
    docs = p.groupBy("persona_id").agg(
        F.count("*").cast("bigint").alias("n_items"),
        F.sort_array(F.collect_list(F.struct(
            "item_no", F.concat("chamada_text", "resumo_text", "link_text").alias("t")))).alias("_l"))
    header = F.concat(F.lit(K.DIGEST_HEADER_PREFIX), digest_date(ts), F.lit("\n\n"))
    names = personas.select(F.col("id").alias("persona_id"), "nome")
    return docs.join(names, "persona_id").select(
        "persona_id", digest_title(F.col("nome"), ts).alias("doc_title"), "n_items",
        F.concat(header, F.array_join(F.transform("_l", lambda s: s["t"]), "")).alias("body"))


def digest_spans(items: DataFrame, run_ts) -> DataFrame:
    """K3: (persona_id, span_no, start, end, style). Heading-1 over the header,
    heading-2 over each item's first line, link style over the URL; the
    cursor is a running length from 1 (W5). Offsets count UTF-16
    units, as the document service does."""
    ts = as_ts(run_ts)
    header_len = utf16_length(F.concat(F.lit(K.DIGEST_HEADER_PREFIX), digest_date(ts), F.lit("\n\n")))
    p = _parts(items).withColumn(
        "item_len", utf16_length("chamada_text") + utf16_length("resumo_text") + utf16_length("link_text"))
    w = Window.partitionBy("persona_id").orderBy("item_no").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("cursor", F.lit(1) + header_len + F.coalesce(F.sum("item_len").over(w), F.lit(0)))
    heading2 = p.select("persona_id", (F.col("item_no") * 2).alias("span_no"),
                        F.col("cursor").alias("start"),
                        (F.col("cursor") + utf16_length("chamada_text") - 1).alias("end"),
                        F.lit("HEADING_2").alias("style"))
    link_start = F.col("cursor") + utf16_length("chamada_text") + utf16_length("resumo_text")
    link = p.select("persona_id", (F.col("item_no") * 2 + 1).alias("span_no"),
                    (link_start + 6).alias("start"),
                    (link_start + utf16_length("link_text") - 2).alias("end"),
                    F.lit(K.LINK_STYLE).alias("style"))
    head = items.select("persona_id").distinct().select(
        "persona_id", F.lit(1).cast("bigint").alias("span_no"), F.lit(1).alias("start"),
        (F.lit(1) + header_len - 1).alias("end"), F.lit("HEADING_1").alias("style"))
    out = head.unionByName(heading2).unionByName(link)
    return out.select("persona_id", F.col("span_no").cast("bigint").alias("span_no"),
                      F.col("start").cast("bigint").alias("start"),
                      F.col("end").cast("bigint").alias("end"), "style")
