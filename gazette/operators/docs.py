"""Stored digests: catalogue candidates (S9), title match (P5), lookback
(P4), per-persona documents (J5, W4), body flatten (S7), item parse (S8)
and history import (U2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions import constants as K
from gazette.functions.dates import as_ts, is_within_days
from gazette.functions.links import doc_link
from gazette.functions.text import col_, js_trim, normalize_search_text


def search_token(name) -> Column:
    """Last whitespace token of >= 3 letters/digits/hyphens, else the name."""
    toks = F.filter(F.transform(F.split(col_(name), r"\s+"),
                                lambda t: F.regexp_replace(t, r"[^\p{L}\p{N}-]", "")),
                    lambda t: F.char_length(t) >= 3)
    return F.when(F.size(toks) > 0, F.element_at(toks, -1)).otherwise(col_(name))


def _grams(text: Column, size: Column) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    n = F.char_length(text) - size
    return F.array_distinct(F.transform(F.when(n >= 0, F.sequence(F.lit(1), n + 1)).otherwise(
        F.array().cast("array<int>")), lambda i: F.substring(text, i, size)))


def _containing(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """(part, text) for every distinct ``part`` found inside a distinct
    ``text``: they meet in an equi-join on the part's first (up to three)
    characters, and the rest is compared there."""
    parts = parts.select("part", F.least(F.char_length("part"), F.lit(3)).alias("size")).distinct()
    parts = parts.withColumn("gram", F.substring(F.col("part"), F.lit(1), F.col("size")))
    grams = (texts.select("text").distinct().withColumn("size", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
             .withColumn("gram", F.explode(_grams(F.col("text"), F.col("size")))))
    return parts.join(grams, ["size", "gram"]).filter(F.col("text").contains(F.col("part"))).select("part", "text")


def _newest(listed: DataFrame, page: int) -> DataFrame:
    """Of each ``text`` (a word or a name) the ``page`` newest documents: a
    posting list in order of time, cut where no token can need more, since a
    token's newest documents are among the newest ones of its words."""
    w = Window.partitionBy("text").orderBy(F.col("modified_time").desc_nulls_last(), F.col("id"))
    return listed.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= page).drop("_place")


def candidate_docs(docs: DataFrame, personas: DataFrame, page: int = K.CATALOGUE_PAGE,
                   kind: str | None = None, folder: str | None = None) -> DataFrame:
    """Per persona, documents whose name contains the persona's search
    token (case-insensitive), newest first, at most ``page``.

    ``kind`` keeps documents of one mime_type, ``folder`` those with that
    parent; a ``trashed`` column, where there is one, drops trashed ones.

    A persona's candidates depend only on its token. A token without white
    space lies inside one word of a name, so distinct tokens meet distinct
    words, then the documents by word; a phrase meets whole names. The
    documents of a word are cut to its ``page`` newest before the tokens meet
    them (a partial windowed group limit), and the merged lists of a token again, so
    what is shuffled for the search is at most ``page`` rows for each pair of a
    token and a word that holds it."""
    if kind is not None:
        docs = docs.filter(F.col("mime_type") == kind)
    if folder is not None:
        docs = docs.filter(F.array_contains("parents", folder))
    if "trashed" in docs.columns:
        docs = docs.filter(~F.coalesce(F.col("trashed"), F.lit(False)))
    named = docs.select("id", "name", "modified_time", "web_view_link", F.lower("name").alias("text"))
    tokens = personas.select(F.col("id").alias("persona_id"), "nome",
                             F.lower(search_token(F.col("nome"))).alias("part")).filter(F.col("part") != "")
    spaced = F.col("part").rlike(r"\s")
    words = named.select("id", "name", "modified_time", "web_view_link",
                         F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("text"))
    by_word = _containing(tokens.filter(~spaced), words).join(_newest(words, page), "text")
    by_name = _containing(tokens.filter(spaced), named).join(_newest(named, page), "text")
    met = by_word.unionByName(by_name).drop("text").dropDuplicates(["part", "id"])
    by_part = Window.partitionBy("part").orderBy(F.col("modified_time").desc_nulls_last(), F.col("id"))
    newest = met.withColumn("cand_rank", F.row_number().over(by_part)).filter(F.col("cand_rank") <= page)
    return tokens.join(newest, "part").drop("part")


def is_doc_for_persona(file_name, persona_name) -> Column:
    """P5: 'dd-dd-dddd | <name>' with the same normalised name, or the legacy
    prefix 'Clipping <name> -'; empty names never match."""
    f, p = normalize_search_text(file_name), normalize_search_text(persona_name)
    pat = K.DOC_TITLE_CURRENT
    current = f.rlike(pat) & (F.regexp_extract(f, pat, 2) == p)
    legacy = f.startswith(normalize_search_text(F.concat(F.lit("Clipping "), col_(persona_name),
                                                         F.lit(" -"))))
    return (f != "") & (p != "") & (current | legacy)


def docs_for_persona(candidates: DataFrame, as_of, lookback_days: int | None = K.LOOKBACK_DAYS
                     ) -> DataFrame:
    """J5 + P4: matching candidates inside the lookback (no limit when
    ``lookback_days`` is None or <= 0; unknown times kept), newest first."""
    m = candidates.filter(is_doc_for_persona(F.col("name"), F.col("nome")))
    if lookback_days is not None and lookback_days > 0:
        m = m.filter(is_within_days("modified_time", as_of, lookback_days))
    w = Window.partitionBy("persona_id").orderBy(F.col("modified_time").desc_nulls_last(),
                                                 F.col("cand_rank"))
    return m.withColumn("doc_rank", F.row_number().over(w))


def latest_doc(docs: DataFrame, personas: DataFrame) -> DataFrame:
    """Newest matching document among the newest 20 candidates."""
    c = candidate_docs(docs, personas, page=K.LATEST_DOC_PAGE)
    m = c.filter(is_doc_for_persona(F.col("name"), F.col("nome")))
    return m.groupBy("persona_id").agg(F.min_by(F.struct("id", "name", "modified_time"),
                                                F.col("cand_rank")).alias("d")).select(
        "persona_id", "d.id", "d.name", "d.modified_time")


def doc_text(bodies: DataFrame) -> DataFrame:
    """(id, text) - text runs concatenated in order, null-safe at every level."""
    runs = F.flatten(F.transform(F.coalesce("content", F.array()), lambda b: F.transform(
        F.coalesce(b["paragraph"]["elements"], F.array()), lambda e: e["textRun"]["content"])))
    return bodies.select("id", F.array_join(runs, "").alias("text"))


def parse_doc_items(texts: DataFrame) -> DataFrame:
    """(id, item_no, title, resumo, link) from digest text.

    Lines are exploded with their position; a running count of title lines
    numbers the items (gaps and islands); an item closes at its first link
    line and only closed items are emitted; header lines are skipped."""
    lines = (texts.select("id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n"))
                          .alias("pos", "raw"))
             .select("id", "pos", js_trim(F.col("raw")).alias("line"))
             .filter(F.col("line") != ""))
    header = F.col("line").rlike(K.DIGEST_HEADER_LINE)
    title = ~header & F.col("line").rlike(K.DIGEST_ITEM_LINE)
    link = ~header & ~title & F.col("line").rlike(K.DIGEST_LINK_LINE)
    lines = lines.select("id", "pos", "line", header.alias("is_header"), title.alias("is_title"),
                         link.alias("is_link"))
    w = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("item", F.sum(F.col("is_title").cast("int")).over(w))
    marks = lines.filter(F.col("item") > 0).groupBy("id", "item").agg(
        F.min(F.when(F.col("is_title"), F.col("pos"))).alias("t_pos"),
        F.min(F.when(F.col("is_link"), F.col("pos"))).alias("l_pos"))
    closed = marks.filter(F.col("l_pos").isNotNull())
    # Only lines between an item's title and its first link are gathered, so
    # text trailing a closed item never enters a group.
    inside = (lines.join(closed, ["id", "item"])
              .filter((F.col("pos") >= F.col("t_pos")) & (F.col("pos") <= F.col("l_pos"))))
    per = inside.groupBy("id", "item").agg(
        F.min_by("line", F.when(F.col("is_title"), F.col("pos"))).alias("t_line"),
        F.min_by("line", F.when(F.col("pos") == F.col("l_pos"), F.col("pos"))).alias("l_line"),
        F.sort_array(F.collect_list(F.when(
            ~F.col("is_title") & ~F.col("is_header") & (F.col("pos") < F.col("l_pos")),
            F.struct("pos", "line")))).alias("body"))
    return per.select(
        "id", F.row_number().over(Window.partitionBy("id").orderBy("item")).cast("bigint").alias("item_no"),
        F.trim(F.regexp_extract("t_line", K.DIGEST_ITEM_LINE, 1)).alias("title"),
        F.trim(F.array_join(F.transform("body", lambda s: s["line"]), " ")).alias("resumo"),
        F.regexp_extract("l_line", K.DIGEST_LINK_LINE, 1).alias("link"))


def hydrate_history(history: DataFrame, personas: DataFrame, docs: DataFrame, bodies: DataFrame,
                    as_of, lookback_days: int = K.LOOKBACK_DAYS) -> DataFrame:
    """Personas without history (J6) get entries from their recent stored
    digests (J5 -> S7 -> S8 -> U1), newest document first, each document's
    items stamped with its modification time. Returns the new history."""
    from gazette.operators.history import record_sent
    fresh = personas.join(history.select(F.col("persona_id").alias("id")).distinct(), "id",
                          "left_anti")
    mine = docs_for_persona(candidate_docs(docs, fresh), as_of, lookback_days)
    texts = doc_text(bodies.join(mine.select("id").distinct(), "id", "left_semi"))
    its = parse_doc_items(texts)
    sent = mine.join(its, "id").select(
        "persona_id",
        F.row_number().over(Window.partitionBy("persona_id").orderBy("doc_rank", "item_no"))
        .cast("bigint").alias("seq"),
        "title", F.col("title").alias("chamada"), "resumo", "link",
        F.lit(None).cast("string").alias("site"),
        F.coalesce("modified_time", as_ts(as_of)).alias("sent_at"),
        F.col("name").alias("doc_title"), F.coalesce("web_view_link", doc_link("id")).alias("doc_link"))
    return record_sent(history, sent, sent_at=None, as_of=as_of, lookback_days=lookback_days)
