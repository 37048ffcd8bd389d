"""Inputs derived from the driver's tables.

The driver ships raw pages, documents, conversations and events, but no
article list, persona, history or document catalogue. These functions derive
them deterministically from those tables (the same rules are written in
DuckDB SQL in ``gazette.plans.oracle``), so every query's work grows with
the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions.text import decode_basic_entities, js_trim

AS_OF = "2024-02-01 00:00:00"
H1 = r"(?s)<h1[^>]*>(.*?)</h1>"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^/?#:]*)"


def page_title(html) -> F.Column:
    """Text of the first <h1>: tags dropped, basic entities decoded, trimmed."""
    inner = F.regexp_replace(F.regexp_extract(html, H1, 1), "<[^>]+>", "")
    return js_trim(decode_basic_entities(inner))


def synthetic_date_text(page_id) -> F.Column:
    """One of seven date-text shapes chosen by ``page_id % 7``."""
    k = page_id % 7
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    iso = F.concat(F.lit("2024-01-"), two(page_id % 30 + 1), F.lit("T"), two(page_id % 24),
                   F.lit(":00:00Z"))
    dmy = F.concat(two(page_id % 19 + 13), F.lit("/01/2024"))
    hours = F.concat(F.lit("há "), (page_id % 60).cast("string"), F.lit(" horas"))
    days = F.concat(F.lit("há cerca de "), (page_id % 6).cast("string"), F.lit(" dias"))
    return (F.when(k == 1, iso).when(k == 2, dmy).when(k == 3, hours).when(k == 4, days)
            .when(k == 5, F.lit("Ontem")).when(k == 6, F.lit("sem hora"))
            .otherwise(F.lit(None).cast("string")))


def articles_from_pages(pages: DataFrame) -> DataFrame:
    """v_articles(ord, site, title, link, date_str): one candidate per page."""
    return pages.select(
        F.col("page_id").alias("ord"),
        F.lower(F.regexp_extract("url", HOST, 1)).alias("site"),
        page_title(F.col("html")).alias("title"),
        F.col("url").alias("link"),
        synthetic_date_text(F.col("page_id")).alias("date_str"))


def link_spellings(articles: DataFrame) -> DataFrame:
    """(ord, spelling, link): pages of each article's site, each spelled in
    several ways. 0-4, 5-6 and 7-9 are one address each."""
    host, n = F.col("site"), F.col("ord").cast("string")
    forms = [
        F.concat(F.lit("https://"), host, F.lit("/noticias/"), n),
        F.concat(F.lit(" HTTPS://"), F.upper(host), F.lit(":443/noticias/"), n, F.lit("/ ")),
        F.concat(F.lit("https:"), host, F.lit("/noticias/x/%2E%2e/"), n, F.lit("?utm_source=a&ref=b")),
        F.concat(F.lit("https:\\\\"), host, F.lit("\\noticias\\.\\"), n, F.lit("#a?b")),
        F.concat(F.lit("https://user:p@ss@"), host, F.lit("/../a/..//../noticias/"), n, F.lit("/?")),
        F.concat(F.lit("https://"), host, F.lit("/not\u00edcias/"), n, F.lit("?b=a+b&a=\u00e7")),
        F.concat(F.lit("https://"), host, F.lit("/not%C3%ADcias/"), n, F.lit("?a=%c3%a7&utm_medium=c&b=a%20b")),
        F.concat(F.lit("https://b\u00fccher."), host, F.lit("/"), n),
        F.concat(F.lit("https://xn--bcher-kva."), host, F.lit("/"), n),
        F.concat(F.lit("https://BU\u0308CHER."), host, F.lit("/"), n, F.lit("/.")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("spelling"), f.alias("link")) for i, f in enumerate(forms)])
    return articles.select("ord", F.explode(rows).alias("r")).select("ord", "r.*")


def date_spellings(articles: DataFrame) -> DataFrame:
    """(ord, spelling, date_str): a moment of each article's own, written in
    several ways."""
    at = F.lit("2024-01-05 09:34:56").cast("timestamp_ntz") + F.make_dt_interval(F.col("ord").cast("int") % 3000, F.col("ord").cast("int") % 13)
    text = lambda pattern: F.date_format(at, pattern)
    forms = [
        text("yyyy-MM-dd'T'HH:mm:ss'Z'"), text("yyyy-MM-dd'T'HH:mm:ss.SSS'-03:00'"), text("EEE, dd MMM yyyy HH:mm:ss '-0300'"),
        text("EEE MMM dd yyyy HH:mm:ss 'GMT-0300 (BRT)'"), text("d MMM yyyy h:mm a"), text("yyyy/MM/dd"), text("yyyy-MM"),
        text("MMMM d, yyyy"), text("dd/MM/yyyy '\u00e0s' HH:mm"), text("MM/dd/yyyy"), text("d-MMM-yy"),
        F.concat(F.lit("Publicado: "), text("d MMMM yyyy HH:mm 'EST'")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("spelling"), f.alias("date_str")) for i, f in enumerate(forms)])
    return articles.select("ord", F.explode(rows).alias("r")).select("ord", "r.*")


# --- personas ---------------------------------------------------------------
# One client profile per conversation: the first turn is the description and
# the conversation's most frequent long words are its topics.
TOPIC_MIN_CHARS = 4
N_TOPICS = 3


def conversation_topics(conversations: DataFrame) -> DataFrame:
    """(conv_id, topic_rank, token): the 4 most frequent words of >= 4 chars,
    ties by word. Counting is a partial aggregate; the top-4 is a windowed
    group limit, so a long conversation never sits whole in one task."""
    from pyspark.sql import Window
    from gazette.functions.text import title_words
    words = conversations.select("conv_id", F.explode(title_words(F.col("text"))).alias("token"))
    counts = (words.filter(F.char_length("token") >= TOPIC_MIN_CHARS)
              .groupBy("conv_id", "token").agg(F.count("*").alias("n")))
    w = Window.partitionBy("conv_id").orderBy(F.col("n").desc(), F.col("token"))
    return (counts.withColumn("topic_rank", F.row_number().over(w))
            .filter(F.col("topic_rank") <= N_TOPICS + 1).drop("n"))


def personas_from_conversations(conversations: DataFrame) -> DataFrame:
    """v_personas(persona_idx, id, nome, descricao, prioridades, evitar)."""
    from gazette.functions.text import squash
    first = (conversations.filter(F.col("turn") == 0)
             .select("conv_id", squash(F.col("text")).alias("descricao")))
    topics = conversation_topics(conversations)
    lists = topics.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("topic_rank") <= N_TOPICS,
                                           F.struct("topic_rank", "token")))).alias("_p"),
        F.sort_array(F.collect_list(F.when(F.col("topic_rank") > N_TOPICS,
                                           F.struct("topic_rank", "token")))).alias("_e"))
    ids = conversations.select("conv_id").distinct()
    return (ids.join(first, "conv_id", "left").join(lists, "conv_id", "left")
            .select(F.col("conv_id").alias("persona_idx"),
                    F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("id"),
                    F.concat(F.lit("Cliente "), (F.col("conv_id") + 100).cast("string")).alias("nome"),
                    "descricao",
                    F.coalesce(F.transform("_p", lambda s: s["token"]),
                               F.array().cast("array<string>")).alias("prioridades"),
                    F.coalesce(F.transform("_e", lambda s: s["token"]),
                               F.array().cast("array<string>")).alias("evitar")))


def raw_personas_from_conversations(conversations: DataFrame) -> DataFrame:
    """Unvalidated profiles: id = first word of the first turn (collides
    across conversations), descricao = the second turn (may be missing)."""
    from gazette.functions.text import normalize_title, squash
    p = personas_from_conversations(conversations)
    turn0 = conversations.filter(F.col("turn") == 0).select(
        F.col("conv_id").alias("persona_idx"),
        F.substring_index(normalize_title(F.col("text")), " ", 1).alias("id"))
    turn1 = conversations.filter(F.col("turn") == 1).select(
        F.col("conv_id").alias("persona_idx"), squash(F.col("text")).alias("descricao"))
    return (p.drop("id", "descricao").join(turn0, "persona_idx", "left")
            .join(turn1, "persona_idx", "left")
            .select("persona_idx", "id", "nome", "descricao", "prioridades", "evitar"))


# --- history ----------------------------------------------------------------
#: Consecutive articles that one persona was sent before: personas with a
#: history grow with the pages.
HISTORY_RUN = 10


def history_from_articles(articles: DataFrame) -> DataFrame:
    """Raw stored history entries, shaped like the JSON file's entries:
    some use the ``titulo``/``summaryTitle`` aliases, some carry a stored
    empty link key, some only a title, some an unknown send time."""
    o = F.col("ord")
    link = F.when(o % 2 == 0, F.concat(
        F.col("link"), F.when(F.col("link").contains("?"), F.lit("&")).otherwise(F.lit("?")),
        F.lit("utm_medium=email"))).otherwise(F.lit(""))
    sent = F.date_format(
        F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit("2024-01-31 00:00:00")))
                            - (o % 30) * 86400), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return (articles.select(
        F.concat(F.lit("p"), F.floor(o / HISTORY_RUN).cast("string")).alias("persona_id"),
        o.alias("entry_pos"),
        F.when(o % 4 != 0, F.col("title")).alias("title"),
        F.col("title").alias("titulo"),
        F.when(o % 2 == 0, F.concat(F.lit("Resumo de "), F.col("title"))).alias("chamada"),
        F.lit(None).cast("string").alias("summaryTitle"),
        F.when(o % 5 == 0, F.lit("   ")).otherwise(
            F.concat(F.lit("Resumo "), o.cast("string"))).alias("resumo"),
        link.alias("link"),
        F.when(o % 9 == 0, F.lit("")).alias("normalizedLink"),
        F.lit(None).cast("array<string>").alias("titleKeys"),
        F.lit(None).cast("string").alias("titleKey"),
        F.lit(None).cast("array<string>").alias("sourceTitleKeys"),
        F.lit(None).cast("string").alias("sourceTitleKey"),
        F.col("site").alias("source"),
        F.when(o % 11 != 0, sent).alias("sentAt"),
        F.lit(None).cast("string").alias("docTitle"),
        F.lit(None).cast("string").alias("docLink")))


# --- listing pages ------------------------------------------------------------
NAV = r"(?is)<nav\b[^>]*>(.*?)</nav>"
ISO_TEXT = r"^\d{4}-\d{2}-\d{2}T"


def _escape(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def listings_from_pages(pages: DataFrame) -> DataFrame:
    """v_listing(page_id, url, html): per page, a listing with the page's own
    article card (h2 title, link, time) followed by its navigation links as
    ``li.item`` cards."""
    art = articles_from_pages(pages).select(F.col("ord").alias("page_id"), "title", "date_str")
    nav = pages.select("page_id", "url", F.replace(F.regexp_extract("html", NAV, 1), F.lit("<li>"),
                                                  F.lit('<li class="item">')).alias("nav"),
                       F.coalesce(F.col("html").rlike(r"(?i)</html>\s*$"), F.lit(False)).alias("whole"))
    d = F.coalesce(F.col("date_str"), F.lit(""))
    time_tag = F.when(d.rlike(ISO_TEXT), F.concat(F.lit('<time datetime="'), d, F.lit('">'),
                                                 _escape(d), F.lit("</time>"))) \
        .otherwise(F.concat(F.lit("<time>"), _escape(d), F.lit("</time>")))
    html = F.concat(F.lit("<html><body><main><article><h2>"), _escape(F.col("title")),
                    F.lit('</h2><a href="'), F.col("url"), F.lit('">ler</a>'), time_tag,
                    F.lit("</article>"), F.col("nav"), F.lit("</main></body>"),
                    F.when(F.col("whole"), F.lit("</html>")).otherwise(F.lit("")))
    return nav.join(art, "page_id").select("page_id", "url", html.alias("html"))


# --- document catalogue -------------------------------------------------------------
#: Documents per persona, and consecutive events per document.
DOCS_EACH, EVENTS_EACH = 5, 40
DOC_LINK_FMT = "https://docs.example.com/document/d/{id}/edit"


def clip_docs(pages: DataFrame, events: DataFrame) -> DataFrame:
    """v_clip_docs(id, name, modified_time, web_view_link, persona_nome, title,
    url): one stored digest per page, named in the current form, the legacy
    form, or an unrelated form that still carries the persona's name token;
    modified when the last of its events happened."""
    art = articles_from_pages(pages).select(F.col("ord").alias("id"), "title", F.col("link").alias("url"))
    # Events are in time order: a document was modified at the last of its own.
    ts = events.groupBy(F.floor(F.col("event_id") / EVENTS_EACH).alias("id")).agg(F.max("ts").alias("modified_time"))
    nome = F.concat(F.lit("Cliente "), (F.floor(F.col("id") / DOCS_EACH) + 100).cast("string"))
    day = F.date_format("modified_time", "dd-MM-yyyy")
    k = F.col("id") % 3
    name = (F.when(k == 0, F.concat(day, F.lit(" | "), nome))
            .when(k == 1, F.concat(F.lit("Clipping "), nome, F.lit(" - "),
                                   F.date_format("modified_time", "dd/MM/yyyy")))
            .otherwise(F.concat(F.lit("Relatorio "), nome)))
    link = F.concat(F.lit(DOC_LINK_FMT.split("{id}")[0]), F.col("id").cast("string"),
                    F.lit(DOC_LINK_FMT.split("{id}")[1]))
    return art.join(ts, "id", "left").select("id", name.alias("name"), "modified_time",
                                             link.alias("web_view_link"), nome.alias("persona_nome"),
                                             "title", "url")


def doc_lines(docs: DataFrame) -> DataFrame:
    """(id, lines): the stored digest text of each document, one finished item
    plus stray text, a header line, an unfinished item and an orphan line."""
    lines = F.array(
        F.concat(F.lit("CLIPPING DE NOTICIAS - "), F.date_format("modified_time", "dd-MM-yyyy")),
        F.lit(""),
        F.concat(F.lit("1. "), F.col("title")),
        F.concat(F.lit("Resumo parte A de "), F.col("id").cast("string")),
        F.lit("  Resumo parte B  "),
        F.concat(F.lit("Link: "), F.col("url")),
        F.lit(""),
        F.lit("texto solto depois do link"),
        F.concat(F.lit("2. Item sem link "), F.col("id").cast("string")),
        F.lit("linha orfa"))
    return docs.select("id", lines.alias("lines"))


def nested_doc_bodies(docs: DataFrame) -> DataFrame:
    """(id, content): each line becomes a paragraph of two text runs; a
    section break (no paragraph) and an element without a text run sit
    after the first line, as document bodies carry them."""
    def runs(line):
        full = F.concat(line, F.lit("\n"))
        half = F.floor(F.char_length(full) / 2).cast("int")
        first = F.substring(full, F.lit(1), half)
        rest = F.substring(full, half + 1, F.char_length(full))
        return F.array(F.struct(F.struct(first.alias("content")).alias("textRun")),
                       F.struct(F.struct(rest.alias("content")).alias("textRun")))
    para = lambda els: F.struct(F.struct(els.alias("elements")).alias("paragraph"))
    null_run = F.array(F.struct(F.lit(None).cast("struct<content:string>").alias("textRun")))
    empty_para = F.struct(F.lit(None).cast(
        "struct<elements:array<struct<textRun:struct<content:string>>>>").alias("paragraph"))
    d = doc_lines(docs)
    blocks = F.transform("lines", lambda l: para(runs(l)))
    content = F.concat(F.slice(blocks, 1, 1), F.array(empty_para, para(null_run)),
                       F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))))
    return d.select("id", content.alias("content"))


# --- model completions ------------------------------------------------------------
def _ords_json(sel: DataFrame) -> DataFrame:
    """(persona_id, persona_idx, ords): a persona's picks as JSON array text."""
    return sel.groupBy("persona_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "ord"))),
                                 lambda s: s["ord"].cast("string")), ", ").alias("ords"),
        F.min_by("ord", "rank").cast("string").alias("first"))


def selection_completions(selection: DataFrame, personas: DataFrame) -> DataFrame:
    """(request_id, content): one preselection answer per persona, built from
    the lexical picks, in seven shapes: plain, fenced, cut short, a string
    index, float indexes, out-of-range indexes, a non-array value."""
    j = _ords_json(selection).join(personas.select(F.col("id").alias("persona_id"), "persona_idx"),
                                   "persona_id")
    key = F.concat(F.lit('{"selecao": {"'), F.col("persona_id"), F.lit('": ['))
    plain = F.concat(key, F.col("ords"), F.lit("]}}"))
    k = F.col("persona_idx") % 7
    content = (F.when(k == 0, plain)
               .when(k == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
               .when(k == 2, F.concat(key, F.col("ords")))
               .when(k == 3, F.concat(key, F.lit('"'), F.col("first"), F.lit('", '), F.col("ords"), F.lit("]}}")))
               .when(k == 4, F.concat(key, F.col("first"), F.lit(".0, 2.5, "), F.col("ords"), F.lit("]}}")))
               .when(k == 5, F.concat(key, F.lit("-1, 999999999, "), F.col("ords"), F.lit("]}}")))
               .otherwise(F.concat(F.lit('{"selecao": {"'), F.col("persona_id"), F.lit('": "nenhum"}}'))))
    return j.select(F.col("persona_id").alias("request_id"), content.alias("content"))


def filter_completions(selection: DataFrame, personas: DataFrame) -> DataFrame:
    """(request_id, content): per persona filter answers in five shapes:
    plain, fenced, malformed, duplicates plus a numeric string, a miss."""
    j = _ords_json(selection).join(personas.select(F.col("id").alias("persona_id"), "persona_idx"),
                                   "persona_id")
    plain = F.concat(F.lit('{"selecionados": ['), F.col("ords"), F.lit("]}"))
    k = F.col("persona_idx") % 5
    content = (F.when(k == 0, plain)
               .when(k == 1, F.concat(F.lit("```\n"), plain, F.lit("\n```")))
               .when(k == 2, F.lit('{"selecionados": [1, 2'))
               .when(k == 3, F.concat(F.lit('{"selecionados": ['), F.col("first"), F.lit(", "),
                                      F.col("first"), F.lit(', "'), F.col("first"), F.lit('"]}')))
               .otherwise(F.concat(F.lit('{"selecionados": [99999999, '), F.col("ords"), F.lit("]}"))))
    return j.select(F.col("persona_id").alias("request_id"), content.alias("content"))


def summary_completions(summaries: DataFrame, articles: DataFrame) -> DataFrame:
    """(request_id, content): per article summary answers in five shapes:
    JSON, fenced JSON, plain text, JSON without link, JSON with another link."""
    j = summaries.join(articles.select("ord", "title"), "ord")
    full = F.to_json(F.struct("chamada", "resumo", "link"))
    k = F.col("ord") % 5
    content = (F.when(k == 0, full)
               .when(k == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
               .when(k == 2, F.concat(F.lit("Resumo indisponivel para "), F.col("title")))
               .when(k == 3, F.to_json(F.struct("chamada", "resumo")))
               .otherwise(F.to_json(F.struct("chamada", "resumo", F.concat(F.col("link"), F.lit("#resumo"))
                                             .alias("link")))))
    return j.select(F.col("ord").cast("string").alias("request_id"), content.alias("content"))


def articles_from_documents(documents: DataFrame) -> DataFrame:
    """v_doc_articles(ord, site, title, link): one candidate per document -
    title = its first line, link = a tracking-tagged URL keyed by the text's
    digest, so exact copies inside one source collide on both keys."""
    from gazette.functions.text import js_trim as trim_js
    link = F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.com/"), F.md5("text"),
                    F.lit("/?utm_source=x"))
    return documents.select(F.col("doc_id").alias("ord"), F.col("source").alias("site"),
                            trim_js(F.substring_index("text", "\n", 1)).alias("title"),
                            link.alias("link"))
