"""DuckDB SQL oracle for each registered query.

The derived inputs (see ``gazette.sources.derived``) are restated here as
CTEs; each query is one SQL statement over the driver's pre-registered views.
"""

from __future__ import annotations

from gazette.functions import constants as K
from gazette.plans import sqlfrag as S

AS_OF = "2024-02-01 00:00:00"
H1 = r"(?s)<h1[^>]*>(.*?)</h1>"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?([^/?#:]*)"
NAV = r"(?is)<nav\b[^>]*>(.*?)</nav>"
ISO = (r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"
       r"(?:Z|[+-]\d{2}:?\d{2})?)?$")
SENTENCE = r"[^.!?]+[.!?]*"
AS = f"TIMESTAMP '{AS_OF}'"


def _decode(x: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&nbsp;", " ")):
        x = f"replace({x}, {S.q(ent)}, {S.q(ch)})"
    return f"replace({x}, '&amp;', '&')"


def _two(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 2, '0')"


V_ARTICLES = f"""v_articles AS (
  SELECT page_id AS ord,
         lower(regexp_extract(url, {S.q(HOST)}, 1)) AS site,
         {S.js_trim(_decode(f"regexp_replace(regexp_extract(html, {S.q(H1)}, 1), '<[^>]+>', '', 'g')"))} AS title,
         url AS link,
         CASE page_id % 7
           WHEN 1 THEN '2024-01-' || {_two('page_id % 30 + 1')} || 'T' || {_two('page_id % 24')} || ':00:00Z'
           WHEN 2 THEN {_two('page_id % 19 + 13')} || '/01/2024'
           WHEN 3 THEN 'há ' || CAST(page_id % 60 AS VARCHAR) || ' horas'
           WHEN 4 THEN 'há cerca de ' || CAST(page_id % 6 AS VARCHAR) || ' dias'
           WHEN 5 THEN 'Ontem'
           WHEN 6 THEN 'sem hora'
         END AS date_str
  FROM pages)"""

V_ANNOTATED = f"""v_annotated AS (
  SELECT *, {S.valid_title('title')} AS title_ok,
         {S.within_days('published_at', AS, K.DAYS_BACK)} AS date_ok
  FROM (SELECT *, {S.parse_date('date_str', AS)} AS published_at FROM v_articles))"""

V_TOP = f"""v_top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY site ORDER BY published_at DESC NULLS LAST, ord)
              AS site_rank
    FROM v_annotated WHERE title_ok AND date_ok)
  WHERE site_rank <= {K.MAX_PER_SITE})"""

V_COLLECT = f"""v_collect AS (
  SELECT t.*, s.site_ord, s.site_ord * {K.MAX_PER_SITE + 1} + t.site_rank AS pos
  FROM v_top t JOIN (SELECT site, min(ord) AS site_ord FROM v_articles GROUP BY site) s
  USING (site))"""

V_KEYS = f"""v_keys AS (
  SELECT *, list_filter([normalized_link] ||
                        CASE WHEN title_key <> '' THEN [id_host || '::' || title_key]
                             ELSE []::VARCHAR[] END, lambda k: k <> '') AS keys
  FROM (SELECT *, {S.identity_host('link', 'normalized_link')} AS id_host,
               {S.normalize_title('title')} AS title_key
        FROM (SELECT *, {S.normalize_link('link')} AS normalized_link FROM v_collect)))"""


def greedy_scan(src: str, order: str, name: str = "v_dedup") -> str:
    """Sequential any-key dedupe as a recursive CTE carrying the claimed keys."""
    return f"""{name}_seq AS (
  SELECT *, row_number() OVER (ORDER BY {order}) AS step FROM {src}),
{name}_scan AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS claimed, CAST(NULL AS BOOLEAN) AS kept
  UNION ALL
  SELECT q.step,
         CASE WHEN list_has_any(s.claimed, q.keys) THEN s.claimed
              ELSE list_concat(s.claimed, q.keys) END,
         NOT list_has_any(s.claimed, q.keys)
  FROM {name}_scan s JOIN {name}_seq q ON q.step = s.step + 1),
{name} AS (
  SELECT q.*, s.kept FROM {name}_seq q JOIN {name}_scan s USING (step))"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def _sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out["scan_pages"] = (f"SELECT page_id, url, {S.site_label('url')} AS site, "
                         f"CAST(length(html) AS BIGINT) AS html_chars FROM pages")
    out["valid_titles"] = with_(V_ARTICLES) + (
        f"SELECT ord, title, {S.valid_title('title')} AS title_ok FROM v_articles")
    out["parse_dates"] = with_(V_ARTICLES) + (
        f"SELECT ord, date_str, {S.ts_text(S.parse_date('date_str', AS))} AS published_at "
        f"FROM v_articles")
    out["recent_articles"] = with_(V_ARTICLES, V_ANNOTATED) + (
        f"SELECT ord, site, title, link, {S.ts_text('published_at')} AS published_at "
        f"FROM v_annotated WHERE title_ok AND date_ok")
    out["normalize_links"] = with_(V_ARTICLES) + (
        f"SELECT ord, link, normalized_link, {S.identity_host('link', 'normalized_link')} AS id_host "
        f"FROM (SELECT *, {S.normalize_link('link')} AS normalized_link FROM v_articles)")
    # expected rows of the spellings: what they spell, not read from them
    out["link_spellings"] = with_(V_ARTICLES) + """
SELECT ord, spelling,
  CASE WHEN spelling < 5 THEN 'https://' || site || '/noticias/' || ord
       WHEN spelling < 7 THEN 'https://' || site || '/not%C3%ADcias/' || ord || '?a=%C3%A7&b=a+b'
       ELSE 'https://xn--bcher-kva.' || site || '/' || ord END AS normalized_link,
  CASE WHEN spelling >= 7 THEN 'xn--bcher-kva.' || site WHEN starts_with(site, 'www.') THEN substr(site, 5) ELSE site END AS id_host
FROM v_articles, (SELECT unnest(range(10))::INT AS spelling)"""
    out["date_spellings"] = with_(V_ARTICLES) + f"""
SELECT ord, spelling, {S.ts_text('''CASE
  WHEN spelling = 0 THEN moment
  WHEN spelling <= 3 THEN moment + INTERVAL 3 HOUR
  WHEN spelling = 4 THEN date_trunc('minute', moment)
  WHEN spelling = 6 THEN date_trunc('month', moment)::TIMESTAMP
  WHEN spelling = 11 THEN date_trunc('minute', moment) + INTERVAL 5 HOUR
  ELSE date_trunc('day', moment)::TIMESTAMP END''')} AS published_at
FROM (SELECT ord, TIMESTAMP '2024-01-05 09:34:56' + to_days(CAST(ord % 3000 AS INT)) + to_hours(ord % 13) AS moment FROM v_articles),
  (SELECT unnest(range(12))::INT AS spelling)"""
    out["title_keys"] = with_(V_ARTICLES) + (
        f"SELECT ord, {S.nws('title')} AS title_ws, {S.normalize_title('title')} AS title_key "
        f"FROM v_articles")
    out["article_keys"] = with_(V_ARTICLES) + f"""
SELECT ord, 'link' AS kind, normalized_link AS key FROM (
  SELECT ord, {S.normalize_link('link')} AS normalized_link FROM v_articles)
WHERE normalized_link <> ''
UNION ALL
SELECT ord, 'source_title' AS kind, id_host || '::' || title_key AS key FROM (
  SELECT ord, {S.identity_host('link', 'normalized_link')} AS id_host, title_key FROM (
    SELECT ord, link, {S.normalize_link('link')} AS normalized_link,
           {S.normalize_title('title')} AS title_key FROM v_articles))
WHERE title_key <> ''"""
    out["top_per_site"] = with_(V_ARTICLES, V_ANNOTATED, V_TOP) + (
        f"SELECT site, site_rank, ord, title, {S.ts_text('published_at')} AS published_at FROM v_top")
    out["collect_articles"] = with_(V_ARTICLES, V_ANNOTATED, V_TOP, V_COLLECT) + (
        "SELECT pos, ord, site, title, link, date_str FROM v_collect")
    dedup = with_(V_ARTICLES, V_ANNOTATED, V_TOP, V_COLLECT, V_KEYS,
                  greedy_scan("v_keys", "pos"), recursive=True)
    out["dedupe_articles"] = dedup + (
        "SELECT pos, ord, site, title, normalized_link FROM v_dedup WHERE kept")
    out["dedupe_removed"] = dedup + (
        "SELECT pos, ord, site, title, normalized_link FROM v_dedup WHERE NOT kept")
    out["run_totals"] = dedup + """
SELECT count(*) AS raw_collected, CAST(count_if(NOT kept) AS BIGINT) AS removed,
       CAST(count_if(kept) AS BIGINT) AS unique_titles,
       CAST(count_if(kept AND date_str IS NULL) AS BIGINT) AS undated,
       count(DISTINCT site) AS sites
FROM v_dedup"""
    k, days = K.MAX_PER_SITE, K.DAYS_BACK
    out["site_report"] = with_(V_ARTICLES, V_ANNOTATED) + f"""
SELECT site, raw_count, CAST(title_filtered AS BIGINT) AS title_filtered,
       CAST(date_filtered AS BIGINT) AS date_filtered, CAST(least(found, {k}) AS BIGINT) AS kept,
       CAST(greatest(found - {k}, 0) AS BIGINT) AS over_limit, CAST(undated AS BIGINT) AS undated,
       CASE WHEN least(found, {k}) = 0 THEN
         CASE WHEN raw_count = 0 THEN {S.q(K.REASON_NO_ELEMENTS)}
              WHEN title_filtered = raw_count THEN {S.q(K.REASON_ALL_TITLES)}
              WHEN date_filtered > 0 THEN CAST(date_filtered AS VARCHAR) ||
                ' artigo(s) encontrado(s) - todos fora dos ultimos {days} dia(s)'
              ELSE {S.q(K.REASON_DEFAULT)} END END AS reason
FROM (SELECT site, count(*) AS raw_count, count_if(NOT title_ok) AS title_filtered,
             count_if(title_ok AND NOT date_ok) AS date_filtered,
             count_if(title_ok AND date_ok) AS found,
             count_if(title_ok AND date_ok AND coalesce(date_str, '') = '' AND r <= {k}) AS undated
      FROM (SELECT *, row_number() OVER (PARTITION BY site, title_ok AND date_ok
                                         ORDER BY published_at DESC NULLS LAST, ord) AS r FROM v_annotated)
      GROUP BY site)"""
    return out


def _blank(x: str) -> str:
    return f"({x} IS NULL OR {S.js_trim(x)} = '')"


def _uniq2(a: str, b: str) -> str:
    """Order-preserving distinct non-empty of a two-element list."""
    return (f"list_filter([{a}, {b}], lambda x, i: x IS NOT NULL AND x <> '' AND "
            f"list_position([{a}, {b}], x) = i)")


def _clean(arr: str) -> str:
    return (f"list_filter(list_transform(coalesce({arr}, CAST([] AS VARCHAR[])), "
            f"lambda x: {S.js_trim('x')}), lambda x: x IS NOT NULL AND x <> '')")


V_TOPICS = f"""v_topics AS (
  SELECT conv_id, token,
         row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, token) AS topic_rank
  FROM (SELECT conv_id, token, count(*) AS n
        FROM (SELECT conv_id, unnest(string_split({S.normalize_title('text')}, ' ')) AS token
              FROM conversations)
        WHERE length(token) >= 4 GROUP BY conv_id, token)
  QUALIFY topic_rank <= 4)"""

V_PERSONAS = f"""v_personas AS (
  SELECT i.conv_id AS persona_idx, 'p' || CAST(i.conv_id AS VARCHAR) AS id,
         'Cliente ' || CAST(i.conv_id + 100 AS VARCHAR) AS nome, f.descricao,
         coalesce(list(t.token ORDER BY t.topic_rank) FILTER (WHERE t.topic_rank <= 3),
                  CAST([] AS VARCHAR[])) AS prioridades,
         coalesce(list(t.token ORDER BY t.topic_rank) FILTER (WHERE t.topic_rank > 3),
                  CAST([] AS VARCHAR[])) AS evitar
  FROM (SELECT DISTINCT conv_id FROM conversations) i
  LEFT JOIN (SELECT conv_id, {S.squash('text')} AS descricao FROM conversations WHERE turn = 0) f
    USING (conv_id)
  LEFT JOIN v_topics t USING (conv_id)
  GROUP BY i.conv_id, f.descricao)"""

V_RAW_PERSONAS = f"""v_raw_personas AS (
  SELECT p.persona_idx, split_part({S.normalize_title('t0.text')}, ' ', 1) AS id, p.nome,
         t1.descricao, p.prioridades, p.evitar
  FROM v_personas p
  LEFT JOIN (SELECT conv_id, text FROM conversations WHERE turn = 0) t0
    ON t0.conv_id = p.persona_idx
  LEFT JOIN (SELECT conv_id, {S.squash('text')} AS descricao FROM conversations WHERE turn = 1) t1
    ON t1.conv_id = p.persona_idx)"""


def _violations(src: str) -> str:
    bad = lambda a: f"coalesce(len(list_filter({a}, lambda x: {_blank('x')})) > 0, false)"
    return f"""v_violations AS (
  SELECT persona_idx, id AS persona_id,
         CASE WHEN {_blank('id')} THEN 'id' WHEN {_blank('nome')} THEN 'nome'
              WHEN {_blank('descricao')} THEN 'descricao'
              WHEN persona_idx > first_idx THEN 'id_duplicado'
              WHEN {bad('prioridades')} THEN 'prioridades'
              WHEN {bad('evitar')} THEN 'evitar' END AS violation
  FROM {src} r
  LEFT JOIN (SELECT {S.js_trim('id')} AS tid, min(persona_idx) AS first_idx FROM {src}
             WHERE NOT {_blank('id')} GROUP BY 1) f ON f.tid = {S.js_trim('r.id')})"""


V_HIST_RAW = f"""v_hist_raw AS (
  SELECT 'p' || CAST(ord // 10 AS VARCHAR) AS persona_id, ord AS entry_pos,
         CASE WHEN ord % 4 <> 0 THEN title END AS title, title AS titulo,
         CASE WHEN ord % 2 = 0 THEN 'Resumo de ' || title END AS chamada,
         CAST(NULL AS VARCHAR) AS summaryTitle,
         CASE WHEN ord % 5 = 0 THEN '   ' ELSE 'Resumo ' || CAST(ord AS VARCHAR) END AS resumo,
         CASE WHEN ord % 2 = 0 THEN link || CASE WHEN contains(link, '?') THEN '&' ELSE '?' END
              || 'utm_medium=email' ELSE '' END AS link,
         CASE WHEN ord % 9 = 0 THEN '' END AS normalizedLink,
         CAST(NULL AS VARCHAR[]) AS titleKeys, CAST(NULL AS VARCHAR) AS titleKey,
         CAST(NULL AS VARCHAR[]) AS sourceTitleKeys, CAST(NULL AS VARCHAR) AS sourceTitleKey,
         site AS source,
         CASE WHEN ord % 11 <> 0 THEN strftime(TIMESTAMP '2024-01-31 00:00:00'
              - to_seconds(CAST(ord % 30 AS BIGINT) * 86400), '%Y-%m-%dT%H:%M:%S.000Z') END AS sentAt
  FROM v_articles)"""

V_HIST = f"""v_hist AS (
  SELECT persona_id, entry_pos, _idt AS title, nullif(_c, '') AS chamada, nullif(_r, '') AS resumo,
         link, coalesce(normalizedLink, id_nl) AS normalized_link,
         coalesce(titleKey, coalesce(tks[1], '')) AS title_key, tks AS title_keys,
         coalesce(sourceTitleKey, coalesce(stks[1], '')) AS source_title_key,
         stks AS source_title_keys, source, sent_at
  FROM (SELECT *, list_transform(tks, lambda k: id_host || '::' || k) AS stks
        FROM (SELECT *, {_uniq2(S.normalize_title('_idt'), S.normalize_title('_c'))} AS tks,
                     {S.identity_host('link', 'id_nl')} AS id_host
              FROM (SELECT *, CASE WHEN _t <> '' THEN _t ELSE _c END AS _idt,
                           {S.normalize_link('link')} AS id_nl,
                           CASE WHEN regexp_matches(sentAt, {S.q(ISO)}) THEN
                             try_cast(regexp_replace(sentAt, 'Z$', '') AS TIMESTAMP) END AS sent_at
                    FROM (SELECT persona_id, entry_pos, normalizedLink, titleKey, sourceTitleKey,
                                 source, sentAt,
                                 {S.nws('coalesce(title, titulo, \'\')')} AS _t,
                                 {S.nws('coalesce(chamada, summaryTitle, \'\')')} AS _c,
                                 {S.nws('resumo')} AS _r, coalesce(link, '') AS link
                          FROM v_hist_raw))))
  WHERE {S.within_days('sent_at', AS, K.LOOKBACK_DAYS)})"""


def _trunc_part(col: str, label: str, limit: int | None) -> str:
    body = S.truncate(col, limit) if limit else col
    return f"CASE WHEN coalesce({col}, '') <> '' THEN {S.q(label)} || {body} END"


V_HCTX = f"""v_hctx AS (
  SELECT persona_id, line_no, line FROM (
    SELECT persona_id,
           row_number() OVER (PARTITION BY persona_id ORDER BY sent_at DESC NULLS LAST, entry_pos)
             AS line_no,
           concat_ws(' | ', {_trunc_part('title', 'Titulo original: ', K.HISTORY_TITLE_LIMIT)},
                     {_trunc_part('chamada', 'Chamada enviada: ', K.HISTORY_CHAMADA_LIMIT)},
                     {_trunc_part('resumo', 'Resumo enviado: ', K.HISTORY_RESUMO_LIMIT)},
                     {_trunc_part('link', 'Link: ', None)}) AS line
    FROM v_hist)
  WHERE line_no <= {K.HISTORY_PROMPT_ITEMS} AND line <> '')"""


def _block(head: str, arr: str) -> str:
    return (f"CASE WHEN len({arr}) > 0 THEN {S.q(head)} || chr(10) || '- ' || "
            f"array_to_string({arr}, chr(10) || '- ') END")


V_LEX = f"""v_unique AS (SELECT * FROM v_dedup WHERE kept),
v_tt AS (
  SELECT DISTINCT ord, token FROM (
    SELECT ord, unnest(string_split({S.normalize_title('title')}, ' ')) AS token FROM v_unique)
  WHERE token <> ''),
v_topic AS (
  SELECT DISTINCT persona_id, topic, token FROM (
    SELECT persona_id, topic, unnest(string_split({S.normalize_title('topic')}, ' ')) AS token
    FROM (SELECT id AS persona_id, unnest({_clean('prioridades')}) AS topic FROM v_personas))
  WHERE token <> ''),
v_avoid AS (
  SELECT DISTINCT persona_id, token FROM (
    SELECT persona_id, unnest(string_split({S.normalize_title('topic')}, ' ')) AS token
    FROM (SELECT id AS persona_id, unnest({_clean('evitar')}) AS topic FROM v_personas))
  WHERE token <> ''),
v_scores AS (
  SELECT t.persona_id, u.ord, u.published_at, count(DISTINCT t.topic) AS score
  FROM v_topic t JOIN v_tt w USING (token) JOIN v_unique u ON u.ord = w.ord
  GROUP BY t.persona_id, u.ord, u.published_at),
v_cand AS (
  SELECT s.persona_id, s.ord, s.score, s.published_at FROM v_scores s
  WHERE NOT EXISTS (SELECT 1 FROM v_tt t JOIN v_avoid a USING (token)
                    WHERE a.persona_id = s.persona_id AND t.ord = s.ord)),
v_lex AS (
  SELECT persona_id, rank, ord, score FROM (
    SELECT *, row_number() OVER (PARTITION BY persona_id
                                 ORDER BY score DESC, published_at DESC NULLS LAST, ord) AS rank
    FROM v_cand)
  WHERE rank <= {max(K.MAX_PER_PERSONA, K.MAX_PER_PERSONA * K.PRESELECT_MULTIPLIER)})"""

V_SUPPRESS = f"""v_hkeys AS (
  SELECT DISTINCT persona_id, 'L' AS kind, normalized_link AS key FROM v_hist
  WHERE coalesce(normalized_link, '') <> ''
  UNION
  SELECT DISTINCT persona_id, 'T' AS kind, key FROM (
    SELECT persona_id, unnest(list_concat(source_title_keys, [source_title_key])) AS key FROM v_hist)
  WHERE coalesce(key, '') <> ''),
v_sel AS (
  SELECT l.persona_id, l.rank, l.ord, u.normalized_link,
         CASE WHEN u.title_key <> '' THEN [u.id_host || '::' || u.title_key]
              ELSE CAST([] AS VARCHAR[]) END AS stk
  FROM v_lex l JOIN v_unique u USING (ord)),
v_seen AS (
  SELECT DISTINCT s.persona_id, s.rank FROM v_sel s JOIN v_hkeys h
    ON h.persona_id = s.persona_id AND h.kind = 'L' AND h.key = s.normalized_link
  UNION
  SELECT DISTINCT s.persona_id, s.rank FROM (
    SELECT persona_id, rank, unnest(stk) AS key FROM v_sel) s JOIN v_hkeys h
    ON h.persona_id = s.persona_id AND h.kind = 'T' AND h.key = s.key),
v_fresh AS (
  SELECT *, list_filter([normalized_link] || stk, lambda k: k <> '') AS keys,
         row_number() OVER (PARTITION BY persona_id ORDER BY rank) AS step
  FROM v_sel s WHERE NOT EXISTS (
    SELECT 1 FROM v_seen x WHERE x.persona_id = s.persona_id AND x.rank = s.rank)),
v_d2 AS (
  SELECT DISTINCT persona_id, CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS claimed,
         CAST(NULL AS BOOLEAN) AS kept, CAST(0 AS BIGINT) AS nkept FROM v_fresh
  UNION ALL
  SELECT q.persona_id, q.step,
         CASE WHEN list_has_any(s.claimed, q.keys) THEN s.claimed
              ELSE list_concat(s.claimed, q.keys) END,
         NOT list_has_any(s.claimed, q.keys),
         s.nkept + CASE WHEN list_has_any(s.claimed, q.keys) THEN 0 ELSE 1 END
  FROM v_d2 s JOIN v_fresh q ON q.persona_id = s.persona_id AND q.step = s.step + 1),
v_fresh_st AS (
  SELECT f.persona_id, f.rank, f.ord, d.kept, d.nkept FROM v_fresh f
  JOIN v_d2 d ON d.persona_id = f.persona_id AND d.step = f.step),
v_cut AS (
  SELECT persona_id, rank AS cut FROM v_fresh_st WHERE kept AND nkept = {K.MAX_PER_PERSONA}),
v_status AS (
  SELECT s.persona_id, s.rank, s.ord,
         CASE WHEN c.cut IS NOT NULL AND s.rank > c.cut THEN 'unexamined'
              WHEN x.rank IS NOT NULL THEN 'history'
              WHEN f.kept THEN 'kept' ELSE 'duplicate' END AS status,
         CASE WHEN f.kept AND (c.cut IS NULL OR s.rank <= c.cut) THEN f.nkept END AS slot
  FROM v_sel s
  LEFT JOIN v_seen x ON x.persona_id = s.persona_id AND x.rank = s.rank
  LEFT JOIN v_fresh_st f ON f.persona_id = s.persona_id AND f.rank = s.rank
  LEFT JOIN v_cut c ON c.persona_id = s.persona_id)"""


def _more_sql(out: dict[str, str]) -> None:
    out["personas_valid"] = with_(V_TOPICS, V_PERSONAS, _violations("v_personas")) + """
SELECT persona_idx, id, nome, descricao, array_to_string(prioridades, ' | ') AS prioridades,
       array_to_string(evitar, ' | ') AS evitar
FROM v_personas p WHERE NOT EXISTS (
  SELECT 1 FROM v_violations v WHERE v.persona_idx = p.persona_idx AND v.violation IS NOT NULL)"""
    out["persona_violations"] = with_(V_TOPICS, V_PERSONAS, V_RAW_PERSONAS,
                                      _violations("v_raw_personas")) + (
        "SELECT persona_idx, persona_id, violation FROM v_violations WHERE violation IS NOT NULL")
    hist = with_(V_ARTICLES, V_HIST_RAW, V_HIST)
    out["history_load"] = hist + f"""
SELECT persona_id, entry_pos, title, chamada, resumo, link, normalized_link, title_key,
       array_to_string(title_keys, '|') AS title_keys,
       array_to_string(source_title_keys, '|') AS source_title_keys,
       {S.ts_text('sent_at')} AS sent_at
FROM v_hist"""
    out["history_context"] = with_(V_ARTICLES, V_HIST_RAW, V_HIST, V_HCTX) + (
        "SELECT persona_id, line_no, line FROM v_hctx")
    nl = "chr(10)"
    out["persona_context"] = with_(V_ARTICLES, V_HIST_RAW, V_HIST, V_HCTX, V_TOPICS, V_PERSONAS) + f"""
SELECT p.id, concat_ws({nl},
  '### ' || coalesce(p.nome, '') || ' | id: "' || coalesce(p.id, '') || '"',
  coalesce(p.descricao, ''),
  {_block('Prioridades:', _clean('p.prioridades'))},
  {_block('Evitar:', _clean('p.evitar'))},
  {_block(K.HISTORY_BLOCK_INTRO, 'coalesce(h.hl, CAST([] AS VARCHAR[]))')}) AS context
FROM v_personas p
LEFT JOIN (SELECT persona_id, list(line ORDER BY line_no) AS hl FROM v_hctx GROUP BY persona_id) h
  ON h.persona_id = p.id"""
    run = [V_ARTICLES, V_ANNOTATED, V_TOP, V_COLLECT, V_KEYS, greedy_scan("v_keys", "pos"),
           V_TOPICS, V_PERSONAS, V_LEX]
    out["lexical_select"] = with_(*run, recursive=True) + (
        "SELECT persona_id, rank, ord, score FROM v_lex")
    sup = with_(*run, V_HIST_RAW, V_HIST, V_SUPPRESS, recursive=True)
    out["suppress_repeats"] = sup + (
        "SELECT persona_id, slot, rank, ord FROM v_status WHERE status = 'kept'")
    # The runs one after the other, each against all keys sent before it
    out["stream_state"] = with_(
        V_ARTICLES, V_ANNOTATED, V_TOP, V_COLLECT, V_KEYS, V_TOPICS, V_PERSONAS,
        V_LEX.replace("SELECT * FROM v_dedup WHERE kept", "SELECT * FROM v_keys"), V_HIST_RAW, V_HIST, f"""v_run_ranked AS (
  SELECT persona_id, ord, ord % 4 AS run, {AS} + to_days(CAST(ord % 4 * 5 AS INT)) AS run_at,
         row_number() OVER (PARTITION BY persona_id, ord % 4 ORDER BY score DESC, published_at DESC NULLS LAST, ord) AS rank
  FROM v_cand),
v_run AS (
  SELECT r.persona_id, r.run_at, r.rank, r.ord,
         list_filter(['L' || u.normalized_link, 'T' || u.id_host || '::' || u.title_key],
                     lambda k: k <> 'L' AND NOT (u.title_key = '' AND starts_with(k, 'T'))) AS keys,
         row_number() OVER (PARTITION BY r.persona_id ORDER BY r.run_at, r.rank) AS step
  FROM v_run_ranked r JOIN v_unique u USING (ord) WHERE r.rank <= {max(K.MAX_PER_PERSONA, K.MAX_PER_PERSONA * K.PRESELECT_MULTIPLIER)}),
v_old AS (
  SELECT persona_id, 'L' || normalized_link AS key, sent_at FROM v_hist WHERE coalesce(normalized_link, '') <> ''
  UNION ALL
  SELECT persona_id, 'T' || key, sent_at FROM (
    SELECT persona_id, sent_at, unnest(list_concat(source_title_keys, [source_title_key])) AS key FROM v_hist)
  WHERE coalesce(key, '') <> ''),
v_known AS (
  SELECT DISTINCT r.persona_id, r.step FROM (SELECT persona_id, step, run_at, unnest(keys) AS key FROM v_run) r JOIN v_old o
  ON o.persona_id = r.persona_id AND o.key = r.key AND (o.sent_at IS NULL OR o.sent_at >= r.run_at - INTERVAL 14 DAY)),
v_state AS (
  SELECT DISTINCT persona_id, 0::BIGINT AS step, NULL::TIMESTAMP AS run_at, 0::BIGINT AS kept, '' AS status,
         []::STRUCT(k VARCHAR, sent_on TIMESTAMP)[] AS sent FROM v_run
  UNION ALL
  SELECT persona_id, step, run_at, before + (status = 'kept')::BIGINT, status,
         CASE WHEN status = 'kept' THEN list_concat(sent, list_transform(keys, lambda x: {{'k': x, 'sent_on': run_at}})) ELSE sent END
  FROM (
    SELECT q.persona_id, q.step, q.run_at, q.keys, s.sent, CASE WHEN q.run_at = s.run_at THEN s.kept ELSE 0 END AS before,
      CASE WHEN CASE WHEN q.run_at = s.run_at THEN s.kept ELSE 0 END >= {K.MAX_PER_PERSONA} THEN 'unexamined'
           WHEN n.step IS NOT NULL OR list_has_any(q.keys, list_transform(list_filter(s.sent,
             lambda x: x.sent_on < q.run_at AND x.sent_on >= q.run_at - INTERVAL 14 DAY), lambda x: x.k)) THEN 'history'
           WHEN list_has_any(q.keys, list_transform(list_filter(s.sent, lambda x: x.sent_on = q.run_at), lambda x: x.k)) THEN 'duplicate'
           ELSE 'kept' END AS status
    FROM v_state s JOIN v_run q ON q.persona_id = s.persona_id AND q.step = s.step + 1
    LEFT JOIN v_known n ON n.persona_id = q.persona_id AND n.step = q.step))""", recursive=True) + f"""
SELECT r.persona_id, {S.ts_text('r.run_at')} AS run_at, r.rank, r.ord, s.status, CASE WHEN s.status = 'kept' THEN s.kept END AS slot
FROM v_run r JOIN v_state s ON s.persona_id = r.persona_id AND s.step = r.step"""
    out["selection_counts"] = sup + """
SELECT persona_id, CAST(count_if(status = 'kept') AS BIGINT) AS kept,
       CAST(count_if(status IN ('history', 'duplicate')) AS BIGINT) AS removed
FROM v_status GROUP BY persona_id"""


# Script and style bodies, block tags and containers of the driver's pages (one
# article element each, never nested), written out for this check.
_GONE = [r"(?is)<script\b[^>]*>.*?</script>", r"(?is)<style\b[^>]*>.*?</style>",
         r"(?is)<title\b[^>]*>.*?</title>", r"(?s)<!--.*?-->"]
_BLOCK = (r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|section|article|header|footer|nav|main|aside|"
          r"tr|td|th|table|blockquote|figure|figcaption)\b[^>]*>")


def _inner_text(x: str) -> str:
    y = f"regexp_replace(regexp_replace({x}, {S.q(_BLOCK)}, ' ', 'g'), '<[^>]+>', '', 'g')"
    y = f"replace(replace({y}, '&copy;', '©'), '&middot;', '·')"
    return S.squash(_decode(y))


def _article_text(h: str) -> str:
    for pattern in _GONE:
        h = f"regexp_replace({h}, {S.q(pattern)}, ' ', 'g')"
    article = _inner_text(f"regexp_extract({h}, {S.q('(?is)<article[^>]*>(.*?)(?:</article>|$)')}, 1)")
    body = _inner_text(f"regexp_extract({h}, {S.q('(?is)<body[^>]*>(.*?)(?:</body>|$)')}, 1)")
    return (f"CASE WHEN length({article}) > {K.ARTICLE_TEXT_MIN_CHARS} THEN {article} "
            f"ELSE trim(substr({body}, 1, {K.BODY_FALLBACK_CHARS})) END")


V_DIGEST = f"""v_kept AS (SELECT persona_id, slot, rank, ord FROM v_status WHERE status = 'kept'),
v_text AS (
  SELECT page_id AS ord, coalesce(nullif(t, ''), {S.q(K.ARTICLE_TEXT_FAILED)}) AS text,
         coalesce(t, '') = '' AS text_failed FROM (
    SELECT page_id, {_article_text('html')} AS t FROM pages
    WHERE page_id IN (SELECT ord FROM v_kept))),
v_sum AS (
  SELECT ord,
         array_to_string(list_slice(string_split({S.squash("coalesce(title, '')")}, ' '), 1, 15), ' ')
           AS chamada,
         array_to_string(list_slice(list_filter(list_transform(
           regexp_extract_all(coalesce(text, ''), {S.q(SENTENCE)}), lambda x: trim(x)),
           lambda x: x <> ''), 1, 3), ' ') AS resumo,
         link
  FROM v_unique JOIN v_text USING (ord)),
v_items AS (
  SELECT k.persona_id, k.slot AS item_no, k.ord, coalesce(s.chamada, u.title) AS chamada,
         coalesce(s.resumo, '') AS resumo, coalesce(s.link, u.link) AS link
  FROM v_kept k JOIN v_unique u USING (ord) LEFT JOIN v_sum s USING (ord)),
v_parts AS (
  SELECT *, CAST(item_no AS VARCHAR) || '. ' || chamada || chr(10) AS chamada_text,
         resumo || chr(10) AS resumo_text, 'Link: ' || link || chr(10) || chr(10) AS link_text
  FROM v_items)"""

HEADER = f"({S.q(K.DIGEST_HEADER_PREFIX)} || strftime({AS}, '%d-%m-%Y') || chr(10) || chr(10))"


def _digest_sql(out: dict[str, str]) -> None:
    run = [V_ARTICLES, V_ANNOTATED, V_TOP, V_COLLECT, V_KEYS, greedy_scan("v_keys", "pos"),
           V_TOPICS, V_PERSONAS, V_LEX, V_HIST_RAW, V_HIST, V_SUPPRESS, V_DIGEST]
    w = with_(*run, recursive=True)
    out["article_text"] = w + "SELECT ord, text, CAST(length(text) AS BIGINT) AS n_chars FROM v_text"
    out["lead_summary"] = w + "SELECT ord, chamada, resumo, link FROM v_sum"
    out["digest_items"] = w + "SELECT persona_id, item_no, ord, chamada, resumo, link FROM v_items"
    out["persona_articles"] = w + """
SELECT i.persona_id, p.nome, count(*) AS n_articles,
       array_to_string(list(CAST(i.ord AS VARCHAR) ORDER BY i.item_no), ',') AS ords
FROM v_items i JOIN v_personas p ON p.id = i.persona_id GROUP BY i.persona_id, p.nome"""
    out["render_digest"] = w + f"""
SELECT d.persona_id, strftime({AS}, '%d-%m-%Y') || ' | ' || {S.js_trim('p.nome')} AS doc_title,
       d.n_items, {HEADER} || d.body AS body
FROM (SELECT persona_id, count(*) AS n_items,
             string_agg(chamada_text || resumo_text || link_text, '' ORDER BY item_no) AS body
      FROM v_parts GROUP BY persona_id) d
JOIN v_personas p ON p.id = d.persona_id"""
    out["digest_spans"] = w + f""",
v_cur AS (
  SELECT *, 1 + length({HEADER}) + coalesce(sum(length(chamada_text) + length(resumo_text)
            + length(link_text)) OVER (PARTITION BY persona_id ORDER BY item_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor
  FROM v_parts)
SELECT DISTINCT persona_id, CAST(1 AS BIGINT) AS span_no, CAST(1 AS BIGINT) AS start,
       CAST(length({HEADER}) AS BIGINT) AS "end", 'HEADING_1' AS style FROM v_parts
UNION ALL
SELECT persona_id, CAST(item_no * 2 AS BIGINT), CAST(cursor AS BIGINT),
       CAST(cursor + length(chamada_text) - 1 AS BIGINT), 'HEADING_2' FROM v_cur
UNION ALL
SELECT persona_id, CAST(item_no * 2 + 1 AS BIGINT),
       CAST(cursor + length(chamada_text) + length(resumo_text) + 6 AS BIGINT),
       CAST(cursor + length(chamada_text) + length(resumo_text) + length(link_text) - 2 AS BIGINT),
       {S.q(K.LINK_STYLE)} FROM v_cur""".replace("WITH RECURSIVE", "WITH RECURSIVE", 1)
    # the spans query appends one more CTE to the WITH list
    out["digest_spans"] = out["digest_spans"].replace("\n,\nv_cur AS", ",\nv_cur AS")


ORIGIN = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]+)', 1)"
NAVA = '<a href="([^"]*)">([^<]*)</a>'
V_LISTED = f"""v_nav AS (
  SELECT page_id, url, regexp_extract(html, {S.q(NAV)}, 1) AS nav FROM pages),
v_navl AS (
  SELECT page_id, url, regexp_extract_all(nav, {S.q(NAVA)}, 1) AS h,
         regexp_extract_all(nav, {S.q(NAVA)}, 2) AS t FROM v_nav),
v_card AS (
  SELECT a.ord AS page_id, 0 AS k, {S.squash('a.title')} AS title, a.link,
         CASE WHEN coalesce(a.date_str, '') = '' THEN NULL ELSE a.date_str END AS date_str
  FROM v_articles a
  UNION ALL
  SELECT page_id, i AS k, {S.squash(_decode('t[i]'))} AS title,
         {ORIGIN} || {_decode('h[i]')} AS link, CAST(NULL AS VARCHAR) AS date_str
  FROM (SELECT *, unnest(generate_series(1, len(h))) AS i FROM v_navl)),
v_card_ok AS (
  SELECT * FROM v_card WHERE title <> '' AND length(title) >= {K.MIN_CARD_TITLE_LENGTH}
  QUALIFY row_number() OVER (PARTITION BY page_id, link ORDER BY k) = 1),
v_listed AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, title, link, date_str
  FROM v_card_ok)"""
V_LISTED_OK = f"""v_listed_ok AS (
  SELECT *, {S.valid_title('title')} AS title_ok, {S.within_days('published_at', AS, K.DAYS_BACK)} AS date_ok
  FROM (SELECT l.page_id * 1048576 + l.pos AS ord, l.*, p.url AS site, {S.parse_date('date_str', AS)} AS published_at
        FROM v_listed l JOIN pages p USING (page_id)))"""


def _extract_sql(out: dict[str, str]) -> None:
    origin = ORIGIN
    out["extract_cards"] = with_(V_ARTICLES, V_LISTED) + "SELECT page_id, pos, title, link, date_str FROM v_listed"
    out["collect_listings"] = with_(V_ARTICLES, V_LISTED, V_LISTED_OK) + f"""
SELECT ord, page_id, site, r AS site_rank, title, link, date_str FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY published_at DESC NULLS LAST, ord) AS r
  FROM v_listed_ok WHERE title_ok AND date_ok)
WHERE r <= {K.MAX_PER_SITE}"""
    A = S.q(r"(?is)<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\"[^>]*>(.*?)</a>")
    alt = S.q(r"(?is)<img\b[^>]*\balt\s*=\s*\"([^\"]*)\"")
    path = "regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
    blocked = " OR ".join(f"starts_with({path}, {S.q(b)})" for b in K.ANCHOR_BLOCKED_PREFIXES)
    first_bad = ", ".join(S.q(b) for b in K.ANCHOR_BLOCKED_FIRST_PARTS)
    clean = lambda x: S.squash(
        f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), {S.q(K.ANCHOR_CAPTION_PREFIX)}, '', 'g')")
    out["extract_anchors"] = f"""
WITH v_a AS (
  SELECT page_id, {origin} AS origin, regexp_extract_all(html, {A}, 1) AS hs,
         regexp_extract_all(html, {A}, 2) AS ins FROM pages),
v_b AS (
  SELECT page_id, origin, i - 1 AS pos, {_decode('trim(hs[i])')} AS href, {_decode('ins[i]')} AS inr
  FROM (SELECT *, unnest(generate_series(1, len(hs))) AS i FROM v_a)),
v_c AS (
  SELECT page_id, pos, origin,
         CASE WHEN regexp_matches(href, '(?i)^[a-z][a-z0-9+.\\-]*:') THEN href
              WHEN starts_with(href, '//') THEN regexp_extract(origin, '^([^:]+:)', 1) || href
              WHEN starts_with(href, '/') THEN origin || href
              ELSE origin || '/' || href END AS link, inr
  FROM v_b),
v_d AS (
  SELECT page_id, pos, link, origin,
         CASE WHEN {clean('inr')} <> '' THEN {clean('inr')}
              ELSE {clean(f"regexp_extract(inr, {alt}, 1)")} END AS title,
         list_filter(string_split({path}, '/'), lambda p: p <> '') AS parts,
         ({blocked}) AS blocked
  FROM v_c)
SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS pos, title,
       CAST(NULL AS VARCHAR) AS date_str
FROM (SELECT page_id, link, min(pos) AS p, arg_min(title, pos) AS title
      FROM v_d
      WHERE starts_with(link, origin || '/') AND NOT blocked AND len(parts) >= 1
        AND NOT (parts[1] IN ({first_bad})) AND length(title) >= 3
      GROUP BY page_id, link)"""


V_DOCS = f"""v_docs AS (
  SELECT a.ord AS id,
         CASE a.ord % 3
           WHEN 0 THEN strftime(e.modified_time, '%d-%m-%Y') || ' | ' || n.nome
           WHEN 1 THEN 'Clipping ' || n.nome || ' - ' || strftime(e.modified_time, '%d/%m/%Y')
           ELSE 'Relatorio ' || n.nome END AS name,
         e.modified_time, a.title, a.link AS url
  FROM v_articles a
  JOIN (SELECT ord, 'Cliente ' || CAST(ord // 5 + 100 AS VARCHAR) AS nome
        FROM v_articles) n USING (ord)
  LEFT JOIN (SELECT event_id // 40 AS id, CAST(max(ts) AS TIMESTAMP) AS modified_time
             FROM events GROUP BY 1) e ON e.id = a.ord)"""


def _token(x: str) -> str:
    toks = (f"list_filter(list_transform(string_split_regex({x}, '\\s+'), "
            f"lambda t: regexp_replace(t, '[^\\p{{L}}\\p{{N}}-]', '', 'g')), lambda t: length(t) >= 3)")
    return f"(CASE WHEN len({toks}) > 0 THEN {toks}[-1] ELSE {x} END)"


def _doc_match(name: str, nome: str) -> str:
    f, p = S.normalize_search(name), S.normalize_search(nome)
    pat = S.q(K.DOC_TITLE_CURRENT)
    legacy = S.normalize_search(f"'Clipping ' || {nome} || ' -'")
    return (f"({f} <> '' AND {p} <> '' AND ((regexp_matches({f}, {pat}) AND "
            f"regexp_extract({f}, {pat}, 2) = {p}) OR starts_with({f}, {legacy})))")


def _cands(page: int) -> str:
    return f"""v_cand{page} AS (
  SELECT * FROM (
    SELECT p.id AS persona_id, p.nome, d.id, d.name, d.modified_time,
           row_number() OVER (PARTITION BY p.id ORDER BY d.modified_time DESC NULLS LAST, d.id)
             AS cand_rank
    FROM (SELECT id, nome, lower({_token('nome')}) AS part FROM v_personas) p
    JOIN v_docs d ON contains(lower(d.name), p.part))
  WHERE cand_rank <= {page})"""


_DOC_LINES = [
    "'CLIPPING DE NOTICIAS - ' || strftime(modified_time, '%d-%m-%Y')", "''", "'1. ' || title",
    "'Resumo parte A de ' || CAST(id AS VARCHAR)", "'  Resumo parte B  '", "'Link: ' || url", "''",
    "'texto solto depois do link'", "'2. Item sem link ' || CAST(id AS VARCHAR)", "'linha orfa'"]
# A line that is null (no modification time) contributes no text runs.
V_DTEXT = ("v_dtext AS (\n  SELECT id, concat_ws('', "
           + ", ".join(f"({x}) || chr(10)" for x in _DOC_LINES) + ") AS text\n  FROM v_docs)")

V_DITEMS = f"""v_dl0 AS (
  SELECT id, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')) AS raw,
         unnest(generate_series(0, len(string_split_regex(coalesce(text, ''), '\\r?\\n')) - 1)) AS pos
  FROM v_dtext),
v_dl AS (
  SELECT id, pos, line,
         regexp_matches(line, {S.q(K.DIGEST_HEADER_LINE)}) AS is_header,
         NOT regexp_matches(line, {S.q(K.DIGEST_HEADER_LINE)})
           AND regexp_matches(line, {S.q(K.DIGEST_ITEM_LINE)}) AS is_title,
         NOT regexp_matches(line, {S.q(K.DIGEST_HEADER_LINE)})
           AND NOT regexp_matches(line, {S.q(K.DIGEST_ITEM_LINE)})
           AND regexp_matches(line, {S.q(K.DIGEST_LINK_LINE)}) AS is_link
  FROM (SELECT id, pos, {S.js_trim('raw')} AS line FROM v_dl0) WHERE line <> ''),
v_dli AS (
  SELECT *, sum(CAST(is_title AS INTEGER)) OVER (PARTITION BY id ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item FROM v_dl),
v_marks AS (
  SELECT id, item, min(pos) FILTER (WHERE is_title) AS t_pos, min(pos) FILTER (WHERE is_link) AS l_pos
  FROM v_dli WHERE item > 0 GROUP BY id, item HAVING min(pos) FILTER (WHERE is_link) IS NOT NULL),
v_items_doc AS (
  SELECT l.id, row_number() OVER (PARTITION BY l.id ORDER BY l.item) AS item_no,
         trim(regexp_extract(arg_min(l.line, l.pos) FILTER (WHERE l.is_title), {S.q(K.DIGEST_ITEM_LINE)}, 1))
           AS title,
         trim(coalesce(string_agg(l.line, ' ' ORDER BY l.pos) FILTER (
           WHERE NOT l.is_title AND NOT l.is_header AND l.pos < m.l_pos), '')) AS resumo,
         regexp_extract(arg_min(l.line, l.pos) FILTER (WHERE l.pos = m.l_pos),
                        {S.q(K.DIGEST_LINK_LINE)}, 1) AS link
  FROM v_dli l JOIN v_marks m ON m.id = l.id AND m.item = l.item
  WHERE l.pos >= m.t_pos AND l.pos <= m.l_pos
  GROUP BY l.id, l.item)"""


def _docs_sql(out: dict[str, str]) -> None:
    base = [V_ARTICLES, V_TOPICS, V_PERSONAS, V_DOCS]
    out["candidate_docs"] = with_(*base, _cands(K.CATALOGUE_PAGE)) + f"""
SELECT persona_id, cand_rank, id AS doc_id, name, {S.ts_text('modified_time')} AS modified_time
FROM v_cand{K.CATALOGUE_PAGE}"""
    out["docs_for_persona"] = with_(*base, _cands(K.CATALOGUE_PAGE)) + f"""
SELECT persona_id,
       row_number() OVER (PARTITION BY persona_id ORDER BY modified_time DESC NULLS LAST, cand_rank)
         AS doc_rank,
       id AS doc_id, name, {S.ts_text('modified_time')} AS modified_time
FROM v_cand{K.CATALOGUE_PAGE}
WHERE {_doc_match('name', 'nome')} AND {S.within_days('modified_time', AS, K.LOOKBACK_DAYS)}"""
    out["latest_doc"] = with_(*base, _cands(K.LATEST_DOC_PAGE)) + f"""
SELECT persona_id, arg_min(id, cand_rank) AS doc_id, arg_min(name, cand_rank) AS name,
       {S.ts_text('arg_min(modified_time, cand_rank)')} AS modified_time
FROM v_cand{K.LATEST_DOC_PAGE} WHERE {_doc_match('name', 'nome')} GROUP BY persona_id"""
    out["doc_text"] = with_(V_ARTICLES, V_DOCS, V_DTEXT) + "SELECT id AS doc_id, text FROM v_dtext"
    out["parse_doc_items"] = with_(V_ARTICLES, V_DOCS, V_DTEXT, V_DITEMS) + (
        "SELECT id AS doc_id, item_no, title, resumo, link FROM v_items_doc")


def _fences(x: str, fallback: str) -> str:
    raw = f"coalesce({S.js_trim(x)}, {S.q(fallback)})"
    raw = f"regexp_replace({raw}, {S.q(K.FENCE_OPEN)}, '')"
    return f"regexp_replace({raw}, {S.q(K.FENCE_CLOSE)}, '')"


def _pctx(name: str, with_history: bool) -> str:
    hist = ("LEFT JOIN (SELECT persona_id, list(line ORDER BY line_no) AS hl FROM v_hctx "
            "GROUP BY persona_id) h ON h.persona_id = p.id") if with_history else ""
    hl = "coalesce(h.hl, CAST([] AS VARCHAR[]))" if with_history else "CAST([] AS VARCHAR[])"
    return f"""{name} AS (
  SELECT p.id, p.persona_idx, concat_ws(chr(10),
    '### ' || coalesce(p.nome, '') || ' | id: "' || coalesce(p.id, '') || '"',
    coalesce(p.descricao, ''),
    {_block('Prioridades:', _clean('p.prioridades'))},
    {_block('Evitar:', _clean('p.evitar'))},
    {_block(K.HISTORY_BLOCK_INTRO, hl)}) AS context
  FROM v_personas p {hist})"""


NUMERIC_JSON = "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')"

V_FETCH = f"""v_site AS (
  SELECT p.page_id, p.url AS site, NOT regexp_matches(coalesce(p.html, ''), '(?i)</html>\\s*$') AS failed,
         coalesce(raw, 0) AS raw, coalesce(bad_titles, 0) AS bad_titles, coalesce(bad_dates, 0) AS bad_dates,
         coalesce(found, 0) AS found
  FROM pages p LEFT JOIN (
    SELECT page_id, count(*) AS raw, count_if(NOT title_ok) AS bad_titles,
           count_if(title_ok AND NOT date_ok) AS bad_dates, count_if(title_ok AND date_ok) AS found
    FROM v_listed_ok GROUP BY page_id) USING (page_id)),
v_linked AS (
  SELECT url AS link, arg_min(t, page_id) AS text FROM (
    SELECT url, page_id, {_article_text('html')} AS t FROM pages) GROUP BY url),
v_fetch AS (
  SELECT a.ord, s.site, 'article' AS kind, a.title, a.link,
         coalesce(nullif(l.text, ''), {S.q(K.ARTICLE_TEXT_FAILED_TOOL)}) AS text,
         CAST(NULL AS BIGINT) AS articles_found, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS error
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY published_at DESC NULLS LAST, ord) AS r
        FROM v_listed_ok WHERE title_ok AND date_ok) a
  JOIN v_site s ON s.page_id = a.page_id AND NOT s.failed LEFT JOIN v_linked l ON l.link = a.link
  WHERE a.r <= {K.MAX_PER_SITE_TOOL}
  UNION ALL
  SELECT page_id * 1048576, site, CASE WHEN failed THEN 'error' ELSE 'empty' END, NULL, NULL, NULL,
         CASE WHEN NOT failed THEN 0 END,
         CASE WHEN NOT failed THEN CASE WHEN raw = 0 THEN {S.q(K.TOOL_REASON_NO_ELEMENTS)}
           WHEN bad_titles = raw THEN {S.q(K.TOOL_REASON_ALL_TITLES)}
           ELSE CAST(bad_dates AS VARCHAR) || ' artigos fora do periodo' END END,
         CASE WHEN failed THEN 'pagina incompleta' END
  FROM v_site WHERE failed OR found = 0)"""

V_SELJ = """v_selj AS (
  SELECT l.persona_id, p.persona_idx,
         string_agg(CAST(l.ord AS VARCHAR), ', ' ORDER BY l.rank) AS ords,
         CAST(arg_min(l.ord, l.rank) AS VARCHAR) AS first
  FROM v_lex l JOIN v_personas p ON p.id = l.persona_id GROUP BY l.persona_id, p.persona_idx)"""


def _io_sql(out: dict[str, str]) -> None:
    run = [V_ARTICLES, V_ANNOTATED, V_TOP, V_COLLECT, V_KEYS, greedy_scan("v_keys", "pos"),
           V_TOPICS, V_PERSONAS, V_LEX, V_HIST_RAW, V_HIST, V_HCTX]
    lim = max(K.MAX_PER_PERSONA, K.MAX_PER_PERSONA * K.PRESELECT_MULTIPLIER)
    head, tail = K.PRESELECT_RULES.split("{max}")
    out["preselect_request"] = with_(*run, _pctx("v_pctx", True), recursive=True) + f"""
SELECT *, CAST({K.PRESELECT_PARAMS[0]} AS DOUBLE) AS temperature, {K.PRESELECT_PARAMS[1]} AS max_tokens FROM (
SELECT 'preselect' AS request_id, 0 AS section_no, CAST(0 AS BIGINT) AS seq,
       {S.q(head)} || CAST(least(count(*), {lim}) AS VARCHAR) || {S.q(tail)} AS text, '' AS joiner
FROM v_unique
UNION ALL SELECT 'preselect', 1, persona_idx, context, chr(10) || chr(10) FROM v_pctx
UNION ALL SELECT 'preselect', 2, 0, {S.q(K.PRESELECT_ARTICLES_HEAD)}, ''
UNION ALL SELECT 'preselect', 3, ord, '[' || CAST(ord AS VARCHAR) || '] ' || title || ' (' ||
       coalesce(substr(nullif(date_str, ''), 1, 16), 'sem data') || ')', chr(10) FROM v_unique
UNION ALL SELECT 'preselect', 4, 0, {S.q(K.PRESELECT_IDS_HEAD)}, ''
UNION ALL SELECT 'preselect', 5, persona_idx, '"' || id || '"', ', ' FROM v_personas
UNION ALL SELECT 'preselect', 6, 0, {S.q(K.PRESELECT_FORMAT)}, '')"""
    fetch = [V_ARTICLES, V_LISTED, V_LISTED_OK, V_FETCH]
    out["fetch_report"] = with_(*fetch) + """
SELECT ord, site, kind, title, link, CAST(length(text) AS DOUBLE) AS text_chars,
       CAST(articles_found AS DOUBLE) AS articles_found, reason, error FROM v_fetch"""
    out["filter_requests"] = with_(*fetch, V_TOPICS, V_PERSONAS, _pctx("v_pctx0", False)) + f""",
v_usable AS (SELECT * FROM v_fetch WHERE error IS NULL AND coalesce(title, '') <> ''
             AND coalesce(link, '') <> '')
SELECT id AS request_id, 1 AS section_no, CAST(0 AS BIGINT) AS seq,
       {S.q(K.FILTER_HEAD)} || context || {S.q(K.FILTER_LIST_HEAD)} AS text, '' AS joiner
FROM v_pctx0 WHERE EXISTS (SELECT 1 FROM v_usable)
UNION ALL SELECT '*', 2, ord, '[' || CAST(ord AS VARCHAR) || '] ' || title || ' - ' || link, chr(10)
FROM v_usable
UNION ALL SELECT id, 3, 0, {S.q(K.FILTER_FOOT)}, '' FROM v_pctx0 WHERE EXISTS (SELECT 1 FROM v_usable)"""
    t, m = K.FILTER_PARAMS
    out["filter_requests"] = out["filter_requests"].replace("\n,\nv_usable", ",\nv_usable").replace(
        "SELECT id AS request_id", f"SELECT *, CAST({t} AS DOUBLE) AS temperature, {m} AS max_tokens FROM (\nSELECT id AS request_id") + ")"
    out["filter_prompts"] = f"""WITH v_req AS ({out["filter_requests"]}),
v_at AS (SELECT seq, text, sum(length(text) + 1) OVER (ORDER BY seq) - length(text) - 1 AS start FROM v_req WHERE request_id = '*'),
v_page AS (SELECT CAST(start // {K.PROMPT_PAGE_CHARS} AS INTEGER) AS page_no, string_agg(text, chr(10) ORDER BY seq) AS list FROM v_at GROUP BY 1),
v_prompt AS (SELECT h.request_id, page_no, h.text || list || f.text AS prompt, h.temperature, h.max_tokens
  FROM v_req h JOIN v_req f ON h.request_id = f.request_id AND h.section_no = 1 AND f.section_no = 3 CROSS JOIN v_page)
SELECT request_id, page_no, length(prompt) AS n_chars, md5(prompt) AS prompt_md5, temperature, max_tokens FROM v_prompt"""
    dig = run + [V_SUPPRESS, V_DIGEST]
    t, m = K.SUMMARY_PARAMS
    out["summary_requests"] = with_(*dig, recursive=True) + f"""
SELECT u.ord, {S.q(K.SUMMARY_HEAD)} || 'Titulo: ' || u.title || chr(10) || 'URL: ' || u.link ||
       chr(10) || 'Texto:' || chr(10) || substr(coalesce(x.text, ''), 1, {K.SUMMARY_TEXT_LIMIT}) AS prompt,
       CAST({t} AS DOUBLE) AS temperature, CAST({m} AS INTEGER) AS max_tokens
FROM v_unique u JOIN v_text x USING (ord)"""
    sel_shapes = f"""v_scomp AS (
  SELECT persona_id AS request_id, CASE persona_idx % 7
    WHEN 0 THEN '{{"selecao": {{"' || persona_id || '": [' || ords || ']}}}}'
    WHEN 1 THEN '```json' || chr(10) || '{{"selecao": {{"' || persona_id || '": [' || ords || ']}}}}' || chr(10) || '```'
    WHEN 2 THEN '{{"selecao": {{"' || persona_id || '": [' || ords
    WHEN 3 THEN '{{"selecao": {{"' || persona_id || '": ["' || first || '", ' || ords || ']}}}}'
    WHEN 4 THEN '{{"selecao": {{"' || persona_id || '": [' || first || '.0, 2.5, ' || ords || ']}}}}'
    WHEN 5 THEN '{{"selecao": {{"' || persona_id || '": [-1, 999999999, ' || ords || ']}}}}'
    ELSE '{{"selecao": {{"' || persona_id || '": "nenhum"}}}}' END AS content
  FROM v_selj),
v_sraw AS (
  SELECT request_id, r AS raw, json_valid(r) AS ok FROM (
    SELECT request_id, {_fences('content', K.PRESELECT_FALLBACK)} AS r FROM v_scomp)),
v_sval AS (
  SELECT request_id, ok, CASE WHEN ok THEN json_extract(raw, '$.selecao."' || request_id || '"') END AS val
  FROM v_sraw),
v_sgood AS (
  SELECT * FROM v_sval WHERE ok AND (val IS NULL OR json_type(val) IN ('NULL', 'ARRAY'))),
v_selem AS (
  SELECT request_id AS persona_id, i, e FROM (
    SELECT request_id, unnest(json_extract(val, '$[*]')) AS e,
           unnest(generate_series(0, CAST(json_array_length(val) AS BIGINT) - 1)) AS i
    FROM v_sgood WHERE json_type(val) = 'ARRAY' AND json_array_length(val) > 0)),
v_snum AS (
  SELECT persona_id, i, TRY_CAST(CAST(e AS VARCHAR) AS DOUBLE) AS x FROM v_selem
  WHERE json_type(e) IN {NUMERIC_JSON})"""
    out["parse_selection"] = with_(*run, V_SELJ, sel_shapes, recursive=True) + f"""
SELECT persona_id, rank, ord FROM (
  SELECT n.persona_id, u.ord, row_number() OVER (PARTITION BY n.persona_id ORDER BY n.i) AS rank
  FROM v_snum n JOIN v_unique u ON CAST(u.ord AS DOUBLE) = n.x
  WHERE n.x = floor(n.x) AND n.x >= 0)
WHERE rank <= {lim}"""
    filt_shapes = f"""v_fcomp AS (
  SELECT persona_id AS request_id, CASE persona_idx % 5
    WHEN 0 THEN '{{"selecionados": [' || ords || ']}}'
    WHEN 1 THEN '```' || chr(10) || '{{"selecionados": [' || ords || ']}}' || chr(10) || '```'
    WHEN 2 THEN '{{"selecionados": [1, 2'
    WHEN 3 THEN '{{"selecionados": [' || first || ', ' || first || ', "' || first || '"]}}'
    ELSE '{{"selecionados": [99999999, ' || ords || ']}}' END AS content
  FROM v_selj),
v_fraw AS (
  SELECT request_id, r AS raw, json_valid(r) AS ok FROM (
    SELECT request_id, {_fences('content', K.FILTER_FALLBACK)} AS r FROM v_fcomp)),
v_farr AS (
  SELECT request_id, json_extract(raw, '$.selecionados') AS arr FROM v_fraw WHERE ok),
v_felem AS (
  SELECT request_id AS persona_id, unnest(json_extract(arr, '$[*]')) AS e,
         unnest(generate_series(0, CAST(json_array_length(arr) AS BIGINT) - 1)) AS pos
  FROM v_farr WHERE json_type(arr) = 'ARRAY' AND json_array_length(arr) > 0),
v_fkey AS (
  SELECT persona_id, pos,
         CASE WHEN json_type(e) IN {NUMERIC_JSON}
                   AND TRY_CAST(CAST(e AS VARCHAR) AS DOUBLE) = floor(TRY_CAST(CAST(e AS VARCHAR) AS DOUBLE))
                THEN CAST(TRY_CAST(CAST(e AS VARCHAR) AS DOUBLE) AS BIGINT)
              WHEN json_type(e) = 'VARCHAR' AND regexp_matches(json_extract_string(e, '$'), '^(0|[1-9][0-9]{{0,17}})$')
                THEN CAST(json_extract_string(e, '$') AS BIGINT) END AS ord
  FROM v_felem)"""
    listed = """v_dedup AS (
  SELECT ord, title, CAST(NULL AS TIMESTAMP) AS published_at, true AS kept FROM v_fetch WHERE kind = 'article')"""
    out["parse_filter"] = with_(V_ARTICLES, V_LISTED, V_LISTED_OK, V_FETCH, listed, V_TOPICS, V_PERSONAS, V_LEX, V_SELJ,
                                filt_shapes, recursive=True) + """
SELECT k.persona_id, CAST(k.pos AS BIGINT) AS pos, k.ord FROM v_fkey k JOIN v_fetch r USING (ord)"""
    sum_shapes = f"""v_mcomp AS (
  SELECT s.ord, CASE s.ord % 5
    WHEN 0 THEN CAST(to_json({{'chamada': s.chamada, 'resumo': s.resumo, 'link': s.link}}) AS VARCHAR)
    WHEN 1 THEN '```json' || chr(10) || CAST(to_json({{'chamada': s.chamada, 'resumo': s.resumo, 'link': s.link}}) AS VARCHAR) || chr(10) || '```'
    WHEN 2 THEN 'Resumo indisponivel para ' || u.title
    WHEN 3 THEN CAST(to_json({{'chamada': s.chamada, 'resumo': s.resumo}}) AS VARCHAR)
    ELSE CAST(to_json({{'chamada': s.chamada, 'resumo': s.resumo, 'link': s.link || '#resumo'}}) AS VARCHAR) END AS content
  FROM v_sum s JOIN v_unique u USING (ord)),
v_mraw AS (
  SELECT ord, r AS raw, json_valid(r) AS ok FROM (
    SELECT ord, {_fences('CAST(content AS VARCHAR)', K.SUMMARY_FALLBACK)} AS r FROM v_mcomp))"""
    out["parse_summaries"] = with_(*dig, sum_shapes, recursive=True) + """
SELECT m.ord,
       CASE WHEN ok THEN coalesce(json_extract_string(raw, '$.chamada'), u.title) ELSE u.title END AS chamada,
       CASE WHEN ok THEN coalesce(json_extract_string(raw, '$.resumo'), '') ELSE raw END AS resumo,
       CASE WHEN ok AND json_exists(raw, '$.link') THEN json_extract_string(raw, '$.link')
            ELSE u.link END AS link
FROM v_mraw m JOIN v_unique u USING (ord)"""
    out["warning_digest"] = with_(*dig, recursive=True) + f""",
v_warn AS (
  SELECT 1 AS label_no, 'Portais com falha' AS label, page_id AS seq,
         {S.site_label('url')} || ': pagina incompleta' AS text
  FROM pages WHERE NOT regexp_matches(coalesce(html, ''), '(?i)</html>\\s*$')
  UNION ALL
  SELECT 2, 'Artigos sem extracao completa', x.ord, u.title
  FROM v_text x JOIN v_unique u USING (ord) WHERE x.text_failed),
v_wn AS (SELECT label_no, label, count(*) AS n FROM v_warn GROUP BY label_no, label)
SELECT label_no, CAST(0 AS BIGINT) AS line_no, '       ' || label || ': ' || CAST(n AS VARCHAR) AS line
FROM v_wn
UNION ALL
SELECT label_no, line_no, '         - ' || text FROM (
  SELECT label_no, text, row_number() OVER (PARTITION BY label_no ORDER BY seq) AS line_no FROM v_warn)
WHERE line_no <= {K.WARNING_SHOWN}
UNION ALL
SELECT label_no, CAST({K.WARNING_SHOWN + 1} AS BIGINT), '         - ... e mais ' || CAST(n - {K.WARNING_SHOWN} AS VARCHAR)
FROM v_wn WHERE n > {K.WARNING_SHOWN}"""
    out["warning_digest"] = out["warning_digest"].replace("chr(10) AS link_text\n  FROM v_items)\n,\nv_warn", "chr(10) AS link_text\n  FROM v_items),\nv_warn")
    out["run_counters"] = with_(*dig, recursive=True) + """
SELECT (SELECT count(*) FROM v_unique) AS titles_collected,
       (SELECT count(DISTINCT ord) FROM v_kept) AS selected_unique,
       (SELECT count(DISTINCT persona_id) FROM v_kept) AS docs_created,
       (SELECT count(*) FROM v_sum) AS summaries"""


V_DOC_ARTS = f"""v_doc_arts AS (
  SELECT doc_id AS ord, source AS site, {S.js_trim("split_part(text, chr(10), 1)")} AS title,
         'https://www.' || source || '.example.com/' || md5(text) || '/?utm_source=x' AS link
  FROM documents),
v_doc_keys AS (
  SELECT *, list_filter([normalized_link] ||
                        CASE WHEN title_key <> '' THEN [id_host || '::' || title_key]
                             ELSE []::VARCHAR[] END, lambda k: k <> '') AS keys
  FROM (SELECT *, {S.identity_host('link', 'normalized_link')} AS id_host,
               {S.normalize_title('title')} AS title_key
        FROM (SELECT *, {S.normalize_link('link')} AS normalized_link FROM v_doc_arts)))"""


def _identity_of(src: str, name: str) -> str:
    """``src`` (persona_id, seq, title, chamada, link, ...) with link key and
    title keys, in send order; rows without any key drop out."""
    return f"""{name} AS (
  SELECT *, list_transform(tks, lambda k: id_host || '::' || k) AS stks,
         row_number() OVER (PARTITION BY persona_id ORDER BY seq) AS step
  FROM (SELECT *, {S.identity_host('link', 'nl')} AS id_host,
               {_uniq2(S.normalize_title("coalesce(title, '')"), S.normalize_title("coalesce(chamada, '')"))} AS tks
        FROM (SELECT *, {S.normalize_link('link')} AS nl FROM {src}))
  WHERE nl <> '' OR len(tks) > 0)"""


def _fold(sent: str) -> str:
    """The sequential upsert as a recursive CTE that carries a persona's whole
    list: (place, link key, title keys, the row that last wrote it)."""
    entry = "{{'pos': {pos}, 'link': {link}, 'keys': {keys}, 'step': {step}}}"
    old = entry.format(pos="entry_pos", link="coalesce(normalized_link, '')", step="CAST(NULL AS BIGINT)",
                       keys="list_filter(list_concat(source_title_keys, [source_title_key]), lambda k: coalesce(k, '') <> '')")
    new = lambda pos: entry.format(pos=pos, link="s.nl", keys="s.stks", step="s.step")
    hits = ("list_transform(list_filter(f.state, lambda e: (s.nl <> '' AND e.link = s.nl) "
            "OR list_has_any(e.keys, s.stks)), lambda e: e.pos)")
    return f"""v_start AS (
  SELECT p.persona_id, coalesce(h.state, []) AS state, coalesce(h.top, -1) AS top
  FROM (SELECT DISTINCT persona_id FROM {sent}) p LEFT JOIN (
    SELECT persona_id, list({old} ORDER BY entry_pos) AS state, max(entry_pos) AS top
    FROM v_hist GROUP BY persona_id) h USING (persona_id)),
v_fold AS (
  SELECT persona_id, CAST(0 AS BIGINT) AS step, state, top FROM v_start
  UNION ALL
  SELECT f.persona_id, s.step,
         CASE WHEN len({hits}) = 0 THEN list_append(f.state, {new('f.top + 1')})
              ELSE list_transform(f.state, lambda e: CASE WHEN e.pos = list_min({hits}) THEN {new('e.pos')} ELSE e END) END,
         CASE WHEN len({hits}) = 0 THEN f.top + 1 ELSE f.top END
  FROM v_fold f JOIN {sent} s ON s.persona_id = f.persona_id AND s.step = f.step + 1),
v_placed AS (
  SELECT persona_id, e.pos AS entry_pos, e.step AS step FROM (
    SELECT persona_id, unnest(state) AS e FROM v_fold
    QUALIFY row_number() OVER (PARTITION BY persona_id ORDER BY v_fold.step DESC) = 1)
  WHERE e.step IS NOT NULL)"""


def _upsert_sql(out: dict[str, str]) -> None:
    run = [V_ARTICLES, V_ANNOTATED, V_TOP, V_COLLECT, V_KEYS, greedy_scan("v_keys", "pos"),
           V_TOPICS, V_PERSONAS, V_LEX, V_HIST_RAW, V_HIST, V_SUPPRESS, V_DIGEST]
    sent = """v_sent0 AS (
  SELECT i.persona_id, i.item_no AS seq, u.title, i.chamada, i.resumo, i.link, u.site
  FROM v_items i JOIN v_unique u USING (ord))"""
    keep = S.within_days("sent_at", AS, K.LOOKBACK_DAYS)
    first = lambda a: f"coalesce({a}[1], '')"
    out["record_sent"] = with_(*run, sent, _identity_of("v_sent0", "v_sent"), _fold("v_sent"), recursive=True) + f"""
SELECT persona_id, entry_pos, title, chamada, link, normalized_link, title_key, {S.ts_text('sent_at')} AS sent_at FROM (
  SELECT s.persona_id, p.entry_pos, {S.nws("coalesce(s.title, s.chamada, '')")} AS title,
         nullif({S.nws("coalesce(s.chamada, '')")}, '') AS chamada, coalesce(s.link, '') AS link,
         s.nl AS normalized_link, {first('s.tks')} AS title_key, {AS} AS sent_at
  FROM v_placed p JOIN v_sent s ON s.persona_id = p.persona_id AND s.step = p.step
  UNION ALL
  SELECT persona_id, entry_pos, title, chamada, link, normalized_link, title_key, sent_at FROM v_hist h
  WHERE NOT EXISTS (SELECT 1 FROM v_placed p WHERE p.persona_id = h.persona_id AND p.entry_pos = h.entry_pos))
WHERE {keep}"""
    docs = [V_ARTICLES, V_TOPICS, V_PERSONAS, V_DOCS, _cands(K.CATALOGUE_PAGE), V_HIST_RAW, V_HIST, V_DTEXT, V_DITEMS]
    page = K.CATALOGUE_PAGE
    imported = f"""v_mine AS (
  SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY modified_time DESC NULLS LAST, cand_rank) AS doc_rank
  FROM v_cand{page} c WHERE {_doc_match('c.name', 'c.nome')} AND {S.within_days('c.modified_time', AS, K.LOOKBACK_DAYS)}
    AND c.persona_id NOT IN (SELECT DISTINCT persona_id FROM v_hist)),
v_sent0 AS (
  SELECT m.persona_id, row_number() OVER (PARTITION BY m.persona_id ORDER BY m.doc_rank, i.item_no) AS seq,
         i.title, i.title AS chamada, i.resumo, i.link, coalesce(m.modified_time, {AS}) AS sent_at, m.name AS doc_title
  FROM v_mine m JOIN v_items_doc i ON i.id = m.id)"""
    out["hydrate_history"] = with_(*docs, imported, _identity_of("v_sent0", "v_sent"), _fold("v_sent"), recursive=True) + f"""
SELECT persona_id, entry_pos, title, resumo, link, normalized_link, {S.ts_text('sent_at')} AS sent_at, doc_title FROM (
  SELECT s.persona_id, p.entry_pos, {S.nws("coalesce(s.title, s.chamada, '')")} AS title,
         nullif({S.nws("coalesce(s.resumo, '')")}, '') AS resumo, coalesce(s.link, '') AS link,
         s.nl AS normalized_link, s.sent_at, s.doc_title
  FROM v_placed p JOIN v_sent s ON s.persona_id = p.persona_id AND s.step = p.step
  UNION ALL
  SELECT persona_id, entry_pos, title, resumo, link, normalized_link, sent_at, CAST(NULL AS VARCHAR) FROM v_hist h
  WHERE NOT EXISTS (SELECT 1 FROM v_placed p WHERE p.persona_id = h.persona_id AND p.entry_pos = h.entry_pos))
WHERE {keep}"""


def _tail_sql(out: dict[str, str]) -> None:
    out["dedupe_documents"] = with_(V_DOC_ARTS, greedy_scan("v_doc_keys", "ord", "v_ddoc"),
                                    recursive=True) + (
        "SELECT ord, site, title, normalized_link, kept FROM v_ddoc")
    out["history_roundtrip"] = out["history_load"]
    out["import_totals"] = with_(V_ARTICLES, V_TOPICS, V_PERSONAS, V_DOCS, _cands(K.CATALOGUE_PAGE),
                                 V_HIST_RAW, V_HIST, V_DTEXT, V_DITEMS) + f"""
SELECT CAST(count(DISTINCT persona_id) AS BIGINT) AS personas, CAST(count(*) AS BIGINT) AS documents,
       CAST(coalesce(sum(n), 0) AS BIGINT) AS articles
FROM v_cand{K.CATALOGUE_PAGE} c
JOIN (SELECT id, count(*) AS n FROM v_items_doc GROUP BY id) i USING (id)
WHERE c.persona_id NOT IN (SELECT DISTINCT persona_id FROM v_hist)
  AND {_doc_match('c.name', 'c.nome')} AND {S.within_days('c.modified_time', AS, K.LOOKBACK_DAYS)}"""


def _file_sql(out: dict[str, str]) -> None:
    out["personas_file"] = with_(V_TOPICS, V_PERSONAS, V_ARTICLES, V_HIST_RAW) + """
SELECT id, nome, descricao, array_to_string(prioridades, ' | ') AS prioridades, array_to_string(evitar, ' | ') AS evitar,
       id IN (SELECT persona_id FROM v_hist_raw) AS requested
FROM v_personas"""
    # places are counted anew in the file
    out["history_file"] = with_(V_ARTICLES, V_HIST_RAW.replace("ord AS entry_pos", (
        "row_number() OVER (PARTITION BY ord // 10 ORDER BY ord) - 1 AS entry_pos")), V_HIST) + f"""
SELECT persona_id, entry_pos, title, chamada, resumo, link, normalized_link, title_key, {S.ts_text('sent_at')} AS sent_at
FROM v_hist"""
    out["digest_sink"] = f"SELECT *, CAST('{AS_OF[:10]}' AS VARCHAR) AS run_date FROM (\n" + out["render_digest"] + ")"
    out["doc_ids"] = with_(V_ARTICLES) + "SELECT ord AS id, CAST(ord AS VARCHAR) AS doc_id FROM v_articles"


def oracle_sql() -> dict[str, str]:
    out = _sql()
    _io_sql(out)
    _more_sql(out)
    _digest_sql(out)
    _extract_sql(out)
    _docs_sql(out)
    _tail_sql(out)
    _upsert_sql(out)
    _file_sql(out)
    return out
