"""Fixed values that must equal the surveyed pipeline's for equal results.

FIXED VALUES — keep as written; they are data, not tuning knobs.
"""

# --- fixed values -----------------------------------------------------------
# Query parameters dropped from links (besides every name starting with utm_).
TRACKING_QUERY_PARAMS = ["fbclid", "gclid", "gs_l", "mc_cid", "mc_eid", "mkt_tok", "ref"]
TRACKING_PREFIX = "utm_"

# Title-noise patterns (the last one is matched case-insensitively).
NOISE_PATTERNS = [
    r"^[A-Z]{3,6}\d[\d.,]+(?:pts|R\$|%)",
    r"^[A-Z]{3,6}\d(?:R\$)?[\d.,%-]+",
    r"R\$[\d.,]+[-+][\d.,]+%",
    r"^\d+[\d.,]+pts",
    r"(?i)^(mais lidas?|redes sociais|onde investir|assine|newsletter|publicidade|login|cadastre)",
]
MIN_TITLE_LENGTH = 15
MIN_CARD_TITLE_LENGTH = 10
MIN_ANCHOR_TITLE_LENGTH = 20

# Date text.
DAY_FIRST_DATE = r"(\d{1,2})/(\d{1,2})/(\d{2,4})"
RELATIVE_DATE = r"ha\s+(?:cerca de\s+)?(\d+)\s+(minuto|minutos|hora|horas|dia|dias|semana|semanas)"
YESTERDAY_WORD = "ontem"
MONTH_ABBREVIATIONS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Anchor-rule portals: host part, blocked path prefixes, blocked first parts.
ANCHOR_HOSTS = ["exame.com"]
ANCHOR_BLOCKED_PREFIXES = [
    "/invest/guia/",
    "/invest/calculadoras/",
    "/tecnologia/examelab/",
    "/edicoes/",
    "/newsletters/",
    "/institucional/",
]
ANCHOR_BLOCKED_FIRST_PARTS = ["autor", "canais-especiais", "pagina-especial"]
ANCHOR_CAPTION_PREFIX = r"(?i)^Imagem referente a noticia:\s*"

# Selectors as (tag, attribute, part of its value), in selector order.
CARD_SELECTORS = [
    ("article", None, None),
    (None, "class", "news-item"),
    (None, "class", "noticia"),
    (None, "class", "card"),
    ("li", "class", "item"),
    (None, "data-testid", "card"),
    (None, "class", "c-card"),
    ("a", "href", "/noticia/"),
    ("a", "href", "/noticias/"),
]
DATE_SELECTORS = [("time", None, None), (None, "class", "date"), (None, "class", "data"), (None, "class", "hora")]
DATE_CONTAINERS = {"div", "li", "section", "main"}
TEXT_SELECTORS = [
    ("article", None, None),
    (None, "class", "content"),
    (None, "class", "article-body"),
    (None, "class", "post-body"),
    ("main", None, None),
]

# Article text.
ARTICLE_TEXT_MIN_CHARS = 200
BODY_FALLBACK_CHARS = 3000
ARTICLE_TEXT_FAILED = "(nao foi possivel extrair)"
ARTICLE_TEXT_FAILED_TOOL = "(nao foi possivel extrair o texto completo)"

# Digest document.
DIGEST_HEADER_PREFIX = "CLIPPING DE NOTICIAS - "
DIGEST_HEADER_LINE = r"(?i)^CLIPPING DE NOTICIAS\b"
DIGEST_ITEM_LINE = r"^\d+\.\s+(.+)$"
DIGEST_LINK_LINE = r"(?i)^Link:\s+(https?://\S+)$"
DOC_TITLE_CURRENT = r"^(\d{2}-\d{2}-\d{4}) \| (.+)$"
LINK_STYLE = "link:rgb(0.1,0.3,0.8):underline"

# Model responses.
FENCE_OPEN = r"(?i)^```(?:json)?\s*"
FENCE_CLOSE = r"(?i)\s*```$"

# History prompt lines.
HISTORY_TITLE_LIMIT = 140
HISTORY_CHAMADA_LIMIT = 110
HISTORY_RESUMO_LIMIT = 220
HISTORY_PROMPT_ITEMS = 8

# Run limits.
MAX_PER_SITE = 20
MAX_PER_SITE_TOOL = 5
MAX_PER_PERSONA = 15
PRESELECT_MULTIPLIER = 2
DAYS_BACK = 3
LOOKBACK_DAYS = 14
SUMMARY_TEXT_LIMIT = 4000
CATALOGUE_PAGE = 50
LATEST_DOC_PAGE = 20

# Empty-site reasons (run / tool wording).
REASON_NO_ELEMENTS = "nenhum elemento compativel na pagina"
REASON_ALL_TITLES = "possivel bloqueio anti-bot (todos os titulos invalidos)"
REASON_DEFAULT = "sem artigos validos no periodo"
TOOL_REASON_NO_ELEMENTS = "nenhum elemento compativel"
TOOL_REASON_ALL_TITLES = "possivel bloqueio anti-bot"

# Warning digest.
WARNING_SHOWN = 3
# --- end of fixed values ----------------------------------------------------

# Whitespace as JavaScript's \s sees it, spelled out (Java's \s is ASCII-only).
JS_SPACE_CLASS_BODY = (r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029"
                       r"\u202f\u205f\u3000\ufeff")
JS_SPACE = "[" + JS_SPACE_CLASS_BODY + "]"
# The same class in RE2 syntax (DuckDB oracle).
RE2_SPACE_CLASS_BODY = (r"\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
                        r"\x{202f}\x{205f}\x{3000}\x{feff}")
RE2_SPACE = "[" + RE2_SPACE_CLASS_BODY + "]"

# --- fixed values: prompt texts ---------------------------------------------
HISTORY_BLOCK_INTRO = (
    "Historico recente que nao pode se repetir. "
    "Considere como repetido o mesmo fato, movimento, anuncio ou materia, "
    "mesmo se o titulo atual estiver reescrito:")
# --- end of fixed values ----------------------------------------------------

# --- fixed values: request prompts (pieces in prompt order) -----------------
PRESELECT_RULES = (
    "Voce e um curador de noticias especializado. Analise os perfis abaixo e selecione artigos "
    "relevantes apenas pelos titulos.\n\n"
    "Regras:\n"
    "- maximo de {max} artigos por cliente\n"
    "- um mesmo artigo pode ser selecionado para multiplos clientes\n"
    "- artigos \"sem data\" devem ser avaliados normalmente\n"
    "- prefira artigos mais recentes quando houver empate\n"
    "- seja criterioso e priorize os temas centrais de cada persona\n"
    "- descarte assuntos perifericos, promocionais, taticos ou fora de contexto\n"
    "- respeite rigidamente a lista \"Evitar\" de cada persona\n"
    "- nunca repita itens listados no historico recente\n"
    "- trate como repetida a mesma noticia mesmo com titulo diferente, se o link, a chamada, "
    "o resumo ou o contexto indicarem o mesmo fato\n\n"
    "Perfis:\n")
PRESELECT_ARTICLES_HEAD = "\n\nArtigos:\n"
PRESELECT_IDS_HEAD = "\n\nResponda apenas com JSON. As chaves devem ser os IDs exatos: "
PRESELECT_FORMAT = '\n\n{\n  "selecao": {\n    "id_cliente": [0, 3, 7]\n  }\n}'
FILTER_HEAD = (
    "Voce e um curador de noticias. Abaixo esta o perfil de um cliente e uma lista de artigos.\n"
    "Selecione apenas os artigos diretamente relevantes para este cliente.\n\n"
    "Regras:\n"
    "- priorize os temas centrais e de maior impacto para a pessoa ou negocio\n"
    "- descarte assuntos perifericos, promocionais, taticos ou fora de contexto\n"
    "- respeite rigidamente a lista \"Evitar\", quando existir\n\n"
    "Perfil do cliente:\n")
FILTER_LIST_HEAD = "\n\nLista de artigos:\n"
FILTER_FOOT = ('\n\nResponda apenas com JSON no formato:\n{"selecionados": [0, 3, 5]}\n\n'
               'Se nenhum for relevante, retorne {"selecionados": []}.')
SUMMARY_HEAD = (
    "Voce e um editor de noticias. Gere um JSON com:\n"
    "- \"chamada\": titulo impactante com no maximo 15 palavras\n"
    "- \"resumo\": resumo objetivo com 3 a 5 frases\n"
    "- \"link\": URL original do artigo\n\n"
    "Responda apenas com JSON, sem markdown.\n\n")
PRESELECT_PARAMS = (0.2, 1024)
FILTER_PARAMS = (0.2, 256)
SUMMARY_PARAMS = (0.3, 320)
PRESELECT_FALLBACK = '{"selecao":{}}'
FILTER_FALLBACK = '{"selecionados":[]}'
SUMMARY_FALLBACK = "{}"
# --- end of fixed values ----------------------------------------------------

# Characters of the shared article list in one prompt (a limit of this library's own).
PROMPT_PAGE_CHARS = 20000
