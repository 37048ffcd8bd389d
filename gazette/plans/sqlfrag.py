"""DuckDB SQL fragments mirroring ``gazette.functions`` (for the oracle only).

DuckDB's regexp_replace needs the 'g' option to replace every match, and
its lambdas are written ``lambda x: ...``. The oracle does not percent-
decode/encode query parameters (the test links use only safe characters).
"""

from __future__ import annotations

from gazette.functions import constants as K

WS = K.RE2_SPACE
WS_BODY = K.RE2_SPACE_CLASS_BODY


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def nws(x: str) -> str:
    return f"coalesce({squash(x)}, '')"


def normalize_title(x: str) -> str:
    y = f"strip_accents(lower({nws(x)}))"
    y = f"regexp_replace({y}, {q('[^a-z0-9' + WS_BODY + ']')}, ' ', 'g')"
    return f"trim(regexp_replace({y}, {q(WS + '+')}, ' ', 'g'))"


def normalize_search(x: str) -> str:
    y = f"strip_accents(lower({x}))"
    return f"coalesce(trim(regexp_replace({y}, {q(WS + '+')}, ' ', 'g')), '')"


def truncate(x: str, n: int) -> str:
    y = nws(x)
    return (f"CASE WHEN length({y}) > {n} THEN trim(substr({y}, 1, {max(0, n - 3)})) || '...' "
            f"ELSE {y} END")


def valid_title(x: str) -> str:
    noisy = " OR ".join(f"regexp_matches({x}, {q(p)})" for p in K.NOISE_PATTERNS)
    return f"coalesce({x} IS NOT NULL AND length({x}) >= {K.MIN_TITLE_LENGTH} AND NOT ({noisy}), false)"


def _url(x: str):
    """A link of the form scheme://[user@]host[:port]/path?query#fragment, cut
    at its separators; the tables have no other links. The spelled-out forms are
    in ``link_spellings``, whose expected rows are made without a parser."""
    t = js_trim(f"coalesce({x}, '')")
    bare = f"split_part({t}, '#', 1)"
    scheme = f"lower(split_part({bare}, '://', 1))"
    rest = f"substr({bare}, length({scheme}) + 4)"
    place = f"split_part({rest}, '?', 1)"
    query = f"substr({rest}, length({place}) + 2)"
    authority = f"split_part({place}, '/', 1)"
    path = f"substr({place}, length({authority}) + 1)"
    server = f"list_last(string_split({authority}, '@'))"
    host = f"lower(split_part({server}, ':', 1))"
    port = f"split_part({server}, ':', 2)"
    usual = f"CASE {scheme} WHEN 'http' THEN '80' WHEN 'ws' THEN '80' WHEN 'ftp' THEN '21' ELSE '443' END"
    port_part = f"(CASE WHEN {port} IN ('', {usual}) THEN '' ELSE ':' || {port} END)"
    ok = (f"(contains({bare}, '://') AND {scheme} IN ('http', 'https', 'ws', 'wss', 'ftp') AND {host} <> '' "
          f"AND NOT regexp_matches({host}, '[ %<>^|]') AND coalesce(try_cast('0' || {port} AS BIGINT) <= 65535, false))")
    return dict(t=t, ok=ok, scheme=scheme, host=host, port_part=port_part, path=path, query=query)


def clean_query(query: str) -> str:
    drop = ", ".join(q(p) for p in K.TRACKING_QUERY_PARAMS)
    params = (f"list_transform(list_filter(string_split({query}, '&'), lambda p: p <> ''), "
              f"lambda p, i: {{'k': regexp_extract(p, '(?s)^([^=]*)', 1), 'i': i, "
              f"'v': regexp_extract(p, '(?s)^[^=]*=(.*)$', 1)}})")
    kept = (f"list_filter({params}, lambda s: NOT (starts_with(lower(s.k), "
            f"{q(K.TRACKING_PREFIX)}) OR lower(s.k) IN ({drop})))")
    return f"array_to_string(list_transform(list_sort({kept}), lambda s: s.k || '=' || s.v), '&')"


def normalize_link(x: str) -> str:
    u = _url(x)
    stripped = f"regexp_replace({u['path']}, '/+$', '', 'g')"
    path = f"(CASE WHEN {stripped} = '' THEN '/' ELSE {stripped} END)"
    cq = clean_query(u["query"])
    canon = (f"{u['scheme']} || '://' || {u['host']} || {u['port_part']} || {path} || "
             f"(CASE WHEN {cq} <> '' THEN '?' || {cq} ELSE '' END)")
    return f"(CASE WHEN {u['ok']} THEN {canon} ELSE {u['t']} END)"


def identity_host(link: str, nl: str) -> str:
    base = f"(CASE WHEN {nl} <> '' THEN {nl} ELSE coalesce({link}, '') END)"
    u = _url(base)
    host = f"(CASE WHEN {u['ok']} THEN regexp_replace({u['host']}, '^www\\.', '') ELSE '' END)"
    return f"(CASE WHEN {host} <> '' THEN {host} ELSE 'unknown' END)"


def site_label(x: str) -> str:
    u = _url(x)
    return f"(CASE WHEN {u['ok']} THEN regexp_replace({u['host']}, '^www\\.', '') ELSE {x} END)"


def ts_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def parse_date(v: str, as_of: str) -> str:
    """The shapes that the tables' date texts have, by DuckDB's own formats.
    The others are in ``date_spellings``, whose expected rows are made without
    reading a text."""
    iso = f"try_strptime({v}, ['%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d'])"
    mdy = f"CASE WHEN length({v}) <= 10 THEN try_strptime({v}, '%m/%d/%Y') END"
    found = f"list_filter(string_split_regex({v}, '[^0-9/]+'), lambda p: len(string_split(p, '/')) = 3)[1]"
    dmy = f"coalesce(try_strptime({found}, '%d/%m/%Y'), try_strptime({found}, '%d/%m/%y'))"
    nv = normalize_search(v)
    after = f"string_split(regexp_replace({nv}, '^ha cerca de |^ha ', ''), ' ')"
    seconds = (f"(CASE rtrim({after}[2], 's') WHEN 'minuto' THEN 60 WHEN 'hora' THEN 3600 "
               f"WHEN 'dia' THEN 86400 WHEN 'semana' THEN 604800 END)")
    rel = f"CASE WHEN starts_with({nv}, 'ha ') THEN {as_of} - to_seconds(try_cast({after}[1] AS BIGINT) * {seconds}) END"
    yday = f"CASE WHEN contains({nv}, 'ontem') THEN {as_of} - INTERVAL 1 DAY END"
    return f"(CASE WHEN {v} <> '' THEN coalesce({iso}, {mdy}, {dmy}, {rel}, {yday}) END)"


def within_days(ts: str, as_of: str, days: int) -> str:
    return f"({ts} IS NULL OR {ts} >= {as_of} - to_seconds({int(days) * 86400}))"
