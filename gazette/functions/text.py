"""Text column expressions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.constants import (ANCHOR_CAPTION_PREFIX, FENCE_CLOSE, FENCE_OPEN,
                                         JS_SPACE)

# Code-point ranges scanned to build the accent-stripping map (Latin, Greek,
# Cyrillic and the extended Latin blocks); the map itself is derived by rule.
_ACCENT_RANGES = [(0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000)]


@lru_cache(maxsize=1)
def accent_map() -> tuple[str, str]:
    """(from, to) strings for ``translate``: every character whose canonical
    decomposition is one base character plus combining marks U+0300-U+036F
    maps to that base character (what NFD followed by mark removal does)."""
    src, dst = [], []
    for lo, hi in _ACCENT_RANGES:
        for cp in range(lo, hi):
            ch = chr(cp)
            decomposed = unicodedata.normalize("NFD", ch)
            if decomposed == ch:
                continue
            base = "".join(c for c in decomposed if not 0x300 <= ord(c) <= 0x36F)
            if len(base) == 1 and base != ch:
                src.append(ch)
                dst.append(base)
    # marks of already decomposed text have no target: translate drops them
    return "".join(src) + "".join(map(chr, range(0x300, 0x370))), "".join(dst)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often the
    body (and a filter pushed below it) refers to it."""
    return F.transform(F.array(value), body)[0]


def js_trim(c) -> Column:
    """Trim the characters JavaScript's ``String.prototype.trim`` removes."""
    return F.regexp_replace(col_(c), f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def squash(c) -> Column:
    """Collapse every whitespace run to one space and trim (null stays null)."""
    return F.trim(F.regexp_replace(col_(c), f"{JS_SPACE}+", " "))


def normalize_whitespace(c) -> Column:
    """collapse whitespace, trim; null becomes ''."""
    return F.coalesce(squash(c), F.lit(""))


def strip_accents(c) -> Column:
    src, dst = accent_map()
    return F.translate(col_(c), src, dst)


def normalize_title(c) -> Column:
    """title key - lower, accents removed, non [a-z0-9] to space, squashed."""
    x = strip_accents(F.lower(normalize_whitespace(c)))
    x = F.regexp_replace(x, f"[^a-z0-9{JS_SPACE[1:-1]}]", " ")
    return F.trim(F.regexp_replace(x, f"{JS_SPACE}+", " "))


def title_words(c) -> Column:
    """The words of ``normalize_title(c)`` (maximal [a-z0-9] runs after
    lower-casing and accent removal) with one regex split instead of the
    full normalisation; may contain '' at the ends."""
    return F.split(strip_accents(F.lower(F.coalesce(col_(c), F.lit("")))), "[^a-z0-9]+")


def normalize_search_text(c) -> Column:
    """lower, accents removed, whitespace squashed; punctuation kept; null -> ''."""
    x = strip_accents(F.lower(col_(c)))
    return F.coalesce(F.trim(F.regexp_replace(x, f"{JS_SPACE}+", " ")), F.lit(""))


#: Characters that count twice in UTF-16.
_WIDE = r"[\x{10000}-\x{10FFFF}]"


def utf16_length(c) -> Column:
    """Length in UTF-16 units, the unit of document offsets and limits."""
    return F.char_length(col_(c)) + F.regexp_count(col_(c), F.lit(_WIDE))


def _first_units(text: Column, units: int) -> Column:
    """The first UTF-16 units of a text; half a character shows as U+FFFD."""
    def step(s: Column, ch: Column) -> Column:
        wide = F.when(ch.rlike(_WIDE), 2).otherwise(1)
        return F.when(s["u"] >= units, s).when(s["u"] + wide <= units, F.struct(
            F.concat(s["t"], ch).alias("t"), (s["u"] + wide).alias("u"))).otherwise(
            F.struct(F.concat(s["t"], F.lit("\ufffd")).alias("t"), F.lit(units).alias("u")))
    chars = F.transform(F.sequence(F.lit(1), F.lit(units)), lambda i: F.substring(text, i, 1))
    folded = F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(0).alias("u")), step, lambda s: s["t"])
    return F.when(text.rlike(_WIDE), folded).otherwise(F.substring(text, 1, units))


def truncate_text(c, max_length: int) -> Column:
    """F8: squash; if longer than max, keep max-3 UTF-16 units (trimmed) and add '...'."""
    units = max(0, max_length - 3)
    return let(normalize_whitespace(c), lambda n: F.when(utf16_length(n) > max_length, F.concat(
        F.trim(_first_units(n, units)) if units else F.lit(""), F.lit("..."))).otherwise(n))


def unique_non_empty(arr) -> Column:
    """distinct, drop null/empty, keep first-seen order."""
    return F.array_distinct(F.filter(col_(arr), lambda x: x.isNotNull() & (x != "")))


def clean_anchor_text(c) -> Column:
    """drop tags, drop one caption prefix, squash."""
    x = F.regexp_replace(col_(c), "<[^>]+>", " ")
    x = F.regexp_replace(x, ANCHOR_CAPTION_PREFIX, "")
    return squash(x)


def strip_fences(c, fallback: str) -> Column:
    """trim; null -> fallback; drop a leading ```json fence and a trailing fence."""
    raw = F.coalesce(js_trim(c), F.lit(fallback))
    raw = F.regexp_replace(raw, FENCE_OPEN, "")
    return F.regexp_replace(raw, FENCE_CLOSE, "")


def clean_topics(arr) -> Column:
    """missing -> empty; trim items; drop null/blank."""
    trimmed = F.transform(F.coalesce(col_(arr), F.array().cast("array<string>")), js_trim)
    return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))


def date_tag(c, max_chars: int | None = 16) -> Column:
    """F16: first ``max_chars`` of the raw date text (None: all), else 'sem data'."""
    text = F.nullif(col_(c), F.lit(""))
    return F.coalesce(text if max_chars is None else F.substring(text, 1, max_chars), F.lit("sem data"))


def decode_basic_entities(c) -> Column:
    """Decode &lt; &gt; &quot; &#39; &nbsp; and finally &amp;."""
    x = col_(c)
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&nbsp;", " ")):
        x = F.replace(x, F.lit(ent), F.lit(ch))
    return F.replace(x, F.lit("&amp;"), F.lit("&"))
