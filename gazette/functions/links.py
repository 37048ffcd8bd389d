"""Link expressions: the URL standard's parser as column expressions.

A link is taken apart as the standard's parser does it, step by step and on
built-in functions: outer control characters and inner tabs go, the scheme
decides between web links (``\\`` counts as ``/``, slashes after the scheme may be
missing) and others (opaque paths, no origin), the host is percent-decoded,
mapped, put into Punycode label by label and read as an IPv4 number where it ends
in one, the path is a stack of segments for ``.`` and ``..`` and is
percent-encoded by the standard's path set, the query is a form. The rare
steps sit in branches that plain links never evaluate. ``try_parse_url`` is not
used because it rejects hosts such as ``a_b.com`` that browsers accept.

Not done: IPv6 addresses are lower-cased, not compressed; of the host mapping
tables only lower case, composition, full-width forms, full stops and ignored
characters; Windows drive letters.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.constants import TRACKING_PREFIX, TRACKING_QUERY_PARAMS
from gazette.functions.reuse import reused
from gazette.functions.text import col_, js_trim, let

DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}

# what the parser reads of a web link: scheme, authority, path, query
_WEB = r"(?is)^(https?|wss?|ftp):[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
# any other: scheme, authority with its slashes, path, query
_OTHER = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_HOST_PORT = r"^(\[[^\]]*\]|[^:\[\]]*)(?::([0-9]*))?$"
_FORBIDDEN_IN_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]"
# the path percent-encode set, as its complement
_PLAIN_IN_PATH = r"[\x21\x24-\x3B\x3D\x40-\x5D\x5F\x61-\x7A\x7C\x7E]"
_DOT = r"(?:\.|%2[eE])"


def _characters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.substring(text, i, 1))


def _percent_encoded(text: Column, plain: str) -> Column:
    """UTF-8 percent-encoding of every character outside the class ``plain``."""
    return let(text, lambda t: F.when(t.rlike("[^" + plain[1:]), F.array_join(F.transform(
        _characters(t), lambda c: F.when(c.rlike("^" + plain), c).otherwise(
            F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), "")).otherwise(t))


def _without_dots(path: Column) -> Column:
    """The path after ``.`` and ``..`` segments: a stack of segments. A dot
    segment at the end leaves an empty segment."""
    def step(stack: Column, part: Column) -> Column:
        # kind: 0 a name, 1 a dot segment, 2 a way up
        pushed = F.when(part["kind"] == 0, F.array(part["s"])).when(part["last"], F.array(F.lit("")))
        left = F.when(part["kind"] == 2, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
        return F.concat(left, F.coalesce(pushed, F.array().cast("array<string>")))
    part = lambda a: F.transform(a, lambda s, i: F.struct(
        s.alias("s"), (i == F.size(a) - 1).alias("last"),
        F.when(s.rlike(f"^{_DOT}$"), 1).when(s.rlike(f"^{_DOT}{_DOT}$"), 2).otherwise(0).alias("kind")))
    return let(path, lambda p: F.when(p.rlike(f"/{_DOT}{{1,2}}(/|$)"), F.concat(F.lit("/"), F.array_join(F.aggregate(
        let(F.split(F.substring(p, 2, 1 << 20), "/", -1), part), F.array().cast("array<string>"), step), "/"))).otherwise(p))


@lru_cache(maxsize=1)
def _compositions() -> str:
    """(letter, mark, composed letter) triples in one string, by rule from the
    character database: Latin, Greek and Cyrillic."""
    triples = []
    for cp in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            triples.append(chr(int(parts[0], 16)) + chr(int(parts[1], 16)) + chr(cp))
    return "".join(triples)


def _composed(text: Column) -> Column:
    """Letters followed by combining marks as composed letters."""
    def step(done: Column, c: Column) -> Column:
        return let(F.instr(F.lit(_compositions()), F.concat(F.right(done, F.lit(1)), c)), lambda at: F.when(
            (at > 0) & (done != ""), F.concat(F.substring(done, F.lit(1), F.length(done) - 1),
                                              F.substring(F.lit(_compositions()), at + 2, F.lit(1)))).otherwise(F.concat(done, c)))
    return let(text, lambda t: F.when(t.rlike("[\\u0300-\\u036F]"), F.aggregate(_characters(t), F.lit(""), step)).otherwise(t))


def _digits(delta: Column, bias: Column) -> Column:
    """A Punycode number of variable length (RFC 3492, 6.3); eight digits
    hold more than any label needs."""
    def step(s: Column, k: Column) -> Column:
        t = F.least(F.greatest(k * 36 - bias, F.lit(1)), F.lit(26))
        last = s["q"] < t
        digit = F.when(last, s["q"]).otherwise(t + F.pmod(s["q"] - t, 36 - t))
        return F.when(s["done"], s).otherwise(F.struct(
            F.floor((s["q"] - t) / (36 - t)).alias("q"),
            F.concat(s["out"], F.substring(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), (digit + 1).cast("int"), F.lit(1))).alias("out"),
            last.alias("done")))
    start = F.struct(delta.cast("long").alias("q"), F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long")), start, step, lambda s: s["out"])


def _bias(delta: Column, points: Column, first: Column) -> Column:
    """Bias adaptation (RFC 3492, 6.1)."""
    halved = F.when(first, F.floor(delta / 700)).otherwise(F.floor(delta / 2))
    start = let(halved, lambda d: F.struct((d + F.floor(d / points)).alias("d"), F.lit(0).cast("long").alias("k")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, lambda s, _: F.when(s["d"] > 455, F.struct(
        F.floor(s["d"] / 35).alias("d"), (s["k"] + 36).alias("k"))).otherwise(s),
        lambda s: s["k"] + F.floor(s["d"] * 36 / (s["d"] + 38)))


def punycode(label: Column) -> Column:
    """A host label in Punycode (RFC 3492) if it has characters beyond ASCII."""
    def encoded(points: Column) -> Column:
        basic = F.filter(points, lambda c: c < 128)
        n_basic = F.size(basic).cast("long")

        def at_point(s: Column, c: Column, m: Column) -> Column:
            delta = s["delta"] + (c < m).cast("long")
            return F.when(c != m, F.struct(delta.alias("delta"), s["bias"].alias("bias"), s["h"].alias("h"), s["out"].alias("out"))).otherwise(
                F.struct(F.lit(0).cast("long").alias("delta"), _bias(delta, s["h"] + 1, s["h"] == n_basic).alias("bias"),
                         (s["h"] + 1).alias("h"), F.concat(s["out"], _digits(delta, s["bias"])).alias("out")))

        def at_value(s: Column, m: Column) -> Column:
            inner = F.struct((s["delta"] + (m - s["n"]) * (s["h"] + 1)).alias("delta"), s["bias"].alias("bias"),
                             s["h"].alias("h"), s["out"].alias("out"))
            return F.aggregate(points, inner, lambda t, c: at_point(t, c, m), lambda t: F.struct(
                (m + 1).alias("n"), (t["delta"] + 1).alias("delta"), t["bias"].alias("bias"), t["h"].alias("h"), t["out"].alias("out")))
        start = F.struct(
            F.lit(128).cast("long").alias("n"), F.lit(0).cast("long").alias("delta"), F.lit(72).cast("long").alias("bias"), n_basic.alias("h"),
            F.concat(F.array_join(F.transform(basic, lambda c: F.char(c)), ""), F.when(n_basic > 0, "-").otherwise("")).alias("out"))
        return F.aggregate(F.array_sort(F.array_distinct(F.filter(points, lambda c: c >= 128))), start, at_value, lambda s: s["out"])
    return let(label, lambda x: F.when(x.rlike(r"[^\x00-\x7F]"), F.concat(F.lit("xn--"), let(
        F.transform(_characters(x), lambda c: F.ascii(c).cast("long")), encoded))).otherwise(x))


def _mapped_host(host: Column) -> Column:
    """Percent-decoded, composed, lower-cased, with ASCII forms of full-width
    characters and full stops and without ignored characters."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3002\uff61"
    narrow = "".join(chr(c) for c in range(0x21, 0x7F)) + ".."
    ignored = "\u00ad\u200b\u2060\ufeff"

    def mapped(h: Column) -> Column:
        decoded = F.coalesce(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))), h)
        plain = F.lower(F.translate(_composed(F.lower(decoded)), wide + ignored, narrow))
        return F.when(h.rlike(r"[^\x21-\x24\x26-\x7E]"), F.array_join(F.transform(F.split(plain, "\\.", -1), punycode), "."))\
            .otherwise(F.lower(h))
    return let(host, mapped)


def _ipv4(host: Column) -> Column:
    """The dotted form of a host that ends in a number; null if it is none."""
    def number(p: Column) -> Column:
        return F.when(p.rlike("^0x[0-9a-f]*$"), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 20)), 16, 10)).when(
            p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).when(p.rlike("^(0|[1-9][0-9]*)$"), p).try_cast("decimal(20,0)")

    def dotted(n: Column) -> Column:
        last, size = F.element_at(n, -1), F.size(n)
        ok = (size <= 4) & F.forall(n, lambda x: x.isNotNull()) & F.forall(F.slice(n, F.lit(1), size - 1), lambda x: x < 256) & (
            last < F.pow(F.lit(256.0), 5 - size))
        powers = F.transform(F.slice(n, F.lit(1), size - 1), lambda x, i: x.cast("long") * F.pow(F.lit(256.0), 3 - i).cast("long"))
        value = F.aggregate(powers, last.cast("long"), lambda a, b: a + b)
        return F.when(ok, let(value, lambda v: F.concat_ws(".", *[
            F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])))
    parts = F.split(F.regexp_replace(host, r"\.$", ""), "\\.", -1)
    return let(F.transform(parts, number), dotted)


_PARTS = ("trimmed", "ok", "scheme", "host", "port_part", "path", "query", "origin", "opaque")


def _web_parts(t: Column, trimmed: Column) -> Column:
    def read(g: Column) -> Column:
        scheme = F.lower(g["scheme"])
        authority = F.regexp_replace(g["authority"], "(?s)^.*@", "")
        host = F.regexp_extract(authority, _HOST_PORT, 1)
        host = F.when(host.startswith("["), F.lower(host)).otherwise(_mapped_host(host))
        return F.struct(scheme.alias("scheme"), host.alias("host"), F.regexp_extract(authority, _HOST_PORT, 2).alias("port"),
                        authority.rlike(_HOST_PORT).alias("readable"),
                        F.translate(g["path"], "\\", "/").alias("path"), g["query"].alias("query"))

    def made(r: Column) -> Column:
        numeric = r["host"].rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
        host = F.when(numeric, _ipv4(r["host"])).otherwise(r["host"])
        port = F.when(r["port"] != "", r["port"].try_cast("decimal(38,0)"))
        default = F.lit(None).cast("int")
        for name, value in DEFAULT_PORTS.items():
            default = F.when(r["scheme"] == name, F.lit(value)).otherwise(default)
        address = r["host"].rlike(r"^\[[0-9a-f:.]+\]$")
        ok = (r["readable"] & (r["host"] != "") & (address | ~r["host"].rlike(_FORBIDDEN_IN_HOST)) & ~(numeric & host.isNull())
              & ((r["port"] == "") | (port.isNotNull() & (port <= 65535))))
        port_part = F.when(port.isNull() | (port == default), F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("string")))
        path = _without_dots(_percent_encoded(F.when(r["path"] == "", F.lit("/")).otherwise(r["path"]), _PLAIN_IN_PATH))
        return F.struct(trimmed.alias("trimmed"), ok.alias("ok"), r["scheme"].alias("scheme"), F.coalesce(host, F.lit("")).alias("host"),
                        port_part.alias("port_part"), path.alias("path"), r["query"].alias("query"),
                        F.concat(r["scheme"], F.lit("://"), F.coalesce(host, F.lit("")), port_part).alias("origin"), F.lit(False).alias("opaque"))
    groups = F.struct(*[F.regexp_extract(t, _WEB, i).alias(n) for i, n in enumerate(("scheme", "authority", "path", "query"), 1)])
    return let(let(groups, read), made)


def _other_parts(t: Column, trimmed: Column) -> Column:
    def made(g: Column) -> Column:
        file = F.lower(g["scheme"]) == "file"
        path = F.when(file, F.translate(g["path"], "\\", "/")).otherwise(g["path"])
        opaque = (g["authority"] == "") & ~path.startswith("/") & ~file
        rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
        path = F.when(opaque, _percent_encoded(path, r"[\x20-\x7E]")).otherwise(_without_dots(_percent_encoded(rooted, _PLAIN_IN_PATH)))
        host = F.regexp_extract(F.regexp_replace(F.substring(g["authority"], 3, 1 << 20), "(?s)^.*@", ""), _HOST_PORT, 1)
        return F.struct(trimmed.alias("trimmed"), (t.rlike(_OTHER) & ~host.rlike(r"[\x00-\x20<>^|]")).alias("ok"),
                        F.lower(g["scheme"]).alias("scheme"), F.coalesce(host, F.lit("")).alias("host"), F.lit("").alias("port_part"),
                        path.alias("path"), g["query"].alias("query"), F.lit("null").alias("origin"), opaque.alias("opaque"))
    groups = F.struct(*[F.regexp_extract(t, _OTHER, i).alias(n) for i, n in enumerate(("scheme", "authority", "path", "query"), 1)])
    return let(groups, made)


@reused
def parsed_link(c) -> Column:
    """A link as the parser reads it, one struct: ``ok`` is false where it is
    no URL; ``origin`` is 'null' for all but web links."""
    def read(trimmed: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(trimmed, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
        return let(text, lambda t: F.when(t.rlike(_WEB), _web_parts(t, trimmed)).otherwise(_other_parts(t, trimmed)))
    return let(js_trim(F.coalesce(col_(c), F.lit(""))), read)


def url_parts(c) -> dict[str, Column]:
    """The fields of ``parsed_link`` as columns."""
    link = parsed_link(c)
    return {k: link[k] for k in _PARTS}


def _form_decode(c: Column) -> Column:
    """'+' is a space in a form; a '%' without two digits stands for itself."""
    whole = F.when(c.contains("%"), F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")).otherwise(c)
    return F.coalesce(F.try_url_decode(whole), c)


def clean_query(query: Column) -> Column:
    """Drop tracking parameters, stable-sort by name, re-encode as a form."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    params = F.transform(pieces, lambda p, i: F.struct(
        _form_decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"),
        i.alias("i"),
        _form_decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.filter(params, lambda s: ~(
        F.lower(s["k"]).startswith(TRACKING_PREFIX) | F.lower(s["k"]).isin(*TRACKING_QUERY_PARAMS)))
    encoded = F.transform(F.array_sort(kept), lambda s: F.concat(
        F.url_encode(s["k"]), F.lit("="), F.url_encode(s["v"])))
    return F.when(query == "", F.lit("")).otherwise(F.array_join(encoded, "&"))


def _key_of(p) -> Column:
    stripped = F.when(p["opaque"], p["path"]).otherwise(F.regexp_replace(p["path"], "/+$", ""))
    path = F.when(stripped == "", F.lit("/")).otherwise(stripped)
    key = let(clean_query(p["query"]), lambda q: F.concat(
        p["origin"], path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))))
    return F.when(p["ok"], key).otherwise(p["trimmed"])


@reused
def normalize_link(c) -> Column:
    """canonical link key; unparseable input -> trimmed text; null -> ''."""
    return let(parsed_link(c), _key_of)


def identity_host_from(parts) -> Column:
    """Host of a link minus ``www.``, or 'unknown'.

    A web link keeps its host through normalisation; any other normalises to a
    text that is no URL, or to itself.
    """
    web = parts["ok"] & (parts["origin"] != "null")
    host = F.when(web, F.regexp_replace(parts["host"], r"^www\.", "")).otherwise(F.lit(""))
    return F.when(host != "", host).otherwise(F.lit("unknown"))


@reused
def link_identity(c) -> Column:
    """One struct: ``normalized_link`` and ``host`` (see ``identity_host_from``)."""
    return let(parsed_link(c), lambda p: F.struct(_key_of(p).alias("normalized_link"), identity_host_from(p).alias("host")))


@reused
def site_label(c) -> Column:
    """host without a leading ``www.``; the input itself if unparseable."""
    return let(parsed_link(c), lambda p: F.when(p["ok"], F.regexp_replace(p["host"], r"^www\.", "")).otherwise(col_(c)))


def doc_id_from_link(c) -> Column:
    """first ``/d/<id>/`` segment of a document link (null if none)."""
    return F.nullif(F.regexp_extract(col_(c), r"/d/([^/]+)/", 1), F.lit(""))


def doc_link(doc_id) -> Column:
    """A stored document's link, built from its id (the import's default)."""
    return F.concat(F.lit("https://docs.google.com/document/d/"), col_(doc_id).cast("string"), F.lit("/edit"))
