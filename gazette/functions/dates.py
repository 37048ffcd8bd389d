"""Date expressions: the Portuguese date-text chain, recency, digest dates.

``as_of`` is always an explicit timestamp (a Column or a string literal);
nothing here reads the clock, so reruns are deterministic. All results are
TIMESTAMP_NTZ in UTC and no step depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.constants import (DAY_FIRST_DATE, JS_SPACE, MONTH_ABBREVIATIONS, RELATIVE_DATE,
                                         YESTERDAY_WORD)
from gazette.functions.reuse import evaluated, reused
from gazette.functions.text import col_, js_trim, let, normalize_search_text

# The standard form: years of four digits (or a sign and six), date alone or
# with a time and a zone.
_ISO = (r"^([+-]\d{6}|\d{4})(?:-(\d{2})(?:-(\d{2}))?)?"
        r"(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(Z|[+-]\d{2}:\d{2})?)?$")
# The free form, read as tokens: a comment, a time, a word (a run of letters and
# of everything beyond ASCII), a number, a sign.
_COMMENT = r"\([^()]*\)?"
_TIME = r"(\d+):(\d+)(?::(\d+)(?:\.(\d+))?)?"
_WORD = r"[^\x00-@]"
_NOT_IN_WORD = rf"(?<!{_WORD})", rf"(?!{_WORD})"
_HALF_DAY = rf"(?i){_NOT_IN_WORD[0]}([ap])m{_NOT_IN_WORD[1]}"
_ZONE_HOURS = {"z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6,
               "pst": -8, "pdt": -7}
_ZONE_NAME = rf"(?i){_NOT_IN_WORD[0]}({'|'.join(_ZONE_HOURS)}){_NOT_IN_WORD[1]}"
_OFFSET = r"([+-])(\d{1,2})(?::?(\d{2}))?(?!\d)"
_MONTH = rf"(?i){_NOT_IN_WORD[0]}({'|'.join(MONTH_ABBREVIATIONS)}){_WORD}*-?"
_BARE_SLASHES = r"^\d{1,2}/\d{1,2}/\d{4}$"
# JavaScript's \b is ASCII-only; spell it out so Java's Unicode-aware \b does not differ.
RELATIVE_FULL = r"(?<![A-Za-z0-9_])" + RELATIVE_DATE + r"(?![A-Za-z0-9_])"
UNIT_SECONDS = {"minuto": 60, "hora": 3600, "dia": 86400, "semana": 7 * 86400}
# Offsets past this many seconds (about 100k years) fall outside any date
# range; they parse to the earliest timestamp so the recency rule drops them.
MAX_OFFSET_SECONDS = 3_155_760_000_000
EARLIEST = "0001-01-01 00:00:00"


def as_ts(as_of) -> Column:
    return (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp_ntz")


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _ymd(y: Column, m: Column, d: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(_number(y), _number(m), _number(d), zero, zero, zero.cast("decimal(16,6)"))


def minus_seconds(ts: Column, seconds: Column) -> Column:
    """``ts`` moved back; days and seconds apart, as intervals hold no more
    than 10^12 seconds."""
    return ts - F.make_dt_interval(
        F.floor(seconds / 86400).cast("int"), F.lit(0), F.lit(0), F.pmod(seconds, F.lit(86400)).cast("decimal(18,6)"))


def _shifted(day: Column, seconds: Column, micros: Column) -> Column:
    """The start of ``day`` plus whole seconds (negative too) and microseconds."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (seconds.cast("decimal(16,0)") + micros.cast("decimal(16,0)") / 1000000).cast("decimal(18,6)"))


def _moment(year: Column, month: Column, day: Column, time: Column, offset: Column) -> Column:
    """UTC moment of calendar fields; null where one is out of range. Days
    past a month's end run into the next month. ``time`` has the fields h, m, s
    and fraction (digits), ``offset`` counts seconds east."""
    def made(f: Column) -> Column:
        midnight = (f["h"] == 24) & (f["m"] == 0) & (f["s"] == 0) & (F.translate(f["fraction"], "0", "") == "")
        ok = (f["month"].between(1, 12) & f["day"].between(1, 31) & (f["m"] < 60) & (f["s"] < 60) & ((f["h"] < 24) | midnight)
              & f["year"].between(1, 9999))
        micros = F.coalesce(F.rpad(F.substring(f["fraction"], 1, 3), 6, "0").try_cast("int"), F.lit(0))
        seconds = f["h"] * 3600 + f["m"] * 60 + f["s"] - f["offset"]
        return F.when(ok, _shifted(F.date_add(F.make_date(f["year"], f["month"], F.lit(1)), f["day"] - 1), seconds, micros))
    return let(F.struct(year.alias("year"), month.alias("month"), day.alias("day"), time["h"].alias("h"), time["m"].alias("m"),
                        time["s"].alias("s"), time["fraction"].alias("fraction"), offset.alias("offset")), made)


def _clock(h: Column, m: Column, s: Column, fraction: Column) -> Column:
    zero = lambda c: F.coalesce(_number(c), F.lit(0))
    return F.struct(zero(h).alias("h"), zero(m).alias("m"), zero(s).alias("s"), fraction.alias("fraction"))


def _east(sign: Column, hours: Column, minutes: Column) -> Column:
    size = F.coalesce(_number(hours), F.lit(0)) * 3600 + F.coalesce(_number(minutes), F.lit(0)) * 60
    return F.when(sign == "-", -size).otherwise(size)


def _iso(v: Column) -> Column:
    """ISO text in UTC; text without a zone is taken as it stands."""
    names = ("year", "month", "day", "h", "m", "s", "fraction", "zone")

    def read(g: Column) -> Column:
        one = lambda c: F.coalesce(_number(g[c]), F.lit(1))
        east = F.when(g["zone"].rlike("^[+-]"), _east(
            F.substring(g["zone"], 1, 1), F.substring(g["zone"], 2, 2), F.substring(g["zone"], 5, 2))).otherwise(F.lit(0))
        return _moment(_number(g["year"]), one("month"), one("day"), _clock(g["h"], g["m"], g["s"], g["fraction"]), east)
    return let(v, lambda x: F.when(x.rlike(_ISO), let(F.struct(*[
        F.regexp_extract(x, _ISO, i).alias(n) for i, n in enumerate(names, 1)]), read)))


def _free(v: Column, slash_order: str) -> Column:
    """Dates in free form, as browsers read them: numbers, month names, one
    time with an optional half of the day, a zone name or offset, comments in
    parentheses. Words are ignored before the first number and spoil the date after
    it. Three numbers are month, day, year - or year, month, day if the
    first is too large for a day; with a month name, day and year in either
    order. Missing day and month are 1, two-digit years lie in 1950-2049, and text
    without a zone is taken as it stands."""
    def timed(t: Column) -> Column:
        g = lambda i: F.regexp_extract(t, _TIME, i)
        half = F.lower(F.regexp_extract(t, _HALF_DAY, 1))
        has = t.rlike(_TIME)
        clock = _clock(g(1), g(2), g(3), g(4))
        noon = let(clock, lambda c: F.when(half == "", c).when(c["h"].between(0, 12), F.struct(
            (F.pmod(c["h"], 12) + F.when(half == "p", 12).otherwise(0)).alias("h"), c["m"].alias("m"), c["s"].alias("s"),
            c["fraction"].alias("fraction"))))
        name = F.lower(F.regexp_extract(t, _ZONE_NAME, 1))
        # what is left beside the time; a mark stands where an offset may follow
        rest = F.regexp_replace(F.when(has, F.regexp_replace(F.regexp_replace(t, _TIME, "\x01"), _HALF_DAY, " ")).otherwise(t),
                                _ZONE_NAME, "\x01")
        return F.struct(noon.alias("clock"), (~has & (half != "") | (F.regexp_count(t, F.lit(_TIME)) > 1)).alias("bad"),
                        name.alias("zone"), rest.alias("rest"))

    def zoned(t: Column) -> Column:
        at = r"\x01[^\x01+\-\d]*" + _OFFSET
        g = lambda i: F.regexp_extract(t["rest"], at, i)
        named = F.lit(0)
        for zone, hours in _ZONE_HOURS.items():
            named = F.when(t["zone"] == zone, F.lit(hours * 3600)).otherwise(named)
        # an offset replaces what the zone's name says
        east = F.when(t["rest"].rlike(at), _east(g(1), g(2), g(3))).otherwise(named)
        rest = F.translate(F.regexp_replace(t["rest"], at, " "), "\x01", " ")
        month = F.lower(F.regexp_extract(rest, _MONTH, 1))
        rest = F.regexp_replace(F.regexp_replace(rest, _MONTH, " "), r"(\d)-(?=\s*\d)", "$1 ")
        return F.struct(t["clock"].alias("clock"), t["bad"].alias("bad"), east.alias("east"), rest.alias("rest"),
                        F.array_position(F.array(*[F.lit(m) for m in MONTH_ABBREVIATIONS]), month).cast("int").alias("month"))

    def dated(t: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(t["rest"], F.lit(r"\d+"), 0), _number)
        spoiled = t["bad"] | t["rest"].rlike(rf"\d[^\x01]*{_WORD}|{_WORD}\d|\d.*[+\-)]")
        return let(numbers, lambda n: F.when(
            ~spoiled & F.size(n).between(1, 3) & F.forall(n, lambda x: x.isNotNull()) & t["clock"].isNotNull(), _calendar(n, t)))

    def _calendar(n: Column, t: Column) -> Column:
        a, b, c = (F.coalesce(F.get(n, i), F.lit(1)) for i in range(3))
        day_first = a.between(1, 31)
        year = F.when(t["month"] > 0, F.when(day_first, b).otherwise(a)).otherwise(F.when(day_first, c).otherwise(a))
        month = F.when(t["month"] > 0, t["month"]).otherwise(F.when(day_first, a).otherwise(b))
        day = F.when(t["month"] > 0, F.when(day_first, a).otherwise(b)).otherwise(F.when(day_first, b).otherwise(c))
        full = let(year, lambda y: F.when(y.between(0, 49), y + 2000).when(y.between(50, 99), y + 1900).otherwise(y))
        return _moment(full, month, day, t["clock"], t["east"])
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, _COMMENT, " "), f"{JS_SPACE}+", " "),
                                   r"(?i)(?<=\d)T(?=\d+:)", " "))
    found = let(let(let(text, timed), zoned), dated)
    readable = v.rlike(r"\d")
    if slash_order == "dmy":
        readable = readable & ~js_trim(v).rlike(_BARE_SLASHES)
    return F.when(readable, found)


@reused
def parse_date(c, as_of, slash_order: str = "mdy_then_dmy") -> Column:
    """ISO text -> a date in free form, bare m/d/yyyy too if ``slash_order``
    allows -> d/m/y anywhere -> 'ha [cerca de] N unidade(s)' back from
    ``as_of`` -> 'ontem' -> null. Null/empty input is null."""
    v = col_(c)
    nv = normalize_search_text(v)
    return _parse(v, nv, F.regexp_extract(nv, RELATIVE_FULL, 1),
                  F.regexp_extract(nv, RELATIVE_FULL, 2), as_of, slash_order)


def with_parsed_date(df, src: str, as_of, out: str = "published_at",
                     slash_order: str = "mdy_then_dmy"):
    """``df`` with ``parse_date`` of the column ``src``, evaluated once a row."""
    return evaluated(df, out, _bound_date(src, as_of, slash_order))


@reused
def _bound_date(src: str, as_of, slash_order: str) -> Column:
    return let(F.col(src), lambda x: let(normalize_search_text(x), lambda nv: _parse(
        x, nv, F.regexp_extract(nv, RELATIVE_FULL, 1), F.regexp_extract(nv, RELATIVE_FULL, 2), as_of, slash_order)))


def _parse(v: Column, nv: Column, n_txt: Column, unit: Column, as_of, slash_order) -> Column:
    now = as_ts(as_of)
    y = F.regexp_extract(v, DAY_FIRST_DATE, 3)
    year = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).when(F.length(y) == 4, y)
    dmy = F.when(v.rlike(DAY_FIRST_DATE), _ymd(year, F.regexp_extract(v, DAY_FIRST_DATE, 2),
                                               F.regexp_extract(v, DAY_FIRST_DATE, 1)))
    amount = F.when(F.length(n_txt) <= 15, n_txt.try_cast("bigint"))
    unit_s = F.lit(None).cast("bigint")
    for name, secs in UNIT_SECONDS.items():
        unit_s = F.when(unit.startswith(name), F.lit(secs)).otherwise(unit_s)
    offset = F.try_multiply(amount, unit_s)
    relative = F.when(unit != "", F.when(
        offset.isNull() | (offset > MAX_OFFSET_SECONDS), F.lit(EARLIEST).cast("timestamp_ntz"))
        .otherwise(minus_seconds(now, offset)))
    yesterday = F.when(nv.contains(YESTERDAY_WORD), minus_seconds(now, F.lit(86400)))
    parsed = F.coalesce(_iso(js_trim(v)), _free(v, slash_order), dmy, relative, yesterday)
    return F.when(v.isNull() | (v == ""), F.lit(None).cast("timestamp_ntz")).otherwise(parsed)


def is_within_days(ts, as_of, days: int) -> Column:
    """Unknown date -> keep; else not older than ``days`` before ``as_of``."""
    t = col_(ts)
    cutoff = minus_seconds(as_ts(as_of), F.lit(int(days) * 86400))
    # One reference to ``ts``: a pushed-down filter inlines the whole parse
    # expression for every reference.
    return F.coalesce(t >= cutoff, F.lit(True))


def digest_date(ts) -> Column:
    """dd-MM-yyyy."""
    return F.date_format(col_(ts), "dd-MM-yyyy")


def digest_title(name, ts) -> Column:
    """'dd-MM-yyyy | <trimmed name>'."""
    return F.concat(digest_date(ts), F.lit(" | "), js_trim(name))


def ts_text(ts) -> Column:
    """Timestamp as 'yyyy-MM-dd HH:mm:ss' text (stable across engines)."""
    return F.date_format(col_(ts), "yyyy-MM-dd HH:mm:ss")


def parse_iso(c) -> Column:
    """The subset of date text both engines agree on: ISO date / date-time
    with optional zone; anything else is null (callers treat null as keep)."""
    return _iso(col_(c))
