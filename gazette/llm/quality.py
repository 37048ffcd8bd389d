"""Quality rules: a threshold table compiled into one projection.

``RULES`` is data: (name, measure, comparison, threshold, minimum words).
``apply_rules`` adds the measures of a text and one verdict column; Catalyst
sees a single projection of built-in functions (no user function, no
shuffle), so it runs inside the scan stage and its cost is linear in the
text: repeated windows are found by sorting the window hashes of a text,
never by comparing windows with each other.

Defined results: a null text has no words (all counts 0, ``base_failed``
true); an empty or all-blank text likewise. Repeated rows are judged each on
their own. Other input columns are kept; an input column that has the name
of a result column is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
#: Java pattern of the separators between words.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Frequent function words of the four languages, lower case.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "be", "with", "as", "by", "this",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "des", "im", "auf", "ist", "nicht", "ein", "eine", "für",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "dans", "pour", "sur", "par", "au",
    "el", "los", "y", "las", "por", "con", "para", "se", "del", "al", "lo", "su", "no",
)


@dataclass(frozen=True)
class Rule:
    """Reject when ``measure`` is below ``low`` or above ``high``; texts of
    fewer than ``min_words`` words are not judged by it."""
    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Rules every text must meet (the contract's base).
BASE_RULES = (
    Rule("too_short", "n_words", low=20),
    Rule("repeated_windows", "repeat_word_pct", high=30.0),
)
#: The method's own thresholds.
RULES = (
    Rule("word_length_low", "mean_word_chars", low=2.0),
    Rule("word_length_high", "mean_word_chars", high=20.0),
    Rule("symbols", "symbol_pct", high=5.0),
    Rule("stop_words", "stop_word_pct", low=2.0, min_words=60),
    Rule("repeated_lines", "dup_line_pct", high=60.0),
    Rule("stuttered", "stutter_pct", high=30.0),
    Rule("upper_case", "upper_pct", high=50.0),
    Rule("exclamations", "exclaim_pct", high=30.0),
)


def bind(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once per row (a let expression)."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more."""
    def windows(h: Column) -> Column:
        return F.when(F.size(h) >= WINDOW, F.transform(
            F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(h, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
            return F.sort_array(F.transform(same, lambda e: e["i"]))

        def total(p: Column) -> Column:
            # each start covers WINDOW words, or up to the next start
            return F.aggregate(F.transform(p, lambda i, k: F.least(
                F.coalesce(F.get(p, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("bigint"), lambda a, b: a + b)
        return bind(bind(pairs, starts), total)

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w))
    return bind(bind(hashes, windows), count)


def counts(text: Column) -> Column:
    """The counts of one text as a struct."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SEPARATORS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACE, "") != "")
    stop = dict.fromkeys(STOP_WORDS)
    size = lambda a: F.size(a).cast("bigint")
    of_words = bind(words, lambda w: F.struct(
        size(w).alias("n"),
        size(F.filter(w, lambda x: F.lower(x).isin(*stop))).alias("stop"),
        size(F.filter(w, lambda x, i: F.get(w, i - 1) == x)).alias("stutter"),
        _repeat_words(F.transform(w, lambda x: F.xxhash64(x))).alias("repeat")))
    of_lines = bind(lines, lambda a: F.struct(
        size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("dup")))
    left = lambda rest: (F.length(text) - F.length(rest)).cast("bigint")
    return F.struct(
        of_words.alias("words"), of_lines.alias("lines"),
        F.length(F.translate(text, SPACE, "")).cast("bigint").alias("chars"),
        left(F.translate(text, SYMBOLS, "")).alias("symbols"), left(F.translate(text, "!", "")).alias("exclaim"),
        left(F.regexp_replace(text, "\\p{Lu}", "")).alias("upper"))


def _measures(c: Column) -> Column:
    """What the rules look at, from the counts."""
    n, chars, lines = c["words"]["n"], c["chars"], c["lines"]["n"]
    share = lambda part, whole: 100 * part / F.greatest(whole, F.lit(1))
    return F.struct(
        n.alias("n_words"), chars.alias("word_chars"), c["symbols"].alias("n_symbols"),
        c["lines"]["dup"].alias("n_dup_lines"), c["words"]["repeat"].alias("n_repeat_words"),
        share(c["words"]["repeat"], n).alias("repeat_word_pct"),
        (chars / F.greatest(n, F.lit(1))).alias("mean_word_chars"),
        share(c["symbols"], chars).alias("symbol_pct"), share(c["words"]["stop"], n).alias("stop_word_pct"),
        share(c["words"]["stutter"], n).alias("stutter_pct"), share(c["lines"]["dup"], lines).alias("dup_line_pct"),
        share(c["upper"], chars).alias("upper_pct"), share(c["exclaim"], n).alias("exclaim_pct"))


def _failed(table: tuple[Rule, ...], m: Column) -> Column:
    """Names of the rules of a table that reject."""
    def fails(rule: Rule) -> Column:
        value, bad = m[rule.measure], F.lit(False)
        if rule.low is not None:
            bad = bad | (value < F.lit(rule.low))
        if rule.high is not None:
            bad = bad | (value > F.lit(rule.high))
        return bad & (m["n_words"] >= rule.min_words)
    names = F.array(*[F.when(fails(r), F.lit(r.name)) for r in table]) if table else F.array().cast("array<string>")
    return F.filter(names, lambda x: x.isNotNull())


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(text: Column, base: tuple[Rule, ...] = BASE_RULES, rules: tuple[Rule, ...] = RULES) -> Column:
    """All results for one text as one struct expression. Every intermediate
    value is bound once, so a filter on a field that Catalyst moves below
    other projections still evaluates the text once."""
    def verdict(m: Column) -> Column:
        return bind(F.struct(_failed(base, m).alias("base"), _failed(rules, m).alias("own")), lambda f: F.struct(
            *[m[c].alias(c) for c in MEASURES], (F.size(f["base"]) > 0).alias("base_failed"),
            F.concat(f["base"], f["own"]).alias("failed_rules"),
            ((F.size(f["base"]) == 0) & (F.size(f["own"]) == 0)).alias("kept")))
    return bind(bind(counts(text), _measures), verdict)


def apply_rules(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES,
                rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Input columns plus the measures, ``base_failed``, ``failed_rules``
    (names of all rules that reject the text) and ``kept``."""
    made = {*MEASURES, "base_failed", "failed_rules", "kept"}
    carried = [c for c in docs.columns if c.lower() not in made]
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in carried]).alias("_row"), assess(docs[text], base, rules).alias("_q"))
    return row.select("_row.*", "_q.*")


def passing(docs: DataFrame, text: str = "text", base: tuple[Rule, ...] = BASE_RULES,
            rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows no rule rejects, with their own columns."""
    return docs.where(assess(docs[text], base, rules)["kept"])
