"""Lengths, cuts and offsets in UTF-16 units."""

from pyspark.sql import functions as F

from gazette.functions.text import truncate_text, utf16_length
from gazette.operators.extract import page_cards
from gazette.operators.quality import is_valid_title
from gazette.operators.render import digest_spans, render_digest

TEXTS = ["", "abc", "😀", "a😀b😀c", "notícia 😀 longa de verdade", "😀" * 9, "x" * 30, None]


def units(text):
    return len(text.encode("utf-16-le")) // 2


def cut(text, most):
    text = " ".join((text or "").split())
    if units(text) <= most:
        return text
    return text.encode("utf-16-le")[:2 * (most - 3)].decode("utf-16-le", "replace").strip() + "..."


def test_lengths_and_cuts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for r in df.select("t", utf16_length("t").alias("n"), *[truncate_text("t", m).alias(f"m{m}") for m in (5, 8, 20)]).collect():
        assert r.n == (None if r.t is None else units(r.t))
        for m in (5, 8, 20):
            assert r[f"m{m}"] == cut(r.t, m), (r.t, m)


def test_an_emoji_in_a_headline_moves_the_later_spans(spark):
    items = spark.createDataFrame([("p", 1, "Alta 😀 da bolsa", "Resumo 😀", "https://x.com/a"), ("p", 2, "Outra", "Texto", "https://x.com/b")],
                                  "persona_id string, item_no long, chamada string, resumo string, link string")
    personas = spark.createDataFrame([("p", "P")], "id string, nome string")
    body = render_digest(items, personas, "2026-05-06 12:00:00").first()["body"].encode("utf-16-le")
    spans = [tuple(r) for r in digest_spans(items, "2026-05-06 12:00:00").orderBy("span_no").select("start", "end").collect()]
    text = [body[2 * (a - 1):2 * (b - 1)].decode("utf-16-le").strip() for a, b in spans]
    assert text[1:] == ["Alta 😀 da bolsa".join(["1. ", ""]), "https://x.com/a", "2. Outra", "https://x.com/b"]


def test_title_limits_count_units(spark):
    ok = spark.range(1).select(is_valid_title(F.lit("😀" * 8)), is_valid_title(F.lit("😀" * 7))).first()
    assert list(ok) == [True, False]
    html = "<article><h2>{}</h2><a href='/a'>x</a></article>"
    assert len(list(page_cards("https://x.com", html.format("😀" * 5)))) == 1 and not list(page_cards("https://x.com", html.format("😀" * 4)))
