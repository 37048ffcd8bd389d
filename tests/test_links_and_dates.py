"""Links and dates against literal expected rows."""

import random

import pytest
from pyspark.sql import functions as F

from gazette.functions.dates import parse_date, with_parsed_date
from gazette.functions.links import link_identity, normalize_link, punycode, site_label

NOW = "2026-05-06 12:00:00"
LINKS = [
    ("https://site.com/path/?utm_source=x&b=2#top", "https://site.com/path?b=2", "site.com"),
    # segments
    ("https://x.com/a/../b/", "https://x.com/b", "x.com"),
    ("HTTPS:///X.com:443//a/./b/..", "https://x.com//a", "x.com"),
    ("https://x.com/%2e%2E/a/%2e", "https://x.com/a", "x.com"),
    ("https://a_b.com/..", "https://a_b.com/", "a_b.com"),
    ("https://x.com/...", "https://x.com/...", "x.com"),
    # escapes
    ("https://x.com/ação", "https://x.com/a%C3%A7%C3%A3o", "x.com"),
    ("https://x.com/a%C3%A7%C3%A3o/", "https://x.com/a%C3%A7%C3%A3o", "x.com"),
    ("https://x.com/a%c3%a7/", "https://x.com/a%c3%a7", "x.com"),
    ("https://x.com/a%2Fb/", "https://x.com/a%2Fb", "x.com"),
    ("https://x.com/😀", "https://x.com/%F0%9F%98%80", "x.com"),
    ("https://x.com/a^b{c}|d~e'f\"g<h>`", "https://x.com/a%5Eb%7Bc%7D|d~e'f%22g%3Ch%3E%60", "x.com"),
    ("https://x.com/a\tb\n", "https://x.com/ab", "x.com"),
    # queries
    ("https://x.com/?a=1&a=0&utm_x=2&B=3&&=", "https://x.com/?=&B=3&a=1&a=0", "x.com"),
    ("https://x.com/?q=são paulo&b=%zz+1&REF=1", "https://x.com/?b=%25zz+1&q=s%C3%A3o+paulo", "x.com"),
    # slashes and schemes
    ("https://x.com\\a\\b", "https://x.com/a/b", "x.com"),
    ("https:x.com/a", "https://x.com/a", "x.com"),
    ("http:\\\\x.com", "http://x.com/", "x.com"),
    ("http://user:p@ss@x.com:80/", "http://x.com/", "x.com"),
    ("http://x.com:0080", "http://x.com/", "x.com"),
    ("http://x.com:8080", "http://x.com:8080/", "x.com"),
    ("wss://www.x.com:443/a/", "wss://www.x.com/a", "x.com"),
    ("mailto:a@b.com", "nulla@b.com", "unknown"),
    ("javascript:void(0)", "nullvoid(0)", "unknown"),
    ("file:///a/b/", "null/a/b", "unknown"),
    ("foo://h/p/../q/?b=1&a=2", "null/q?a=2&b=1", "unknown"),
    # hosts
    ("https://bücher.de/x", "https://xn--bcher-kva.de/x", "xn--bcher-kva.de"),
    ("https://BÜCHER.de/", "https://xn--bcher-kva.de/", "xn--bcher-kva.de"),
    ("https://B%C3%BCCHER.de/", "https://xn--bcher-kva.de/", "xn--bcher-kva.de"),
    ("https://straße.de", "https://xn--strae-oqa.de/", "xn--strae-oqa.de"),
    ("https://президент.рф/", "https://xn--d1abbgf6aiiy.xn--p1ai/", "xn--d1abbgf6aiiy.xn--p1ai"),
    ("https://例え.テスト/あ b", "https://xn--r8jz45g.xn--zckzah/%E3%81%82%20b", "xn--r8jz45g.xn--zckzah"),
    ("https://ｅｘａｍｐｌｅ。com/", "https://example.com/", "example.com"),
    ("https://x%2ecom/", "https://x.com/", "x.com"),
    ("http://0x7f.1/a", "http://127.0.0.1/a", "127.0.0.1"),
    ("http://3232235777/", "http://192.168.1.1/", "192.168.1.1"),
    ("https://[2001:DB8::1]:443/x", "https://[2001:db8::1]/x", "[2001:db8::1]"),
    # no links: the trimmed text
    ("http://1.2.3.4.5/", "http://1.2.3.4.5/", "unknown"),
    ("http://09.1/", "http://09.1/", "unknown"),
    (" http://x.com:99999/ ", "http://x.com:99999/", "unknown"),
    ("http://x.com:8a/", "http://x.com:8a/", "unknown"),
    ("http://a b.com/", "http://a b.com/", "unknown"),
    ("https://", "https://", "unknown"),
    ("//x.com/a", "//x.com/a", "unknown"),
    ("not a url", "not a url", "unknown"),
    ("", "", "unknown"),
    (None, "", "unknown"),
]


def test_links(spark):
    df = spark.createDataFrame([(i, link) for i, (link, *_) in enumerate(LINKS)], "i int, link string")
    rows = df.select("i", "link", link_identity("link").alias("u")).select("i", "u.normalized_link", "u.host", site_label("link")).orderBy("i").collect()
    for (link, key, host), (_, got_key, got_host, label) in zip(LINKS, rows, strict=True):
        assert (got_key, got_host) == (key, host), link
        if host != "unknown":
            assert label == host


def test_a_key_is_its_own_key(spark):
    df = spark.createDataFrame([(key,) for _, key, host in LINKS if host != "unknown"], "link string")
    assert all(r[0] == r[1] for r in df.select("link", normalize_link("link")).collect())


def test_punycode_against_the_codec(spark):
    rng = random.Random(4)
    labels = ["".join(rng.choice("abcz-09éüçãñабвгд例テスト語中文ßø😀") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    got = spark.createDataFrame([(x,) for x in labels], "l string").select("l", punycode(F.col("l"))).collect()
    assert all(p == (x if x.isascii() else "xn--" + x.encode("punycode").decode()) for x, p in got)


DATES = [
    # standard forms
    ("2026-05-06T12:00:00Z", "2026-05-06 12:00:00"),
    ("2026-05-06T12:00:00.5-03:00", "2026-05-06 15:00:00.5"),
    ("2026-05-06T12:00", "2026-05-06 12:00:00"),
    ("2026-05-06", "2026-05-06 00:00:00"),
    ("2026-05", "2026-05-01 00:00:00"),
    ("2026", "2026-01-01 00:00:00"),
    ("+002026-05-06", "2026-05-06 00:00:00"),
    ("2026-05-06T24:00:00Z", "2026-05-07 00:00:00"),
    ("2026-05-06T25:00:00Z", None),
    ("2026-02-31", "2026-03-03 00:00:00"),
    # free forms
    ("Wed, 06 May 2026 12:00:00 -0300", "2026-05-06 15:00:00"),
    ("Wed May 06 2026 12:00:00 GMT-0300 (BRT)", "2026-05-06 15:00:00"),
    ("Mon, 06 May 2026 12:00:00 GMT", "2026-05-06 12:00:00"),
    ("6 May 2026 10:30 PM", "2026-05-06 22:30:00"),
    ("12:00 am May 6 2026", "2026-05-06 00:00:00"),
    ("13:00 PM May 6 2026", None),
    ("May 6 2026 12:00 EST", "2026-05-06 17:00:00"),
    ("May 6 2026 10:00:00.123 UTC+2", "2026-05-06 08:00:00.123"),
    ("2026-05-06T12:00:00-0300", "2026-05-06 15:00:00"),
    ("2026-05-06 10:00", "2026-05-06 10:00:00"),
    ("2026/05/06", "2026-05-06 00:00:00"),
    ("2026-5-6", "2026-05-06 00:00:00"),
    ("May 6, 2026", "2026-05-06 00:00:00"),
    ("6-May-2026", "2026-05-06 00:00:00"),
    ("May 2026", "2026-05-01 00:00:00"),
    ("(comment) May 6, 2026", "2026-05-06 00:00:00"),
    ("06.05.2026", "2026-06-05 00:00:00"),
    ("06/05/2026", "2026-06-05 00:00:00"),
    ("5/6/70", "1970-05-06 00:00:00"),
    ("5/6/26", "2026-05-06 00:00:00"),
    ("março 6, 2026", "2026-03-06 00:00:00"),
    # a word after a number: no free form
    ("6 May 2026, Wed", None),
    ("6 de maio de 2026", None),
    ("abc12", None),
    # day first, then texts about now
    ("25/12/2026", "2026-12-25 00:00:00"),
    ("06/05/2026 às 10:30", "2026-05-06 00:00:00"),
    ("06/05/26 10h30", "2026-05-06 00:00:00"),
    ("13/13/2026", None),
    ("há 2 horas", "2026-05-06 10:00:00"),
    ("Atualizado há 3 dias", "2026-05-03 12:00:00"),
    ("há cerca de 1 semana", "2026-04-29 12:00:00"),
    ("Ontem às 12:30", "2026-05-05 12:00:00"),
    ("12:30", None),
    ("sem hora", None),
    ("", None),
    (None, None),
]


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
def test_dates(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(DATES)], "i int, t string")
        df = with_parsed_date(df, "t", NOW, "again").select("i", parse_date("t", NOW).cast("string"), F.col("again").cast("string"))
        rows = df.orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for (text, want), (_, got, again) in zip(DATES, rows, strict=True):
        assert got == want and again == want, text


def test_slashes_day_first(spark):
    got = spark.range(1).select(*[parse_date(F.lit(t), NOW, slash_order="dmy").cast("string") for t in ("06/05/2026", "2026/05/06")]).first()
    assert list(got) == ["2026-05-06 00:00:00", "2026-05-06 00:00:00"]
