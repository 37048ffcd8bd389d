from pyspark.sql import functions as F

from gazette.operators import extract as ex
from gazette.operators import requests as rq

PAGE = ("<html><head><script>var x='<article>no</article>';</script></head><body><nav><ul>"
        "<li><a href=\"/secao/materia-longa-com-titulo\">Uma materia com titulo bem longo</a></li>"
        "<li><a href=\"/autor/fulano/x\">Autor com nome bem comprido aqui</a></li>"
        "<li><a href=\"/edicoes/2026/01\">Edicao com um titulo comprido</a></li></ul></nav>"
        "<article><h1>Titulo</h1><p>" + "palavra " * 40 + "</p></article></body></html>")


def test_article_text_prefers_article(spark):
    df = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    t = df.select(ex.article_text(F.col("html")).alias("t")).first()["t"]
    assert t.startswith("Titulo palavra palavra") and len(t) > 200


def rows(spark, frame):
    return [tuple(r) for r in frame.drop("page_id").orderBy("pos").collect()]


def page(spark, html, url="https://p.com/a/b/page"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def test_card_title_is_the_first_rendered_line(spark):
    html = ("<div class='card'>\n   <div>\n      <span>Porto  amplia\n  o cais</span>\n   </div><p>resto</p>"
            "<a href='/n/1?a=1&amp;b=2'>ler</a></div>"
            "<article>\n\n<a href=c/d>Linha de trem &eacute; aberta<br>detalhe</a></article>")
    assert rows(spark, ex.extract_cards(page(spark, html))) == [
        (0, "Linha de trem é aberta", "https://p.com/a/b/c/d", None),
        (1, "Porto amplia o cais", "https://p.com/n/1?a=1&b=2", None)]


def test_unclosed_and_nested_tags(spark):
    html = "<ul>" + "".join(f"<li class=item><a href='/n/{i}'>Item numero {i} da lista</a>" for i in range(1500)) + "</ul>"
    got = rows(spark, ex.extract_cards(page(spark, html)))
    assert len(got) == 1500 and got[1499][1:3] == ("Item numero 1499 da lista", "https://p.com/n/1499")
    deep = "<div>" * 5000 + "<article><h2>Titulo bem fundo</h2><a href='/x'>y</a></article>"
    assert rows(spark, ex.extract_cards(page(spark, deep))) == [(0, "Titulo bem fundo", "https://p.com/x", None)]


def test_text_of_nested_containers(spark):
    inner = "<div class='content'><div><p>" + "um " * 60 + "</p></div><div><p>" + "dois " * 40 + "</p></div></div>"
    html = "<body><nav><p>menu</p></nav>" + inner + "<footer>rodape</footer></body>"
    assert ex.page_text(html) == ("um " * 60 + "dois " * 40).strip()


def test_anchor_date_and_attributes(spark):
    html = ("<section><time datetime='2026-05-06T10:00:00Z'>x</time><ul><li><span class='data'>06/05/2026</span>"
            "<a href='/secao/uma-materia'>Uma <b>materia</b> com titulo longo</a></li>"
            "<li><a href='/secao/outra'><img alt='Imagem referente a noticia: Titulo que vem da imagem'></a></li></ul>"
            "<a href='/secao/terceira#x'>Terceira materia sem lista</a></section>")
    assert rows(spark, ex.extract_anchors(page(spark, html))) == [
        (0, "Uma materia com titulo longo", "https://p.com/secao/uma-materia", "06/05/2026"),
        (1, "Titulo que vem da imagem", "https://p.com/secao/outra", None),
        (2, "Terceira materia sem lista", "https://p.com/secao/terceira#x", "2026-05-06T10:00:00Z")]


def test_hosts_choose_their_rule(spark):
    html = "<li class='item'><a href='/secao/x'>Uma materia com titulo longo</a></li>"
    by_anchor = ex.extract_candidates(page(spark, html, "https://portal.net/"), anchor_hosts=("portal.net",))
    assert rows(spark, by_anchor)[0][2] == "https://portal.net/secao/x"
    short = page(spark, "<li class='item'><a href='/x'>Titulo curto</a></li>", "https://portal.net/")
    assert rows(spark, ex.extract_candidates(short, anchor_hosts=("portal.net",))) == []
    assert len(rows(spark, ex.extract_candidates(short))) == 1


def test_article_text_body_fallback(spark):
    html = "<html><body><article>curto</article><p>" + "x" * 5000 + "</p></body></html>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    t = df.select(ex.article_text(F.col("html")).alias("t")).first()["t"]
    assert len(t) == 3000


def test_anchor_rules(spark):
    df = spark.createDataFrame([(1, "https://portal.com/home", PAGE)], "page_id long, url string, html string")
    got = ex.extract_anchors(df).collect()
    assert [(r["link"], r["title"]) for r in got] == [
        ("https://portal.com/secao/materia-longa-com-titulo", "Uma materia com titulo bem longo")]


def test_cards_first_per_link(spark):
    html = ("<html><body><article><h2>Primeiro titulo longo</h2><a href=\"/n/1\">a</a>"
            "<time datetime=\"2026-05-06T10:00:00Z\">x</time></article>"
            "<div class=\"card\"><h3>Outro titulo longo</h3><a href=\"/n/1\">b</a></div>"
            "<li class=\"item\"><a href=\"/n/2\">Curto</a></li>"
            "<a href=\"/noticia/abc\">Noticia pelo link direto</a></body></html>")
    df = spark.createDataFrame([(1, "https://p.com/", html)], "page_id long, url string, html string")
    got = [(r["pos"], r["title"], r["link"], r["date_str"]) for r in ex.extract_cards(df).orderBy("pos").collect()]
    assert got == [(0, "Primeiro titulo longo", "https://p.com/n/1", "2026-05-06T10:00:00Z"),
                   (1, "Noticia pelo link direto", "https://p.com/noticia/abc", None)]


def test_selection_decode_rules(spark):
    arts = spark.createDataFrame([(0,), (1,), (2,), (3,)], "ord long")
    comp = spark.createDataFrame([
        ("r1", '```json\n{"selecao": {"a": [0, 1.0, 2.5, "3", true, -1, 9, 3], "b": null}}\n```'),
        ("r2", '{"selecao": {"c": [1], "d": "x"}}'),
        ("r3", "not json")], "request_id string, content string")
    req = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "c"), ("r2", "d"), ("r3", "e")],
                                "request_id string, persona_id string")
    got = [(r["persona_id"], r["rank"], r["ord"]) for r in
           rq.parse_selection(comp, req, arts, 2).orderBy("persona_id", "rank").collect()]
    assert got == [("a", 1, 0), ("a", 2, 1)]


def test_summary_decode_rules(spark):
    arts = spark.createDataFrame([(1, "T1", "https://a/1"), (2, "T2", "https://a/2"), (3, "T3", "https://a/3")],
                                 "ord long, title string, link string")
    comp = spark.createDataFrame([("1", '{"resumo": "r", "link": null}'), ("2", "texto livre"),
                                  ("3", '{"chamada": "C", "link": "https://b/3"}')],
                                 "request_id string, content string")
    got = {r["ord"]: (r["chamada"], r["resumo"], r["link"]) for r in rq.parse_summaries(comp, arts).collect()}
    assert got == {1: ("T1", "r", None), 2: ("T2", "texto livre", "https://a/2"), 3: ("C", "", "https://b/3")}
