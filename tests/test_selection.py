"""Exact selection, search and dates on the cases that a cut or a zone hides."""

import datetime as dt

from pyspark.sql import functions as F

from gazette.functions.dates import parse_date
from gazette.functions.text import normalize_search_text, normalize_title
from gazette.operators import docs as dc
from gazette.operators import personas as pers
from gazette.operators.dedupe import greedy_dedupe
from gazette.operators.select import lexical_select

PERSONA = "persona_idx long, id string, nome string, descricao string, prioridades array<string>, evitar array<string>"
ARTICLE = "ord long, title string, published_at timestamp_ntz"


def day(n):
    return dt.datetime(2026, 5, 1) + dt.timedelta(minutes=n)


def select(spark, articles, likes, avoids=(), limit=10):
    p = spark.createDataFrame([(0, "a", "A", "d", list(likes), list(avoids)), (1, "b", "B", "d", list(likes), list(avoids))], PERSONA)
    got = lexical_select(spark.createDataFrame(articles, ARTICLE), p, limit).collect()
    by = {k: [(r.ord, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.persona_id == k] for k in "ab"}
    assert by["a"] == by["b"]
    return by["a"]


def test_newer_single_matches_do_not_hide_a_better_one(spark):
    articles = [(i, f"grain number {i}", day(i)) for i in range(100, 160)]
    articles += [(i, f"shipping number {i}", day(i)) for i in range(200, 260)]
    articles.append((1, "grain shipping from the north", day(1)))
    assert select(spark, articles, ["grain", "shipping"])[0] == (1, 2)


def test_avoided_articles_leave_their_places(spark):
    articles = [(i, f"grain sport {i}", day(i)) for i in range(100, 140)] + [(i, f"grain {i}", day(i)) for i in range(5)]
    assert select(spark, articles, ["grain"], ["sport"]) == [(4, 1), (3, 1), (2, 1), (1, 1), (0, 1)]


def test_score_counts_topics_not_words(spark):
    articles = [(1, "grain port news", day(1)), (2, "rail news", day(2)), (3, "grain and rail", day(0))]
    assert select(spark, articles, ["grain port", "rail"]) == [(3, 2), (2, 1), (1, 1)]


def test_decomposed_accents(spark):
    df = spark.createDataFrame([("Ac\u0327a\u0303o",), ("Ação",)], "t string")
    assert {tuple(r) for r in df.select(normalize_title("t"), normalize_search_text("t")).collect()} == {("acao", "acao")}
    old = spark.createDataFrame([("ha\u0301 2 dias",)], "t string").select(parse_date("t", "2026-05-06 12:00:00")).first()[0]
    assert old == dt.datetime(2026, 5, 4, 12)


def test_dates_do_not_depend_on_the_session_zone(spark):
    texts = ["2026-05-06T10:00:00Z", "2026-05-06T10:00:00-03:00", "2026-05-06 10:00", "06/11/2018", "4/11/2018", "ha 3 horas",
             "ontem", "Mon, 06 May 2026 12:00:00 GMT", "nada"]
    want = [dt.datetime(2026, 5, 6, 10), dt.datetime(2026, 5, 6, 13), dt.datetime(2026, 5, 6, 10), dt.datetime(2018, 6, 11),
            dt.datetime(2018, 4, 11), dt.datetime(2026, 5, 6, 9), dt.datetime(2026, 5, 5, 12), dt.datetime(2026, 5, 6, 12), None]
    for zone in ("UTC", "America/Sao_Paulo", "Asia/Kolkata"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
            got = df.select("i", parse_date("t", "2026-05-06 12:00:00").cast("string").alias("d")).orderBy("i").collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert [r.d for r in got] == [None if w is None else str(w) for w in want], zone


def test_search_is_contains(spark):
    docs = spark.createDataFrame([
        (1, "Clipping Mariana - x", day(1), "l"), (2, "01-05-2026 | Mar Azul", day(2), "l"), (3, "nota jo sa", day(3), "l"),
        (4, "JO SANTOS", day(4), "l"), (5, "outra", day(5), "l")],
        "id long, name string, modified_time timestamp_ntz, web_view_link string")
    p = spark.createDataFrame([(0, "m", "Mar", "d", [], []), (1, "j", "Jo Sa", "d", [], []), (2, "n", "Nome Que Falta", "d", [], [])], PERSONA)
    found = lambda **kw: sorted((r.persona_id, r.cand_rank, r.id) for r in dc.candidate_docs(docs, p, **kw).collect())
    assert found() == [("j", 1, 4), ("j", 2, 3), ("m", 1, 2), ("m", 2, 1)]
    assert found(page=1) == [("j", 1, 4), ("m", 1, 2)]
    more = docs.withColumn("mime_type", F.when(F.col("id") == 2, "sheet").otherwise("doc")) \
        .withColumn("trashed", F.col("id") == 4).withColumn("parents", F.array(F.when(F.col("id") == 3, "f").otherwise("g")))
    got = dc.candidate_docs(more, p, kind="doc", folder="f").collect()
    assert [(r.persona_id, r.id) for r in got] == [("j", 3)]


def test_empty_persona_list_is_rejected(spark):
    import pytest
    with pytest.raises(ValueError):
        pers.validate_personas(spark.createDataFrame([], PERSONA))


def test_long_chain_of_shared_keys(spark):
    rows = [(i, [f"k{i}", f"k{i + 1}"]) for i in range(30)]
    df = spark.createDataFrame(rows, "pos long, keys array<string>")
    kept = sorted(r.pos for r in greedy_dedupe(df, "pos", "keys").where("kept").collect())
    assert kept == list(range(0, 30, 2))


def test_each_run_has_its_own_cut_and_ranks(spark):
    import random
    rng = random.Random(4)
    words = ["grain", "ship", "steel", "sport", "rain", "north", "bank"]
    articles = [(i, " ".join(rng.choices(words, k=3)), None if i % 7 == 0 else day(rng.randrange(40))) for i in range(300)]
    people = [(i, f"p{i}", "A", "d", rng.sample(words, 3) + ["north bank"] * (i % 2), rng.sample(words, i % 2)) for i in range(12)]
    got = lexical_select(spark.createDataFrame(articles, ARTICLE), spark.createDataFrame(people, PERSONA), 5, run=F.col("ord") % 3).collect()
    want = []
    for _, person, _, _, likes, avoids in people:
        for run in range(3):
            found = []
            for i, title, at in articles:
                has = set(title.split())
                score = sum(bool(has & set(topic.split())) for topic in set(likes))
                if i % 3 == run and score and not has & set(avoids):
                    found.append((-score, at is None, -at.timestamp() if at else 0, i))
            want += [(person, run, n, f[3], -f[0]) for n, f in enumerate(sorted(found)[:5], 1)]
    assert sorted((r.persona_id, r.run, r["rank"], r.ord, r.score) for r in got) == sorted(want)


def test_pairs_are_cut_before_they_are_shuffled(spark):
    articles = spark.createDataFrame([(i, f"grain {i}", day(i)) for i in range(2000)], ARTICLE)
    people = spark.createDataFrame([(i, f"p{i}", "A", "d", ["grain", f"topic{i}"], []) for i in range(50)], PERSONA)
    got = lexical_select(articles, people, 2)
    assert sorted(r.ord for r in got.where("persona_id = 'p7'").collect()) == [1998, 1999]
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
