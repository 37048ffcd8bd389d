"""Plan shape checks: the properties the scale design relies on."""

from gazette.plans import queries as Q
from gazette.sources.derived import AS_OF

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_limited_before_the_shuffle(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = plan(Q.REGISTRY["top_per_site"](spark, SF))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # a partial group limit on the map side, a final one after the exchange
    assert p.count("WindowGroupLimit") >= 2


def test_scan_prunes_columns_and_keeps_python_out(spark):
    p = plan(Q.REGISTRY["site_report"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in p
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    p2 = plan(Q.REGISTRY["candidate_docs"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p2
    assert "Python" not in p2


def test_text_extraction_reads_html_only_for_selected(spark):
    a = Q.unique_articles(spark, SF)
    kept = Q.kept_selection(spark, SF, a)
    p = plan(Q.selected_texts(spark, SF, kept))
    # both joins with the selection happen before any text is extracted
    assert p.index("ArrowEvalPython") < p.index("Join")


def test_html_of_unselected_pages_is_not_shuffled(spark):
    """Without a broadcast of the ids, the filter of fixed size still stands
    between the html scan and the semi join's exchange."""
    from gazette.operators.extract import texts_for_selected
    from gazette.sources.tables import read_table
    pages = read_table(spark, SF, "pages")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(texts_for_selected(pages, pages.selectExpr("page_id as ord").where("ord < 5")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = p[p.index("Exchange hashpartitioning"):]
    assert "BroadcastHashJoin" in below and below.index("BroadcastHashJoin") < below.index("FileScan")


def test_collecting_walks_each_page_once(spark):
    assert plan(Q.REGISTRY["collect_listings"](spark, SF)).count("MapInPandas") == 1


def test_filter_lets_few_other_pages_through(spark):
    from gazette.operators.extract import maybe_selected
    pages = spark.range(200_000).withColumnRenamed("id", "page_id")
    selected = pages.where("page_id % 40 = 7")
    for limit in (1 << 21, 2_000):  # one filter, and three by key range
        got = maybe_selected(pages, selected, "page_id", limit)
        n, hits = got.selectExpr("count(*)", "count_if(page_id % 40 = 7)").first()
        assert hits == 5_000 and n - hits < 0.02 * 195_000
    names = spark.range(3000).selectExpr("concat('https://x.com/', id) as url")
    assert maybe_selected(names, names.limit(500), "url", 100).join(names.limit(500), "url").count() == 500


def test_search_lists_are_cut_before_the_tokens_meet_them(spark):
    p = plan(Q.REGISTRY["candidate_docs"](spark, SF))
    assert p.count("WindowGroupLimit") >= 4  # posting lists of words and names, then the merged ones


def test_no_cartesian_products(spark):
    for key in ("lexical_select", "filter_requests", "candidate_docs", "run_counters"):
        p = plan(Q.REGISTRY[key](spark, SF))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, key
