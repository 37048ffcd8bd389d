"""Filters and per-site funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.functions import constants as K
from gazette.functions.dates import is_within_days, with_parsed_date
from gazette.functions.text import col_, utf16_length


def is_valid_title(title) -> Column:
    """At least 15 characters and none of the noise patterns; null -> false."""
    t = col_(title)
    noisy = F.lit(False)
    for pattern in K.NOISE_PATTERNS:
        noisy = noisy | t.rlike(pattern)
    return F.coalesce(t.isNotNull() & (utf16_length(t) >= K.MIN_TITLE_LENGTH) & ~noisy,
                      F.lit(False))


def annotate(articles: DataFrame, as_of, days_back: int = K.DAYS_BACK) -> DataFrame:
    """Add published_at, title_ok, date_ok (date_ok only counts after titles pass)."""
    return (with_parsed_date(articles, "date_str", as_of)
            .withColumn("title_ok", is_valid_title("title"))
            .withColumn("date_ok", is_within_days("published_at", as_of, days_back)))


def recent_articles(articles: DataFrame, as_of, days_back: int = K.DAYS_BACK) -> DataFrame:
    """P1 then P2, immediately after extraction so later shuffles carry less."""
    return annotate(articles, as_of, days_back).filter("title_ok AND date_ok")


def rank_within_site(df: DataFrame, site: str = "site") -> Column:
    """W1 order: newest first, undated last, ties in page order."""
    w = Window.partitionBy(site).orderBy(F.col("published_at").desc_nulls_last(),
                                         F.col("ord").asc())
    return F.row_number().over(w)


def top_per_site(recent: DataFrame, k: int = K.MAX_PER_SITE) -> DataFrame:
    """At most k per site (row_number <= k plans as a WindowGroupLimit)."""
    return recent.withColumn("site_rank", rank_within_site(recent)).filter(F.col("site_rank") <= k)


def site_order(articles: DataFrame) -> DataFrame:
    """Position of each site in the configured list: first page of the site."""
    return articles.groupBy("site").agg(F.min("ord").alias("site_ord"))


def collect_articles(articles: DataFrame, as_of, k: int = K.MAX_PER_SITE,
                     days_back: int = K.DAYS_BACK, sites: DataFrame | None = None) -> DataFrame:
    """X1 + W7: per-site lists concatenated in site order.

    ``pos`` orders rows by (site position, rank in site) as one BIGINT,
    ``site_ord * (k + 1) + site_rank``; no global window or single-task sort
    is needed. The site position is a partial aggregate (skew-safe) joined to
    the at most k rows per site that survive the top-k. ``sites`` (site,
    site_ord) gives the order where reading the articles twice would cost more.
    """
    top = top_per_site(recent_articles(articles, as_of, days_back), k)
    return (top.join(site_order(articles) if sites is None else sites, "site")
            .withColumn("pos", F.col("site_ord") * (k + 1) + F.col("site_rank")))


def site_funnel(articles: DataFrame, as_of, k: int = K.MAX_PER_SITE,
                days_back: int = K.DAYS_BACK) -> DataFrame:
    """A1 + P10: per-site raw / title-rejected / date-rejected / kept /
    over-limit counts, the undated ones among the kept, and the empty-site
    reason."""
    a = annotate(articles, as_of, days_back)
    agg = a.groupBy("site").agg(
        F.count("*").alias("raw_count"),
        F.count_if(~F.col("title_ok")).alias("title_filtered"),
        F.count_if(F.col("title_ok") & ~F.col("date_ok")).alias("date_filtered"),
        F.count_if(F.col("title_ok") & F.col("date_ok")).alias("found"))
    kept = F.least(F.col("found"), F.lit(k))
    shown = top_per_site(a.filter("title_ok AND date_ok"), k)
    undated = shown.groupBy("site").agg(
        F.count_if(F.coalesce(F.col("date_str"), F.lit("")) == "").alias("undated"))
    return agg.join(undated, "site", "left").select(
        "site", "raw_count", "title_filtered", "date_filtered",
        kept.alias("kept"),
        F.greatest(F.col("found") - F.lit(k), F.lit(0)).alias("over_limit"),
        F.coalesce("undated", F.lit(0)).alias("undated"),
        empty_site_reason(F.col("raw_count"), F.col("title_filtered"), F.col("date_filtered"),
                          kept, days_back).alias("reason"))


def empty_site_reason(raw, title_filtered, date_filtered, kept, days_back: int,
                      tool: bool = False) -> Column:
    """P10: why a site yielded nothing (null when it yielded something)."""
    if tool:
        text = (F.when(raw == 0, F.lit(K.TOOL_REASON_NO_ELEMENTS))
                .when(title_filtered == raw, F.lit(K.TOOL_REASON_ALL_TITLES))
                .otherwise(F.concat(date_filtered.cast("string"), F.lit(" artigos fora do periodo"))))
    else:
        text = (F.when(raw == 0, F.lit(K.REASON_NO_ELEMENTS))
                .when(title_filtered == raw, F.lit(K.REASON_ALL_TITLES))
                .when(date_filtered > 0, F.concat(
                    date_filtered.cast("string"),
                    F.lit(" artigo(s) encontrado(s) - todos fora dos ultimos "),
                    F.lit(str(days_back)), F.lit(" dia(s)")))
                .otherwise(F.lit(K.REASON_DEFAULT)))
    return F.when(kept == 0, text)
