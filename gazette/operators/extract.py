"""Extraction from raw pages: listing cards (S2), rule-based anchors (S3) and
article text (S4). Selectors, rendered lines and containers need the element
tree, so each rule is a small function over ``htmltree.Page``, run once per
page inside Arrow batches; everything around it is DataFrame work."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions import constants as K
from gazette.session import cut_lineage

CANDIDATE_DDL = "page_id long, pos long, title string, link string, date_str string"


def _link(url: str, href: str) -> str:
    """The address an anchor resolves to, as the page sees it."""
    try:
        return urljoin(url or "", href.strip())
    except ValueError:
        return href.strip()


def _units(text: str) -> int:
    """Length in UTF-16 units, as a browser counts."""
    return len(text) + sum(c > "\uffff" for c in text)


def _date_text(page, i: int | None) -> str | None:
    if i is None:
        return None
    return page.attrs[i].get("datetime") or page.text(i).strip() or None


def page_cards(url: str, html: str, min_title_chars: int = K.MIN_CARD_TITLE_LENGTH) -> Iterator[tuple]:
    """S2 on one page: (title, link, date text) in selector order, the first
    card per link."""
    from gazette.operators.htmltree import Page
    page = Page(html)
    anchors = page.all(("a", "href", ""))
    headings = page.all(*[(h, None, None) for h in ("h1", "h2", "h3", "h4")])
    dates = page.all(*K.DATE_SELECTORS)
    seen = set()
    for rule in K.CARD_SELECTORS:
        for i in page.all(rule):
            anchor = i if page.tag[i] == "a" else page.first_below(i, anchors)
            heading = page.first_below(i, headings)
            title = (page.text(heading) if heading is not None else page.inner_text(i).split("\n")[0]).strip()
            if anchor is None or "href" not in page.attrs[anchor] or _units(title) < min_title_chars:
                continue
            link = _link(url, page.attrs[anchor]["href"])
            if link and link not in seen:
                seen.add(link)
                yield title, link, _date_text(page, page.first_below(i, dates))


def _clean(text: str) -> str:
    """F11 on one anchor text: tags, one caption prefix and white space."""
    import re
    text = re.sub(r"<[^>]+>", " ", text)
    return " ".join(re.sub(K.ANCHOR_CAPTION_PREFIX, "", text).split())


def page_anchors(url: str, html: str, prefix: str | None = None, blocked_prefixes=tuple(K.ANCHOR_BLOCKED_PREFIXES),
                 blocked_first=tuple(K.ANCHOR_BLOCKED_FIRST_PARTS), min_parts: int = 2,
                 min_title_chars: int = K.MIN_ANCHOR_TITLE_LENGTH) -> Iterator[tuple]:
    """S3 on one page: (title, link, date text) of the anchors under
    ``prefix`` (default: the page's own origin), the first per link."""
    from gazette.operators.htmltree import Page
    page = Page(html)
    parts = urlsplit(url or "")
    prefix = f"{parts.scheme}://{parts.netloc}/" if prefix is None else prefix
    images = page.all(("img", None, None))
    dates = page.all(*K.DATE_SELECTORS)
    seen = set()
    for i in page.all(("a", "href", "")):
        link = _link(url, page.attrs[i]["href"])
        if not link.startswith(prefix) or link in seen:
            continue
        path = urlsplit(link).path
        names = [p for p in path.split("/") if p]
        if (any(path.startswith(b) for b in blocked_prefixes) or len(names) < min_parts
                or (names and names[0] in blocked_first)):
            continue
        image = page.first_below(i, images)
        title = _clean(page.text(i)) or (_clean(page.attrs[image].get("alt", "")) if image is not None else "")
        if _units(title) < min_title_chars:
            continue
        seen.add(link)
        box = page.closest(page.parent[i], K.DATE_CONTAINERS)
        yield title, link, _date_text(page, page.first_below(box, dates)) if box is not None else None


def page_text(html: str, min_chars: int = K.ARTICLE_TEXT_MIN_CHARS, fallback_chars: int | None = K.BODY_FALLBACK_CHARS) -> str:
    """S4 on one page: the first selector whose first element has more than
    ``min_chars`` of visible text, else the body's, cut to ``fallback_chars``
    (None: not cut)."""
    from gazette.operators.htmltree import Page
    page = Page(html)
    for rule in K.TEXT_SELECTORS:
        for i in page.all(rule)[:1]:
            text = page.inner_text(i)
            if _units(text) > min_chars:
                return " ".join(text.split())
    body = page.all(("body", None, None))
    text = " ".join((page.inner_text(body[0]) if body else page.rendered()).split())
    return text if fallback_chars is None else text[:fallback_chars].strip()


def _per_page(pages: DataFrame, rule: Callable) -> DataFrame:
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(page, pos, *found) for page, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True)
                    for pos, found in enumerate(rule(url or "", html or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "title", "link", "date_str"])
    return pages.select("page_id", "url", "html").mapInPandas(run, CANDIDATE_DDL)


def extract_cards(listings: DataFrame, min_title_chars: int = K.MIN_CARD_TITLE_LENGTH) -> DataFrame:
    """S2 + D3: (page_id, pos, title, link, date_str) per listing page."""
    return _per_page(listings, lambda url, html: page_cards(url, html, min_title_chars))


def extract_anchors(pages: DataFrame, prefix: str | None = None, blocked_prefixes=tuple(K.ANCHOR_BLOCKED_PREFIXES),
                    blocked_first=tuple(K.ANCHOR_BLOCKED_FIRST_PARTS), min_parts: int = 2,
                    min_title_chars: int = K.MIN_ANCHOR_TITLE_LENGTH) -> DataFrame:
    """S3 + D3: (page_id, pos, title, link, date_str) per page; the date is
    that of the anchor's nearest container."""
    return _per_page(pages, lambda url, html: page_anchors(
        url, html, prefix, blocked_prefixes, blocked_first, min_parts, min_title_chars))


def extract_candidates(pages: DataFrame, anchor_hosts: tuple[str, ...] = tuple(K.ANCHOR_HOSTS)) -> DataFrame:
    """The candidates of a listing page by its host's rule: S3 for hosts that
    contain one of ``anchor_hosts``, S2 for all others."""
    def rule(url: str, html: str):
        host = urlsplit(url).hostname or ""
        return page_anchors(url, html) if any(h in host for h in anchor_hosts) else page_cards(url, html)
    return _per_page(pages, rule)


#: Candidates a page can hold: their places share a BIGINT with the page id.
POS_BITS = 20


def articles_from_listings(pages: DataFrame, anchor_hosts: tuple[str, ...] = tuple(K.ANCHOR_HOSTS)) -> DataFrame:
    """(ord, page_id, site, title, link, date_str): every candidate of every
    listing page, with the date it carries. ``ord`` orders them by page and
    place; a page with 2^20 candidates or more fails the run."""
    c = extract_candidates(pages, anchor_hosts)
    place = F.when(F.col("pos") < (1 << POS_BITS), F.shiftleft("page_id", POS_BITS) + F.col("pos")).otherwise(
        F.raise_error(F.lit("too many candidates on one page")).cast("bigint"))
    sites = pages.select(F.col("page_id").alias("_p"), F.col("url").alias("site"))
    return c.join(sites, F.col("page_id") == F.col("_p")).select(
        place.alias("ord"), "page_id", "site", "title", "link", "date_str")


def listing_order(pages: DataFrame) -> DataFrame:
    """(site, site_ord): the position of each listing site, by its first page;
    from the page table, so that no html is walked for it."""
    return pages.groupBy(F.col("url").alias("site")).agg(F.shiftleft(F.min("page_id"), POS_BITS).alias("site_ord"))


def article_text(html, min_chars: int = K.ARTICLE_TEXT_MIN_CHARS, fallback_chars: int | None = K.BODY_FALLBACK_CHARS):
    """S4 as a column (an Arrow-batched function)."""
    import pandas as pd

    def text(pages):
        return pages.map(lambda h: page_text(h or "", min_chars, fallback_chars))
    text.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(text, "string")(html)


#: A filter over selected keys: bits a key, bits set by one key (all in one
#: word, so that a key is one lookup), and the keys of one filter at most (8 MB of
#: words that are sent to the scan).
KEY_BITS, KEY_HASHES, FILTER_KEYS = 16, 5, 1 << 21


def _filtered(pages: DataFrame, selected: DataFrame, key: str, n: int) -> DataFrame:
    """``pages`` through a blocked Bloom filter of the ``n`` selected keys."""
    words = 1 << max(0, (n * KEY_BITS - 1).bit_length() - 6)
    word = F.pmod(F.xxhash64(key), F.lit(words))
    again = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("bigint")
    for i in range(KEY_HASHES):
        at = F.shiftright(again, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    table = cut_lineage(selected.groupBy(word.alias("_word")).agg(F.bit_or(mask).alias("_bits")))
    return (pages.join(F.broadcast(table), word == F.col("_word"))
            .where(F.col("_bits").bitwiseAND(mask) == mask).drop("_word", "_bits"))


def maybe_selected(pages: DataFrame, selected: DataFrame, key: str, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """The pages whose ``key`` may be selected: all selected ones and less than
    2 % of the others, at any number of keys.

    A filter is sized by the counted keys (distinct in ``selected``) and sent
    to the scan. More than ``filter_keys`` are cut by key range: each range has its
    own filter and its own scan, to which the range is pushed down, so
    that pages stored in key order are still read once."""
    n = selected.count()
    parts = max(1, -(-n // filter_keys))
    if parts == 1:
        return _filtered(pages, selected, key, n)
    ranged = cut_lineage(selected.select(key).repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    starts = [r[0] for r in ranged.groupBy("_part").agg(F.min(key).alias("first")).orderBy("first").select("first").collect()]
    out = None
    for i, first in enumerate(starts):
        inside = F.col(key) >= F.lit(first)
        if i + 1 < len(starts):
            inside = inside & (F.col(key) < F.lit(starts[i + 1]))
        mine = ranged.where(inside).select(key)
        part = _filtered(pages.where(inside), mine, key, mine.count())
        out = part if out is None else out.union(part)
    return out


def texts_for_selected(pages: DataFrame, selected_ords: DataFrame) -> DataFrame:
    """J4 + S4: text only for selected articles, before any html work.

    The selected ids reach the html scan as a Bloom filter first (an
    aggregate of fixed size, read once), so that the html of pages that were
    not selected stays in its scan stage even when the ids are too many for a
    broadcast; the exact join with the distinct ids follows on the survivors
    (as an inner join, since a semi join would be moved below the filter)."""
    sel = cut_lineage(selected_ords.select(F.col("ord").alias("page_id")).distinct())
    chosen = maybe_selected(pages.select("page_id", "html"), sel, "page_id").join(sel, "page_id")
    text = article_text(F.col("html"))
    return chosen.select(F.col("page_id").alias("ord"), text.alias("_t")).select(
        "ord", F.coalesce(F.nullif("_t", F.lit("")), F.lit(K.ARTICLE_TEXT_FAILED)).alias("text"),
        (F.coalesce("_t", F.lit("")) == "").alias("text_failed"))


def texts_for_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """J4 by address: (link, text, text_failed) for the ``links`` that are the
    url of a page (the first by page_id, if several are)."""
    sel = cut_lineage(links.select(F.col("link").alias("url")).distinct())
    found = maybe_selected(pages.select("url", "page_id", "html"), sel, "url").join(sel, "url")
    text = found.select("url", "page_id", article_text(F.col("html")).alias("_t"))
    text = text.groupBy("url").agg(F.min_by("_t", "page_id").alias("_t"))
    return text.select(F.col("url").alias("link"),
                       F.coalesce(F.nullif("_t", F.lit("")), F.lit(K.ARTICLE_TEXT_FAILED)).alias("text"),
                       (F.coalesce("_t", F.lit("")) == "").alias("text_failed"))
