"""Article identity (F5-F7): the keys two articles are compared on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.links import link_identity
from gazette.functions.reuse import evaluated
from gazette.functions.text import col_, normalize_title, unique_non_empty


def identity_host(link) -> Column:
    """Host of the normalised link (else of the raw link) minus ``www.``,
    or 'unknown' when neither parses."""
    return link_identity(link)["host"]


def title_keys(title, chamada=None) -> Column:
    """Distinct non-empty title keys of title and (optional) chamada."""
    parts = [normalize_title(F.coalesce(col_(title), F.lit("")))]
    if chamada is not None:
        parts.append(normalize_title(F.coalesce(col_(chamada), F.lit(""))))
    return unique_non_empty(F.array(*parts))


def with_identity(df, title="title", link="link", chamada=None, prefix=""):
    """Add normalized_link, title_key(s), source_title_key(s) and id_host.

    The link is parsed once, into one struct.
    """
    out = evaluated(df, "_u", link_identity(link))
    out = out.select("*", F.col("_u.normalized_link").alias(prefix + "normalized_link"), F.col("_u.host").alias(prefix + "id_host"),
                     title_keys(title, chamada).alias(prefix + "title_keys")).drop("_u")
    out = out.withColumn(prefix + "source_title_keys", F.transform(
        F.col(prefix + "title_keys"),
        lambda k: F.concat(F.col(prefix + "id_host"), F.lit("::"), k)))
    return (out.withColumn(prefix + "title_key",
                           F.coalesce(F.get(F.col(prefix + "title_keys"), 0), F.lit("")))
            .withColumn(prefix + "source_title_key",
                        F.coalesce(F.get(F.col(prefix + "source_title_keys"), 0), F.lit(""))))


def dedupe_keys(normalized_link, source_title_keys) -> Column:
    """Keys used by the any-key dedupe: link key then host::title keys, non-empty."""
    return F.filter(F.concat(F.array(col_(normalized_link)), col_(source_title_keys)),
                    lambda k: k.isNotNull() & (k != ""))
