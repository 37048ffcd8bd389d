"""Large column expressions: built once a session, evaluated once a row."""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reused(build: Callable[..., Column]) -> Callable[..., Column]:
    """``build`` with its result kept for a session and plain arguments
    (column names, texts, numbers): an expression names its columns without belonging to
    a DataFrame, and building some hundreds of nodes takes longer than running them."""
    made: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

    @functools.wraps(build)
    def call(*args, **more) -> Column:
        plain = all(isinstance(a, (str, int, type(None))) for a in (*args, *more.values()))
        try:
            context = SparkSession.active().sparkContext if plain else None
        except Exception:  # Spark Connect has no context
            context = None
        if context is None:
            return build(*args, **more)
        known = made.setdefault(context, {})
        key = (args, tuple(sorted(more.items())))
        if key not in known:
            known[key] = build(*args, **more)
        return known[key]
    return call


def evaluated(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` as a new column, as the one element of a generator: filters on
    other columns pass below it, filters on the value stay above, where Catalyst would
    put a copy of the whole expression for every mention of a plain column."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
