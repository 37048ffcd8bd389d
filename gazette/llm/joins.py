"""Joins against a side whose size is measured first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.session import cut_lineage

#: The most a measured side may hold to be sent to every executor.
BROADCAST_BYTES = 16 << 20
ROW_BYTES = 48


def join_measured(left: DataFrame, right: DataFrame, on: Column, how: str, more: Column | None = None,
                  limit: int = BROADCAST_BYTES) -> DataFrame:
    """``left`` joined with a table that is materialised and measured: sent
    to every executor up to ``limit`` bytes (ROW_BYTES a row of fixed width,
    plus ``more``), shuffled beyond."""
    right = cut_lineage(right)
    size = right.agg(F.sum(F.lit(ROW_BYTES) + (F.lit(0) if more is None else more))).first()[0] or 0
    return left.join(F.broadcast(right) if size <= limit else right, on, how)
