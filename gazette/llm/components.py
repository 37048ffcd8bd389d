"""Connected components of a link table by alternating stars.

Each round points every node at the smallest node in its neighbourhood
(large star, then small star; Kiveris et al., "Connected Components in
MapReduce and Beyond"), so a long chain shortens geometrically. A round is
two aggregates and two joins over the links that are left; the minima are
checkpointed before they are joined back, so that a node with very many
links is an ordinary skewed join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.session import cut_lineage


def _pointed(both: DataFrame) -> DataFrame:
    """(u, v, m): every neighbour pair with the least of u and its neighbours."""
    least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("_u"), F.least("u", "m").alias("m")))
    return both.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a
    link to another one. Null ends and self links are ignored; an empty link
    table gives an empty result."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = cut_lineage(edges)
    state = None
    while True:
        # the sum of hashes over distinct rows identifies the set
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state or not row[0]:
            break
        state = tuple(row)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _pointed(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct())
        least = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u"))
        small = large.join(least, F.col("u") == F.col("_u")).select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.*").where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))\
        .union(edges.select("v", "v").distinct())
