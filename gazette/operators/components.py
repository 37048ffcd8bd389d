"""Connected components of a link table by contraction.

While there are more than LOCAL_LINKS links, a round contracts the graph: every
node gets a coin from its hash and the round, a node with tails joins its
smallest neighbour with heads, and links are rewritten to the joined nodes. A
round takes about a quarter of the nodes away, however long the paths are, and
costs two aggregates and two joins on what is left. At most LOCAL_LINKS links are
finished by one task with a union-find table; the joins are then undone
in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.session import cut_lineage

#: Links that one task finishes (some 100 MB of its memory).
LOCAL_LINKS = 1 << 19


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the links (a, b) of one partition; the root is the
    smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top
    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(x) for x in list(parent)], pa.int64())],
                                         ["node", "root"])


def components(links: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, root) for every node of the links (a, b), both longs: nodes have
    the same root if and only if links join them. Nulls and self links are ignored."""
    edges = cut_lineage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    joined: list[DataFrame] = []
    while edges.count() > local_links:
        heads = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(len(joined))), F.lit(2)) == 0
        both = edges.union(edges.select("b", "a"))
        into = cut_lineage(both.where(heads("b") & ~heads("a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))
        joined.append(into)
        moved = edges
        for c in "ab":
            to = into.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
            moved = moved.join(to, c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        edges = cut_lineage(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = cut_lineage(edges.coalesce(1).mapInArrow(_union_find, "node long, root long"))
    for into in reversed(joined):
        above = found.select(F.col("node").alias("root"), F.col("root").alias("_top"))
        named = into.join(above, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
        # nodes that others joined and that have no link left stand for themselves
        alone = into.select(F.col("root").alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("root"))
        found = cut_lineage(found.union(named).union(alone))
    return found
