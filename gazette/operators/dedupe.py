"""Ordered, any-key, greedy deduplication.

Sequential rule: walk rows in order; drop a row if any of its keys was
claimed by an earlier *kept* row; a kept row claims all its keys; rows
without keys are always kept. Dropped rows claim nothing, so the relation is
not transitive (A{1}, B{1,2}, C{2} keeps A and C) - neither ``dropDuplicates``
nor connected components give this answer.

Parallel form: the kept rows are the lexicographically-first maximal
independent set of the "shares a key" graph.

1. Keys held by one row can't conflict; only (row, key) pairs of shared keys
   take part.
2. ROUNDS rounds decide nearly everything on real data. A round keeps every
   undecided row that holds the minimum order value on *all* of its keys (no
   earlier undecided neighbour can still claim them), then drops the undecided
   rows sharing a key with a newly kept row. Hot keys are done here: a key
   held by a third of all rows costs one pre-aggregated value per map task,
   and its rows go in one round.
3. What is left are chains (A{1}, B{1,2}, C{2,3}, ...), each of which would
   take a round for every two of its rows. They are cut into connected
   components; a component of at most FOLD_PAIRS pairs is folded in order by one
   task, as the sequential rule says.
4. Only larger components go on in rounds.

Without groups, at most FOLD_PAIRS pairs are folded in order as they are: one task
takes less time than the jobs of a round.

The verdicts and the shrinking undecided set are checkpointed to the shared
folder, so plans and lineage stay flat and a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.operators.components import components
from gazette.session import cut_lineage

#: Rounds before chains are folded, and the largest component one task folds.
ROUNDS = 2
FOLD_PAIRS = 200_000


def _round(undecided: DataFrame, g: list[str], order_col: str) -> DataFrame:
    """The verdicts of one round: ids and ``kept``."""
    ids = [*g, order_col]
    first = (undecided.groupBy(*g, "key")
             .agg(F.min(F.struct(F.col(order_col), F.col("nk"))).alias("m"))
             .select(*g, "key", F.col("m")[order_col].alias("mo"), F.col("m.nk").alias("mnk")))
    roots = (first.groupBy(*g, "mo", "mnk").agg(F.count("*").alias("c"))
             .filter(F.col("c") == F.col("mnk"))
             .select(*g, F.col("mo").alias(order_col)))
    claimed = first.join(roots.withColumnRenamed(order_col, "mo"), g + ["mo"], "left_semi")
    hit = undecided.join(claimed.select(*g, "key"), g + ["key"], "left_semi").select(*ids).distinct()
    removed = hit.join(roots, ids, "left_anti")
    return cut_lineage(roots.withColumn("kept", F.lit(True)).unionByName(removed.withColumn("kept", F.lit(False))))


def _folded(pairs: DataFrame, g: list[str], order_col: str) -> DataFrame:
    """The sequential rule over whole components (``root``)."""
    ids = [*g, order_col]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, claimed = None, set()
        for batch in batches:
            kept = []
            columns = [c.to_pylist() for c in batch.columns]
            for place, keys in zip(zip(columns[0], *columns[2:2 + len(g)], strict=True), columns[1], strict=True):
                if place != at:
                    at, claimed = place, set()
                kept.append(claimed.isdisjoint(keys))
                if kept[-1]:
                    claimed.update(keys)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(kept, pa.bool_())], [*ids, "kept"])
    rows = pairs.groupBy("root", *ids).agg(F.collect_list("key").alias("keys")).select("root", "keys", *ids)
    rows = rows.repartition("root").sortWithinPartitions("root", *ids)
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in ids)
    return rows.mapInArrow(fold, f"{schema}, kept boolean")


def greedy_dedupe(df: DataFrame, order_col: str, keys_col: str,
                  group_cols: Sequence[str] = (), materialize_input: bool = True, rounds: int = ROUNDS,
                  fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """Return ``df`` plus a boolean ``kept``; (group_cols, order_col) must be unique.

    ``group_cols`` run independent dedupes side by side (D2: one per persona).
    ``materialize_input=False`` skips checkpointing the input when it is
    already a cheap read of checkpointed data.
    """
    g = list(group_cols)
    ids = g + [order_col]
    # Checkpointed, not persisted: downstream plans then start from a small
    # leaf instead of the input's whole expression tree.
    base = cut_lineage(df) if materialize_input else df
    pairs = base.select(*ids, F.explode(keys_col).alias("key")).distinct()
    shared_keys = (pairs.groupBy(*g, "key").agg(F.count("*").alias("kc"))
                   .filter(F.col("kc") > 1).select(*g, "key"))
    shared = pairs.join(shared_keys, g + ["key"], "left_semi")
    n_keys = shared.groupBy(*ids).agg(F.count("*").alias("nk"))
    undecided = cut_lineage(shared.join(n_keys, ids))
    decided: list[DataFrame] = []
    done, cut = 0, False
    while left := undecided.count():
        if not g and left <= fold_pairs:  # all that is left is one task's work
            decided.append(cut_lineage(_folded(undecided.withColumn("root", F.lit(0)), g, order_col)))
            break
        if done >= rounds and not cut:
            cut = True
            links = undecided.select(F.xxhash64(*ids).alias("a"), F.xxhash64(*g, "key").alias("b"))
            named = undecided.withColumn("_row", F.xxhash64(*ids)).join(
                components(links).withColumnRenamed("node", "_row"), "_row").drop("_row")
            named = cut_lineage(named)
            small = named.groupBy("root").agg(F.count("*").alias("_n")).where(F.col("_n") <= fold_pairs).select("root")
            verdicts = cut_lineage(_folded(named.join(small, "root", "left_semi"), g, order_col))
        else:
            verdicts = _round(undecided, g, order_col)
            done += 1
        decided.append(verdicts)
        undecided = cut_lineage(undecided.join(verdicts.select(*ids), ids, "left_anti"))
    status = None
    for part in decided:
        status = part if status is None else status.unionByName(part)
    if status is None:
        out = base.withColumn("kept", F.lit(None).cast("boolean"))
    else:
        out = base.join(status, ids, "left")
    return out.withColumn("kept", F.coalesce(F.col("kept"), F.lit(True)))


def first_per_key(df: DataFrame, partition_cols: Sequence[str], order_col: str) -> DataFrame:
    """D3: the first row (smallest ``order_col``) for each partition key.

    A ``min_by`` aggregate instead of a row_number window, so a key held by
    many rows is pre-aggregated on the map side rather than sorted in one task.
    """
    others = [c for c in df.columns if c not in partition_cols]
    packed = F.min_by(F.struct(*others), F.col(order_col)).alias("_first")
    return df.groupBy(*partition_cols).agg(packed).select(*partition_cols, "_first.*")
