"""SimHash near-duplicates: fingerprints, then BK-trees over shards.

A text's fingerprint has the majority bit of the XXH64 values of its word
shingles. Two fingerprints link when they differ in at most ``radius`` bits.

*Shards.* Fingerprints within ``radius`` bits agree on at least one of
``radius + 1`` bit blocks, so each distinct fingerprint goes into one shard a
block, keyed by the block's value, and every link lies inside some shard. A
shard of more than ``shard_limit`` fingerprints is split by the same rule over
the bits it doesn't fix yet, as often as bits last, so the rule is exact at
any size. A tree of all fingerprints, or a broadcast of all shards' trees, would
grow with the data; each tree goes only to the queries of its shard instead.

*BK-trees.* A task holds some shards at a time, builds their trees level by
level (children keyed by the integer Hamming distance to the parent) and
walks all queries together, following only edges within ``radius`` of the
query's distance to the node. It emits one link per fingerprint to the least
one of its local group, so no group is expanded into pairs.

Equal fingerprints are one node, so copies cost nothing beyond a partial
aggregate.

Defined results: a null, empty or blank text has fingerprint 0 and links like
any other; a text of fewer words than the shingle is one shingle. A row with
a null doc_id has a fingerprint and the component of its group like any
other, but can't name one: where every row of a group has a null id, the
component is null. Rows that share a doc_id stand or fall with their own
texts. Extra input columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.components import components
from gazette.llm.joins import join_measured
from gazette.llm.tables import kept_table
from gazette.llm.text import U64, group_starts, run_offsets, slices, small_batches, word_spans
from gazette.llm.xxh import xxh64_spans
from gazette.session import cut_lineage

#: Pairs a task looks at together while it walks the trees.
FRONTIER = 1 << 20


def _joined_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words one space apart, and where each begins there."""
    length = end - start
    at = group_starts(length + 1)
    out = np.full(int(at[-1]), 0x20, np.uint8)
    inner = run_offsets(length)
    out[np.repeat(at[:-1], length) + inner] = buf[np.repeat(start, length) + inner]
    return out, at[:-1]


def text_fingerprints(buf: np.ndarray, offs: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """The fingerprint of each document of a slice."""
    lower = buf + np.where((buf >= 0x41) & (buf <= 0x5A), np.uint8(32), np.uint8(0))
    start, end, words = word_spans(lower, offs)
    out = np.zeros(len(words), U64)
    if not len(start):
        return out
    joined, at = _joined_words(lower, start, end)
    count = np.maximum(words - shingle + 1, np.minimum(words, 1))
    first = np.repeat(group_starts(words)[:-1], count) + run_offsets(count)
    last = first + np.repeat(np.minimum(words, shingle), count) - 1
    h = xxh64_spans(joined, at[first], at[last] + (end - start)[last] - at[first], seed)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(count)
    ones = np.add.reduceat(bits, group_starts(count[some])[:-1], axis=0, dtype=np.int32)
    major = (2 * ones > count[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                 seed: int = 42) -> DataFrame:
    """(doc_id, fp): one row per document, the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in slices(batches, "text"):
            fp = text_fingerprints(buf, offs, shingle, seed)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
    d = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    return small_batches(d).mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


class BKTrees:
    """BK-trees of consecutive runs of distinct fingerprints, one a shard."""

    def __init__(self, fps: np.ndarray, sizes: np.ndarray) -> None:
        self.fps, n = fps, len(fps)
        self.root = np.repeat(group_starts(sizes)[:-1], sizes)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        rest = np.arange(n)
        rest = rest[rest != self.root]
        above = self.root[rest]
        while len(rest):
            d = np.bitwise_count(fps[rest] ^ fps[above]).astype(np.int64)
            order = np.lexsort((rest, d, above))
            rest, above, d = rest[order], above[order], d[order]
            head = np.ones(len(rest), bool)
            head[1:] = (above[1:] != above[:-1]) | (d[1:] != d[:-1])
            # the first of each (parent, distance) is that child; the others go below it
            parent[rest[head]], edge[rest[head]] = above[head], d[head]
            child = rest[head][np.cumsum(head) - 1]
            rest, above = rest[~head], child[~head]
        keyed = np.flatnonzero(parent >= 0)
        order = np.lexsort((edge[keyed], parent[keyed]))
        self.child = keyed[order]
        self.key = parent[self.child] * 65 + edge[self.child]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs at most ``radius`` bits apart, each
        query against its own shard's tree."""
        todo = [(q, self.root[q]) for q in np.array_split(queries, len(queries) // FRONTIER + 1) if len(q)]
        while todo:
            q, node = todo.pop()
            d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
            hit = (d <= radius) & (node != q)
            yield q[hit], node[hit]
            low = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right") - low
            # depth first in pieces, so that the frontier stays bounded
            ends = np.cumsum(n)
            at = 0
            while at < len(n):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + FRONTIER, "right")))
                part = slice(at, to)
                if ends[to - 1] > done:
                    todo.append((np.repeat(q[part], n[part]),
                                 self.child[np.repeat(low[part], n[part]) + run_offsets(n[part])]))
                at = to


def least_labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index of each index's group under the pairs."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def block_masks(parts: int, depth: int) -> list[int]:
    """The bits fixed by each path of ``depth`` block choices: every choice
    takes one of ``parts`` equal blocks of the bits not yet fixed."""
    masks = [0]
    for _ in range(depth):
        masks = [m | sum(1 << int(b) for b in block) for m in masks
                 for block in np.array_split([b for b in range(64) if not m >> b & 1], parts)]
    return masks


#: Block choices in a row at most; with radius 3 they fix 37 of 64 bits.
MAX_DEPTH = 3


def shards(nodes: DataFrame, radius: int, shard_limit: int) -> DataFrame:
    """(path, value, fp): the shards of each distinct fingerprint, one row
    each. ``path`` numbers the block choices, ``value`` has the bits they fix."""
    parts = radius + 1
    rows = nodes.select(F.lit(0).alias("path"), "fp")
    found = None
    for depth in range(1, MAX_DEPTH + 1):
        masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in block_masks(parts, depth)])
        split = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        split = split.select((F.col("path") * parts + F.col("_b")).alias("path"), "fp")
        split = split.select((F.lit(1000 ** depth) + F.col("path")).alias("path"),
                             F.col("fp").bitwiseAND(F.get(masks, F.col("path"))).alias("value"), "fp", F.col("path").alias("_n"))
        large = split.groupBy("path", "value").count().where(F.col("count") > shard_limit)
        large = cut_lineage(large.select(F.col("path").alias("_p"), F.col("value").alias("_v")))
        match = (F.col("path") == F.col("_p")) & (F.col("value") == F.col("_v"))
        if depth == MAX_DEPTH or large.isEmpty():
            fit, rows = split, None
        else:
            fit = split.join(large, match, "left_anti")
            rows = cut_lineage(split.join(large, match, "left_semi").select(F.col("_n").alias("path"), "fp"))
        fit = fit.select("path", "value", "fp")
        found = fit if found is None else found.unionByName(fit)
        if rows is None:
            return found
    return found


def _star_links(radius: int):
    def solve(fps: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        trees = BKTrees(fps, sizes)
        label = least_labels(len(fps), trees.within(np.arange(len(fps)), radius))
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays(
            [pa.array(fps[moved].view(np.int64)), pa.array(fps[label[moved]].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows (path, value, fp), sorted by shard
        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(i), np.int64) for i in range(3)]))
            if sum(x.shape[1] for x in held) < FRONTIER // 8:
                continue
            rows = np.concatenate(held, axis=1)
            open_shard = (rows[:2] == rows[:2, -1:]).all(axis=0)  # may go on in the next batch
            held = [rows[:, open_shard]]
            yield from whole(rows[:, ~open_shard])
        if held:
            yield from whole(np.concatenate(held, axis=1))

    def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1] < 2:
            return
        head = np.ones(rows.shape[1], bool)
        head[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
        sizes = np.diff(np.append(np.flatnonzero(head), rows.shape[1]))
        several = np.repeat(sizes > 1, sizes)
        if several.any():
            yield solve(np.ascontiguousarray(rows[2][several]).view(U64), sizes[sizes > 1])
    return run


def links(nodes: DataFrame, radius: int = 3, shard_limit: int = 16_384) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that have
    the same components as all pairs within ``radius`` bits."""
    keyed = shards(nodes, radius, shard_limit)
    # most shards hold one fingerprint; the rest meet in sorted order
    dealt = keyed.repartition("path", "value").sortWithinPartitions("path", "value", "fp")
    return dealt.mapInArrow(_star_links(radius), "a long, b long")


def _grouped(fps: DataFrame, least: dict[str, Column], radius: int = 3, shard_limit: int = 16_384) -> DataFrame:
    """``fps`` with, for each of ``least``, its smallest value (null if there
    is none) over the rows of the group."""
    smallest = lambda c: [F.min(x).alias(name) for name, x in c.items()]
    nodes = cut_lineage(fps.groupBy("fp").agg(*smallest(least)))
    linked = components(links(nodes.select("fp"), radius, shard_limit))
    rooted = nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        nodes["fp"], *least, F.coalesce("component", nodes["fp"]).alias("root"))
    rooted = cut_lineage(rooted)
    named = cut_lineage(rooted.groupBy(F.col("root").alias("_r")).agg(*smallest({c: F.col(c) for c in least})))
    named = rooted.select(F.col("fp").alias("_fp"), "root").join(named, F.col("root") == F.col("_r")).select("_fp", *least)
    return join_measured(fps, named, F.col("fp") == F.col("_fp"), "inner").drop("_fp")


def near_duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3,
                          radius: int = 3, seed: int = 42, shard_limit: int = 16_384) -> DataFrame:
    """(doc_id, fp, component_id): ``component_id`` is the smallest doc_id
    reachable over links, a document's own included."""
    fps = cut_lineage(fingerprints(docs, doc_id, text, shingle, seed))
    return _grouped(fps, {"component_id": F.col("doc_id")}, radius, shard_limit).select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42,
                  **params) -> DataFrame:
    """One row of ``docs`` for each group: of those with the smallest doc_id
    the first by a hash of the text, of repeated rows any one. Rows with a
    null doc_id can't stand for named ones, nor named ones for them: of each
    group's, one stays as well."""
    # rows are told apart by a number of their own, written before it is used
    rows = kept_table(docs.select(F.struct("*").alias("own"), F.monotonically_increasing_id().alias("row")))
    place = F.struct(F.col("own")[doc_id].alias("id"), F.xxhash64(F.col("own")[text]).alias("hash"), "row")
    placed = rows.select(place.alias("place"), F.col("own")[text].alias("text"))
    fps = cut_lineage(fingerprints(placed, "place", "text", shingle, seed))
    at, unnamed = F.col("doc_id"), F.col("doc_id.id").isNull()
    groups = _grouped(fps, {"named": F.when(~unnamed, at), "unnamed": F.when(unnamed, at)}, **params)
    stays = F.when(unnamed, F.col("unnamed.row")).otherwise(F.col("named.row"))
    gone = groups.where(F.col("doc_id.row") != stays).select(F.col("doc_id.row").alias("_gone"))
    return join_measured(rows, gone, F.col("row") == F.col("_gone"), "left_anti").select("own.*")
