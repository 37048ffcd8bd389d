"""Windows of a fixed length that occur more than once in a corpus.

The two substring operators share this search; what a position is (a word, a
byte) is theirs. A scan cuts a document into *blocks*: runs of window starts
that have the same anchor, the least gram hash inside the window. The anchor
depends on nothing outside the window, so equal windows always have equal
anchors, at the same offset, and a block may be cut further at fixed distances
from its anchor.

A round looks at blocks (or pieces of them) with two hashes: of the core,
which all its windows contain, and of all it covers. They meet in buckets by
core: a core that occurs once settles its block (nothing repeats); a block
that occurs twice as a whole is repeated in all its windows; blocks that share
a core but differ go on, one occurrence of each, cut into smaller pieces,
until a piece is a single window. The first round sees every block, the others
only what lies at the edges of repeated passages.

A core that is hot over the whole corpus is spread over the buckets by the
hash of the whole block, which brings equal blocks together just as well; its
blocks go on without a look at their number. No pairs of occurrences are made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.buckets import dealt, entry, hashed_counts, heads, hot_entries, in_order, sizes, through_buckets
from gazette.llm.joins import join_measured
from gazette.llm.tables import kept_table
from gazette.llm.text import BASES as _BASES
from gazette.llm.text import SLICE_BYTES, U64, mix64, run_offsets, span_hash

#: Stands for a null doc_id; rows are told apart by their texts' hash as well.
NO_ID = (1 << 63) - 1


@dataclass
class Blocks:
    """Blocks of one slice: the document (row), first window start (position
    in the slice), number of windows, and anchor position of each."""
    row: np.ndarray
    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray

    def take(self, mine: np.ndarray) -> Blocks:
        return Blocks(self.row[mine], self.start[mine], self.count[mine], self.anchor[mine])

    def pieces(self, step: int) -> Blocks:
        """Cut where the distance from start to anchor passes a multiple of
        ``step``."""
        first = (self.anchor - self.start) // step
        last = (self.anchor - self.start - self.count + 1) // step
        n = first - last + 1
        own = np.repeat(np.arange(len(n)), n)
        q = np.repeat(first, n) - run_offsets(n)
        start = np.maximum(self.start[own], self.anchor[own] - q * step - step + 1)
        end = np.minimum((self.start + self.count)[own], self.anchor[own] - q * step + 1)
        return Blocks(self.row[own], start, end - start, self.anchor[own])


@dataclass
class Scanned:
    """One slice: its blocks, where documents begin, and the two prefix hashes."""
    blocks: Blocks
    begin: np.ndarray
    prefix: tuple[np.ndarray, np.ndarray]
    grams: np.ndarray

    def cores(self) -> np.ndarray:
        """The anchor gram of each block, hashed anew: anchors are the least
        hashes of their windows, so their own bits are far from even."""
        return mix64(self.grams[self.blocks.anchor] ^ U64(0xA0761D6478BD642F))


Scan = Callable[[np.ndarray, np.ndarray], Scanned]


def anchored(gram: np.ndarray, size: int, gram_size: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, windows, anchor position) of every block, from
    the gram hash at each position of documents with ``counts`` positions.
    ``gram`` is only read where a whole window follows or precedes it."""
    n, reach = len(gram), size - gram_size + 1
    if n < reach:
        return (np.empty(0, np.int64),) * 3
    # least (hash, position) over `reach` grams by doubling; ties: the first
    least = (gram & ~U64((1 << 28) - 1)) | np.arange(n, dtype=U64)
    span = 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[:len(least) - (reach - span)], least[reach - span:])
    anchor = (least & U64((1 << 28) - 1)).astype(np.int64)
    ends = np.cumsum(counts)
    begin = ends - counts
    usable = np.maximum(counts - size + 1, 0)
    at = np.repeat(begin, usable) + run_offsets(usable)
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    own = anchor[at]
    head = np.ones(len(at), bool)
    head[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(head)
    return at[first], np.diff(np.append(first, len(at))), own[first]


def identified(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    """(doc, sig): rows with the same doc_id and text are interchangeable;
    ``sig`` is the whole 64-bit hash of the text."""
    return F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)), F.xxhash64(docs[text])


#: What a bucket returns: blocks repeated as a whole, or blocks to look into.
WHOLE, LEAD = 0, 1
_OUT = "kind int, doc long, sig long, start int, count int, settled boolean, ref_doc long, ref_sig long, ref_start int"


def _round(docs: DataFrame, scan: Scan, window: int, step: int | None, hot: np.ndarray | None, asked: bool) -> DataFrame:
    """One round over ``docs`` (doc, sig, text[, starts, settled]); ``step``
    is the size of a piece, None for whole blocks; ``asked``: only the blocks
    or pieces (of the previous round's size) with the given starts."""
    def cut(rows, buf, offs, buckets):
        s = scan(buf, offs)
        b, settled = s.blocks, None
        if asked:
            starts, flags = rows.column(3), rows.column(4)
            base = np.repeat(s.begin[:-1], np.diff(starts.offsets.to_numpy()))
            at = base + starts.flatten().to_numpy()
            order = np.argsort(at)
            at, flag = at[order], flags.flatten().to_numpy(zero_copy_only=False)[order]
            mine = np.flatnonzero(np.isin(b.start, at))
            b, settled = b.take(mine), flag[np.searchsorted(at, b.start[mine])]
            n = (b.anchor - b.start) // step - (b.anchor - b.start - b.count + 1) // step + 1
            b, settled = b.pieces(step), np.repeat(settled, n)
        last = b.start + b.count - 1 + window
        high, low = (span_hash(p, b.start, last, base) for p, base in zip(s.prefix, _BASES, strict=True))
        if asked:
            # the widest span that all windows of an uncut piece contain
            q = (b.anchor - b.start) // step
            core_at = b.anchor - q * step
            core = span_hash(s.prefix[0], core_at, core_at - step + 1 + window, _BASES[0])
        else:
            core = s.cores()
        spread = mix64(core) if hot is None else np.where(hot[entry(core)], mix64(core ^ high), mix64(core))
        doc, sig = (rows.column(i).to_numpy()[b.row] for i in (0, 1))
        start = (b.start - s.begin[b.row]).view(U64)
        flag = np.zeros(len(core), np.uint8) if settled is None else settled.astype(np.uint8)
        order = np.argsort(core)
        for bucket, r in dealt(spread[order], order, buckets):
            yield 0, bucket, [core[r], high[r], low[r], doc[r].view(U64), sig[r].astype(np.int64).view(U64), start[r], b.count[r].view(U64), flag[r]]

    def whole(kind, columns):
        core, high, low, doc, sig, start, count, flag = columns
        order = in_order(core, high, low, doc, sig, start)
        if asked:  # rows that repeat a document answer alike
            order = order[heads(order, core, high, low, doc, sig, start)]
        block = heads(order, core, high, low)
        times = sizes(block)
        first = np.flatnonzero(block)
        run = np.cumsum(block) - 1
        settled = np.logical_or.reduceat(flag[order] != 0, first) | (times[first] > 1) if len(first) else np.empty(0, bool)
        out = (times > 1) & (flag[order] == 0)
        # another occurrence: the first one, or the last for the first itself
        end = np.append(first[1:], len(order)) - 1
        other = np.where(np.arange(len(order)) == first[run], end[run], first[run]) if len(order) else run
        mine, ref = order[out], order[other[out]]
        yield _rows(WHOLE, doc[mine], sig[mine], start[mine], count[mine], None, doc[ref], sig[ref], start[ref])
        if step == 1:
            return
        lead = order[first]
        group = heads(lead, core)
        number = np.cumsum(group) - 1
        unsettled = np.zeros(int(group.sum()), bool)
        np.logical_or.at(unsettled, number, ~settled)
        go = (sizes(group) > 1) & unsettled[number]
        if hot is not None:  # the others of a hot core are in other buckets
            go |= hot[entry(core[lead])]
        yield _rows(LEAD, doc[lead[go]], sig[lead[go]], start[lead[go]], count[lead[go]], settled[go])
    return through_buckets(docs, cut, whole, _OUT, SLICE_BYTES)


def _rows(kind, doc, sig, start, count, settled=None, ref_doc=None, ref_sig=None, ref_start=None) -> pa.RecordBatch:
    n = len(doc)
    ints = lambda a, t: pa.nulls(n, t) if a is None else pa.array(a.astype(np.int64)).cast(t)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), ints(doc, pa.int64()), ints(sig, pa.int64()), ints(start, pa.int32()),
         ints(count, pa.int32()), pa.nulls(n, pa.bool_()) if settled is None else pa.array(settled),
         ints(ref_doc, pa.int64()), ints(ref_sig, pa.int64()), ints(ref_start, pa.int32())],
        ["kind", "doc", "sig", "start", "count", "settled", "ref_doc", "ref_sig", "ref_start"])


def repeated_blocks(docs: DataFrame, scan: Scan, window: int, steps: tuple[int, ...]) -> DataFrame:
    """(doc, sig, start, count, ref_doc, ref_sig, ref_start): runs of window
    starts whose windows all occur elsewhere, with another occurrence of the
    run. ``docs`` has doc, sig and text; ``steps`` are the sizes of the pieces
    in further rounds and end with 1."""
    hot = hot_entries(hashed_counts(docs, lambda buf, offs: scan(buf, offs).cores()))
    found = kept_table(_round(docs, scan, window, None, hot, False))
    runs = found.where(F.col("kind") == WHOLE)
    previous = scan
    for step in (s for s in steps if s == 1 or 2 * s <= window):
        lead = found.where(F.col("kind") == LEAD)
        asked = lead.groupBy(F.col("doc").alias("_d"), F.col("sig").alias("_s")).agg(
            F.sort_array(F.collect_list(F.struct("start", "settled"))).alias("_a"))
        asked = asked.select("_d", "_s", F.col("_a.start").alias("starts"), F.col("_a.settled").alias("settled"))
        match = (F.col("doc") == F.col("_d")) & (F.col("sig") == F.col("_s"))
        some = join_measured(docs, asked, match, "inner", 5 * F.size("starts")).select("doc", "sig", "text", "starts", "settled")
        found = kept_table(_round(some, previous, window, step, None, True))
        runs = runs.unionByName(found.where(F.col("kind") == WHOLE))
        previous = _cut_scan(previous, step)
    return runs.drop("kind", "settled")


def _cut_scan(scan: Scan, step: int) -> Scan:
    def cut(buf, offs):
        s = scan(buf, offs)
        return Scanned(s.blocks.pieces(step), s.begin, s.prefix, s.grams)
    return cut


def covered(runs: DataFrame, window: int) -> DataFrame:
    """(doc, sig, starts, ends): the maximal runs of covered positions, in
    order."""
    spans = runs.select("doc", "sig", "start", (F.col("start") + F.col("count") - 1 + window).alias("end"))
    before = Window.partitionBy("doc", "sig").orderBy("start", "end")
    up_to = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(F.col("start") <= up_to, 0).otherwise(1))
    spans = spans.withColumn("_run", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    joined = spans.groupBy("doc", "sig", "_run").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    return joined.groupBy(F.col("doc").alias("_d"), F.col("sig").alias("_s")).agg(
        F.sort_array(F.collect_list(F.struct("s", "e"))).alias("_r")).select(
            "_d", "_s", F.col("_r.s").alias("starts"), F.col("_r.e").alias("ends"))


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``docs`` (doc, sig, ...) with the covered runs of each row, or null."""
    match = (F.col("doc") == F.col("_d")) & (F.col("sig") == F.col("_s"))
    return join_measured(docs, runs, match, "left", 8 * F.size("starts")).drop("_d", "_s")


def run_mask(n: int, starts: pa.Array, ends: pa.Array, begin: np.ndarray) -> np.ndarray:
    """Which of n positions lie in a run; ``begin`` is each document's first
    position. A run past its document's end is an error."""
    edge = np.zeros(n + 1, np.int64)
    counts = np.diff(starts.offsets.to_numpy()) if len(starts) else np.empty(0, np.int64)
    base, end = np.repeat(begin, counts), ends.flatten().to_numpy()
    if (end > np.repeat(np.diff(np.append(begin, n)), counts)).any():
        raise ValueError("a run ends past its document: two texts share a doc_id and a 64-bit hash")
    np.add.at(edge, base + starts.flatten().to_numpy(), 1)
    np.add.at(edge, base + end, -1)
    return np.cumsum(edge[:-1]) > 0
