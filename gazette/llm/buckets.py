"""Grouping by hash without a row per item: compressed columns per bucket.

A scan turns a slice of documents into arrays, cuts them by hash into buckets
and ships every part as one compressed row; the task that holds a bucket puts
its parts together and works on whole columns. Against a row per item this
shuffles about half the bytes and no item passes through the JVM.

A bucket must not be at the mercy of one hot hash: ``hashed_counts`` measures
hashes over the whole input in a table of fixed size, and callers spread the
hot ones over all buckets by a second hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gazette.llm.text import U64, pack, slices, small_batches, unpack

TABLE = 1 << 16
#: An entry with so many times its even share holds a hot hash.
HOT_TIMES = 8
BLOCK_BYTES = 1 << 20


def entry(h: np.ndarray) -> np.ndarray:
    """The table entry of each hash: its top 16 bits."""
    return (h >> U64(48)).astype(np.int64)


def hashed_counts(docs: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """How many of the hashes of all documents fall on each table entry:
    TABLE counts at any input size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLE, np.int64)
        for _, buf, offs in slices(batches, "text"):
            total += np.bincount(entry(hashes(buf, offs)), minlength=TABLE)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLE, np.int64)
        for batch in batches:
            for row in batch.column(0):
                total += np.frombuffer(row.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])
    rows = small_batches(docs.select("text")).mapInArrow(count, "counts binary")
    # tables of one size: summed in a few tasks, then in the driver
    total = np.zeros(TABLE, np.int64)
    for r in rows.repartition(8).mapInArrow(add, "counts binary").collect():
        total += np.frombuffer(r.counts, np.int64)
    return total


def hot_entries(counts: np.ndarray) -> np.ndarray:
    return counts > HOT_TIMES * max(1, int(counts.sum()) // TABLE)


def dealt(h: np.ndarray, rows: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """``rows`` cut by hash: (bucket, its rows)."""
    bucket = (h % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        yield int(bucket[part[0]]), rows[part]


def in_order(*keys: np.ndarray) -> np.ndarray:
    """As ``np.lexsort`` of the keys from the last to the first; only rows that
    share their first key are compared on the others."""
    order = np.argsort(keys[0])
    shared = sizes(heads(order, keys[0])) > 1
    rows = np.sort(order[shared])
    order[shared] = rows[np.lexsort([k[rows] for k in keys[::-1]])]
    return order


def heads(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where a new value of ``keys`` begins in ``order``."""
    out = np.ones(len(order), bool)
    if len(order):
        out[1:] = False
        for k in keys:
            k = k[order]
            out[1:] |= k[1:] != k[:-1]
    return out


def sizes(head: np.ndarray) -> np.ndarray:
    """For each row, the number of rows of its run."""
    n = np.diff(np.append(np.flatnonzero(head), len(head)))
    return np.repeat(n, n)


Cut = Callable[[pa.RecordBatch, np.ndarray, np.ndarray, int], Iterator[tuple[int, int, list[np.ndarray]]]]
Whole = Callable[[int, list[np.ndarray]], Iterator[pa.RecordBatch]]


def through_buckets(docs: DataFrame, cut: Cut, whole: Whole, schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``cut(rows, bytes, offsets, buckets)`` yields (kind, bucket, columns)
    of one slice of about ``block_bytes``, the columns unsigned; ``whole(kind, columns)`` gets a
    bucket's columns of one kind, as uint64, and yields output rows."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in slices(batches, "text", block_bytes):
            made = [(k, b, len(c), pack(c)) for k, b, c in cut(rows, buf, offs, buckets)]
            kind, bucket, width, body = zip(*made, strict=True) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(width, pa.int32()), pa.array(body, pa.binary())],
                ["kind", "bucket", "width", "body"])

    def finish(at: tuple[int, int], parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        yield from whole(at[0], [np.concatenate(c).astype(U64, copy=False) for c in zip(*parts, strict=True)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for kind, bucket, width, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (kind, bucket) != at:
                    if held:
                        yield from finish(at, held)
                    held, at = [], (kind, bucket)
                held.append([a.astype(U64, copy=False) if a.dtype != np.uint8 else a for a in unpack(body, width)])
        if held:
            yield from finish(at, held)
    parts = small_batches(docs).mapInArrow(scan, "kind int, bucket int, width int, body binary")
    return parts.repartition(buckets, "bucket").sortWithinPartitions("kind", "bucket").mapInArrow(gather, schema)
