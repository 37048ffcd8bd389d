"""Byte-level dedup by prefix-free parsing.

A rolling hash over ``trigger`` bytes picks a trigger in every window of
``window`` bytes, its least one, so triggers depend on content alone and no
window is without one. The text between triggers makes phrases. A window is
then a suffix of a phrase, up to its trigger, followed by the parse from that
trigger on, and two windows are equal exactly if both parts are: this is how
prefix-free parsing puts the suffix array of the text together from those of
the dictionary of phrases and of the parse. Positions whose longest common
prefix with a neighbour in that order reaches ``window`` bytes are the members
of one class of (phrase suffix, parse class), so the classes are all that is
needed of the order, and they are found without sorting suffixes of the
corpus:

1. the dictionary: phrases whose trigger occurs once are left out;
2. the parse: a phrase with all that its windows reach (the parse suffix cut
   at ``window`` bytes) is one class; a class met twice is repeated in every
   window, which settles repetitive text phrase by phrase;
3. where classes of one trigger differ, their suffixes are merged: one
   occurrence of each class is cut into ever smaller runs of (suffix, parse)
   pairs, down to single windows, as long as other classes share them.

Matches never cross documents. Exact up to 128-bit hashes.

Defined results: a null or empty text has no bytes. Repeated rows repeat each
other and lose all windows. A null doc_id is an ordinary value. What stays of
a text may break a multi-byte character, so it is binary. An empty table
gives an empty result. Extra input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm import repeats
from gazette.llm.text import BASES, prefix_hash, slices, span_hash

WINDOW, TRIGGER = 200, 40
#: Sizes of the pieces of phrases in which suffixes are merged.
STEPS = (32, 4, 1)


def byte_phrases(window: int, trigger: int) -> repeats.Scan:
    def scan(buf: np.ndarray, offs: np.ndarray) -> repeats.Scanned:
        prefix = tuple(prefix_hash(buf, b) for b in BASES)
        at = np.arange(max(len(buf) - trigger + 1, 0))
        rolling = span_hash(prefix[0], at, at + trigger, BASES[0])
        first, count, anchor = repeats.anchored(rolling, window, trigger, np.diff(offs))
        row = np.searchsorted(offs, first, "right") - 1
        return repeats.Scanned(repeats.Blocks(row, first, count, anchor), offs, prefix, rolling)
    return scan


def dedup_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                trigger: int = TRIGGER) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes that stay."""
    doc, sig = repeats.identified(docs, doc_id, text)
    d = docs.select(doc.alias("doc"), sig.alias("sig"), docs[text].cast("string").alias("text"), docs[doc_id].alias("doc_id"))
    runs = repeats.repeated_blocks(d.select("doc", "sig", "text"), byte_phrases(window, trigger), window, STEPS)
    id_type = d.schema["doc_id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in slices(batches, "text"):
            gone = repeats.run_mask(len(buf), rows.column(2), rows.column(3), offs[:-1])
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[offs[1:]] - total[offs[:-1]]
            at = np.concatenate([[0], np.cumsum(~gone)])[offs].astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer(at), pa.py_buffer(buf[~gone].tobytes())])
            spans = np.diff(rows.column(2).offsets.to_numpy()) if rows.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(offs)), pa.array(removed), pa.array(spans.astype(np.int64)), kept],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
    joined = repeats.with_runs(d, repeats.covered(runs, window)).select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(remove, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")
