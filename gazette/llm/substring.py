"""Substring dedup by relative Lempel-Ziv parsing, over words.

The corpus is its own reference: every document is cut into blocks and every
block is indexed by its hash. A document is factored greedily from left to
right: a factor copies from one occurrence of an indexed block and goes on
while the following block copies from the place that follows it there;
otherwise the next factor begins. A block covers at least one whole window of
``window`` words, so every factor is long enough to be a duplicate span. A
repeated window need not lie inside one factor, so the blocks at factor
boundaries (without another whole occurrence, but beside an anchor that has
one) are looked up again window by window, and what is found there becomes
part of the factors. The result is exact, up to
128-bit hashes: a word goes if a window over it also starts anywhere else.

Defined results: a null, empty or blank text has no words. Repeated rows
repeat each other, so all their windows go, in every one of them; equal
texts under different ids as well. A null doc_id is an ordinary value. An
empty table gives an empty result. Extra input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm import repeats
from gazette.llm.text import BASES, group_starts, prefix_hash, slices, span_hash, word_hashes, word_spans

WINDOW, GRAM = 35, 8
#: Pieces in which the blocks at factor boundaries are checked.
STEPS = (1,)


def word_blocks(window: int, gram_size: int) -> repeats.Scan:
    def scan(buf: np.ndarray, offs: np.ndarray) -> repeats.Scanned:
        start, end, words = word_spans(buf, offs)
        prefix = tuple(prefix_hash(word_hashes(buf, start, end, b), b) for b in BASES)
        at = np.arange(max(len(start) - gram_size + 1, 0))
        gram = span_hash(prefix[0], at, at + gram_size, BASES[0])
        first, count, anchor = repeats.anchored(gram, window, gram_size, words)
        row = np.repeat(np.arange(len(words)), words)[first]
        return repeats.Scanned(repeats.Blocks(row, first, count, anchor), group_starts(words), prefix, gram)
    return scan


def factors(blocks: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, sig, start, end, ref_doc, ref_start) of the factors: blocks that
    follow each other here and at the place they copy from are one."""
    order = Window.partitionBy("doc", "sig").orderBy("start")
    shift = F.col("ref_start") - F.col("start")
    same = ((F.lag("ref_doc").over(order) == F.col("ref_doc")) & (F.lag("ref_sig").over(order) == F.col("ref_sig"))
            & (F.lag(shift).over(order) == shift)
            & (F.lag(F.col("start") + F.col("count")).over(order) >= F.col("start")))
    b = blocks.dropDuplicates(["doc", "sig", "start"]).withColumn("_new", F.when(same, 0).otherwise(1))
    b = b.withColumn("_factor", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("doc", "sig", "_factor", "ref_doc").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("count") - 1 + window).alias("end"),
        F.min("ref_start").alias("ref_start")).drop("_factor")


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
                     gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): the words that stay, joined
    by one space."""
    doc, sig = repeats.identified(docs, doc_id, text)
    d = docs.select(doc.alias("doc"), sig.alias("sig"), docs[text].cast("string").alias("text"), docs[doc_id].alias("doc_id"))
    blocks = repeats.repeated_blocks(d.select("doc", "sig", "text"), word_blocks(window, gram), window, STEPS)
    runs = factors(blocks, window).select("doc", "sig", "start", (F.col("end") - F.col("start") - window + 1).alias("count"))
    id_type = d.schema["doc_id"].dataType.simpleString()

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in slices(batches, "text"):
            start, end, words = word_spans(buf, offs)
            gone = repeats.run_mask(len(start), rows.column(2), rows.column(3), group_starts(words)[:-1])
            data, kept, at = buf.tobytes(), [], group_starts(words)
            spans = list(zip(start.tolist(), end.tolist(), gone.tolist(), strict=True))
            for r in range(rows.num_rows):
                kept.append(b" ".join([data[a:b] for a, b, g in spans[at[r]:at[r + 1]] if not g]))
            total = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(words), pa.array(total[at[1:]] - total[at[:-1]]),
                 pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])
    joined = repeats.with_runs(d, repeats.covered(runs, window)).select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(remove, f"doc_id {id_type}, n_words long, n_removed long, kept_text string")
