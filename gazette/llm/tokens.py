"""Token counts: pieces counted once per distinct pre-token.

The tokenizer's own pattern never joins characters across ASCII white space,
so a text's token count is the sum over its words of the word's count. Words
(pure ASCII ones in lower case, as the tokenizer's normaliser makes them; words
with a special string stay as they are) are the pre-tokens here:

1. the scan turns a block of documents into its distinct words with per-document
   frequencies, and cuts that table by word hash into buckets;
2. a bucket's task meets every distinct word once, counts its pieces once, and
   joins the counts to the frequencies: partial sums per block and document;
3. the sums of a block meet, and one row per document comes out.

No ids and no (document, word) rows are materialised: a shuffled row is a
compressed part of one block's table. Words that are very frequent in a block
are salted over all buckets, so a bucket holds no hot word.

Defined results: a null or empty text has 0 bytes and 0 tokens. A null doc_id
is an ordinary value. Repeated rows are counted each on their own. An empty
table gives an empty result. Extra input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.encoders import default_path, load
from gazette.llm.text import U64, group_starts, mix64, pack, run_offsets, slices, small_batches, unpack, word_hashes, word_spans

BLOCK_BYTES = 4 << 20
#: A word that makes up more than this part of a block's words is salted.
HOT_SHARE = 1e-3


def _lowered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, except in words that hold "<|" or a
    character beyond ASCII: the tokenizer composes before it lowers, and some
    capitals compose with a mark only in lower case."""
    out = buf + np.where((buf >= 0x41) & (buf <= 0x5A), np.uint8(32), np.uint8(0))
    special = np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C))
    asis = np.zeros(len(start), bool)
    asis[np.searchsorted(start, np.concatenate([special, np.flatnonzero(buf >= 0x80)]), "right") - 1] = True
    size = (end - start)[asis]
    at = np.repeat(start[asis], size) + run_offsets(size)
    out[at] = buf[at]
    return out


def block_tables(buf: np.ndarray, offs: np.ndarray, buckets: int, salt: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, table) of one block: distinct words and, for each, its
    documents and frequencies."""
    start, end, words = word_spans(buf, offs)
    if not len(start):
        return
    buf = _lowered(buf, start, end)
    h = word_hashes(buf, start, end)
    distinct, seen, word = np.unique(h, return_index=True, return_inverse=True)
    pair = word.astype(np.int64) * len(words) + np.repeat(np.arange(len(words)), words)
    pair, times = np.unique(pair, return_counts=True)
    owner, doc = pair // len(words), pair % len(words)
    total = np.bincount(owner, weights=times, minlength=len(distinct))
    hot = total > HOT_SHARE * len(start)
    key = np.where(hot, mix64(distinct + U64(salt)), mix64(distinct))
    bucket = (key % U64(buckets)).astype(np.int64)
    n_docs = np.bincount(owner, minlength=len(distinct))
    first = group_starts(n_docs)[:-1]
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        at, size = start[seen[part]], (end - start)[seen[part]]
        text = buf[np.repeat(at, size) + run_offsets(size)]
        rows = np.repeat(first[part], n_docs[part]) + run_offsets(n_docs[part])
        yield int(bucket[part[0]]), pack([size, text, n_docs[part], doc[rows], times[rows]])


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                 buckets: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens): one row per document."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"),
                    F.spark_partition_id().cast("long").alias("_part"))
    id_type = d.schema["doc_id"].dataType

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "block", "body", "ids"]
        for n, (rows, buf, offs) in enumerate(slices(batches, "text", BLOCK_BYTES)):
            block = (rows.column(2)[0].as_py() << 32) + n
            made = list(block_tables(buf, offs, buckets, block))
            header = pa.BufferOutputStream()
            ids = pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offs))], ["doc_id", "n_bytes"])
            with pa.ipc.new_stream(header, ids.schema) as out:
                out.write_batch(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block % buckets, *(b for b, _ in made)], pa.int32()),
                 pa.array([block] * (len(made) + 1), pa.int64()),
                 pa.array([header.getvalue().to_pybytes(), *(t for _, t in made)], pa.binary()),
                 pa.array([True] + [False] * len(made))], names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at, pieces = tokenizer or default_path("word_bpe_49k.json"), None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if not row["ids"]:
                    if row["bucket"] != at:
                        at, pieces = row["bucket"], {}
                    row["body"] = _sums(row["body"], pieces, path)
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("block", "body", "ids")}], schema=summed)

    def documents(table: pa.Table) -> pa.Table:
        ids, total = None, None
        for body, is_ids in zip(table.column("body"), table.column("ids"), strict=True):
            if is_ids.as_py():
                ids = pa.ipc.open_stream(body.as_buffer()).read_all()
                total = np.zeros(ids.num_rows, np.int64)
        for body, is_ids in zip(table.column("body"), table.column("ids"), strict=True):
            if not is_ids.as_py():
                doc, n = unpack(body.as_py(), 2)
                total[doc] += n
        return ids.append_column("n_tokens", pa.array(total))

    summed = pa.schema([("block", pa.int64()), ("body", pa.binary()), ("ids", pa.bool_())])
    parts = small_batches(d).mapInArrow(tables, "bucket int, block long, body binary, ids boolean")
    dealt = parts.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    sums = dealt.mapInArrow(joined, "block long, body binary, ids boolean")
    return sums.groupBy("block").applyInArrow(documents, f"doc_id {id_type.simpleString()}, n_bytes long, n_tokens long")


def _sums(body: bytes, pieces: dict[bytes, int], path: str) -> bytes:
    """Token sums per document of one part of a block's table; ``pieces``
    remembers the count of every word of the bucket."""
    size, text, n_docs, doc, times = unpack(body, 5)
    data, ends = text.tobytes(), np.cumsum(size, dtype=np.int64)
    words = [data[e - s:e] for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
    new = [w for w in words if w not in pieces]
    for at in range(0, len(new), 4096):
        some = new[at:at + 4096]
        for w, e in zip(some, load(path).encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
            pieces[w] = len(e.ids)
    count = np.repeat(np.fromiter(map(pieces.__getitem__, words), np.int64, len(words)), n_docs.astype(np.int64))
    total = np.bincount(doc, weights=count * times.astype(np.int64))
    some = np.flatnonzero(total)
    return pack([some, total[some].astype(np.int64)])
