"""Arrow-batch helpers shared by the operators that look inside texts.

All of them work on one contiguous UTF-8 buffer per slice of documents, so
the per-word work is vectorised and a task's memory follows the slice size
(``SLICE_BYTES``) or the longest single document, never the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Text bytes worked on at a time inside a task.
SLICE_BYTES = 1 << 19

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

U64 = np.uint64


#: Rows of an Arrow batch of texts at most; batches are buffered outside the heap.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches have BATCH_ROWS rows at most
    (a larger session setting is lowered)."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return df


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
        column = column.fill_null(b"" if binary else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None or offs[-1] == offs[0]:
        return np.empty(0, np.uint8), offs - offs[0]
    buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]]
    return buf, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str,
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row slices of about ``limit`` text bytes: (rows, bytes, offsets)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        buf, offs = string_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(at, end - at), buf[offs[at]:offs[end]], offs[at:end + 1] - offs[at]
            at = end


def word_spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per document) of the words in the buffer, parted by
    the bytes of ``space``; a document's edge always ends a word."""
    n = len(buf)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    solid = np.frombuffer(buf.tobytes().translate((~space).tobytes()), bool)
    edge = offs[(offs > 0) & (offs < n)]
    first = solid.copy()
    first[1:] = solid[1:] > solid[:-1]
    first[edge] = solid[edge]
    last = solid.copy()
    last[:-1] = solid[:-1] > solid[1:]
    last[edge - 1] = solid[edge - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.diff(np.searchsorted(start, offs))


def mix64(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: Odd bases of the two polynomial hashes; their inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^n (or of its inverse) modulo 2^64."""
    key = (base, inverse)
    have = _powers.get(key)
    if have is None or len(have) <= n:
        step = np.full(max(n + 1, SLICE_BYTES + (1 << 16)), pow(base, -1, 1 << 64) if inverse else base, U64)
        step[0] = 1
        have = np.cumprod(step, out=step)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[key] = have
    return have


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base^i modulo 2^64, with a leading 0."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(base, len(values))[:len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end], free of where the span lies; the length is
    mixed in. One base gives 64 bits, the two bases together 128."""
    h = (prefix[end] - prefix[start]) * powers(base, len(prefix), True)[start]
    return mix64(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """One 64-bit hash per word, made from its bytes."""
    return span_hash(prefix_hash(buf, base), start, end, base)


#: Bytes hashed at a time by ``chunked_hashes``.
HASH_BYTES = 1 << 21


def chunked_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As ``word_hashes``, in chunks of HASH_BYTES, so that the eight bytes a
    text byte that hashing needs don't follow the text; a word longer than a
    chunk is hashed by itself."""
    out = np.empty(len(start), U64)
    at = 0
    while at < len(start):
        stop = max(int(np.searchsorted(end, start[at] + HASH_BYTES, "right")), at + 1)
        if end[at] - start[at] > HASH_BYTES:
            digest = hashlib.blake2b(buf[start[at]:end[at]].tobytes(), digest_size=8).digest()
            out[at] = np.frombuffer(digest, U64)[0]
        else:
            out[at:stop] = word_hashes(buf[start[at]:end[stop - 1]], start[at:stop] - start[at], end[at:stop] - start[at])
        at = stop
    return out


#: Words of more bytes are not hashed in steps of eight.
STEP_BYTES = 64


def stepped_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, made eight bytes at a time and so without
    an array over the bytes; longer words than STEP_BYTES go to
    ``chunked_hashes``."""
    data = np.concatenate([buf, np.zeros(8, np.uint8)])
    wide = np.ndarray((len(buf) + 1,), "<u8", data, strides=(1,))
    length = end - start

    def lane(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return wide[at] << (U64(64) - (np.minimum(left, 8) << 3).astype(U64))
    h = mix64(lane(start, length) + length.astype(U64) * U64(BASES[0]))
    live = np.flatnonzero((length > 8) & (length <= STEP_BYTES))
    done = 8
    while len(live):
        h[live] = mix64((h[live] ^ lane(start[live] + done, length[live] - done)) + U64(BASES[1]))
        done += 8
        live = live[length[live] > done]
    long = np.flatnonzero(length > STEP_BYTES)
    if len(long):
        h[long] = chunked_hashes(buf, start[long], end[long])
    return h


def run_offsets(lengths: np.ndarray) -> np.ndarray:
    """0 .. length-1 of each run, concatenated."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def group_starts(counts: np.ndarray) -> np.ndarray:
    """Offsets of consecutive groups, with the total at the end."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return h.view(np.int64) if h.dtype == U64 else h.astype(np.int64)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Unsigned arrays as one compressed buffer, each in its smallest type."""
    sink = pa.BufferOutputStream()
    for a in arrays:
        if a.dtype != np.uint8:
            a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(a)), sink)
    raw = sink.getvalue()
    return np.int64(raw.size).tobytes() + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes, count: int) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int(np.frombuffer(data[:8], np.int64)[0]), "zstd")
    source = pa.BufferReader(raw)
    return [pa.ipc.read_tensor(source).to_numpy() for _ in range(count)]
