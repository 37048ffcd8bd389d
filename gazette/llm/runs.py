"""Periodic runs of words: maximal repetitions, found tile by tile and scale by
scale.

A run is a stretch of words with a smallest period q (words q apart are equal)
and a length of at least max(LEAST, TIMES * q) that no neighbouring word
extends. Periods are sought octave by octave, q in [2^k, 2^(k+1)). For octave k
a document is cut into overlapping tiles: one tile around every multiple c of
A = 2^(k+1), from c - A to c + A + q. A run of the octave has at least
3 * 2^k places that equal the place q words on, so one of them is some tile's
boundary c, and the boundary's Z-values decide the tile alone:

* only periods with word[c] == word[c + q] are asked (half a comparison a word
  and octave);
* the Z-value forward (how far the words from c and from c + q agree) and the
  one backward are found by bisection over prefix hashes, both cut at A;
* a tile keeps the fragment [c - back, c + forward) if it has A places, and
  if its block of q words is primitive (else a smaller period has the run).

Fragments of short documents are joined inside the task that read them; a long
document (more than TILE_WORDS words) is exploded into rows of tiles, which are shuffled and
solved anywhere. The fragments are shuffled by (document, period) and
stitched: those that touch are one run. Documents with fragments travel once
more, to meet their runs.

Words are compared by 64-bit hashes; spans by polynomials modulo 2^61 - 1, since
periodic texts defeat arithmetic modulo 2^64.

Defined results: a null or empty text has no words and no runs. Rows with the
same doc_id (or null) and different texts are told apart by 64 bits of hash of
the text; repeated rows have the same runs, found once. Only the named
columns are read, so other columns can't clash. An empty table gives an empty result. A very long text is
held once as hashes (eight bytes a word) while it is cut into tiles, and the tiles of
the octave nearest to a quarter of its length hold most of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.joins import join_measured
from gazette.llm.repeats import NO_ID, identified
from gazette.llm.tables import kept_table
from gazette.llm.text import (U64, chunked_hashes, group_starts, mix64, pack, run_offsets, slices, small_batches,
                              unpack, word_spans)

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: Words of a block of tiles; longer documents are exploded.
TILE_WORDS = 1 << 16
#: Boundaries and periods worked on at a time.
ASKED = 1 << 20

_P = U64((1 << 61) - 1)
_BASE = 0x1B873593C2B2AE35 % ((1 << 61) - 1)
_LOW31, _LOW30 = U64((1 << 31) - 1), U64((1 << 30) - 1)


def _mod(x: np.ndarray) -> np.ndarray:
    x = (x >> U64(61)) + (x & _P)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1."""
    ah, al, bh, bl = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    mid = al * bh + ah * bl
    return _mod(((ah * bh) << U64(1)) + (mid >> U64(30)) + ((mid & _LOW30) << U64(31)) + al * bl)


_power = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    """_BASE^0 .. _BASE^n at least, by doubling."""
    global _power
    have = _power
    while len(have) <= n:
        have = np.concatenate([have, _times(have, np.full(1, pow(_BASE, len(have), int(_P)), U64))])
    if len(have) <= 1 << 21:
        _power = have
    return have


class Spans:
    """Equality of spans of one sequence of hashes."""

    def __init__(self, values: np.ndarray) -> None:
        self.power = _powers(len(values))
        item = _times(_mod(mix64(values)), self.power[:len(values)])
        high, low = np.cumsum(item >> U64(31), dtype=U64), np.cumsum(item & _LOW31, dtype=U64)
        self.prefix = np.zeros(len(values) + 1, U64)
        self.prefix[1:] = _mod(_times(_mod(high), np.full(1, 1 << 31, U64)) + _mod(low))

    def equal(self, a: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether [a, a + length) and the span ``shift`` words on are equal."""
        p = self.prefix
        mine = _mod(p[a + length] + _P - p[a])
        other = _mod(p[a + shift + length] + _P - p[a + shift])
        return _times(mine, self.power[shift]) == other


def _bisect(most: np.ndarray, holds) -> np.ndarray:
    """The largest z in 0..most for which holds(rows, z), which is true up to it."""
    low, high = np.zeros_like(most), most.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_] + 1) >> 1
        ok = holds(open_, mid)
        low[open_] = np.where(ok, mid, low[open_])
        high[open_] = np.where(ok, high[open_], mid - 1)


def _primitive(spans: Spans, c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether [c, c + q) is no power of a shorter block: of none of
    q / r words, for the primes r of q."""
    ok, live, rest, prime = np.ones(len(c), bool), np.arange(len(c)), q.copy(), 2

    def test(rows: np.ndarray, r) -> None:
        step = q[rows] // r
        ok[rows] &= ~spans.equal(c[rows], step, q[rows] - step)
    while len(live) and prime * prime <= rest[live].max():
        by = live[rest[live] % prime == 0]
        test(by, prime)
        while len(by):
            rest[by] //= prime
            by = by[rest[by] % prime == 0]
        live = live[ok[live] & (rest[live] > 1)]
        prime += 1
    test(live[rest[live] > 1], rest[live[rest[live] > 1]])  # what is left is a prime
    return ok


def octaves(words: int) -> int:
    """How many octaves of periods ``words`` words can have runs of."""
    return (words // TIMES).bit_length()


def solve(values: np.ndarray, starts: np.ndarray, octave: int, spans: Spans | None = None,
          core: tuple[int, int, int] | None = None) -> tuple[np.ndarray, ...]:
    """(text, period, first, last) fragments of one octave: [first, last) of
    text ``values[starts[text]:starts[text + 1]]`` equal the places ``period`` on.

    Tile boundaries are the multiples of 2^(octave + 1) in each text; with
    ``core`` = (from, to, words), those between two places of the one text
    given, which is a piece of one of ``words`` words."""
    step, half = 2 << octave, 1 << octave
    size = np.diff(starts)
    if core is not None:
        at, size = np.arange(core[0], core[1]), np.array([core[2]])
        text = np.zeros(len(at), np.int64)
    else:
        which = np.flatnonzero(size >= TIMES * half)
        text, at = np.repeat(which, size[which]), run_offsets(size[which])
    q = at & (step - 1)
    near = np.flatnonzero((q >= half) & (q * TIMES <= size[text]))
    place = starts[text[near]] + at[near]
    near = near[values[place] == values[place - q[near]]]
    spans = spans or Spans(values)
    found = [_fragments(starts, text[rows], at[rows], q[rows], spans, step)
             for rows in np.split(near, range(ASKED, len(near), ASKED))]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _fragments(starts: np.ndarray, text: np.ndarray, at: np.ndarray, q: np.ndarray, spans: Spans, step: int) -> tuple[np.ndarray, ...]:
    """The fragments of the boundaries ``at`` - ``q`` and periods ``q``."""
    half = step // 2
    c = starts[text] + at - q
    ahead = np.minimum(step, starts[text + 1] - c - q)
    behind = np.minimum(step, c - starts[text])
    # one of both sides agrees for half a step
    ok = np.zeros(len(c), bool)
    for room, first in ((ahead, c), (behind, c - half)):
        can = np.flatnonzero(room >= half)
        ok[can] |= spans.equal(first[can], q[can], np.full(len(can), half))
    ok = np.flatnonzero(ok)
    ok = ok[_primitive(spans, c[ok], q[ok])]
    text, q, c, ahead, behind = text[ok], q[ok], c[ok], ahead[ok], behind[ok]
    forward = _bisect(ahead, lambda r, z: spans.equal(c[r], q[r], z))
    back = _bisect(behind, lambda r, z: spans.equal(c[r] - z, q[r], z))
    ok = forward + back >= step
    first = c[ok] - starts[text[ok]]
    return text[ok], q[ok], first - back[ok], first + forward[ok]


def _joined(text: np.ndarray, period: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fragments of a text and period that touch as one."""
    order = np.lexsort((first, period, text))
    text, period, first, last = text[order], period[order], first[order], last[order]
    if not len(text):
        return text, period, first, last
    group = np.cumsum(np.concatenate([[0], (np.diff(text) != 0) | (np.diff(period) != 0)]))
    # ends as running maxima inside a group: groups are lifted above each other
    lift = group * (int(last.max()) + 2)
    ends = np.maximum.accumulate(last + lift)
    head = np.ones(len(text), bool)
    head[1:] = (np.diff(group) != 0) | (first[1:] + lift[1:] > ends[:-1])
    at = np.flatnonzero(head)
    tail = np.append(at[1:], len(text)) - 1
    return text[at], period[at], first[at], ends[tail] - lift[tail]


#: What the scan writes: a document, a fragment, or a row of tiles.
DOCUMENT, FRAGMENT, TILES = 0, 1, 2
_TYPES = {"kind": pa.int32(), "doc": pa.int64(), "sig": pa.int64(), "n_words": pa.int64(), "busy": pa.bool_(),
          "period": pa.int64(), "first": pa.int64(), "last": pa.int64(), "octave": pa.int32(), "body": pa.binary()}
_FOUND = ("kind int, doc long, sig long, n_words long, busy boolean, period long, first long, last long, "
          "octave int, body binary")


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    columns["kind"] = np.full(n, kind, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _TYPES.items()], list(_TYPES))


def _fragment_rows(doc: np.ndarray, sig: np.ndarray, period: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    return _rows(FRAGMENT, len(period), doc=doc, sig=sig, period=period, first=first, last=last)


def _tile_rows(doc: int, sig: int, values: np.ndarray, tile_words: int) -> Iterator[pa.RecordBatch]:
    """A long text as rows of tiles, octave by octave: the words that the
    tiles of a row see, and (where those begin, the row's boundaries, the words of
    the text)."""
    n = len(values)
    for octave in range(octaves(n)):
        step = 2 << octave
        block = max(step, tile_words)
        for at in range(0, n, block):
            low, high = max(at - step, 0), min(at + block + 2 * step, n)
            body = pack([values[low:high], np.array([low, at, min(at + block, n), n], U64)])
            yield _rows(TILES, 1, doc=[doc], sig=[sig], octave=[octave], body=[body])


def _solve_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, sig, octave, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            values, where = unpack(body, 2)
            low, at, end, n = where.astype(np.int64).tolist()
            found = solve(values.astype(U64), np.array([0, len(values)]), octave, core=(at - low, end - low, n))
            _, period, first, last = _joined(*found)
            if len(period):
                yield _fragment_rows(np.full(len(period), doc), np.full(len(period), sig), period, first + low, last + low)


def scan_documents(docs: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """The written rows of the scan of (doc, sig, text): every document with
    its words joined by one space, fragments, and tiles of long documents."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in slices(batches, "text"):
            start, end, words = word_spans(buf, offs)
            values, starts = chunked_hashes(buf, start, end), group_starts(words)
            doc, sig = (rows.column(i).to_numpy() for i in (0, 1))
            long = words > tile_words
            for r in np.flatnonzero(long):
                yield from _tile_rows(int(doc[r]), int(sig[r]), values[starts[r]:starts[r + 1]], tile_words)
            busy = long.copy()
            most = int(words[~long].max(initial=0))
            if most >= LEAST:
                short = values[np.repeat(~long, words)]
                at = group_starts(np.where(long, 0, words))
                spans = Spans(short)
                text, period, first, last = _joined(*(np.concatenate(c) for c in zip(
                    *(solve(short, at, k, spans) for k in range(octaves(most))), strict=True)))
                whole = np.flatnonzero(last - first + period >= np.maximum(LEAST, TIMES * period))
                text = text[whole]
                busy[text] = True
                if len(text):
                    yield _fragment_rows(doc[text], sig[text], period[whole], first[whole], last[whole])
            data = buf.tobytes()
            bodies = [b" ".join(data[a:b].split()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield _rows(DOCUMENT, len(words), doc=doc, sig=sig, n_words=words, busy=busy, body=bodies)
    return kept_table(small_batches(docs).mapInArrow(scan, _FOUND))


def stitched(fragments: DataFrame) -> DataFrame:
    """(doc, sig, runs): the runs of every document that has one, in order of
    start and period. Touching fragments of a document and period are one."""
    f = fragments.select("doc", "sig", "period", "first", "last").distinct()
    order = Window.partitionBy("doc", "sig", "period").orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("_new", F.when(F.col("first") <= before, 0).otherwise(1))
    f = f.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = f.groupBy("doc", "sig", "period", "_run").agg(F.min("first").alias("start"), F.max("last").alias("_last"))
    length = F.col("_last") - F.col("start") + F.col("period")
    runs = runs.withColumn("length", length).where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    return runs.groupBy("doc", "sig").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for body, runs in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            words = body.split(b" ")
            gone = np.zeros(len(words) + 1, np.int32)
            for r in runs or ():
                gone[r["start"] + r["period"]] += 1
                gone[r["start"] + r["length"]] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 2, 4)), pa.array(kept, pa.binary()).cast(pa.string())],
                                         ["doc", "sig", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile_words: int = TILE_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every document: ``runs`` are
    structs (start, period, length) in order; ``collapsed`` has the words that no run
    holds after its first period, joined by one space."""
    doc, sig = identified(docs, doc_id, text)
    found = scan_documents(docs.select(doc.alias("doc"), sig.alias("sig"), docs[text].cast("string").alias("text")), tile_words)
    tiles = found.where(F.col("kind") == TILES).select("doc", "sig", "octave", "body")
    # a row of tiles is work for seconds: dealt by place, whatever its size
    solved = tiles.repartition(F.xxhash64("body")).mapInArrow(_solve_rows, _FOUND)
    runs = stitched(found.where(F.col("kind") == FRAGMENT).union(solved)).select(
        F.col("doc").alias("_doc"), F.col("sig").alias("_sig"), "runs")
    every = found.where(F.col("kind") == DOCUMENT).select("doc", "sig", "n_words", "body", "busy")
    busy = join_measured(every.where("busy"), runs, (F.col("doc") == F.col("_doc")) & (F.col("sig") == F.col("_sig")), "left",
                         24 * F.size("runs"))
    runs_type = "array<struct<start:long,period:long,length:long>>"
    loud = busy.select("doc", "sig", "n_words", "body", "runs").mapInArrow(
        _collapse, f"doc long, sig long, n_words long, runs {runs_type}, collapsed string")
    quiet = every.where("not busy").select("doc", "sig", "n_words", F.lit(None).cast(runs_type).alias("runs"),
                                           F.col("body").cast("string").alias("collapsed"))
    id_type = docs.schema[doc_id].dataType
    return loud.union(quiet).select(F.when(F.col("doc") != NO_ID, F.col("doc")).cast(id_type).alias("doc_id"), "n_words",
                                    F.coalesce("runs", F.array().cast(runs_type)).alias("runs"), "collapsed")
