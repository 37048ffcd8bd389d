"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` writes the postings of all training texts as a table of
segments. A segment is the inverted index of some documents (about
SEGMENT_BYTES of text, whole documents): its terms in order, and for each
term the word positions where it stands. Segments are made where the texts
are read, so no posting is shuffled, and a lost executor costs the segments it
was writing.

A search takes the test texts in blocks of BLOCK_BYTES of distinct texts (what
is sent to the tasks never exceeds a block, whatever the size of the
benchmark) and runs each block over all segments. For each window of a test
text, in each segment:

* the posting lists of its terms are looked up; a window with an absent term
  is done;
* the shortest list, less the term's offset in the window, gives the places
  where the window may begin;
* the other lists are intersected with these places, offset-adjusted, from
  the rarest to the most frequent; a place that stays in all lists is an
  exact phrase match.

``near_matches`` does the same with distances instead of offsets: every term
of the window must stand within reach of the rarest one; the shortest
stretches of words that hold all terms are the proximity matches.

Words are maximal runs of digits, letters after A-Z are lower-cased, and of
all characters beyond ASCII; they are compared by 64-bit hashes.

Defined results: a null or empty text has no words and no matches, on either
side. Rows are judged each on their own, also repeated ones and ones under
a null doc_id; benchmark rows with the same text are searched once. Rows
of one item_id are one item with the windows of all its texts; a null
item_id contaminates like others and counts as one item, but has no id to
list. An empty table on either side gives no hits. Only the named columns are
read, so other columns can't clash. A very long text is a segment of its own;
its task needs about ten bytes for each byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.buckets import heads
from gazette.llm.joins import join_measured
from gazette.llm.tables import kept_table
from gazette.llm.text import (BASES, U64, chunked_hashes, group_starts, pack, prefix_hash, run_offsets, signed, slices,
                              small_batches, span_hash, string_bytes, unpack, word_spans)

WINDOW = 10
SEGMENT_BYTES = 1 << 21
#: Bytes of distinct test texts searched at a time.
BLOCK_BYTES = 4 << 20
#: Places and windows worked on at a time in a task.
PLACES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_GAP = np.ones(256, bool)
_GAP[0x30:0x3A] = _GAP[0x61:0x7B] = _GAP[0x80:] = False


def terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text)."""
    low = _LOWER[buf]
    start, end, words = word_spans(low, offs, _GAP)
    return chunked_hashes(low, start, end), words


class Segment:
    """Sorted terms, and the sorted places of each."""

    def __init__(self, term: np.ndarray, count: np.ndarray, place: np.ndarray, words: np.ndarray) -> None:
        self.term, self.count, self.first = term, count.astype(np.int64), group_starts(count)
        self.place, self.docs = place.astype(np.int64), group_starts(words)
        self.width = int(self.docs[-1]) + 1
        #: (term, place) as one number: a membership test is a binary search
        self.posting = np.repeat(np.arange(len(term)), self.count) * self.width + self.place

    @staticmethod
    def packed(hashes: np.ndarray) -> bytes:
        order = np.argsort(hashes, kind="stable")
        head = np.flatnonzero(heads(order, hashes))
        return pack([hashes[order[head]], np.diff(np.append(head, len(order))).astype(U64), order.astype(U64)])

    def slots(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, length of the posting list) of each term; 0 if absent."""
        if not len(self.term):
            return np.zeros(len(term), np.int64), np.zeros(len(term), np.int64)
        slot = np.minimum(np.searchsorted(self.term, term), len(self.term) - 1)
        return slot, np.where(self.term[slot] == term, self.count[slot], 0)

    def after(self, slot: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of a term at or after ``place`` (or the width)."""
        i = np.searchsorted(self.posting, slot * self.width + place)
        found = self.posting[np.minimum(i, len(self.posting) - 1)]
        return np.where((i < len(self.posting)) & (found // self.width == slot), found % self.width, self.width)

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.docs, place, "right") - 1


class Windows:
    """The distinct windows of a block of test texts."""

    def __init__(self, texts: list[str], window: int) -> None:
        buf, offs = string_bytes(pa.array(texts, pa.large_string()))
        hashes, words = terms(buf, offs)
        self.term, self.word = np.unique(hashes, return_inverse=True)
        self.word = self.word.astype(np.uint32)
        per_text = np.where(words > 0, np.maximum(words - window + 1, 1), 0)
        base = group_starts(words)[:-1]
        first = np.repeat(base, per_text) + run_offsets(per_text)
        length = np.repeat(np.minimum(words, window), per_text)
        text = np.repeat(np.arange(len(texts)), per_text)
        ident = np.zeros(len(first), [("a", U64), ("b", U64)])
        for f, b in zip("ab", BASES, strict=True):
            ident[f] = span_hash(prefix_hash(hashes, b), first, first + length, b)
        _, lead, which = np.unique(ident, return_index=True, return_inverse=True)
        self.first, self.length = first[lead], length[lead]
        # the texts of each window
        pair = np.unique(which.astype(np.int64) * max(len(texts), 1) + text)
        self.of, self.text = group_starts(np.bincount(pair // max(len(texts), 1), minlength=len(lead))), pair % max(len(texts), 1)

    def rows(self, which: np.ndarray, length: int) -> np.ndarray:
        """Terms of windows of one length, as a matrix."""
        return self.word[self.first[which][:, None] + np.arange(length)]

    def chunks(self) -> Iterator[tuple[np.ndarray, int]]:
        for length in np.unique(self.length):
            same = np.flatnonzero(self.length == length)
            for at in range(0, len(same), PLACES // 8):
                yield same[at:at + PLACES // 8], int(length)


def _rarest_first(seg: Segment, windows: Windows) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(window, length, slots, offsets, list lengths), terms from the rarest
    on, for windows whose terms all occur; a chunk has about PLACES places of
    rarest terms."""
    slot, count = seg.slots(windows.term)
    for which, length in windows.chunks():
        matrix = windows.rows(which, length)
        n = count[matrix]
        live = np.flatnonzero(n.min(axis=1) > 0)
        if not len(live):
            continue
        which, matrix, n = which[live], matrix[live], n[live]
        order = np.argsort(n, axis=1, kind="stable")
        lists = np.take_along_axis(n, order, 1)
        slots = slot[np.take_along_axis(matrix, order, 1)]
        step = np.cumsum(lists[:, 0]) // PLACES
        for part in np.split(np.arange(len(which)), np.flatnonzero(np.diff(step)) + 1):
            yield which[part], length, slots[part], order[part], lists[part]


def exact_matches(seg: Segment, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, length) of every place where a window stands."""
    found = []
    for which, length, slots, offset, lists in _rarest_first(seg, windows):
        n = lists[:, 0]
        row = np.repeat(np.arange(len(which)), n)
        start = seg.place[seg.first[slots[row, 0]] + run_offsets(n)] - offset[row, 0]
        ok = start >= 0
        row, start = row[ok], start[ok]
        for j in range(1, length):
            want = start + offset[row, j]
            ok = (want < seg.width) & (seg.after(slots[row, j], np.minimum(want, seg.width - 1)) == want)
            row, start = row[ok], start[ok]
        ok = seg.doc(start) == seg.doc(start + length - 1)
        found.append((which[row[ok]], start[ok], np.full(int(ok.sum()), length)))
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def proximity_matches(seg: Segment, windows: Windows, slop: int) -> list[tuple[int, int, int]]:
    """(window, start, end) of the shortest stretches of at most window +
    ``slop`` words of one document that hold every term of a window."""
    found = set()
    for which, length, slots, _, lists in _rarest_first(seg, windows):
        reach, n = length + slop, lists[:, 0]
        row = np.repeat(np.arange(len(which)), n)
        place = seg.place[seg.first[slots[row, 0]] + run_offsets(n)]
        doc = seg.doc(place)
        low = np.maximum(place - reach + 1, seg.docs[doc])
        high = np.minimum(place + reach, seg.docs[doc + 1])
        for j in range(1, length):
            ok = seg.after(slots[row, j], low) < high
            row, low, high = row[ok], low[ok], high[ok]
        for r, a, b in zip(row.tolist(), low.tolist(), high.tolist(), strict=True):
            wanted = sorted(set(slots[r].tolist()))
            at = []
            for s in wanted:
                mine = seg.place[seg.first[s]:seg.first[s + 1]]
                at += [(int(p), s) for p in mine[np.searchsorted(mine, a):np.searchsorted(mine, b)]]
            at.sort()
            last: dict[int, int] = {}
            for p, s in at:
                last[s] = p
                if len(last) == len(wanted) and p - min(last.values()) < reach:
                    found.add((int(which[r]), min(last.values()), p + 1))
    return _shortest(found)


def _shortest(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches that hold no other one of their window."""
    out: list[tuple[int, int, int]] = []
    for m in sorted(found, key=lambda m: (m[0], m[2], -m[1])):
        if not out or out[-1][0] != m[0] or m[1] > out[-1][1]:
            out.append(m)
    return out


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored index: (segment, ids, words, body), one row a segment. ``ids``
    and ``words`` are its documents and their numbers of words."""
    d = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for rows, buf, offs in slices(batches, "text", segment_bytes):
            hashes, words = terms(buf, offs)
            ids = rows.column(0)
            n = pa.array([0, rows.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int64()), pa.ListArray.from_arrays(n, ids),
                 pa.ListArray.from_arrays(n, pa.array(words.astype(np.int64))), pa.array([Segment.packed(hashes)], pa.binary())],
                ["segment", "ids", "words", "body"])
            segment += 1
    id_type = d.schema["doc_id"].dataType.simpleString()
    return kept_table(small_batches(d).mapInArrow(index, f"segment long, ids array<{id_type}>, words array<long>, body binary"))


def _read(index: DataFrame, work, schema: str) -> DataFrame:
    """``work(segment number, ids, words, Segment)`` over all segments."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(2)[i].values.to_numpy()
                seg = Segment(*unpack(batch.column(3)[i].as_py(), 3), words)
                yield from work(batch.column(0)[i].as_py(), batch.column(1)[i].values, words, seg)
    return small_batches(index).mapInArrow(read, schema)


def blocks(items: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """The distinct test texts in blocks of about ``block_bytes`` (a longer
    text has a block of its own size); each block is read when it is asked for."""
    texts = items.select(items[text].cast("string").alias("text")).where("text <> ''").distinct()
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // block_bytes)
    part = F.pmod(F.xxhash64("text"), F.lit(parts))
    for b in range(parts):
        yield [r.text for r in texts.where(part == b).orderBy("text").collect()]


def text_hashes(texts: list[str]) -> np.ndarray:
    """``xxhash64`` of Spark (seed 42), as signed numbers."""
    import xxhash
    return np.array([xxhash.xxh64_intdigest(t.encode(), seed=42) for t in texts], U64).view(np.int64)


def phrase_hits(index: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(segment, row, doc_id, n_words, spans, texts) of every document: the
    stretches of words inside exact matches, apart and in order, and the xxhash64 of
    the matching test texts in order."""
    id_type = index.schema["ids"].dataType.elementType.simpleString()
    span = "array<struct<start:long,end:long>>"
    schema = f"segment long, row int, doc_id {id_type}, n_words long, spans {span}, texts array<long>"

    def searched(block: list[str]) -> DataFrame:
        windows, names = Windows(block, window), text_hashes(block)

        def work(number, ids, words, seg):
            w, start, length = exact_matches(seg, windows)
            mark = np.zeros(seg.width + 1, np.int32)
            np.add.at(mark, start, 1)
            np.add.at(mark, start + length, -1)
            hit = np.cumsum(mark[:seg.width]) > 0
            hit[-1] = False
            # stretches, cut at the edges of documents
            edge = np.zeros(seg.width + 1, bool)
            edge[seg.docs] = True
            head = np.flatnonzero(hit & (~np.concatenate([[False], hit[:-1]]) | edge[:-1]))
            tail = np.flatnonzero(hit & (~np.concatenate([hit[1:], [False]]) | edge[1:])) + 1
            owner = seg.doc(head)
            spans = pa.StructArray.from_arrays([pa.array(head - seg.docs[owner]), pa.array(tail - seg.docs[owner])], ["start", "end"])
            n_spans = group_starts(np.bincount(owner, minlength=len(words))).astype(np.int32)
            # test texts of each document; copies have the same windows
            pair = np.unique(seg.doc(start) * max(len(windows.first), 1) + w)
            doc, w = pair // max(len(windows.first), 1), pair % max(len(windows.first), 1)
            known: dict[bytes, list[int]] = {}
            texts: list[list[int]] = [[] for _ in words]
            for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else ():
                mine = w[part].tobytes()
                if mine not in known:
                    n = np.diff(windows.of)[w[part]]
                    which = np.unique(windows.text[np.repeat(windows.of[w[part]], n) + run_offsets(n)])
                    known[mine] = np.sort(names[which]).tolist()
                texts[int(doc[part[0]])] = known[mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(words), number)), pa.array(np.arange(len(words), dtype=np.int32)), ids, pa.array(words),
                 pa.ListArray.from_arrays(pa.array(n_spans), spans), pa.array(texts, pa.list_(pa.int64()))],
                ["segment", "row", "doc_id", "n_words", "spans", "texts"])
        return _read(index, work, schema)

    found = [searched(block) for block in blocks(items, text, block_bytes)] or [searched([])]
    if len(found) == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    merged = every.groupBy("segment", "row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("texts")))).alias("texts"))
    joined = F.expr(f"""aggregate(spans, cast(array() as {span}), (done, s) ->
        if(size(done) > 0 and element_at(done, -1).end >= s.start,
           concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end)))),
           concat(done, array(s))))""")
    return merged.withColumn("spans", joined)


def near_matches(index: DataFrame, items: DataFrame, slop: int, text: str = "text", window: int = WINDOW,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(segment, row, doc_id, text, start, end): the proximity matches, each
    with the xxhash64 of a test text that has the window."""
    id_type = index.schema["ids"].dataType.elementType.simpleString()

    def searched(block: list[str]) -> DataFrame:
        windows, names = Windows(block, window), text_hashes(block)

        def work(number, ids, words, seg):
            found = np.array(proximity_matches(seg, windows, slop), np.int64).reshape(-1, 3)
            n = np.diff(windows.of)[found[:, 0]]
            which = windows.text[np.repeat(windows.of[found[:, 0]], n) + run_offsets(n)]
            start, end = (np.repeat(found[:, c], n) for c in (1, 2))
            doc = seg.doc(start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(doc), number)), pa.array(doc.astype(np.int32)), ids.take(pa.array(doc)), pa.array(names[which]),
                 pa.array(start - seg.docs[doc]), pa.array(end - seg.docs[doc])],
                ["segment", "row", "doc_id", "text", "start", "end"])
        return _read(index, work, f"segment long, row int, doc_id {id_type}, text long, start long, end long")

    found = [searched(block) for block in blocks(items, text, block_bytes)] or [searched([])]
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.distinct()


def words_in(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, spans) of every document:
    ``spans`` are its contaminated stretches, ``items`` the ids found there
    as strings, in order.

    Documents with the same matching texts share one list of items, which
    is made once for each set of texts."""
    hits = kept_table(phrase_hits(build_index(docs, doc_id, text), items, item_text, window, block_bytes)
                      .withColumn("found", F.xxhash64("texts")))
    sets = hits.where(F.size("texts") > 0).groupBy("found").agg(F.first("texts").alias("texts"))
    ids = items.select(F.xxhash64(items[item_text].cast("string")).alias("_text"), items[item_id].cast("string").alias("_id")).distinct()
    listed = sets.select("found", F.explode("texts").alias("_text")).join(ids, "_text").groupBy(F.col("found").alias("_found")).agg(
        F.array_sort(F.collect_set("_id")).alias("items"), F.max(F.col("_id").isNull().cast("int")).alias("_unnamed"))
    named = join_measured(hits.where(F.size("texts") > 0), listed, F.col("found") == F.col("_found"), "left", 24 * F.size("items"))
    quiet = hits.where(F.size("texts") == 0).select("*", F.array().cast("array<string>").alias("items"), F.lit(0).alias("_unnamed"))
    return named.drop("_found").union(quiet).select(
        "doc_id", "n_words", words_in(F.col("spans")).alias("n_hit"),
        (F.size("items") + F.col("_unnamed")).cast("long").alias("n_items"), "items", "spans")
