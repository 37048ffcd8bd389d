"""Packing documents into fixed-length training sequences.

Texts are encoded in the scan; only a document longer than a sequence is
cut. Pieces are dealt into groups of about ``group_pieces`` and each group is
packed in a task of its own: best fit on decreasing length first, then a local
search that takes the emptiest sequence and moves a document into another
underfull one, exchanges one for one, or one for two, whenever that raises
the sum of squared fills; a sequence that runs empty is saved. A group leaves
at most one or two ill-filled sequences, so the loss against packing
everything together is below one sequence in thousands.

Defined results: a null or empty text is the single end token. Repeated rows
are packed each on their own. A null doc_id is an ordinary value. An empty
table gives an empty result. Extra input columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.encoders import byte_level_ids, default_path
from gazette.llm.text import slices, small_batches
from gazette.session import cut_lineage

LENGTH = 2048
END = 0


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
           end_id: int = END, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a document of up to
    ``length`` tokens is one piece; a longer one is cut from its end, so its
    first piece may be the shorter one."""
    d = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or default_path("byte_bpe_50k.json")
        for rows, buf, offs in slices(batches, "text"):
            out: list[tuple] = []
            data = buf.tobytes()
            for row in range(rows.num_rows):
                ids = np.append(byte_level_ids(path, data[offs[row]:offs[row + 1]]), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % length or length, len(ids), length), len(ids)]
                out += [(row, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b])
                        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            at, k, start, n, crc, ids = zip(*out, strict=True)
            columns = [rows.column(0).take(pa.array(at)), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return small_batches(d).mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
                        + ", ids array<int>" * with_ids)


class Packer:
    """One group's sequences: best fit decreasing, then local search."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        self.bin = np.full(len(sizes), -1, np.int64)
        self.room: list[int] = []
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        open_rooms = 0  # bit r: some sequence has room r
        for i in np.argsort(-self.sizes, kind="stable").tolist():
            n = int(self.sizes[i])
            fits = open_rooms >> n
            if fits:
                room = n + (fits & -fits).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    open_rooms &= ~(1 << room)
            else:
                room, b = capacity, len(self.room)
                self.room.append(capacity)
            self.bin[i] = b
            self.room[b] = room = room - n
            by_room[room].append(b)
            open_rooms |= 1 << room
        self.space = np.array(self.room, np.int64)
        self.members: list[list[int]] = [[] for _ in self.room]
        for i, b in enumerate(self.bin.tolist()):
            self.members[b].append(i)

    def move(self, i: int, to: int) -> None:
        at, n = self.bin[i], self.sizes[i]
        self.members[at].remove(i)
        self.members[to].append(i)
        self.bin[i] = to
        self.space[at] += n
        self.space[to] -= n

    def improve(self, patience: int) -> None:
        """Empty the least filled sequences as long as one of ``patience``
        tries in a row gets rid of one."""
        least = -(-int(self.sizes.sum()) // self.capacity)
        live = int((self.space < self.capacity).sum())
        misses, stuck = 0, np.zeros(len(self.space), bool)
        while live > least and misses < patience:
            fill = np.where((self.space < self.capacity) & ~stuck, self.capacity - self.space, self.capacity + 1)
            t = int(fill.argmin())
            if fill[t] > self.capacity:
                return
            while self.members[t] and self.step(t):
                pass
            if self.members[t]:
                stuck[t] = True
                misses += 1
            else:
                live -= 1
                misses = 0

    def step(self, t: int) -> bool:
        """One exchange that makes sequence ``t`` lighter and another one
        fuller than ``t`` was, which raises the sum of squared fills."""
        fill = self.capacity - int(self.space[t])
        others = np.flatnonzero((self.space > 0) & (self.space < self.capacity) & (self.capacity - self.space >= fill))
        others = others[others != t]
        mine = sorted(self.members[t], key=lambda i: -self.sizes[i])
        for i in mine:  # a move into the tightest room
            fits = others[self.space[others] >= self.sizes[i]]
            if len(fits):
                self.move(i, int(fits[self.space[fits].argmin()]))
                return True
        item = np.flatnonzero(np.isin(self.bin, others))
        size, room = self.sizes[item], self.space[self.bin[item]]
        for i in mine:  # one for one: the largest gain
            n = self.sizes[i]
            ok = (size < n) & (size + room >= n)
            if ok.any():
                j = int(item[ok][size[ok].argmin()])
                x = int(self.bin[j])
                self.move(j, t)
                self.move(i, x)
                return True
        for a in range(len(mine)):  # two of this one for one
            for b in range(a + 1, min(len(mine), a + 9)):
                n = self.sizes[mine[a]] + self.sizes[mine[b]]
                ok = (size < n) & (size + room >= n)
                if ok.any():
                    j = int(item[ok][size[ok].argmin()])
                    x = int(self.bin[j])
                    self.move(j, t)
                    self.move(mine[a], x)
                    self.move(mine[b], x)
                    return True
        order = np.lexsort((size, self.bin[item]))
        item = item[order]
        near = self.bin[item[1:]] == self.bin[item[:-1]]
        first, second = item[:-1][near], item[1:][near]
        pair, room = self.sizes[first] + self.sizes[second], self.space[self.bin[first]]
        for i in mine:  # one of this one for two neighbours in size of another
            n = self.sizes[i]
            ok = (pair < n) & (pair + room >= n)
            if ok.any():
                k = int(np.flatnonzero(ok)[pair[ok].argmin()])
                x = int(self.bin[first[k]])
                self.move(int(first[k]), t)
                self.move(int(second[k]), t)
                self.move(i, x)
                return True
        return False

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece; sequences without gaps."""
        order = np.lexsort((np.arange(len(self.bin)), self.bin))
        ends = np.cumsum(self.sizes[order])
        head = np.ones(len(order), bool)
        head[1:] = self.bin[order][1:] != self.bin[order][:-1]
        begin = (ends - self.sizes[order])
        offset = np.empty(len(order), np.int64)
        offset[order] = begin - np.repeat(begin[head], np.diff(np.append(np.flatnonzero(head), len(order))))
        return self.bin, offset


def pack(cut: DataFrame, length: int = LENGTH, group_pieces: int = 16_384, patience: int = 64) -> DataFrame:
    """``cut`` (with a column ``length``) plus sequence_id and offset.

    Full pieces are sequences of their own and are not dealt out."""
    cut = cut_lineage(cut.withColumn("_row", F.monotonically_increasing_id()))
    full = cut.where(F.col("length") >= length).select(
        "*", (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = cut.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group_pieces))
    rest = rest.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        packer = Packer(table.column("length").to_numpy(), length)
        packer.improve(patience)
        sequence, offset = packer.places()
        group = table.column("_group")[0].as_py()
        kept = table.drop_columns(["_group"])
        return kept.append_column("sequence_id", pa.array(sequence + (group << 32))).append_column("offset", pa.array(offset))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long"
    packed = rest.groupBy("_group").applyInArrow(run, schema)
    return full.unionByName(packed).drop("_row")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   tokenizer: str | None = None, **params) -> DataFrame:
    """Encode, cut and pack: one row per piece."""
    return pack(pieces(docs, doc_id, text, length, tokenizer=tokenizer), length, **params)
