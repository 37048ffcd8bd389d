"""Conversation prefix trie: every distinct sequence of first turns is a node.

1. ``numbered`` orders the turns of each conversation by range partitioning, so
   that a conversation of any length is spread over tasks, and numbers them by a
   prefix scan: each partition sums up the conversation it ends in (one row a
   partition goes to the driver), and the sums before it are carried in.
2. A prefix is named by 128 bits: the exclusive or of hashes of (depth, role,
   text) of its turns, again a prefix scan (``prefixes``).
3. Count-min screening: all prefix digests are counted in a sketch of at most
   SKETCH_CELLS cells a row, each cell up to 2. The sketch never counts too little:
   an estimate of one proves that a prefix belongs to one conversation, and so do
   all longer ones of that conversation. These tails are emitted where they are;
   only prefixes that may be shared are shuffled and grouped exactly. (With more
   prefixes than the largest sketch can tell apart, more rows are shuffled; the
   results stay the same.)
4. Subtree sums need no walk over the tree. A node belongs to its smallest
   member; along a conversation its own nodes begin at one depth ``top`` and last to
   its end. A subtree's saved tokens are, over its members, the bytes of the
   turns from the node's depth to the one before their ``top``; its leaves are the
   members that own a childless last node. Both are plain sums over members,
   combined before the shuffle.
5. The hash of a node's ending members is taken over their ids in order: ids are
   joined in pieces of CHUNK consecutive numbers, and the pieces of a node
   stream through one hash.

Defined results: turns are in order of (turn, role, text), null turns first; rows
alike in all of these are one after the other. A null role or text is empty. Rows
without conv_id belong to no conversation and are left out. A conversation
that is rebuilt without turns is a member of the root alone. An empty table has
no node. Only the named columns are read, so other columns can't clash. Texts are
hashed where they are read; long ones cost no memory beyond their row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.joins import join_measured
from gazette.llm.text import U64, mix64, pack, small_batches, unpack
from gazette.session import cut_lineage

#: Cells of a row of the sketch: at least, and at most (a byte each).
LEAST_CELLS, SKETCH_CELLS = 1 << 16, 1 << 23
SKETCH_ROWS = 3
#: Cells that travel in one row when sketches are added up.
SKETCH_PIECE = 1 << 18
#: Consecutive conv_ids whose decimals are joined in one row, as a power of two.
CHUNK_BITS = 16


def _ends(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])


def _running(values: np.ndarray, first: np.ndarray, add: np.ufunc, carry: int) -> np.ndarray:
    """Running ``add`` inside each run; ``carry`` goes into the first run."""
    total = add.accumulate(values)
    before = np.concatenate([[0], total])[first[:-1]]
    size = np.diff(first)
    base = np.repeat(before, size)
    out = total ^ base if add is np.bitwise_xor else total - base
    out[:size[0]] = add(out[:size[0]], carry)
    return out


def running(df: DataFrame, key: str, xors: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``nth`` and, for each column c of longs, ``c_upto``: the number, the
    exclusive or or the sum of its key's rows up to this one.

    ``df`` must have stable partitions (a checkpoint, or narrow steps after
    one) whose rows, one partition after the other, are in order of ``key``,
    a long that is never null. What is carried in is found by the number of the
    partition, so the result is materialised here: inside a union or after a
    coalesce the same partitions run under other numbers."""
    columns = [*xors, *sums]
    adds = [np.add, *[np.bitwise_xor] * len(xors), *[np.add] * len(sums)]
    names = ["nth", *[f"{c}_upto" for c in columns]]

    def values(batch: pa.RecordBatch) -> list[np.ndarray]:
        mine = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns]
        return [np.ones(batch.num_rows, np.int64), *mine]

    def last_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = at = None
        total = [0] * len(adds)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            begin = int(_ends(keys)[-2])
            first = int(keys[0]) if first is None else first
            if begin or at != int(keys[-1]):
                total = [0] * len(adds)
            at = int(keys[-1])
            total = [int(f(np.int64(t), f.reduce(v[begin:]))) for f, t, v in zip(adds, total, values(batch), strict=True)]
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int64()) for x in (TaskContext.get().partitionId(), first, at, *total)], ["part", "first", "last", *names])
    ended = small_batches(df).mapInArrow(last_of, ", ".join(f"{c} long" for c in ["part", "first", "last", *names]))
    carried: dict[int, list[int]] = {}
    at, total = None, []
    for r in sorted(ended.collect()):  # one row a partition
        own = list(r[3:])
        if r["first"] == at:
            carried[r["part"]] = total
            if r["last"] == at:
                own = [int(f(np.int64(a), np.int64(b))) for f, a, b in zip(adds, total, own, strict=True)]
        at, total = r["last"], own

    def upto(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, carry = None, carried.get(TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
            first = _ends(keys)
            use = carry if carry is not None and at in (None, int(keys[0])) else [0] * len(adds)
            made = [_running(v, first, f, c) for v, f, c in zip(values(batch), adds, use, strict=True)]
            at, carry = int(keys[-1]), [int(v[-1]) for v in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v) for v in made]], [*batch.schema.names, *names])
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`{n}` long" for n in names)])
    return cut_lineage(df.mapInArrow(upto, fields))


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in order, range-partitioned, materialised."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def numbered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, nth, u, v, bytes): the turns of each conversation from 1 on, with
    two hashes of role and text and the text's UTF-8 bytes."""
    empty = lambda c: F.coalesce(turns[c].cast("string"), F.lit(""))
    t = turns.where(turns[conv_id].isNotNull()).select(
        turns[conv_id].cast("long").alias("conv"), turns[turn].alias("turn"), empty(role).alias("role"), empty(text).alias("text"),
        F.monotonically_increasing_id().alias("row"))  # rows alike must not stay in one range
    slim = _ranged(t, "conv", "turn", "role", "text", "row").select(
        "conv", F.xxhash64("role", "text").alias("u"), F.xxhash64("text", F.lit(1), "role").alias("v"),
        F.octet_length("text").cast("long").alias("bytes"))
    return running(cut_lineage(slim), "conv")


def rebuilt(turns: DataFrame, head: Column, base: Column, most: int = 8) -> DataFrame:
    """(conv, depth, len, u, v, bytes): each conversation with its first
    ``head`` turns (a column over ``conv``, at most ``most``) replaced by those
    of the conversation ``base``; row 0 stands for the empty sequence."""
    convs = cut_lineage(turns.groupBy("conv").agg(F.max("nth").alias("own")).select(
        "conv", "own", head.cast("long").alias("head"), base.cast("long").alias("base")))
    there = convs.select(F.col("conv").alias("_base"), F.col("own").alias("_n"))
    convs = convs.join(there, F.col("base") == F.col("_base"), "left").select(
        "conv", "head", "base", F.least("head", F.coalesce("_n", F.lit(0))).alias("taken"), "own")
    convs = cut_lineage(convs.select("conv", "head", "base", "taken", (
        F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("len")))
    heads = turns.where(F.col("nth") <= most).withColumnRenamed("conv", "_of")
    heads = convs.join(heads, (F.col("base") == F.col("_of")) & (F.col("nth") <= F.col("head"))).select(
        "conv", F.col("nth").alias("depth"), "len", "u", "v", "bytes")
    mine = convs.select(F.col("conv").alias("_conv"), "head", "taken", "len")
    tails = join_measured(turns, mine, (F.col("conv") == F.col("_conv")) & (F.col("nth") > F.col("head")), "inner").select(
        "conv", (F.col("taken") + F.col("nth") - F.col("head")).alias("depth"), "len", "u", "v", "bytes")
    none = F.lit(0).cast("long")
    roots = convs.select("conv", none.alias("depth"), "len", none.alias("u"), none.alias("v"), none.alias("bytes"))
    return roots.union(heads).union(tails)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, len, bytes, a, b, pa, pb, upto): every prefix of the
    rebuilt conversations, its digest (a, b), its parent's (null at the root)
    and the bytes of all its turns; partitions in order of conv and depth."""
    at = F.col("depth") > 0
    t = cut_lineage(turns.select(
        "conv", "depth", "len", "bytes", F.when(at, F.xxhash64("depth", "u", "v")).otherwise(0).cast("long").alias("x"),
        F.when(at, F.xxhash64("v", "u", "depth")).otherwise(0).cast("long").alias("y")))
    t = running(cut_lineage(_ranged(t, "conv", "depth")), "conv", ("x", "y"), ("bytes",))
    parent = lambda upto, own: F.when(at, F.col(upto).bitwiseXOR(F.col(own)))
    return t.select("conv", "depth", "len", "bytes", F.col("x_upto").alias("a"), F.col("y_upto").alias("b"),
                    parent("x_upto", "x").alias("pa"), parent("y_upto", "y").alias("pb"), F.col("bytes_upto").alias("upto"))


def _cells(batch: pa.RecordBatch, cells: int) -> list[np.ndarray]:
    """The cell of every digest in each row of the sketch."""
    a, b = (batch.column(batch.schema.get_field_index(c)).to_numpy().view(U64) for c in "ab")
    return [(h % U64(cells)).astype(np.int64) for h in (a, b, mix64(a + mix64(b)))][:SKETCH_ROWS]


def sketch(prefix: DataFrame, cells: int) -> np.ndarray:
    """The count-min sketch of all digests: SKETCH_ROWS x ``cells`` counts up to 2."""
    piece = min(SKETCH_PIECE, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((SKETCH_ROWS, cells), np.uint8)
        for batch in batches:
            for row, at in zip(table, _cells(batch, cells), strict=True):
                once, n = np.unique(at, return_counts=True)
                row[once] = np.minimum(row[once] + np.minimum(n, 2), 2)
        for r, row in enumerate(table):
            for at in range(0, cells, piece):
                if row[at:at + piece].any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r * cells + at]), pa.array([pack([row[at:at + piece]])], pa.binary())], ["at", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for where, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = unpack(body, 1)[0]
                if where != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([pack([total])], pa.binary())], ["at", "body"])
                    at, total = where, np.zeros(piece, np.uint8)
                total = np.minimum(total + part, 2)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([pack([total])], pa.binary())], ["at", "body"])
    parts = small_batches(prefix.select("a", "b")).mapInArrow(count, "at long, body binary")
    parts = parts.repartition(F.col("at")).sortWithinPartitions("at").mapInArrow(add, "at long, body binary")
    table = np.zeros(SKETCH_ROWS * cells, np.uint8)
    for r in parts.collect():  # at most SKETCH_ROWS x SKETCH_CELLS bytes in all
        table[r["at"]:r["at"] + piece] = unpack(r["body"], 1)[0]
    return table.reshape(SKETCH_ROWS, cells)


def screened(prefix: DataFrame, cells: int | None = None) -> DataFrame:
    """``prefix`` with ``proven_upto``: how many prefixes of its conversation up to
    this one the sketch proves to be single; 0 where it may be shared."""
    if cells is None:
        rows = prefix.count()
        cells = max(LEAST_CELLS, min(SKETCH_CELLS, 1 << (4 * rows).bit_length()))
    table = sketch(prefix, cells)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = np.min([row[at] for row, at in zip(table, _cells(batch, cells), strict=True)], axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((least == 1).astype(np.int64))], [*batch.schema.names, "proven"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prefix.schema)
    return running(prefix.mapInArrow(screen, f"{fields}, proven long"), "conv", sums=("proven",))


def _ends_hash(shared: DataFrame) -> DataFrame:
    """(a, b, ends): the hash of the ids of the conversations that end at a node."""
    last = shared.where(F.col("depth") == F.col("len")).select("a", "b", "conv", F.shiftright("conv", CHUNK_BITS).alias("chunk"))
    pieces = last.groupBy("a", "b", "chunk").agg(F.array_join(F.array_sort(F.collect_list("conv")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["a", "b", "ends"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())], ["a", "b", "ends"])
    ordered = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "chunk").select("a", "b", "ids")
    return small_batches(ordered).mapInArrow(hashed, "a long, b long, ends string")


def prefix_trie(turns: DataFrame, cells: int | None = None) -> DataFrame:
    """One row a node of the trie of ``turns`` (see ``rebuilt``): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and ``a``, ``b``,
    its digest. ``cells`` sets the width of the sketch."""
    rows = screened(prefixes(turns), cells)
    shared = rows.where("proven_upto = 0")
    single = rows.where("proven_upto > 0")
    first = single.where("proven_upto = 1 and proven = 1")  # where a tail leaves the shared part
    nodes = cut_lineage(shared.groupBy("a", "b").agg(
        F.first("depth").alias("depth"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.count("*").alias("n_convs"),
        F.min("conv").alias("conv_id"), (F.sum((F.col("depth") == F.col("len")).cast("int")) == F.count("*")).alias("childless")))
    # where a conversation's own nodes begin, and whether it owns a leaf
    owners = nodes.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("depth").alias("top"), F.max(F.col("childless").cast("int")).alias("leaf"))
    owners = owners.union(first.select("conv", "depth", F.lit(1))).groupBy("_conv").agg(F.min("top").alias("top"), F.max("leaf").alias("leaf"))
    member = shared.join(owners, F.col("conv") == F.col("_conv"), "left").select(
        "conv", "depth", "a", "b", "upto", "bytes", F.coalesce("leaf", F.lit(0)).alias("leaf"), "top")
    before = F.max(F.when(F.col("top").isNull() | (F.col("depth") < F.col("top")), F.col("upto")))
    paid = member.groupBy(F.col("conv").alias("_conv")).agg(F.coalesce(before, F.lit(0)).alias("paid"))
    sums = member.join(paid, F.col("conv") == F.col("_conv")).groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(
        F.sum(F.greatest(F.col("paid") - F.col("upto") + F.col("bytes"), F.lit(0))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    children = nodes.select("pa", "pb").union(first.select("pa", "pb")).groupBy("pa", "pb").agg(F.count("*").alias("n_children"))\
        .select(F.col("pa").alias("_ca"), F.col("pb").alias("_cb"), "n_children")
    ends = _ends_hash(shared).select(F.col("a").alias("_ea"), F.col("b").alias("_eb"), "ends")
    parents = nodes.select(F.col("a").alias("_pa"), F.col("b").alias("_pb"), F.col("conv_id").alias("parent_conv_id"))
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    nothing = hashlib.sha256(b"").hexdigest()
    grouped = nodes.join(sums, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))\
        .join(children, (F.col("a") == F.col("_ca")) & (F.col("b") == F.col("_cb")), "left")\
        .join(ends, (F.col("a") == F.col("_ea")) & (F.col("b") == F.col("_eb")), "left")\
        .join(parents, (F.col("pa") == F.col("_pa")) & (F.col("pb") == F.col("_pb")), "left")
    grouped = grouped.select("conv_id", "depth", "parent_conv_id", "n_convs", long("n_children").alias("n_children"),
                             long("n_leaves").alias("n_leaves"), long("saved_tokens").alias("saved_tokens"),
                             F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"), "a", "b")
    one = F.lit(1).cast("long")
    tail = lambda df, parent: df.select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), one.alias("n_convs"),
        (F.col("depth") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("len"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"), "a", "b")
    leaving = first.join(parents, (F.col("pa") == F.col("_pa")) & (F.col("pb") == F.col("_pb")), "left")
    inner = single.where("proven_upto > 1 or proven = 0")
    return grouped.union(tail(leaving, F.col("parent_conv_id"))).union(tail(inner, F.col("conv")))
