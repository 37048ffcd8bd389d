"""Line dedup: an exact set-similarity join over the lines of all documents.

A line's tokens are its word shingles (``shingle`` words; a shorter line is
one token); with ``shingle=1`` they are its distinct words, which finds more near
lines but meets far more candidates. A line is removed when an earlier line, by (doc_id, line
number), has a Jaccard similarity of ``threshold`` or more; lines are judged
on the input, not on what is left.

1. The tokens of a line are ordered by rarity: by the magnitude of a hashed
   count over the whole corpus (a table of fixed size, ``buckets.TABLE``),
   then by hash. Any total order gives exact results; a rare first token
   gives short posting lists.
2. Two similar lines share a token among their first
   size - ceil(threshold * size) + 1 (prefix filter). The scan cuts each
   slice's prefix tokens, and its first line of every token set, by hash into
   buckets, and shuffles them as compressed columns. A bucket drops the
   tokens of one set only and all but the first line of a set.
3. For the posting lists that are left, the length and positional filters
   are join conditions. Two lines are judged at their first shared token: what
   they can share is no more than what either has from there on, and of two
   similar lines the smaller one has enough left for a line of its own size
   (it is strong there). So only strong postings meet all others of their
   list, and near copies that miss the threshold are not paired.
   Each line first meets the ``firsts`` earliest lines of
   its lists, one candidate each, which settles groups of near copies without
   pairing their members; only lines not yet removed then meet the other
   earlier lines of their lists: eight times as many in each further step
   while the lists would still give many pairs, and at last all.
4. Candidates that share too few prefix tokens to reach the overlap drop out;
   the rest is verified on whole token sets, which travel for these only.

A token that makes up far more than its share of all tokens is spread over the
buckets (it needs no test of being shared), and a hot token is an ordinary
skewed join key afterwards.

Defined results: a line without words is never removed; a null text has no
lines and stays null, an empty text one empty line. A null doc_id comes
after all others; different texts under one doc_id (or under null) follow
each other by a hash of the text. Rows with the same doc_id and text are one
document: they lose the same lines, not each other's. A document may lose
all its lines; it stays with an empty text. Token and line hashes have 64
bits. A very long text is a slice of its own: its task's memory follows it. Other
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.buckets import dealt, entry, hashed_counts, heads, hot_entries, in_order, sizes, through_buckets
from gazette.llm.joins import join_measured
from gazette.llm.quality import bind
from gazette.llm.text import BASES, U64, group_starts, mix64, run_offsets, slices, stepped_hashes, word_spans
from gazette.llm.tables import kept_table
from gazette.session import cut_lineage

#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1
#: Lists that would give more pairs than so many a posting are met step by step.
PAIRS_A_POSTING = 16
#: So many times more of the earliest lines are met by each step.
WIDER = 8


def _by_rarity(owner: np.ndarray, magnitude: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The order of (owner, magnitude, token): sorted as one number that holds the
    token's upper bits, and as three keys where that leaves ties of different tokens."""
    if len(owner) and owner[-1] < 1 << 20:
        packed = owner.astype(U64) << U64(44) | magnitude.astype(U64) << U64(38) | token >> U64(26)
        order = np.argsort(packed)
        packed = packed[order]
        tie = np.flatnonzero(packed[1:] == packed[:-1])
        if not (token[order[tie + 1]] != token[order[tie]]).any():
            return order
    return np.lexsort((token, magnitude, owner))


def _shingles(word: np.ndarray, first: np.ndarray, count: np.ndarray, shingle: int) -> np.ndarray:
    """One hash for each ``shingle`` words in a row of a line, in order; of a
    shorter line, one of all its words. ``first`` and ``count``: the lines."""
    # a factor for each place, and what stands for the number of words
    factor = [U64(pow(BASES[1], j, 1 << 64)) for j in range(shingle)]
    length = np.arange(shingle + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)
    total = word + length[shingle]
    for j in range(1, min(shingle, len(word))):
        total[:-j] += word[j:] * factor[j]
    short = np.flatnonzero(count < shingle)
    at, n = first[short], count[short]
    part = word[at] + length[n]
    inner = np.ones(len(word), bool)
    for j in range(1, min(shingle, int(count.max(initial=0)))):
        more = np.flatnonzero(n > j)
        part[more] += word[at[more] + j] * factor[j]
        long = count > j
        inner[first[long] + count[long] - j] = False
    total[at] = part
    return mix64(total[inner])


class Tokens:
    """The token sets of the lines of one slice, each in order of rarity.

    Per line: ``row``, ``line``, ``size``, ``first`` (offset into
    ``token``) and ``key`` (hash of the set)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, shingle: int, rarity: np.ndarray | None = None) -> None:
        start, end, _ = word_spans(buf, offs)
        breaks = np.flatnonzero(buf == 0x0A)
        # the first words after a document's start or a line break
        first = np.unique(np.searchsorted(start, np.concatenate([offs[:-1], breaks + 1])))
        first = first[first < len(start)]
        count = np.diff(np.append(first, len(start)))
        self.row = np.searchsorted(offs, start[first], "right") - 1
        self.line = (np.searchsorted(breaks, start[first]) - np.searchsorted(breaks, offs[self.row])).astype(np.int32)
        token, n = stepped_hashes(buf, start, end), count
        if shingle > 1:
            token, n = _shingles(token, first, count, shingle), np.maximum(count - shingle + 1, 1)
        self.every = token
        if rarity is None:
            return
        owner = np.repeat(np.arange(len(first)), n)
        token = token[_by_rarity(owner, rarity[entry(token)], token)]  # owners are in order already
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        self.token, owner = token[new], owner[new]
        self.size = np.bincount(owner, minlength=len(first)).astype(np.int32)
        self.first = group_starts(self.size)[:-1]
        total = np.add.reduceat(mix64(self.token ^ U64(0x5851F42D4C957F2D)), self.first) if len(first) else np.empty(0, U64)
        self.key = mix64(total + self.size.astype(U64))


def _lines_of(buf: np.ndarray, offs: np.ndarray, row: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of some lines, each as a document of its own."""
    breaks = np.append(np.flatnonzero(buf == 0x0A), len(buf))
    at = np.searchsorted(breaks, offs[row]) + line
    start = np.where(line == 0, offs[row], breaks[at - 1] + 1)
    size = np.minimum(breaks[at], offs[row + 1]) - start
    cut = [buf[a:a + n] for a, n in zip(start.tolist(), size.tolist(), strict=True)]
    return np.concatenate(cut) if cut else buf[:0], group_starts(size)


def _least_overlap(a, b, threshold: float):
    return F.ceil(F.lit(threshold / (1 + threshold)) * (a + b) - F.lit(1e-9))


def candidates(later: DataFrame, earlier: DataFrame, threshold: float) -> DataFrame:
    """(x, y), once each: the keys of the lines of ``later`` and of those before them in
    ``earlier`` that share a list and pass the length and positional filters there.
    Similar lines pass at their first shared token; at others they need not."""
    # weak postings do not meet each other: of two that pass, the smaller one is strong
    classes = F.when(F.col("strong"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    a, b = later.withColumn("meets", F.explode(classes)).alias("a"), earlier.alias("b")
    small, large = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    bound = F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.meets") == F.col("b.strong"))
                   & (F.col("b.place") < F.col("a.place")) & (F.col("a.key") != F.col("b.key"))
                   & (small >= F.ceil(large * F.lit(threshold) - F.lit(1e-9)))
                   & (bound >= _least_overlap(F.col("a.size"), F.col("b.size"), threshold)))
    return pairs.select(F.col("a.key").alias("x"), F.col("b.key").alias("y")).distinct()


#: What a bucket returns: a line to remove, or a posting.
REMOVED, POSTING = 0, 1
_OUT = "kind int, token long, key long, doc long, tag long, line int, size int, pos int, n int"
_NAMES = ["kind", "token", "key", "doc", "tag", "line", "size", "pos", "n"]


def _out(kind: int, doc: np.ndarray, tag: np.ndarray, line: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    columns = {"kind": np.full(n, kind, np.int32), "doc": doc, "tag": tag, "line": line.astype(np.int32)} | more
    kinds = [pa.int32(), *[pa.int64()] * 4, *[pa.int32()] * 4]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c].view(np.int64) if columns[c].dtype == U64 else columns[c], t) if c in columns else pa.nulls(n, t)
         for c, t in zip(_NAMES, kinds, strict=True)], _NAMES)


def _by_token(h: np.ndarray, token: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(token)  # sorted hashes compress
    return dealt(h[order], order, buckets)


def postings(docs: DataFrame, shingle: int, threshold: float, rarity: np.ndarray) -> DataFrame:
    """The rows of all buckets (see _OUT): lines that repeat an earlier
    line's token set, and the prefix tokens that several sets share, each
    with the first line of its set and ``n``, its number in the token's list
    (0: a spread token, whose list is not in one bucket)."""
    magnitude, hot = np.ceil(np.log2(rarity + 1)).astype(np.uint8), hot_entries(rarity)

    def cut(rows, buf, offs, buckets):
        t = Tokens(buf, offs, shingle, magnitude)
        docs_, tags = (rows.column(i).to_numpy() for i in (0, 1))
        by_place = in_order(docs_, tags)
        rank = np.empty(len(by_place), np.int64)
        rank[by_place] = np.cumsum(heads(by_place, docs_, tags))
        doc, tag, line, place = docs_[t.row], tags[t.row], t.line, rank[t.row] << 32 | t.line
        order = in_order(t.key, place)
        head = heads(order, t.key)
        lead = order[head][np.cumsum(head) - 1]
        # equal places are rows of one document, not repeats
        again = order[place[order] != place[lead]]
        if len(again):
            yield 0, int(again[0]) % buckets, [doc[again].view(U64), tag[again].view(U64), line[again].view(np.uint32)]
        first = order[head]
        for b, r in dealt(mix64(t.key[first]), first, buckets):
            yield 1, b, [t.key[r], doc[r].view(U64), tag[r].view(U64), line[r].view(np.uint32)]
        n = (t.size - np.ceil(threshold * t.size - 1e-9) + 1).astype(np.int64)[first]
        own, pos = np.repeat(first, n), run_offsets(n)
        token = t.token[t.first[own] + pos]
        spread = np.where(hot[entry(token)], mix64(token ^ t.key[own]), mix64(token))
        for b, r in _by_token(spread, token, buckets) if len(token) else ():
            o = own[r]
            yield 2, b, [token[r], t.key[o], doc[o].view(U64), tag[o].view(U64), line[o].view(np.uint32), t.size[o].view(np.uint32), pos[r].view(U64)]

    def whole(kind, columns):
        if kind == 0:
            yield _out(REMOVED, *columns)
        elif kind == 1:
            key, doc, tag, line = columns
            order = in_order(key, doc.view(np.int64), tag.view(np.int64), line)
            head = heads(order, key)
            lead = order[head][np.cumsum(head) - 1]
            again = order[(doc[order] != doc[lead]) | (tag[order] != tag[lead]) | (line[order] != line[lead])]
            yield _out(REMOVED, doc[again], tag[again], line[again])
        else:
            token, key, doc, tag, line, size, pos = columns
            order = in_order(token, key, doc.view(np.int64), tag.view(np.int64), line)
            kept = order[heads(order, token, key)]  # one a token and set: its first line
            kept = kept[(sizes(heads(kept, token)) > 1) | hot[entry(token[kept])]]
            kept = kept[in_order(*(c[kept] for c in (token, doc.view(np.int64), tag.view(np.int64), line, key.view(np.int64))))]
            n = run_offsets(np.diff(np.append(np.flatnonzero(heads(kept, token)), len(kept)))) + 1
            n[hot[entry(token[kept])]] = 0  # other buckets hold parts of these lists
            yield _out(POSTING, doc[kept], tag[kept], line[kept], token=token[kept], key=key[kept],
                       size=size[kept].astype(np.int32), pos=pos[kept].astype(np.int32), n=n.astype(np.int32))
    return through_buckets(docs, cut, whole, _OUT)


def posted_lines(found: DataFrame, threshold: float) -> DataFrame:
    """The postings among the rows of ``postings``; strong: with enough tokens from here on
    for an equally large line."""
    return found.where(F.col("kind") == POSTING).select(
        "token", "key", F.struct("doc", "tag", "line").alias("place"), "size", "pos", "n",
        (F.col("size") - F.col("pos") >= _least_overlap(F.col("size"), F.col("size"), threshold)).alias("strong"))


def removed_lines(docs: DataFrame, shingle: int = 5, threshold: float = 0.8, firsts: int = 2) -> DataFrame:
    """(doc, tag, line) of every line to remove; ``docs`` has the columns doc
    (long, LAST for null), tag (see ``identified``) and text."""
    rarity = hashed_counts(docs, lambda buf, offs: Tokens(buf, offs, shingle).every)
    magnitude = np.ceil(np.log2(rarity + 1)).astype(np.uint8)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in slices(batches, "text"):
            wanted = rows.column(1)
            row = np.repeat(np.arange(rows.num_rows), np.diff(wanted.offsets.to_numpy()))
            t = Tokens(*_lines_of(buf, offs, row, wanted.flatten().to_numpy()), shingle, magnitude)
            lists = pa.ListArray.from_arrays(pa.array(group_starts(t.size).astype(np.int32)), pa.array(t.token.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(t.key.view(np.int64)), lists], ["key", "tokens"])

    found = kept_table(postings(docs, shingle, threshold, rarity))
    posted = posted_lines(found, threshold)
    # of every set: its shared prefix tokens, size and first line
    prefix = kept_table(posted.groupBy("key").agg(
        F.collect_list("token").alias("tokens"), F.first("size").alias("size"), F.first("place").alias("place")))

    def met(later: DataFrame, earlier: DataFrame) -> DataFrame:
        """(x, y, x_place, y_place) of the candidates that pass the filters."""
        pairs = candidates(later, earlier, threshold)
        for side in "xy":
            pairs = pairs.join(prefix.select(*[F.col(c).alias(f"{side}_{c}") for c in prefix.columns]),
                               F.col(side) == F.col(f"{side}_key"))
        # what two sets share beyond their prefixes fits into the rest of one
        rest = lambda side: F.ceil(F.col(f"{side}_size") * F.lit(threshold) - F.lit(1e-9)) - 1
        shared = F.size(F.array_intersect("x_tokens", "y_tokens"))
        near = pairs.where(shared + F.greatest(rest("x"), rest("y")) >= _least_overlap(F.col("x_size"), F.col("y_size"), threshold))
        return cut_lineage(near.select("x", "y", "x_place", "y_place"))

    def verified(pairs: DataFrame) -> DataFrame:
        """(x, x_place) of the later lines that are similar to a candidate."""
        lines = pairs.select(F.explode(F.array("x_place", "y_place")).alias("p")).distinct()
        wanted = lines.groupBy(F.col("p.doc").alias("_d"), F.col("p.tag").alias("_tag")).agg(
            F.collect_list("p.line").alias("_lines"))
        at = join_measured(docs, wanted, (F.col("doc") == F.col("_d")) & (F.col("tag") == F.col("_tag")), "inner",
                           4 * F.size("_lines")).select("text", "_lines")
        sets_of = kept_table(at.mapInArrow(sets, "key long, tokens array<long>"))
        x = sets_of.select(F.col("key").alias("x"), F.col("tokens").alias("xs"))
        y = sets_of.select(F.col("key").alias("y"), F.col("tokens").alias("ys"))
        full = pairs.join(x, "x").join(y, "y").withColumn("_o", F.size(F.array_intersect("xs", "ys")))
        return cut_lineage(full.where(
            F.col("_o") >= _least_overlap(F.size("xs"), F.size("ys"), threshold)).select("x", "x_place").distinct())

    early = Window.partitionBy("token").orderBy("place", "key")
    spread = posted.where(F.col("n") == 0)
    heads_of = posted.where(F.col("n").between(1, firsts)).union(
        spread.withColumn("n", F.row_number().over(early)).where(F.col("n") <= firsts))
    gone = verified(met(posted.where(F.col("n") != 1), heads_of))

    # spread lists are not put in order: their lines get places by hash, as many as the longest has
    longest = spread.groupBy("token").count().agg(F.max("count")).first()[0] or 1
    at = F.when(F.col("n") == 0, firsts + 1 + F.pmod(F.xxhash64("key"), F.lit(longest))).otherwise(F.col("n"))
    posted = posted.withColumn("spread", F.col("n") == 0).withColumn("n", at)
    limit = PAIRS_A_POSTING * posted.count()

    def many(others: DataFrame, gone: DataFrame) -> int:
        """The pairs that the lists of ``others`` give lines not yet removed."""
        left = F.when(F.col("_x").isNull(), 1).otherwise(0)
        lists = others.join(gone.select(F.col("x").alias("_x")), F.col("key") == F.col("_x"), "left").groupBy("token").agg(
            F.count("*").alias("n"), F.count_if("strong").alias("strong"), F.sum(left).alias("left"),
            F.sum(F.when(F.col("strong"), left).otherwise(0)).alias("left_strong"))
        pairs = F.col("left_strong") * F.col("n") + (F.col("left") - F.col("left_strong")) * F.col("strong")
        return lists.agg(F.sum(pairs.cast("double"))).first()[0] or 0

    while True:
        # all later lines of a list have met its first ones by now
        others = posted.where(F.col("n") > firsts)
        rest = posted.where(F.col("spread") | (F.col("n") > firsts + 1))
        rest = rest.join(gone.select(F.col("x").alias("_x")), F.col("key") == F.col("_x"), "left_anti")
        last = many(others, gone) <= limit
        gone = gone.union(verified(met(rest, others if last else others.where(F.col("n") <= firsts * WIDER))))
        if last:
            break
        firsts *= WIDER
    return found.where(F.col("kind") == REMOVED).select("doc", "tag", "line").union(gone.select("x_place.*"))


def identified(docs: DataFrame, doc_id: str, text: str) -> tuple:
    """(doc, tag) columns: the place of a document's lines in the corpus. The
    tag is the whole 64-bit hash of the text, ordered by its lower 31 bits
    first."""
    h = F.xxhash64(docs[text])
    turned = F.shiftleft(h, 33).bitwiseOR(F.shiftrightunsigned(h, 31))
    return F.coalesce(docs[doc_id].cast("long"), F.lit(LAST)), turned.bitwiseXOR(F.lit(-1 << 63))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """``docs`` with later matches of a line taken out of ``text``, plus
    n_lines and n_removed."""
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    doc, tag = identified(docs, doc_id, text)
    gone = removed_lines(docs.select(doc.alias("doc"), tag.alias("tag"), docs[text].alias("text")), **params)
    gone = gone.groupBy(F.col("doc").alias("_doc"), F.col("tag").alias("_t")).agg(F.collect_set("line").alias("_gone"))
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in own]).alias("_row"), docs[text].alias("_text"),
                    doc.alias("_id"), tag.alias("_tag"))
    d = join_measured(d, gone, (F.col("_id") == F.col("_doc")) & (F.col("_tag") == F.col("_t")), "left", 4 * F.size("_gone"))
    lines = F.split("_text", "\n", -1)
    keep = bind(lines, lambda a: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("_gone")), lambda i: F.get(a, i)), "\n"))
    d = d.withColumn("_kept", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(keep))
    return d.select(*[F.col("_kept").alias(c) if c == text else F.col("_row")[c].alias(c) for c in own],
                    F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                    F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
