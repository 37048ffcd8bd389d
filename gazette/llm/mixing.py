"""Mixing sources to target weights by Sainte-Laguë apportionment.

DataFrame functions only. The plan of a mix:

1. every source gets a target: its weight's share of ``share`` x all sizes,
   stopped at ``cap`` x its own size, the excess reshared by weight;
2. equal-token blocks (``block_words`` words) go to the sources by the
   highest quotients target / (2k + 1): an integer quota per source;
3. a source's documents are dealt by a seeded hash into shards of about
   ``shard_words`` words; the source's quota goes to its shards the same way;
4. in each shard the documents stand in seeded order, are cut into blocks,
   and the quota takes the first blocks, starting over when it is larger
   than the shard.

The document-level work is one shuffle by source and one by (source, shard);
a source that holds a third of all rows is spread over its shards, and the
tables of sources and shards are aggregates. Only the water level (one row a
round) reaches the driver. A very long text is one row whose
words are counted where it is read.

Defined results: a null or empty text has size 0 and takes nothing; a null
source is a source of its own, after all others; a null doc_id is an
ordinary row. Rows under one doc_id (or under null) are numbered by a
hash of the text and seeded each on its own, so that they spread over shards, and
each is counted. An empty table gives an empty result. Extra input columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.llm.joins import join_measured
from gazette.llm.tables import kept_table
from gazette.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)


def text_size(text: Column) -> Column:
    """Number of words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with its global rank from 1 in ``order``: range partitions are
    ranked on their own and moved on by the sizes of those before them, so no
    task sees more than its range."""
    part = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return part.withColumn("_own", own).join(sizes, "_part").withColumn(
        name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def water_level(sources: DataFrame, share: float, cap: float) -> float:
    """The words a unit of weight gets: excess over the caps is reshared
    until no target is above its cap. One aggregated row a round."""
    level = -1.0
    while True:
        full = F.col("source_size") * cap < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("source_size") * cap).otherwise(0.0)).alias("capped"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")).first()
        if not row["all"] or not row["weight"]:
            return max(level, 0.0)
        now = (share * row["all"] - row["capped"]) / row["weight"]
        if now <= level:
            return level
        level = now


def _candidates(df: DataFrame, ideal: Column, total: Column, parties: Column, most: Column) -> DataFrame:
    """One row for each seat whose quotient is near the last one given out.

    ``ideal`` seats sum to ``total`` within a half. Rounding ideal * m for
    m = 1 -+ parties/total gives fewer / more than ``total`` seats, so the
    seats below ``_sure`` are certain and none above the last row can win.
    """
    slack = parties / F.greatest(total, F.lit(1.0))
    low = F.greatest(F.lit(0), F.floor(ideal * (1 - slack)) - 2)
    high = F.greatest(low, F.least(F.ceil(ideal * (1 + slack)) + 2, most))
    return (df.withColumn("_sure", F.least(low, most).cast("bigint")).withColumn("_high", high.cast("bigint"))
            .withColumn("_k", F.explode_outer(F.when(
                F.col("_high") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_high") - 1))))
            .withColumn("_quotient", ideal / (2 * F.col("_k") + 1)))


def _copies(d: DataFrame) -> DataFrame:
    """``d`` with ``_copy``: 0 for rows alone under their doc_id; the rows of
    one doc_id are numbered from 0, in order of hash, size and row."""
    several = cut_lineage(d.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id")))
    if several.isEmpty():
        return d.withColumn("_copy", F.lit(0).cast("long"))
    shared = join_measured(d, several, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    placed = cut_lineage(ranked(shared.select("doc_id", "hash", "size", "row"), "_place", *map(F.col, ("doc_id", "hash", "size", "row"))))
    base = placed.groupBy(F.col("doc_id").alias("_id")).agg(F.min("_place").alias("_base"))
    numbers = join_measured(placed, base, F.col("doc_id").eqNullSafe(F.col("_id")), "inner").select(
        F.col("row").alias("_row"), (F.col("_place") - F.col("_base")).alias("_number"))
    d = join_measured(d, numbers, F.col("row") == F.col("_row"), "left")
    return cut_lineage(d.withColumn("_copy", F.coalesce("_number", F.lit(0).cast("long"))).drop("_row", "_number"))


def mix(docs: DataFrame, size: Column, doc_id: str = "doc_id", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0,
        block_words: int = 64, shard_words: int = 2_000_000, shard_rows: int = 1_000_000, seed: int = 17,
        text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its
    source's, double), shard, quota_words (its shard's) and taken."""
    row = F.monotonically_increasing_id()
    mixed = _mix(docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), size.cast("long").alias("size"),
                             F.xxhash64(docs[text] if text in docs.columns else size).alias("hash"), row.alias("row")),
                 weights, share, cap, block_words, shard_words, shard_rows, seed)
    return mixed.drop("row")


def _mix(d: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, block_words: int = 64,
         shard_words: int = 2_000_000, shard_rows: int = 1_000_000, seed: int = 17) -> DataFrame:
    """``mix`` of (doc_id, source, size, hash, row), with ``row``, a number of
    its own for each row."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                    F.when(F.col("_copy") > 0, F.concat(F.lit(":"), F.col("_copy").cast("string"))).otherwise(F.lit("")))
    seeded = F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("bigint")
    # row numbers are written before they are used
    d = cut_lineage(_copies(cut_lineage(d)).withColumn("_seeded", seeded).drop("hash"))

    last = F.col("source").asc_nulls_last()
    s = ranked(d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), "_rank", last)
    cycle = F.array(*[F.lit(w) for w in weights])
    s = cut_lineage(s.withColumn("weight", F.get(cycle, F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int"))))
    level = water_level(s, share, cap)
    s = s.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("source_size") * cap).cast("double"))

    sums = s.agg(F.sum("target").alias("_all"), F.count("*").alias("_parties")).first()
    total = round((sums["_all"] or 0.0) / block_words)
    ideal = F.col("target") / block_words
    most = F.ceil(F.col("source_size") * cap / block_words)
    c = _candidates(s, ideal, F.lit(float(total)), F.lit(sums["_parties"]), most)
    sure = c.groupBy("source").agg(F.max("_sure").alias("n")).agg(F.sum("n")).first()[0] or 0
    c = ranked(c, "_place", F.col("_quotient").desc_nulls_last(), last, F.col("_k"))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_place") <= total - sure), 1).otherwise(0))
    s = cut_lineage(c.groupBy("source", "source_size", "target", "_rows").agg((F.max("_sure") + won).alias("_seats"))
                    .withColumn("_shards", F.greatest(
                        F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("_rows") / shard_rows))))

    d = d.alias("d").join(s.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        "d.*", "source_size", "target", "_seats", "_shards", F.pmod("_seeded", "_shards").alias("shard"))
    # a source's words in a shard, and the shard's part of the source's quota
    cells = d.groupBy("source", "shard", "source_size", "_seats", "_shards").agg(F.sum("size").alias("_cell"))
    words = F.greatest(F.col("source_size"), F.lit(1))
    v = _candidates(cells, F.col("_seats") * F.col("_cell") / words, F.col("_seats").cast("double"),
                    F.col("_shards"), F.ceil(F.col("_cell") * cap / block_words))
    sure = F.sum(F.when(F.col("_k").isNull() | (F.col("_k") == F.col("_sure")), F.col("_sure")).otherwise(0))
    v = cut_lineage(ranked(v, "_rank", last, F.col("_quotient").desc_nulls_last(), F.col("shard"), F.col("_k")))
    base = v.groupBy(F.col("source").alias("_of")).agg(sure.alias("_all_sure"), (F.min("_rank") - 1).alias("_base"))
    v = join_measured(v, base, F.col("source").eqNullSafe(F.col("_of")), "inner",
                      F.coalesce(F.octet_length(F.col("_of").cast("string")), F.lit(0))).withColumn(
        "_place", F.col("_rank") - F.col("_base"))
    won = F.sum(F.when(F.col("_k").isNotNull() & (F.col("_place") <= F.col("_seats") - F.col("_all_sure")), 1).otherwise(0))
    v = v.groupBy("source", "shard", "_cell").agg((F.max("_sure") + won).alias("_quota")).select(
        F.col("source").alias("_s"), F.col("shard").alias("_h"), "_cell",
        F.least(F.col("_quota") * block_words, F.floor(F.col("_cell") * cap)).cast("bigint").alias("quota_words"))

    tape = Window.partitionBy("source", "shard").orderBy("_seeded", "doc_id", "size", "row").rowsBetween(
        Window.unboundedPreceding, -1)
    d = d.withColumn("_start", F.coalesce(F.sum("size").over(tape), F.lit(0)))
    d = d.join(v, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    rounds = F.when(F.col("_cell") > 0, F.floor(F.col("quota_words") / F.col("_cell"))).otherwise(F.lit(0)).cast("bigint")
    rest = F.col("quota_words") - F.col("_cell") * rounds - F.col("_start")
    taken = F.col("size") * rounds + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return d.select("doc_id", "source", "size", "source_size", "target", "shard", "quota_words",
                    taken.cast("bigint").alias("taken"), "row")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space inside kept."""
    gap = "[\\x20\\x09-\\x0D]"
    parts = F.split(text, f"(?<={gap})(?=[^\\x20\\x09-\\x0D])")
    lead = F.when(F.rlike(text, F.lit(f"^{gap}")), 1).otherwise(0)
    return F.rtrim(F.array_join(F.slice(parts, F.lit(1), (n + lead).cast("int")), ""), F.lit(SPACE))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                    **params) -> DataFrame:
    """The mix as rows of ``docs``: a row for each time a document is taken
    whole, and one with its first words for the rest; what is not taken goes.
    Each row takes what ``mix`` gives it."""
    own = docs.columns
    # rows are told apart by a number of their own, written before it is used
    rows = kept_table(docs.select(F.struct(*[docs[f"`{c}`"] for c in own]).alias("_row"), docs[doc_id].alias("_id"),
                                  docs[source].alias("_source"), docs[text].alias("_text"), text_size(docs[text]).cast("long").alias("_size"),
                                  F.monotonically_increasing_id().alias("_n")))
    mixed = _mix(rows.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"),
                             F.xxhash64("_text").alias("hash"), F.col("_n").alias("row")), **params)
    taken = mixed.where("taken > 0").select(F.col("row").alias("_taken_row"), F.col("taken").alias("_taken"))
    d = join_measured(rows, taken, F.col("_n") == F.col("_taken_row"), "inner")
    parts = F.expr("transform(sequence(1, ceil(_taken / _size)), i -> least(_size, _taken - (i - 1) * _size))")
    d = d.withColumn("_words", F.explode(parts))
    cut = F.col("_words") < F.col("_size")
    new_text = F.when(cut, first_words(F.col("_text"), F.col("_words"))).otherwise(F.col("_text"))
    d = d.withColumn("_new", new_text)
    values = {text: F.col("_new")}
    if "n_chars" in own:
        values["n_chars"] = F.when(cut, F.length("_new")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return d.select(*[values.get(c, F.col("_row")[c]).alias(c) for c in own])
