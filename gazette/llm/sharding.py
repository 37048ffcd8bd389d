"""Sharding by extendible hashing.

A document's hash is read from its first bit on. The directory starts with
one bucket; only a bucket over ``limit`` bytes splits, on its next bit, until
every bucket fits. A bucket is therefore a hash prefix that fits while its
parent doesn't, which one aggregate decides for ``BITS`` depths at a time:
the bytes of every prefix of those depths, next to its parent's. Rows of
buckets still over the limit go on to the next depths.

Only (hash, bytes) pairs are shuffled. Texts meet the directory through the
hash.

Defined results: a null doc_id or text counts as empty in the hash, and a
null or empty text has 0 bytes. Rows with the same doc_id and text have the
same hash and stay together. A bucket of one hash (one document, or repeated
rows) can't be split: it is a shard even if over the limit, with
``shard_bytes`` showing it. An empty table gives an empty result. Other
columns are kept by ``sharded``; one named like a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.joins import join_measured
from gazette.session import cut_lineage

#: Depths that one pass decides, and the bits of a hash.
BITS, HASH_BITS = 6, 60


def document_hash(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of "doc_id:text"."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _prefix(h: str, depth: Column, bits: int = HASH_BITS) -> Column:
    """The first ``depth`` of the ``bits`` bits of a hash."""
    return F.call_function("shiftright", F.col(h), (F.lit(bits) - depth).cast("int"))


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, shard_bytes, shard_rows) of every bucket, from a table
    of (h, n_bytes)."""
    sums = (F.sum("n_bytes").alias("bytes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    rows = sized.groupBy("h").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n")).select(
        "h", "n_bytes", "n", F.col("h").alias("low"), F.col("h").alias("high"))
    rows = cut_lineage(rows)
    whole = rows.agg(*sums).where("n > 0")
    fits = (F.col("bytes") <= limit) | (F.col("low") == F.col("high"))
    columns = ["depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows")]
    whole = cut_lineage(whole.withColumn("depth", F.lit(0)).withColumn("prefix", F.lit(0).cast("long")))
    found = whole.where(fits).select(*columns)
    if whole.where(~fits).isEmpty():
        return found
    for base in range(0, HASH_BITS, BITS):
        deepest = min(base + BITS, HASH_BITS)
        leaf = rows.groupBy(_prefix("h", F.lit(deepest)).alias("_p")).agg(*sums)
        level = leaf.withColumn("depth", F.explode(F.sequence(F.lit(base + 1), F.lit(deepest)))).groupBy(
            "depth", _prefix("_p", F.col("depth"), deepest).alias("prefix")).agg(
                F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        level = cut_lineage(level)
        # a bucket exists if its parent had to be split
        parents = level.where(~fits).select((F.col("depth") + 1).alias("_d"), F.col("prefix").alias("_q"))
        split = F.col("depth") == base + 1
        below = level.where(~split).join(parents, (F.col("depth") == F.col("_d")) & (
            F.shiftright("prefix", 1) == F.col("_q")), "left_semi")
        level = cut_lineage(level.where(split).unionByName(below))
        found = found.unionByName(level.where(fits).select(*columns))
        over = level.where((F.col("depth") == deepest) & ~fits).select(F.col("prefix").alias("_over"))
        if deepest == HASH_BITS or over.isEmpty():
            return found
        rows = cut_lineage(rows.join(over, _prefix("h", F.lit(deepest)) == F.col("_over"), "left_semi"))
    return found


def assignments(sized: DataFrame, limit: int) -> DataFrame:
    """(h, shard, depth, shard_bytes) of every distinct hash; ``shard`` is
    the bucket's prefix as a string of bits."""
    found = cut_lineage(directory(sized, limit))
    depths = F.array(*[F.lit(r[0]) for r in found.select("depth").distinct().orderBy("depth").collect()])  # at most 61
    keys = sized.select("h").distinct().withColumn("_d", F.explode(depths.cast("array<int>")))
    keys = keys.withColumn("_p", _prefix("h", F.col("_d")))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return join_measured(keys, found, (F.col("_d") == F.col("depth")) & (F.col("_p") == F.col("prefix")), "inner").select(
        "h", bits.alias("shard"), "depth", "shard_bytes")


def sharded(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` plus n_bytes, shard, depth and shard_bytes."""
    made = ("n_bytes", "shard", "depth", "shard_bytes")
    own = [c for c in docs.columns if c.lower() not in made]
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in own]).alias("_row"),
                    document_hash(docs[doc_id], docs[text]).alias("_h"),
                    F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"))
    sized = cut_lineage(d.select(F.col("_h").alias("h"), "n_bytes"))
    placed = assignments(sized, limit)
    return join_measured(d, placed, F.col("_h") == F.col("h"), "inner").select("_row.*", *made)


def write_shards(docs: DataFrame, path: str, limit: int, **columns) -> None:
    """One folder ``shard=<bits>`` a shard; a shard is written by one task."""
    s = sharded(docs, limit, **columns).drop("n_bytes", "depth", "shard_bytes")
    s.withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard").write.partitionBy("shard").parquet(path)
