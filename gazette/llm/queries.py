"""The registered queries of this subpackage and their DuckDB SQL.

Each query reads the whole table its operator is meant for, with production
parameters; the contract's digest columns are derived here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import embed, lines, mixing, packing, phrases, quality, runs, sharding, simhash, substring, suffix, tokens, trie


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", *quality.MEASURES, "base_failed", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "source", "text")
    return mixing.mix(d, mixing.text_size(d["text"])).select(
        "doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(documents(spark, sf_dir, "doc_id", "text"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir, "doc_id", "text"), limit=1 << 20).select(
        "doc_id", "n_bytes", "shard", "depth", "shard_bytes")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(documents(spark, sf_dir, "doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(documents(spark, sf_dir, "doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    nodes = trie.prefix_trie(trie.rebuilt(turns, F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(9)), F.col("conv") - F.col("conv") % 5))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.decontaminate(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with every word from word a on of a tenth of the texts taken
    from the p words there, round and round (the contract's rule)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", quality.SEPARATORS), lambda w: w != "")
    parts = quality.bind(words, lambda w: F.struct(
        w.alias("words"), F.size(w).cast("long").alias("n"), F.pmod(F.floor(h / 10), F.size(w)).alias("a")))
    period = quality.bind(parts, lambda v: F.struct(
        v["words"].alias("words"), v["n"].alias("n"), v["a"].alias("a"),
        (1 + F.floor((v["n"] - v["a"]) / (3 + F.floor(h / 10) % 8))).alias("p")))
    return docs.withColumn("text", F.when((h % 10 == 0) & (F.size(words) > 0), quality.bind(
        period, lambda v: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), v["n"] - 1),
            lambda i: F.get(v["words"], F.when(i < v["a"], i).otherwise(v["a"] + (i - v["a"]) % v["p"]).cast("int"))), " ")))
        .otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(with_planted_runs(documents(spark, sf_dir, "doc_id", "text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumn("_top", longest)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_top.s")).alias("start"), F.col("_top.length").alias("length"),
        (-F.col("_top.p")).alias("period"), F.floor(1000 * F.col("_top.length") / -F.col("_top.p")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_sharding": op5_sharding,
    "op6_substring": op6_substring,
    "op7_suffix": op7_suffix,
    "op8_embeddings": op8_embeddings,
    "op9_lines": op9_lines,
    "op10_simhash": op10_simhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_decontamination": op12_decontamination,
    "op13_periodic_runs": op13_periodic_runs,
}
