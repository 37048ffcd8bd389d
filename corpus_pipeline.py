"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing,
packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it sees all that
its predecessor kept, and its decisions take effect there. All but the last
return the columns of ``documents``. ``run`` writes each stage as Parquet
beside the checkpoints (the folder all executors share) and reads it back,
so a lost executor costs at most the stage at work.

Defined results follow the operators': an empty table passes through all
stages; nulls in any column and extra columns are carried to the end of the
last stage that keeps columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import lines, mixing, packing, quality, simhash
from gazette.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matches of a line leave the text; ``n_chars`` follows the text."""
    kept = lines.dedup_lines(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
        kept = kept.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return kept


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest doc_id; of a group's
    rows without one, one as well."""
    return simhash.one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: one row for each time a document is taken
    whole; a document taken in part ends with its first words of that part."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The hashing and tokenizing stages have no SQL form; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
