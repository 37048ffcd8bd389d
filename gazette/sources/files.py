"""File sources and sinks: persona list (S5), history file (S6) and digest documents (K4)."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.sources.json_elements import RANGE_BYTES, read_elements

FAIL = {"mode": "FAILFAST"}
PERSONA_DDL = ("id STRING, nome STRING, descricao STRING, prioridades ARRAY<STRING>, "
               "evitar ARRAY<STRING>")


def read_personas_json(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The persona list (a JSON array, or a folder of them) with a declared
    schema, read by ranges of bytes; the position in the file becomes
    ``persona_idx`` (the order checks run in). Malformed JSON fails the read."""
    raw = read_elements(spark, path, range_bytes=range_bytes)
    return raw.select(F.col("pos").alias("persona_idx"), F.from_json("element", PERSONA_DDL, FAIL).alias("p")).select(
        "persona_idx", "p.id", "p.nome", "p.descricao", "p.prioridades", "p.evitar")


def select_personas(personas: DataFrame, persona_ids: list[str] | DataFrame | None = None) -> DataFrame:
    """The requested personas, or all when none are named. Many requests
    are a table with a column ``id``."""
    if isinstance(persona_ids, DataFrame):
        return personas.join(persona_ids.select("id"), "id", "left_semi").select(*personas.columns)
    if not persona_ids:
        return personas
    return personas.filter(F.col("id").isin(*persona_ids))


def write_digests(digests: DataFrame, path: str, run_date: str, observed=None) -> None:
    """K4: one document (row) per persona with at least one item, written
    under ``run_date=...``; a folder per persona would be millions of files.
    ``observed`` wraps the rows that are written."""
    rows = digests.filter(F.col("n_items") > 0)
    (rows if observed is None else observed(rows)).withColumn("run_date", F.lit(run_date)).write.mode(
        "errorifexists").partitionBy("run_date").json(path)


def _written_as_documents(rows: DataFrame, path: str, lines) -> None:
    """``rows`` (key, element), a JSON document a partition: ``lines`` turns the
    stream of (key, element) into the document's lines; nothing is gathered."""
    def documents(batches):
        import pandas as pd
        items = ((k, e) for batch in batches for k, e in zip(batch["key"], batch["element"]))
        first = next(items, None)
        if first is None:
            return
        out = []
        for line in lines(itertools.chain([first], items)):
            out.append(line)
            if len(out) == 1000:
                yield pd.DataFrame({"value": out})
                out = []
        yield pd.DataFrame({"value": out})
    rows.select("key", "element").mapInPandas(documents, "value string").write.mode("errorifexists").text(path)


def _array_lines(items):
    mark = "["
    for _, element in items:
        yield f"{mark} {element}"
        mark = ","
    yield "]"


def _history_lines(items):
    yield '{"version": 1, "personas": {'
    before = None
    for key, element in items:
        if key != before:
            yield f"{'' if before is None else '], '}{json.dumps(key)}: [ {element}"
        else:
            yield f", {element}"
        before = key
    yield "]}}"


def write_personas_json(personas: DataFrame, path: str) -> None:
    """The persona list as files that ``read_personas_json`` reads, a JSON array
    a partition, in the order of ids."""
    one = F.to_json(F.struct("id", "nome", "descricao", "prioridades", "evitar"))
    rows = personas.select(F.col("id").alias("key"), one.alias("element"))
    _written_as_documents(rows.repartitionByRange("key").sortWithinPartitions("key"), path, _array_lines)


def write_history_json(entries: DataFrame, path: str) -> None:
    """Raw history entries (persona_id, entry_pos, and the stored fields) as
    files in the stored layout {"version", "personas": {id: [entry, ...]}}, a
    document a partition; entries without a persona have no place in it."""
    fields = [c for c in entries.columns if c not in ("persona_id", "entry_pos")]
    rows = entries.where("persona_id IS NOT NULL").select(
        F.col("persona_id").alias("key"), "entry_pos", F.to_json(F.struct(*fields)).alias("element"))
    _written_as_documents(rows.repartition("key").sortWithinPartitions("key", "entry_pos"), path, _history_lines)
