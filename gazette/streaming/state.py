"""T1 on the state store: repeat suppression over a stream of selections.

Every run of the pipeline adds one set of files with its selections (persona,
run time, rank, article, keys). The stream groups them by persona and keeps,
for each persona, a map from key to the time it was last sent in Spark's state store
(RocksDB). A micro-batch reads and writes only the keys of its own rows, so its
cost follows the run and not the history; state, source position and output
are committed together, so a batch that is run again gives the same rows.

The lookback is the state's time to live: a key older than the run's time less
the lookback counts as absent and is dropped when it is met, and the store
expires what is never met again (by the clock). A history from before the
stream is the initial state; entries without a time stay.

Rows of a persona in one run are examined in rank order: a row with a live key
is ``history``, one with a key of an earlier kept row of the run is
``duplicate``, else it is ``kept`` until the cap, after which rows are
``unexamined``. A persona's selection of a run must be in one file
(``write_selection``); its size is the preselection limit.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gazette.functions import constants as K
from gazette.operators.history import entry_match_keys

SELECTION_DDL = "persona_id STRING, run_at TIMESTAMP_NTZ, rank BIGINT, ord BIGINT, keys ARRAY<STRING>"
STATUS_DDL = "persona_id STRING, run_at TIMESTAMP_NTZ, rank BIGINT, ord BIGINT, status STRING, slot INT"
#: The store that has maps with a time to live; and no batches without data, which
#: the clock would keep asking for.
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass":
             "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
             "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
#: Time of entries that never expire, in microseconds.
FOREVER = 1 << 62
_EPOCH = dt.datetime(1970, 1, 1)


def _micros(t) -> int:
    return FOREVER if t is None or pd.isna(t) else (pd.Timestamp(t).to_pydatetime() - _EPOCH) // dt.timedelta(microseconds=1)


class Suppressor(StatefulProcessor):
    """Statuses of a persona's rows against the keys it was sent."""

    def __init__(self, max_per_persona: int, lookback_days: int) -> None:
        self.most, self.lookback = max_per_persona, lookback_days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getMapState("sent", "key string", "at bigint", ttlDurationMs=self.lookback // 1000)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for name, at in zip(initialState["key"], initialState["sent_at"], strict=True):
            at, known = _micros(at), self.sent.getValue((name,))
            self.sent.updateValue((name,), (max(at, known[0]) if known else at,))

    def _live(self, name: str, since: int) -> bool:
        found = self.sent.getValue((name,))
        if found is None:
            return False
        if found[0] < since:
            self.sent.removeKey((name,))
            return False
        return True

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mine = pd.concat(list(rows)).sort_values(["run_at", "rank"])
        run, claimed, kept, out = None, set(), 0, []
        for at, rank, ord_, keys in zip(mine["run_at"], mine["rank"], mine["ord"], mine["keys"], strict=True):
            if at != run:
                run, claimed, kept = at, set(), 0
            slot = None
            if kept >= self.most:
                status = "unexamined"
            elif any(k not in claimed and self._live(k, _micros(at) - self.lookback) for k in keys):
                status = "history"
            elif not claimed.isdisjoint(keys):
                status = "duplicate"
            else:
                status, kept = "kept", kept + 1
                slot = kept
                claimed.update(keys)
                for k in keys:
                    self.sent.updateValue((k,), (_micros(at),))
            out.append((key[0], at, rank, ord_, status, slot))
        made = pd.DataFrame(out, columns=["persona_id", "run_at", "rank", "ord", "status", "slot"])
        made["slot"] = made["slot"].astype("Int32")
        yield made

    def close(self) -> None:
        pass


def row_keys(normalized_link: str, source_title_keys: str):
    """The keys of a row, link and title keys in namespaces of their own."""
    return F.concat(F.when(F.col(normalized_link) != "", F.array(F.concat(F.lit("L"), normalized_link))).otherwise(F.array().cast("array<string>")),
                    F.transform(F.filter(source_title_keys, lambda k: k != ""), lambda k: F.concat(F.lit("T"), k)))


def initial_keys(history: DataFrame) -> DataFrame:
    """The initial state of a history: (persona_id, key, sent_at)."""
    keys = entry_match_keys(history).join(history.select("persona_id", "entry_pos", "sent_at"), ["persona_id", "entry_pos"])
    return keys.select("persona_id", F.concat("kind", "key").alias("key"), "sent_at")


def write_selection(selection: DataFrame, source: str, files: int | None = None) -> None:
    """Append one run's selection to the stream's source, a persona to a file."""
    columns = [f.split()[0] for f in SELECTION_DDL.split(", ")]
    rows = selection.select(*columns)
    rows = rows.repartition(files, "persona_id") if files else rows.repartition("persona_id")
    rows.write.mode("append").parquet(source)


def run_stateful(spark: SparkSession, source: str, work_dir: str, history: DataFrame, files_per_batch: int | None = 1,
                 max_per_persona: int = K.MAX_PER_PERSONA, lookback_days: int = K.LOOKBACK_DAYS) -> DataFrame:
    """Drive the stream over what ``source`` holds beyond the last call, in
    batches of so many files (None: one batch), and return all statuses so far."""
    before = {name: spark.conf.get(name) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        stream = spark.readStream.schema(SELECTION_DDL)
        if files_per_batch:
            stream = stream.option("maxFilesPerTrigger", files_per_batch)
        stream = stream.parquet(source)
        statuses = stream.groupBy("persona_id").transformWithStateInPandas(
            statefulProcessor=Suppressor(max_per_persona, lookback_days), outputStructType=STATUS_DDL, outputMode="Append",
            timeMode="ProcessingTime", initialState=initial_keys(history).groupBy("persona_id"))
        query = (statuses.writeStream.format("parquet").option("path", f"{work_dir}/statuses").outputMode("append")
                 .option("checkpointLocation", f"{work_dir}/stream-checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(STATUS_DDL).parquet(f"{work_dir}/statuses")
