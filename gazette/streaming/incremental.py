"""Incremental repeat suppression.

Each micro-batch of listing pages is one run: extract -> filter -> per-site
cut -> dedupe -> lexical selection -> suppression against the history ->
upserts. The history is kept as files in the shared checkpoint folder: batch
``e`` reads the state before ``e`` (the newest snapshot of an earlier batch
and the deltas after it, scanned where they lie: a delta's rows say whether they
replace an entry) and writes its own entries as delta ``e``. A batch
that is run again therefore starts from the same state and overwrites its own
delta with the same entries, so each article is recorded once. Every
``SNAPSHOT_EVERY`` batches the state is written out as a snapshot, and what
lies before the previous snapshot is removed. The stream's own checkpoint
remembers which files were consumed; the lookback filter is the state's time
to live.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import constants as K
from gazette.functions.dates import is_within_days
from gazette.operators import history as hist
from gazette.plans.digest_run import kept_selection, unique_articles
from gazette.session import cut_lineage
from gazette.sources.tables import SCHEMAS

HISTORY_DDL = ("persona_id STRING, entry_pos BIGINT, title STRING, chamada STRING, resumo STRING, "
               "link STRING, normalized_link STRING, title_key STRING, title_keys ARRAY<STRING>, "
               "source_title_key STRING, source_title_keys ARRAY<STRING>, source STRING, "
               "sent_at TIMESTAMP_NTZ, doc_title STRING, doc_link STRING")
#: A delta's rows: whether an older entry had the place, and the batch.
DELTA_DDL = f"{HISTORY_DDL}, replaces BOOLEAN, epoch BIGINT"
SNAPSHOT_EVERY = 8


def _folder(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """The batches whose files under ``path`` are complete."""
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    done = lambda p: fs.exists(_folder(spark, f"{p.toString()}/_SUCCESS")[0])
    return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("e=") and done(p))


def _live(rows: DataFrame, as_of) -> DataFrame:
    return rows if as_of is None else rows.filter(is_within_days("sent_at", as_of, K.LOOKBACK_DAYS))


def _rows_before(spark: SparkSession, state_dir: str, epoch: int, initial: DataFrame | None, as_of, once: bool) -> DataFrame:
    """The rows of the history as batch ``epoch`` finds it, read where they lie: no
    entry is exchanged unless a delta replaced some. ``once``: entries that an
    initial history holds twice are given once (as soon as there is a delta)."""
    snapshots = [e for e in _epochs(spark, f"{state_dir}/snapshot") if e < epoch]
    since = snapshots[-1] if snapshots else -1
    if snapshots:
        base = spark.read.schema(HISTORY_DDL).parquet(f"{state_dir}/snapshot/e={since}")
    elif initial is not None:
        base = initial.select(*hist.HISTORY_COLS)
    else:
        base = spark.createDataFrame([], HISTORY_DDL)
    deltas = [f"{state_dir}/delta/e={e}" for e in _epochs(spark, f"{state_dir}/delta") if since < e < epoch]
    if not deltas:
        return _live(base, as_of)
    added = spark.read.schema(DELTA_DDL).parquet(*deltas)
    place, by_epoch = ["persona_id", "entry_pos"], added.select(*hist.HISTORY_COLS, "epoch")
    if as_of is None:  # also entries past the lookback, whose places may be taken again: the latest of each place
        rows = base.withColumn("epoch", F.lit(-1).cast("bigint")).unionByName(by_epoch)
        return rows.groupBy(*place).agg(F.max_by(F.struct(*hist.HISTORY_COLS[2:]), "epoch").alias("_entry")).select(
            *place, "_entry.*").select(*hist.HISTORY_COLS)
    if once and not snapshots and initial is not None:
        base = base.dropDuplicates(place)
    rows = _live(base.withColumn("epoch", F.lit(-1).cast("bigint")).unionByName(by_epoch), as_of)
    again = added.where("replaces")
    if not again.isEmpty():
        newest = again.groupBy(*place).agg(F.max("epoch").alias("_newest"))
        rows = rows.join(newest, place, "left").where("_newest IS NULL OR epoch >= _newest")
    return rows.select(*hist.HISTORY_COLS)


def history_before(spark: SparkSession, state_dir: str, epoch: int, initial: DataFrame | None = None,
                   as_of=None) -> DataFrame:
    """The history as batch ``epoch`` finds it."""
    return _rows_before(spark, state_dir, epoch, initial, as_of, once=True)


def run_batch(listings: DataFrame, history: DataFrame, personas: DataFrame, as_of,
              days_back: int = K.DAYS_BACK) -> DataFrame:
    """One run over a batch of listing pages; the entries it adds to or
    replaces in the history, each place once, with ``replaces``."""
    unique = unique_articles(listings, as_of, days_back=days_back)
    kept = kept_selection(unique, personas, history)
    sent = kept.join(unique.select("ord", "title", "link", "site"), "ord").select(
        "persona_id", F.col("slot").cast("bigint").alias("seq"), "title",
        F.lit(None).cast("string").alias("chamada"), F.lit(None).cast("string").alias("resumo"),
        "link", "site")
    return hist.upserts(history, sent, sent_at=as_of, as_delta=True)


def process_batch(spark: SparkSession, batch: DataFrame, epoch: int, state_dir: str, personas: DataFrame,
                  as_of, initial: DataFrame | None = None) -> None:
    """Batch ``epoch``: the same files whenever and however often it runs."""
    current = _rows_before(spark, state_dir, epoch, initial, as_of, once=False)
    new = run_batch(batch, current, personas, as_of).withColumn("epoch", F.lit(epoch).cast("bigint"))
    new.write.mode("overwrite").parquet(f"{state_dir}/delta/e={epoch}")
    if (epoch + 1) % SNAPSHOT_EVERY == 0:
        history_before(spark, state_dir, epoch + 1, initial, as_of).write.mode("overwrite").parquet(
            f"{state_dir}/snapshot/e={epoch}")
        expire(spark, state_dir)


def expire(spark: SparkSession, state_dir: str) -> None:
    """Remove what no batch from the last snapshot on can read."""
    snapshots = _epochs(spark, f"{state_dir}/snapshot")
    for kind in ("snapshot", "delta"):
        for e in _epochs(spark, f"{state_dir}/{kind}"):
            if len(snapshots) > 1 and (e < snapshots[-2] if kind == "snapshot" else e <= snapshots[-2]):
                folder, fs = _folder(spark, f"{state_dir}/{kind}/e={e}")
                fs.delete(folder, True)


def run_incremental(spark: SparkSession, source: str, work_dir: str, personas: DataFrame,
                    as_of, initial_history: DataFrame | None = None, files_per_batch: int = 1,
                    listing: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Drive ``process_batch`` over the files of ``source`` (page_id, url,
    html), read where they are, with an available-now trigger; returns the
    final history. ``listing`` turns raw pages into listing pages."""
    state_dir = f"{work_dir}/history"
    personas = cut_lineage(personas)
    initial = None if initial_history is None else cut_lineage(initial_history.select(*hist.HISTORY_COLS))

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def on_batch(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            pages = listing(batch) if listing else batch
            pages = pages.repartition(tasks, "page_id")  # a file is one task's, and few bytes are much to parse
            process_batch(spark, pages, epoch, state_dir, personas, as_of, initial)

    path, fs = _folder(spark, source)
    reader = spark.readStream.schema(SCHEMAS["pages"]).option("maxFilesPerTrigger", files_per_batch)
    if fs.getFileStatus(path).isFile():  # a stream reads folders
        reader, source = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    stream = reader.parquet(source)
    q = (stream.writeStream.foreachBatch(on_batch)
         .option("checkpointLocation", f"{work_dir}/stream-checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return history_before(spark, state_dir, 1 << 62, initial, as_of)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    import uuid
    from gazette.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex}")
