"""Structured Streaming ingestion of the change journal.

Records are appended by micro-batches; a batch that runs again after a failure writes the same directory, so that changes
are kept at least once and the last by sequence wins: effectively once. Damaged tails of raw logs never appear, as files
are seen whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.live import latest_changes
from ..sources.catalog import changes_of, journal
from ..sources.journal_log import JournalReset, register

CHANGES = "volume string, seq long, op string, file_id long, parent_id long, size_bytes long, flags int, name string"


def journal_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """Changes from a directory of event files; ``files_per_batch`` bounds a micro-batch."""
    return changes_of(journal(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)))


def ingest(changes: DataFrame, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append changes below ``target``, one directory a batch; without ``every``, catch up with what is there and stop."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    writer = changes.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ingested(spark: SparkSession, target: str) -> DataFrame:
    """All changes so far, those of batches that came twice once."""
    return spark.read.schema(CHANGES + ", batch string").parquet(target).drop("batch")


def state(spark: SparkSession, target: str) -> DataFrame:
    """The latest change of each file."""
    return latest_changes(ingested(spark, target))


#: A file's latest change as it is kept, and as it is given.
KEPT = "seq long, op string, parent_id long, size_bytes long, flags int, name string"
GIVEN = "volume string, file_id long, " + KEPT
KEPT_COLUMNS = [c.split()[0] for c in KEPT.split(", ")]


def log_stream(spark: SparkSession, path: str, records_per_batch: int | None = None) -> DataFrame:
    """Changes of a raw journal log, with the milliseconds of their time."""
    register(spark)
    reader = spark.readStream.format("journal").option("path", path)
    return changes_of((reader if records_per_batch is None else reader.option("records_per_batch", records_per_batch)).load(), "millis")


def combined(changes: DataFrame) -> DataFrame:
    """The last change of each file in each Arrow batch, before any shuffle, so that a file that changes all the time is few
    rows a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.sort_values("seq").drop_duplicates(["volume", "file_id"], keep="last")

    return changes.mapInPandas(run, changes.schema)


def keyed(changes: DataFrame, keep_millis: int | None = None) -> DataFrame:
    """The latest change of each file as keyed state of a stream: a batch gives a row for each file that it names, and costs
    in proportion to its own records and not to all that came before. An older record that comes late changes nothing.

    A deletion stays as a tombstone, so that an older record can't bring its file back. With ``keep_millis`` it goes once the
    stream's watermark is so far past it; records older than the watermark are dropped by then. Only that takes a timer for
    each file, and a Python call with it; without, the state is an aggregate's that Spark keeps and merges."""
    if keep_millis is None:
        return changes.groupBy("volume", "file_id").agg(F.max(F.struct(*KEPT_COLUMNS)).alias("kept")).select("volume", "file_id", "kept.*")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        before, millis = held, 0
        for rows in frames:
            last = rows.loc[rows["seq"].idxmax()]
            if held is None or last["seq"] > held[0]:
                held, millis = (int(last["seq"]), last["op"], int(last["parent_id"]), int(last["size_bytes"]), int(last["flags"]), last["name"]), int(last["millis"])
        if held is None or held == before:
            return
        state.update(held)
        if held[1] == "Delete":
            state.setTimeoutTimestamp(max(millis + keep_millis, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, *held)], columns=[c.split()[0] for c in GIVEN.split(", ")])

    rows = combined(changes).withColumn("time", F.timestamp_millis("millis")).withWatermark("time", "0 seconds")
    return rows.groupBy("volume", "file_id").applyInPandasWithState(run, GIVEN, KEPT, "update", GroupStateTimeout.EventTimeTimeout)


def follow(changes: DataFrame, checkpoint: str, keep_millis: int | None = None) -> StreamingQuery:
    """Keep ``keyed`` state under ``checkpoint``, from where it was left."""
    return keyed(changes, keep_millis).writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).start()


def kept_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as of the last batch, read from its store: (volume, file_id, seq, op, ...), a row a file."""
    rows = spark.read.format("statestore").load(checkpoint)
    kept = "groupState" if "groupState" in rows.schema["value"].dataType.names else rows.schema["value"].dataType.names[0]
    return rows.select("key.*", f"value.{kept}.*")


def followed_or_rebuilt(spark: SparkSession, log: str, checkpoint: str, again: str) -> DataFrame:
    """The state of a log's files: followed from where ``checkpoint`` left it, or, where that place is gone, from the log's
    beginning under a checkpoint of its own."""
    for place in (checkpoint, again):
        started = follow(log_stream(spark, log), place)
        try:
            started.processAllAvailable()
            return kept_state(spark, place)
        except StreamingQueryException as e:
            if place == again or JournalReset.__name__ not in str(e):
                raise
        finally:
            started.stop()
    raise AssertionError


def needs_rebuild(position: DataFrame, journals: DataFrame) -> DataFrame:
    """(volume, rebuild): whether a checkpoint names another journal, or a place that its journal no longer or not yet has."""
    j = journals.select("volume", F.col("journal_id").alias("now"), "lowest_usn", F.col("next_usn").alias("newest"))
    lost = ~F.col("journal_id").eqNullSafe(F.col("now")) | (F.col("next_usn") < F.col("lowest_usn")) | (F.col("next_usn") > F.col("newest"))
    return position.join(j, "volume", "left").select("volume", F.coalesce(lost, F.lit(True)).alias("rebuild"))


def throttle_seconds(decision: str, spinning_disk: bool = False) -> int:
    """The trigger's interval under a governor's decision."""
    return max(3, 5 * spinning_disk) * {"Run": 1, "Throttle": 2, "Pause": 4}[decision]


#: Bytes of changes that may wait while a user is active, and idle milliseconds from which a compaction may run.
WAITING_BYTES, IDLE_MS = 2 << 20, 30_000


def next_step(waiting_bytes: Column, idle_ms: Column) -> Column:
    """What ingestion does next: Compact what waits if nobody is there, Wait while too much does, Ingest otherwise."""
    idle = idle_ms >= IDLE_MS
    return F.when(idle & (waiting_bytes > 0), "Compact").when(waiting_bytes >= WAITING_BYTES, "Wait").otherwise("Ingest")


class ServiceState(StreamingQueryListener):
    """Keeps the transitions of an application's streams: Started, Progress with its batch and rows, Stopped or Failed."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        self.rows.append((str(event.runId), "Started", None, None, None))

    def onQueryProgress(self, event) -> None:
        self.rows.append((str(event.progress.runId), "Progress", event.progress.batchId, event.progress.numInputRows, None))

    def onQueryIdle(self, event) -> None:
        self.rows.append((str(event.runId), "Idle", None, None, None))

    def onQueryTerminated(self, event) -> None:
        self.rows.append((str(event.runId), "Failed" if event.exception else "Stopped", None, None, event.exception))

    def table(self, spark: SparkSession) -> DataFrame:
        """(run, state, batch, rows, error), as it happened."""
        return spark.createDataFrame(self.rows, "run string, state string, batch long, rows long, error string")
