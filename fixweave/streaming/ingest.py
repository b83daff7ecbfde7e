"""Incremental ingest: new record files are picked up by a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fixweave.operators.records import drop_rejected, good_records, outcome, outcome_counts, parse_records
from fixweave.plans.ingest import record_batches
from fixweave.session import staged_with_counts
from fixweave.sources.store import TableStore

# Source order inside a batch: the later file wins, inside a file the later split, inside a split the later row.
_ORDER = ["file_time", "file_path", "split_start", "row"]
_COUNTS = ["input_rows", "processed", "rejected", "skipped", "unread"]


def read_record_stream(
    spark: SparkSession, source: str, whole_files: bool = False, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of record texts from a folder of line files, or of one-record files.

    Line files are cut into splits as in any scan, so a file of any size is read
    by many tasks. A row keeps the offset at which its split starts.
    """
    reader = spark.readStream.format("text").option("wholetext", str(whole_files).lower())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source).select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_block_start").alias("split_start"),
    )


def start_ingest(records: DataFrame, store: TableStore, checkpoint: str) -> StreamingQuery:
    """Process all files that are new since the last start, then stop.

    The checkpoint remembers the files that are done. A batch's rows and its
    counts are published together, under the query's id and the batch's number.
    A batch that comes again, as its end did not reach the checkpoint, is found
    there and left out.
    """
    spark = store.spark

    def upsert(batch: DataFrame, batch_id: int) -> None:
        # The id lies in the checkpoint, so it is the same after every restart.
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        if store.has_batch(stream, batch_id):
            return
        # A split is read by one task from its start to its end, and ids grow inside a task.
        placed = batch.withColumn("row", F.monotonically_increasing_id())
        tagged, counts = staged_with_counts(
            outcome(parse_records(placed)).drop("value"), "stream-batch", input_rows=F.count("*"), **outcome_counts()
        )
        store.upsert(record_batches(drop_rejected(good_records(tagged)), _ORDER), batch=(stream, batch_id, counts))

    return (
        records.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def progress_rows(store: TableStore) -> DataFrame:
    """One row of counts per batch that was stored, as published with its rows."""
    return store.batches().select("stream", "batch_id", *[F.col("counts")[name].alias(name) for name in _COUNTS])
