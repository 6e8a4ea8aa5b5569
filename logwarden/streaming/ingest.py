"""Streaming ingest: log lines in, scored rows upserted, duplicates dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from logwarden.plans.flow import analyze_lines
from logwarden.sources.lines import merge_continuations, number_lines, server_type_of_path
from logwarden.session import materialize, spread
from logwarden.sources.sinks import write_version


def stream_table(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; back-pressure by files per batch."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def stream_log_lines(spark: SparkSession, folder: str, glob: str = "*.log", files_per_batch: int = 100) -> DataFrame:
    """New text logs as a stream of ``file, _start, value``; a file is never split over micro-batches."""
    return (
        spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch).text(folder)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value")
    )


def drop_repeats(stream: DataFrame, ts: str = "ts", key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """First row of each key within the watermark delay. Watermarks need an instant, not local time."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None,
                  once: bool = False) -> StreamingQuery:
    """Micro-batches through ``transform`` into a keyed table; a replayed batch changes nothing.

    ``read_current`` gives the table's state.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        write_version(transform(batch) if transform else batch, table, batch_id)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")
    return writer.start()


def score_batch(batch: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Scored requests of one micro-batch of whole log files, as the batch reader scores them.

    All columns are kept, or those in ``columns``: features that these don't depend on are not computed then.

    Lines are numbered within their file and ids name both, so equal lines stay apart and a replay
    gives the same ids; indented lines join their record, W3C headers hold to the next one, and bad UTF-8 is
    read as Latin-1. Only the byte-order-mark flag is missing: the stream reader drops the mark. The records are
    written once for the parsers of all servers and dealt out over all cores, since a file is one task to the reader.
    """
    lines = materialize(number_lines(batch).withColumn("bom", F.lit(False)), "lines")
    records = materialize(merge_continuations(lines).withColumn("server_type", server_type_of_path(F.col("file"))), "records")
    scored = analyze_lines(spread(records, "file", "line_number"), namespace="file")
    return scored.select(*columns) if columns else scored
