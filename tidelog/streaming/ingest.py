"""Ingest stream: validated events are appended to the archive, late ones too.

The stream keeps no state, so nothing is ever too late for it; reads merge and
deduplicate.  With ``exactly_once`` a batch is anti-joined with what the archive
holds of its own time range, so an attempt that is repeated isn't written twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tidelog.schema import EVENT_LOG, IDENTITY, event_log
from tidelog.sources.archive import read_archive, write_archive
from tidelog.sources.sinks import Sink, chain


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Events that arrive as Parquet files; ``max_files`` a trigger holds back the rest (backpressure)."""
    reader = spark.readStream.schema(EVENT_LOG)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def valid(events: DataFrame) -> DataFrame:
    return events.filter("event_time > 0 and length(record) > 0")


def start_ingest(events: DataFrame, archive: str, checkpoint: str, sinks: Sequence[Sink] = (), exactly_once: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Start the stream; the checkpoint takes the place of a write-ahead log and receipts."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = event_log(valid(batch)).dropDuplicates(IDENTITY)
        if exactly_once:
            span = rows.agg(F.min("event_time").alias("lo"), F.max("event_time").alias("hi")).head()
            if span["lo"] is None:
                return
            try:
                held = read_archive(batch.sparkSession, archive, span["lo"], span["hi"] + 1).select(*IDENTITY)
                rows = rows.join(held, IDENTITY, "left_anti")
            except AnalysisException:  # no archive yet
                pass
        chain([lambda df: write_archive(df, archive), *sinks])(rows)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def sealed_chunks(events: DataFrame, granularity: str = "10 seconds", acceptance: str = "15 seconds") -> DataFrame:
    """Chunk counts, emitted when the watermark passes a chunk's end by the acceptance window.

    Sealing goes by the newest event seen; a recorder seals by the clock.
    """
    timed = events.withColumn("at", F.col("event_ts").cast("timestamp")).withWatermark("at", acceptance)
    return timed.groupBy("chronicle", "story", F.window("at", granularity).alias("w")).agg(F.count("*").alias("events")).select("chronicle", "story", F.col("w.start").alias("chunk_start"), F.col("w.end").alias("chunk_end"), "events")
