"""The archive: Parquet by chronicle, story and day, sorted by key inside files, and the manifest of what was published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import EventLogError
from tidelog.operators.replay import in_range
from tidelog.operators.windows import contiguous_watermark, gap_filled
from tidelog.schema import EVENT_LOG, KEY, SECOND, event_log
from tidelog.sources.manifest import append_manifest, read_manifest


def write_archive(log: DataFrame, path: str, mode: str = "append") -> None:
    """Append events.  A story's day is dealt to tasks by hour too, so a hot story isn't one task's."""
    rows = event_log(log).withColumn("event_date", F.col("event_ts").cast("date"))
    hour = F.expr(f"event_time div {3600 * SECOND}")
    rows.repartition("chronicle", "story", "event_date", hour).sortWithinPartitions("chronicle", "story", "event_date", *KEY).write.mode(mode).partitionBy("chronicle", "story", "event_date").parquet(path)


def read_archive(spark: SparkSession, path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Events of an archive; a range prunes days as well as row groups."""
    rows = spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_LOG) + ", event_date date").parquet(path)
    day = lambda ns: F.date_add(F.lit("1970-01-01").cast("date"), F.lit(ns // (86_400 * SECOND)).cast("int"))
    keep = in_range(start, end)
    if start:
        keep = keep & (F.col("event_date") >= day(start))
    if end is not None:
        keep = keep & (F.col("event_date") <= day(end))
    return rows.filter(keep).select(*EVENT_LOG.names)


def read_foreign(spark: SparkSession, path: str) -> DataFrame:
    """An archive of another writer: narrower whole numbers (client ids of 32 bits) are widened, other types are an error."""
    rows = spark.read.parquet(path)
    whole = ("tinyint", "smallint", "int", "bigint", "decimal(20,0)")
    for f in EVENT_LOG:
        if f.name == "event_ts":
            continue
        if f.name not in rows.columns:
            raise EventLogError(f"no column {f.name}")
        have, want = rows.schema[f.name].dataType.simpleString(), f.dataType.simpleString()
        if have != want and not (have in whole and want in whole and whole.index(have) <= whole.index(want)):
            raise EventLogError(f"{f.name} is {have}, not {want}")
    return event_log(rows)


def publish(log: DataFrame, path: str, granularity_ns: int, writer: str = "w", writer_start: int = 0, incarnation: int = 0) -> None:
    """Write events below ``path`` and then a manifest record for each window, so that a record always has its events.

    Empty windows between a story's events get records without events: they
    move the watermark alone.
    """
    write_archive(log, f"{path}/events")
    held = gap_filled(log, granularity_ns)
    name = F.concat_ws(".", F.expr(f"chunk_start div {SECOND}").cast("string"), F.lit(str(writer_start)), F.lit(str(incarnation)))
    records = held.select(
        F.lit("PUBLISH").alias("op"), "chronicle", "story", F.lit(False).alias("whole_chronicle"), F.when(F.col("events") > 0, name).alias("file"), F.lit(writer).alias("writer"),
        F.lit(writer_start).cast("long").alias("writer_start"), F.lit(incarnation).cast("long").alias("incarnation"), F.lit(None).cast("long").alias("incarnation_bound"),
        F.col("chunk_start").alias("start"), F.col("chunk_end").alias("end"), F.col("events").cast("long").alias("events"),
    )
    append_manifest(records, f"{path}/manifest")


def persisted_watermark(spark: SparkSession, path: str) -> DataFrame:
    """chronicle, story, watermark: up to where each story's windows are published without a gap."""
    published = read_manifest(spark, f"{path}/manifest").filter("op = 'PUBLISH'")
    return contiguous_watermark(published, ["chronicle", "story"])
