"""The canonical event table.

An event is named by (chronicle, story, event_time, client_id, event_index) and
ordered within its story by the last three.  Times are nanoseconds since the
epoch as BIGINT: TIMESTAMP has microseconds and would merge events.  Client ids
are unsigned 64-bit numbers, hence DECIMAL(20, 0): as BIGINT half of them would
sort before the others.  ``event_ts`` (UTC, no zone) is for pruning and
watermarks only and never part of the identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_LOG = T.StructType(
    [
        T.StructField("chronicle", T.StringType(), False),
        T.StructField("story", T.StringType(), False),
        T.StructField("event_time", T.LongType(), False),
        T.StructField("client_id", T.DecimalType(20, 0), False),
        T.StructField("event_index", T.LongType(), False),
        T.StructField("record", T.StringType(), True),
        T.StructField("event_ts", T.TimestampNTZType(), True),
    ]
)
COLUMNS = EVENT_LOG.names
KEY = ["event_time", "client_id", "event_index"]
IDENTITY = ["chronicle", "story", *KEY]
SECOND = 1_000_000_000
DAY = 86_400 * SECOND


def ntz_of_micros(micros: Column) -> Column:
    """UTC timestamp without zone, whatever the session's zone."""
    day = 86_400_000_000
    rest = F.pmod(micros, F.lit(day))
    days, seconds = ((micros - rest) / day).cast("int"), (rest.cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days, F.lit(0), F.lit(0), seconds)


def event_log(df: DataFrame) -> DataFrame:
    """Bring a frame with the identity columns and ``record`` to the canonical columns and types."""
    if "event_ts" not in df.columns:
        df = df.withColumn("event_ts", ntz_of_micros(F.expr("event_time div 1000")))
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT_LOG])


def from_events(events: DataFrame, record: Column | None = None, story: Column | None = None) -> DataFrame:
    """Event table from the ``events`` test table; ``ts`` stays a plain column, so filters on it reach the scan."""
    ts = F.col("ts").cast("timestamp_ntz")
    return events.select(
        F.lit("events").alias("chronicle"),
        (story if story is not None else F.col("event_type")).alias("story"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") * 1000).alias("event_time"),
        F.col("user_id").cast("decimal(20,0)").alias("client_id"),
        F.col("event_id").cast("long").alias("event_index"),
        (record if record is not None else F.col("props")).cast("string").alias("record"),
        ts.alias("event_ts"),
    )


def read_events(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"), **options)


def public(df: DataFrame, *columns: str) -> DataFrame:
    """Result columns; client ids as BIGINT where they fit."""
    names = columns or tuple(c for c in COLUMNS if c != "event_ts")
    return df.select(*[F.col(c).cast("long").alias(c) if c == "client_id" else F.col(c) for c in names])
