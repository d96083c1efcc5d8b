"""Versioned key-value view: a key is a story, a version an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.errors import InvalidArgument
from tidelog.schema import KEY

CHRONICLE = "values"


def versions(log: DataFrame, value: Column | None = None) -> DataFrame:
    """key, timestamp, value and the rest of the order."""
    return log.select(F.col("story").alias("key"), F.col("event_time").alias("timestamp"), (value if value is not None else F.col("record")).alias("value"), "client_id", "event_index")


def _order() -> Column:
    return F.struct("timestamp", "client_id", "event_index")


def get(kv: DataFrame, key: str, timestamp: int) -> DataFrame:
    """One row: the value written at exactly this time, the first of several, or the empty string."""
    return kv.filter((F.col("key") == key) & (F.col("timestamp") == timestamp)).agg(F.coalesce(F.min_by("value", _order()), F.lit("")).alias("value"))


def history(kv: DataFrame, key: str) -> DataFrame:
    return kv.filter(F.col("key") == key).orderBy("timestamp", *KEY[1:])


def value_range(kv: DataFrame, key: str, start: int, end: int) -> DataFrame:
    if start >= end:
        raise InvalidArgument("start must be before end")
    return history(kv.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end)), key)


def earliest(kv: DataFrame) -> DataFrame:
    """key, timestamp, value of each key's first version."""
    return kv.groupBy("key").agg(F.min("timestamp").alias("timestamp"), F.min_by("value", _order()).alias("value"))


def latest(kv: DataFrame) -> DataFrame:
    """The same of the newest time; of several versions at that time the first by client and index."""
    order = F.struct(F.col("timestamp"), -F.col("client_id"), -F.col("event_index"))
    return kv.groupBy("key").agg(F.max("timestamp").alias("timestamp"), F.max_by("value", order).alias("value"))
