"""Numbers out of records, telemetry points, line protocol and metric envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("double")


def single_number(record: Column) -> Column:
    """A JSON ``"value": n``, else ``value = n``, else the first number, else 1 or 0 for true or false, else null."""
    return F.coalesce(
        _first(record, rf'"value"\s*:\s*({NUMBER})'),
        _first(record, rf"value\s*=\s*({NUMBER})"),
        _first(record, rf"({NUMBER})"),
        F.when(F.lower(record).rlike("true"), 1.0).when(F.lower(record).rlike("false"), 0.0),
    )


def leading_number(text: Column) -> Column:
    """The number a text begins with, junk behind it allowed."""
    return _first(text, rf"^\s*({NUMBER})")


def number_pair(record: Column) -> tuple[Column, Column]:
    """The numbers either side of the first comma, else the first two numbers; nulls without both."""
    head = F.substring_index(record, ",", 1)
    tail = F.when(F.instr(record, ",") > 0, F.substring(record, F.instr(record, ",") + 1, F.length(record)))
    found = F.regexp_extract_all(record, F.lit(f"({NUMBER})"), F.lit(1))
    a, b = F.when(F.instr(record, ",") > 0, leading_number(head)), leading_number(tail)
    x, y = F.get(found, F.lit(0)).try_cast("double"), F.get(found, F.lit(1)).try_cast("double")
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a).when(y.isNotNull(), x), F.when(both, b).when(y.isNotNull(), y)


def points(log: DataFrame) -> DataFrame:
    """measurement, tags, fields, ts_ns: one point for each event; the story ``network_usage`` has two fields, others one; no number counts as 0."""
    rx, tx = number_pair(F.col("record"))
    pair = F.create_map(F.lit("rx_bytes"), F.coalesce(rx, F.lit(0.0)), F.lit("tx_bytes"), F.coalesce(tx, F.lit(0.0)))
    one = F.create_map(F.lit("value"), F.coalesce(single_number(F.col("record")), F.lit(0.0)))
    tags = F.create_map(F.lit("chronicle"), F.col("chronicle"), F.lit("story"), F.col("story"))
    return log.select(F.col("story").alias("measurement"), tags.alias("tags"), F.when(F.col("story") == "network_usage", pair).otherwise(one).alias("fields"), F.col("event_time").alias("ts_ns"))


def escaped(text: Column) -> Column:
    """Space, comma and equals sign behind a backslash."""
    return F.regexp_replace(text, r"([ ,=])", r"\\$1")


def line_protocol(pts: DataFrame) -> DataFrame:
    """``line``: measurement,tags fields timestamp.  Tags and fields in order of their names."""
    join = lambda m, show: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(escaped(e["key"]), F.lit("="), show(e["value"]))), ",")
    text = F.concat(escaped(F.col("measurement")), F.lit(","), join(F.col("tags"), escaped), F.lit(" "), join(F.col("fields"), lambda v: v.cast("string")), F.lit(" "), F.col("ts_ns").cast("string"))
    return pts.select(text.alias("line"))


def metric_story(schema: Column, producer: Column) -> Column:
    """Story of a metric set: schema and the producer with all but letters, digits, _ and - replaced."""
    return F.concat_ws("_", schema, F.regexp_replace(producer, "[^A-Za-z0-9_-]", "_"))


def metric_envelope(timestamp: Column, producer: Column, instance: Column, schema: Column, metrics: Column) -> Column:
    """JSON record of a metric sample; NaN and infinite values are null."""
    finite = F.transform_values(metrics, lambda _, v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v))
    return F.to_json(F.struct(timestamp.alias("timestamp"), producer.alias("producer"), instance.alias("instance"), schema.alias("schema"), finite.alias("metrics")), {"ignoreNullFields": "false"})
