"""Record text: row codec, export lines, conversation records and time arguments."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.errors import InvalidArgument
from tidelog.schema import SECOND


def decode_row(df: DataFrame, record: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep``, key, value: the members of each record's JSON object as texts; a JSON null is the text "null".

    Records that are no JSON object have no rows.
    """
    objects = df.withColumn("_v", F.try_parse_json(record)).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    names = "".join(f"`{k}`, " for k in keep)
    return df.sparkSession.sql(
        f"SELECT {names}key, CASE WHEN is_variant_null(value) THEN 'null' ELSE CAST(value AS STRING) END AS value FROM {{rows}}, LATERAL variant_explode(_v)",
        rows=objects,
    )


def encode_row(values: Column) -> Column:
    """A map of texts as a JSON object; null values are left out."""
    return F.to_json(F.map_filter(values, lambda _, v: v.isNotNull()))


def event_line(story_id: Column) -> Column:
    """One line of the text export: ``event : story id:time:client:index:record``."""
    return F.concat(F.lit("event : "), F.concat_ws(":", story_id.cast("string"), F.col("event_time").cast("string"), F.col("client_id").cast("string"), F.col("event_index").cast("string"), F.col("record")))


def csv_time(event_time: Column) -> Column:
    """Local seconds and nanoseconds, the latter padded to nine digits."""
    seconds = F.timestamp_seconds(((event_time - F.pmod(event_time, F.lit(SECOND))) / SECOND).cast("long"))
    return F.concat(F.date_format(seconds, "yyyy-MM-dd HH:mm:ss"), F.lit("."), F.lpad(F.pmod(event_time, F.lit(SECOND)).cast("string"), 9, "0"))


def dashboard_frame(log: DataFrame) -> DataFrame:
    """Time (whole milliseconds), Log, Client ID, Index."""
    return log.select(F.expr("event_time div 1000000").alias("time_ms"), F.col("record").alias("log"), F.col("client_id").cast("long").alias("client"), F.col("event_index").alias("idx"))


def interactions(turns: DataFrame) -> DataFrame:
    """conv_id, turn, record: each user turn with the assistant's next one, as ``user: ..., assistant: ...``."""
    user = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("u"))
    answer = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return user.join(answer, ["conv_id", "turn"]).select("conv_id", "turn", F.concat(F.lit("user: "), "u", F.lit(", assistant: "), "a").alias("record"))


def parse_time(text: str | None, end: bool = False, now: dt.datetime | None = None) -> int | None:
    """Nanoseconds of a time argument: digits, yesterday, today, tomorrow or an ISO date.

    Days begin at 0:00, and as an end stand for 23:59:59.999999 of the day (UTC here).
    """
    if text is None or text == "":
        return None
    if text.isdigit():
        return int(text)
    now = now or dt.datetime.now(dt.timezone.utc)
    shift = {"yesterday": -1, "today": 0, "tomorrow": 1}.get(text.lower())
    try:
        day = now.date() + dt.timedelta(days=shift) if shift is not None else dt.datetime.fromisoformat(text).date()
    except ValueError as e:
        raise InvalidArgument(f"no time: {text!r}") from e
    start = int(dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc).timestamp()) * SECOND
    return start + 86_400 * SECOND - 1000 if end else start
