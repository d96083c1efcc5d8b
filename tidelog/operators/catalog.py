"""Chronicles and stories, archive manifests and tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chronicles(log: DataFrame) -> DataFrame:
    return log.select("chronicle").distinct()


def stories(log: DataFrame, chronicle: str) -> DataFrame:
    return log.filter(F.col("chronicle") == chronicle).select("story").distinct()


def stories_like(log: DataFrame, chronicle_pattern: str, story_pattern: str) -> DataFrame:
    """Dashboard variable: distinct stories whose names match, ordered."""
    rows = log.filter(F.col("chronicle").rlike(chronicle_pattern) & F.col("story").rlike(story_pattern))
    return rows.select("story").distinct().withColumnRenamed("story", "value").orderBy("value")


def find_variable(log: DataFrame, text: str) -> DataFrame:
    """Values of a dashboard variable: ``chronicles`` or ``*`` for chronicles, ``stories(x)`` for those of one; none for other texts."""
    text = text.strip()
    if text in ("chronicles", "*"):
        return chronicles(log).withColumnRenamed("chronicle", "value").orderBy("value")
    if text.startswith("stories(") and text.endswith(")"):
        return stories(log, text[8:-1].strip()).withColumnRenamed("story", "value").orderBy("value")
    return log.select(F.col("story").alias("value")).limit(0)


def files_for_range(manifest: DataFrame, start: int, end: int, max_span: int | None = None) -> DataFrame:
    """Published files (start_time, end_time) that overlap ``[start, end)``.

    ``max_span``, the longest file's span, bounds how far back a file can begin
    and gives the scan a bound on ``start_time`` to prune by.
    """
    keep = (F.col("start_time") < end) & (F.col("end_time") > start)
    if max_span is not None:
        keep = keep & (F.col("start_time") >= start - max_span)
    return manifest.filter(keep)


def visible_files(published: DataFrame, deletions: DataFrame) -> DataFrame:
    """Files not covered by a deletion of their writer start and chronicle/story with a higher incarnation bound."""
    bounds = deletions.groupBy("chronicle", "story", "writer_start").agg(F.max("incarnation_bound").alias("bound"))
    out = published.join(bounds, ["chronicle", "story", "writer_start"], "left")
    return out.filter(F.col("bound").isNull() | (F.col("incarnation") > F.col("bound"))).drop("bound")


def without_destroyed(log: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Events of stories that weren't destroyed, or that were written after their story's last destruction (``destroyed_at``)."""
    last = tombstones.groupBy("chronicle", "story").agg(F.max("destroyed_at").alias("destroyed_at"))
    out = log.join(last, ["chronicle", "story"], "left")
    return out.filter(F.col("destroyed_at").isNull() | (F.col("event_time") > F.col("destroyed_at"))).drop("destroyed_at")


def fold_tables(operations: DataFrame) -> DataFrame:
    """Tables alive after a log of operations: name, columns, position (of the first creation).

    ``operations``: seq, record (JSON: op, name, columns).  Malformed records
    and unknown operations are passed over; creating a table that exists changes
    nothing; one that is created again after a drop keeps its first position.
    """
    parsed = F.from_json("record", "op string, name string, columns array<struct<name string, type string>>")
    ops = operations.select("seq", parsed.alias("r")).filter("r.op in ('create_table', 'drop_table') and r.name is not null").select("seq", "r.op", "r.name", "r.columns")
    by_name = Window.partitionBy("name").orderBy("seq")
    ops = ops.withColumn("last_drop", F.max(F.when(F.col("op") == "drop_table", F.col("seq"))).over(Window.partitionBy("name")))
    ops = ops.withColumn("position", F.min(F.when(F.col("op") == "create_table", F.col("seq"))).over(Window.partitionBy("name")))
    alive = ops.filter((F.col("op") == "create_table") & (F.col("last_drop").isNull() | (F.col("seq") > F.col("last_drop"))))
    return alive.withColumn("_n", F.row_number().over(by_name)).filter("_n = 1").select("name", "columns", "position")


def window_file_parts(name: Column) -> dict[str, Column]:
    """Fields of an archive window's file name: seconds.group.writer start.incarnation.sequence.vlen.h5."""
    shape = r"^(\d+)\.(\d+)\.(\d+)\.(\d+)\.(\d+)\.vlen\.h5$"
    fields = ("start_sec", "group_id", "writer_start", "incarnation", "seq")
    return {f: F.regexp_extract(name, shape, k).try_cast("long") for k, f in enumerate(fields, 1)}


def archive_name(name: Column) -> Column:
    """A name as a folder: percent, slash and NUL are escaped; dots alone and the empty name get escapes of their own."""
    safe = F.replace(F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")), F.lit("\0"), F.lit("%00"))
    return F.when(name == "", "%").when(name == ".", "%2E").when(name == "..", "%2E%2E").otherwise(safe)
