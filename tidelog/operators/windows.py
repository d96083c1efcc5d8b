"""Chunks, gaps, persisted watermarks and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.schema import SECOND

#: Granularity and acceptance window of the three tiers, in seconds.
TIERS = {"keeper": (10, 15), "grapher": (30, 60), "player": (60, 300)}


def chunk_start(event_time: Column, granularity_ns: int) -> Column:
    return event_time - F.pmod(event_time, F.lit(granularity_ns))


def chunks(log: DataFrame, granularity_ns: int) -> DataFrame:
    """chronicle, story, chunk_start, chunk_end, events: tumbling windows that hold events."""
    start = chunk_start(F.col("event_time"), granularity_ns)
    return log.groupBy("chronicle", "story", start.alias("chunk_start")).agg(F.count("*").alias("events")).withColumn("chunk_end", F.col("chunk_start") + granularity_ns)


def gap_filled(log: DataFrame, granularity_ns: int) -> DataFrame:
    """As ``chunks``, with the empty windows between a story's first and last (events 0)."""
    held = chunks(log, granularity_ns)
    span = held.groupBy("chronicle", "story").agg(F.min("chunk_start").alias("lo"), F.max("chunk_start").alias("hi"))
    grid = span.select("chronicle", "story", F.explode(F.sequence("lo", "hi", F.lit(granularity_ns))).alias("chunk_start"))
    return grid.join(held, ["chronicle", "story", "chunk_start"], "left").select("chronicle", "story", "chunk_start", (F.col("chunk_start") + granularity_ns).alias("chunk_end"), F.coalesce("events", F.lit(0)).alias("events"))


def contiguous_watermark(intervals: DataFrame, by: list[str], start: str = "start", end: str = "end", anchor: Column | None = None, bucket: int = 24 * 3_600 * SECOND) -> DataFrame:
    """``by``, watermark: the end of the unbroken stretch of persisted intervals from the anchor on.

    An interval that begins at or before the watermark extends it; empty ones
    count for nothing.  The anchor is the first interval's start unless given.
    Intervals are merged into stretches within buckets of time first, so that
    one group's intervals aren't one task's; stretches are merged after that.
    """
    rows = intervals.filter(F.col(end) > F.col(start)).select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), (anchor if anchor is not None else F.lit(None).cast("long")).alias("_anchor"))
    rows = rows.withColumn("_bucket", F.expr(f"_s div {bucket}"))

    def stretches(df: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("_s", "_e")
        reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
        marked = df.withColumn("_new", F.coalesce(F.col("_s") > reach, F.lit(False)).cast("int")).withColumn("_island", F.sum("_new").over(w))
        return marked.groupBy(*keys, "_island").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.max("_anchor").alias("_anchor")).drop("_island")

    few = stretches(rows, [*by, "_bucket"]).drop("_bucket")
    first = few.groupBy(*by).agg(F.coalesce(F.max("_anchor"), F.min("_s")).alias("_from"))
    # what begins behind the anchor may still be reached from stretches before it
    w = Window.partitionBy(*by).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    few = few.drop("_anchor").join(first, by).withColumn("_reach", F.greatest("_from", F.max("_e").over(w)))
    held = F.min(F.when(F.col("_s") > F.col("_reach"), F.col("_reach")))
    return few.groupBy(*by).agg(F.coalesce(held, F.greatest(F.max("_e"), F.max("_from"))).alias("watermark"))


def registered_watermark(stories: DataFrame) -> DataFrame:
    """The watermark after a story is registered again at ``start_time``.

    ``stories``: watermark, start_time, fresh_pipeline, write_failed, parked
    (intervals above a gap).  An idle gap is covered only if nothing received
    may still be unwritten: a fresh pipeline, no failed write, nothing parked.
    A story without a watermark (null) begins at its start.
    """
    covers = F.col("fresh_pipeline") & ~F.col("write_failed") & (F.col("parked") == 0)
    w = F.when(F.col("watermark").isNull(), F.col("start_time")).when((F.col("start_time") > F.col("watermark")) & covers, F.col("start_time")).otherwise(F.col("watermark"))
    return stories.withColumn("watermark", w)


def settled_receipts(receipts: DataFrame, holders: DataFrame) -> DataFrame:
    """receipt, settled: a delivered chunk's receipt settles once it is merged and every window that holds its events is written.

    ``receipts``: receipt, merged; ``holders``: receipt, window, written.
    """
    open_ = holders.groupBy("receipt").agg(F.sum((~F.col("written")).cast("int")).alias("_open"))
    return receipts.join(open_, "receipt", "left").select("receipt", (F.col("merged") & (F.coalesce("_open", F.lit(0)) == 0)).alias("settled"))


def receipt_report(receipts: DataFrame) -> DataFrame:
    """story, highest_receipt, pending: all receipts up to the highest are written but the pending ones (ascending)."""
    return receipts.groupBy("story").agg(F.max("receipt").alias("highest_receipt"), F.sort_array(F.collect_list(F.when(~F.col("settled"), F.col("receipt")))).alias("pending"))


def salvaged(events: DataFrame, timeline_start: Column, granularity_ns: int, most_windows: int, queue: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events that the timeline takes, events that go to the archive in chunks of their own).

    An event so far before the timeline that more than ``most_windows`` would
    have to be put in front is salvaged: it goes straight to extraction and
    moves no watermark.  Without an extraction queue such events are discarded.
    """
    windows = F.ceil((timeline_start - chunk_start(F.col("event_time"), granularity_ns)) / F.lit(granularity_ns))
    fits = windows <= most_windows
    return events.filter(fits), events.filter(~fits) if queue else events.limit(0)


def timeline(log: DataFrame, granularity_ns: int) -> DataFrame:
    """chronicle, story, timeline_start, timeline_end, windows: a story's timeline after it grew to hold all its events."""
    at = chunk_start(F.col("event_time"), granularity_ns)
    span = log.groupBy("chronicle", "story").agg(F.min(at).alias("timeline_start"), (F.max(at) + granularity_ns).alias("timeline_end"))
    return span.withColumn("windows", F.expr(f"(timeline_end - timeline_start) div {granularity_ns}"))


def retirement(stories: DataFrame, now_ns: Column, tier: str = "keeper") -> DataFrame:
    """Adds ``exit_time`` and ``retired``: a stopped story (``stopped_at``) leaves after the tier's acceptance window unless it is acquired again (``acquired_at``)."""
    active = F.col("stopped_at").isNull() | F.coalesce(F.col("acquired_at") >= F.col("stopped_at"), F.lit(False))
    exit_time = F.when(~active, F.col("stopped_at") + TIERS[tier][1] * SECOND)
    return stories.withColumn("exit_time", exit_time).withColumn("retired", F.coalesce(exit_time < now_ns, F.lit(False)))


def orphan_chunks(events: DataFrame, stories: DataFrame, granularity_ns: int) -> DataFrame:
    """chronicle, story, chunk_start, events: recovery chunks of late events of retired stories; destroyed stories' events are refused.

    ``stories``: chronicle, story, retired, destroyed.
    """
    gone = stories.filter(F.col("retired") & ~F.col("destroyed")).select("chronicle", "story")
    return chunks(events.join(gone, ["chronicle", "story"], "left_semi"), granularity_ns).drop("chunk_end")


def late_merge(archive: DataFrame, late: DataFrame) -> DataFrame:
    """Late events are never dropped: they are appended, and reads merge them in (each identity once)."""
    from tidelog.operators.replay import merge

    return merge(archive, late)


def acceptance_end(chunk_end: Column, tier: str = "keeper") -> Column:
    """When a chunk seals: its end and the tier's acceptance window."""
    return chunk_end + TIERS[tier][1] * SECOND


def sealed(held: DataFrame, now_ns: Column, tier: str = "keeper") -> DataFrame:
    """Chunks whose acceptance window has passed by the clock; a late event only ever lengthens the window."""
    return held.filter(now_ns > acceptance_end(F.col("chunk_end"), tier))


def freeable(status: DataFrame, now_ns: Column, visibility_delay_ns: int) -> DataFrame:
    """Chunks that may leave memory: shipped, receipt settled, persisted up to their end, out of the tail, not queued, and visible long enough."""
    return status.filter(
        F.col("shipped") & F.col("receipt_settled") & (F.col("watermark") >= F.col("chunk_end")) & ~F.col("in_tail") & ~F.col("queued") & (now_ns >= F.col("chunk_end") + visibility_delay_ns)
    )
