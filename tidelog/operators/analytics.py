"""Summaries used by the benchmark tooling, and joins and windows beyond the event log's own queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, value: Column) -> DataFrame:
    """n, min, mean, p50, p90, p99, max; percentiles are exact, interpolated linearly."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    out = df.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), p.alias("p"), F.max(value).alias("max"))
    return out.select("n", "min", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"), "max")


def rollup_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: reps, mean, min and max."""
    return df.groupBy(*by).agg(F.count("*").alias("reps"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def collision_ratio(df: DataFrame, column: str) -> DataFrame:
    """1 - distinct / total."""
    return df.agg((1 - F.count_distinct(column) / F.count(column)).alias("ratio"))


def counter_rate(df: DataFrame, by: str, order: list[str], idle: str, total: str) -> DataFrame:
    """Busy percentage between samples of counters: 100 (1 - d idle / d total), held to 0..100; null on the first sample or without progress."""
    w = Window.partitionBy(by).orderBy(*order)
    d_idle, d_total = F.col(idle) - F.lag(idle).over(w), F.col(total) - F.lag(total).over(w)
    return df.withColumn("busy", F.when(d_total != 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * (1 - d_idle / d_total)))))


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Extension.  Each left row with the values of the last right row at or before its time.

    Both sides are laid in one sequence and carried forward, so a key is sorted
    once and nothing is paired.
    """
    a = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1))
    b = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def sessions(df: DataFrame, by: str, ts: str, gap: str) -> DataFrame:
    """Extension.  Session windows: by, session_start, session_end, events."""
    return df.groupBy(by, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("events")).select(by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def sliding(df: DataFrame, by: str, ts: str, width: str, slide: str) -> DataFrame:
    """Extension.  Sliding windows: by, window_start, events."""
    return df.groupBy(by, F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("window_start"), "events")
