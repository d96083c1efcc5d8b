"""Exports: text lines, CSV, line protocol, and chains of sinks."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.errors import InvalidArgument
from tidelog.functions.records import csv_time, event_line
from tidelog.functions.telemetry import line_protocol, points
from tidelog.schema import KEY

log = logging.getLogger(__name__)
Sink = Callable[[DataFrame], None]


def text_sink(path: str) -> Sink:
    """One line for each event; an empty frame writes nothing."""

    def write(events: DataFrame) -> None:
        if not events.isEmpty():
            events.sortWithinPartitions(*KEY).select(event_line(F.col("story")).alias("value")).write.mode("append").text(path)

    return write


def csv_sink(path: str) -> Sink:
    """Local time with nanoseconds, client, index, record."""

    def write(events: DataFrame) -> None:
        events.sortWithinPartitions(*KEY).select(csv_time(F.col("event_time")).alias("time"), "client_id", "event_index", "record").write.mode("append").option("header", True).csv(path)

    return write


def records_sink(path: str) -> Sink:
    """One record for each line."""

    def write(events: DataFrame) -> None:
        events.sortWithinPartitions(*KEY).select(F.coalesce("record", F.lit("")).alias("value")).write.mode("append").text(path)

    return write


def chunk_summaries(events: DataFrame) -> DataFrame:
    """chronicle, story, lo, hi, n: span and count of each story's events."""
    return events.groupBy("chronicle", "story").agg(F.min("event_time").alias("lo"), F.max("event_time").alias("hi"), F.count("*").alias("n"))


def logging_sink(level: int = logging.INFO) -> Sink:
    """Story, span and count of each chunk to the log; a row for each story reaches the driver."""

    def write(events: DataFrame) -> None:
        for r in chunk_summaries(events).toLocalIterator():
            log.log(level, "%s/%s: %d events in [%d, %d]", r["chronicle"], r["story"], r["n"], r["lo"], r["hi"])

    return write


def line_protocol_sink(post: Callable[[str], bool], max_retries: int = 3, backoff_s: float = 0.25, batch: int = 5_000) -> Sink:
    """Send line-protocol batches from the executors with ``post(body) -> ok``; a batch is tried 1 + ``max_retries`` times."""

    def send(lines: list[str]) -> None:
        for attempt in range(1, max_retries + 2):
            if post("\n".join(lines) + "\n"):
                return
            if attempt <= max_retries:
                time.sleep(backoff_s * attempt)
        raise OSError(f"{len(lines)} lines were not accepted")

    def partition(rows: Iterable) -> None:
        held: list[str] = []
        for r in rows:
            held.append(r["line"])
            if len(held) >= batch:
                send(held)
                held = []
        if held:
            send(held)

    return lambda events: line_protocol(points(events)).foreachPartition(partition)


def chain(sinks: Sequence[Sink]) -> Sink:
    """All sinks in order; the chunk counts as written only if each one took it."""

    def write(events: DataFrame) -> None:
        events = events.persist()
        try:
            for s in sinks:
                s(events)
        finally:
            events.unpersist()

    return write


def configured(kinds: Sequence[dict]) -> Sink:
    """The chain that a configuration names: ``[{"type": "csv", "path": ...}, {"type": "logging"}]``.

    Types: text, csv, records (with ``path``), logging, line_protocol (with ``post``), archive (with ``path``).
    """
    from tidelog.sources.archive import write_archive

    makers: dict[str, Callable[..., Sink]] = {
        "text": text_sink, "csv": csv_sink, "records": records_sink, "logging": logging_sink, "line_protocol": line_protocol_sink,
        "archive": lambda path: lambda events: write_archive(events, path),
    }
    for k in kinds:
        if k.get("type") not in makers:
            raise InvalidArgument(f"no such sink: {k.get('type')}")
    return chain([makers[k["type"]](**{a: v for a, v in k.items() if a != "type"}) for k in kinds])
