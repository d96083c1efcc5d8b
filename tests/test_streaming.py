"""Ingest and subscriptions on files, with all that is there as one trigger."""

from pyspark.sql import functions as F

from tidelog.schema import IDENTITY, read_events
from tidelog.sources.archive import read_archive
from tidelog.sources.sinks import csv_sink, line_protocol_sink, records_sink, text_sink
from tidelog.streaming.ingest import read_stream, sealed_chunks, start_ingest
from tidelog.streaming.pubsub import Subscriptions

SF = "/root/testdata/sf0.001"
NOW = {"availableNow": True}


def test_ingest_keeps_late_events_and_repeats_nothing(spark, tmp_path):
    log = read_events(spark, SF)
    source, archive = str(tmp_path / "in"), str(tmp_path / "archive")
    log.orderBy(F.desc("event_time")).limit(600).write.parquet(source)
    run = lambda: start_ingest(read_stream(spark, source), archive, str(tmp_path / "cp"), exactly_once=True, trigger=NOW).awaitTermination()
    run()
    log.write.mode("append").parquet(source)  # the older 400 are late, 600 come again
    run()
    got = read_archive(spark, archive)
    assert got.count() == 1000 and got.select(*IDENTITY).distinct().count() == 1000
    lo, hi = 1_704_412_800 * 10**9, 1_705_017_600 * 10**9
    assert read_archive(spark, archive, lo, hi).count() == log.filter((F.col("event_time") >= lo) & (F.col("event_time") < hi)).count()


def test_subscription_equals_batch(spark, tmp_path):
    log = read_events(spark, SF)
    log.write.parquet(str(tmp_path / "in"))
    seen, hub = [], Subscriptions(read_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"))

    def callback(row):
        seen.append((row["timestamp"], row["payload"]))
        if len(seen) == 3:
            raise RuntimeError("a subscriber's own fault")

    number = hub.subscribe_from("click", 1_704_412_800 * 10**9, callback, trigger=NOW)
    hub.query(number).awaitTermination()
    want = [(r["event_time"], r["record"]) for r in log.filter("story = 'click'").filter(F.col("event_time") >= 1_704_412_800 * 10**9).orderBy("event_time").collect()]
    assert seen == want
    assert hub.unsubscribe(number) is True and hub.unsubscribe(number) is False


def test_chunks_seal(spark, tmp_path):
    read_events(spark, SF).write.parquet(str(tmp_path / "in"))
    query = sealed_chunks(read_stream(spark, str(tmp_path / "in")), "1 hour", "1 minute").writeStream.format("memory").queryName("sealed").outputMode("complete").trigger(**NOW).start()
    query.awaitTermination()
    assert spark.table("sealed").agg(F.sum("events")).head()[0] == 1000


def test_sinks(spark, tmp_path):
    log = read_events(spark, SF).limit(50)
    for name, sink in (("text", text_sink), ("csv", csv_sink), ("records", records_sink)):
        sink(str(tmp_path / name))(log)
    assert spark.read.text(str(tmp_path / "text")).filter("value like 'event : %'").count() == 50
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 50
    assert spark.read.text(str(tmp_path / "records")).count() == 50
    out = str(tmp_path / "lines")

    def post(body):
        with open(out, "a") as f:
            f.write(body)
        return True

    line_protocol_sink(post)(log)
    assert sum(1 for _ in open(out)) == 50
