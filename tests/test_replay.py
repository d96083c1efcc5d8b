"""Small vectors for the split, merge, chunk and tail rules."""

import pytest
from pyspark.sql import functions as F

from tidelog.errors import InvalidArgument, PartialResult
from tidelog.operators import kv, replay, tail, windows
from tidelog.schema import event_log


def events(spark, *rows):
    """Rows (time, client, index[, record])."""
    full = [("c", "s", r[0], r[1], r[2], r[3] if len(r) > 3 else f"event@{r[0]}") for r in rows]
    df = spark.createDataFrame(full, "chronicle string, story string, event_time long, client long, event_index long, record string")
    return event_log(df.withColumn("client_id", F.col("client").cast("decimal(20,0)")))


def times(df):
    return [r["event_time"] for r in df.orderBy("event_time", "client_id", "event_index").collect()]


def held(spark, ts, **kw):
    return replay.HotResponse(events(spark, *[(t, 1, 0) for t in ts]), **kw)


def test_split_by_floor(spark):
    r = [held(spark, [210, 220], hot_floor=210), held(spark, [180, 190, 230], hot_floor=180), held(spark, [240], hot_floor=240)]
    s = replay.split_hot_range(r, 100, 300)
    assert (s.boundary, times(s.hot), s.complete) == (180, [180, 190, 210, 220, 230, 240], False)


def test_split_by_watermark(spark):
    r = [held(spark, [100, 105, 250], hot_floor=100, known_w=200), held(spark, [210, 220], hot_floor=210, known_w=180)]
    s = replay.split_hot_range(r, 100, 300)
    assert (s.boundary, times(s.hot), s.complete) == (200, [210, 220, 250], False)


def test_split_without_recorders():
    s = replay.split_hot_range([], 100, 300)
    assert (s.boundary, s.hot, s.complete) == (300, None, False)


def test_unconfirmed_events_are_hot_anywhere(spark):
    r = [replay.HotResponse(events(spark, (150, 1, 0), (250, 1, 0)), events(spark, (120, 1, 0)), 100, 200)]
    assert times(replay.split_hot_range(r, 100, 300).hot) == [120, 250]


def test_plan():
    split = replay.HotSplit(180, None, False)
    assert replay.plan_replay(split, 100, 300) == replay.ReplayPlan(True, 180, True)
    assert replay.plan_replay(split, 100, 300, missing=1) == replay.ReplayPlan(True, 300, False)
    assert replay.plan_replay(split, 100, 300, truncated=True).complete is False
    assert replay.plan_replay(replay.HotSplit(100, None, True), 100, 300).read_archive is False


def test_incomplete_results_are_refused(spark):
    with pytest.raises(PartialResult):
        replay.planned_replay(events(spark, (150, 1, 0)), [], 100, 300, missing=1).require()


def test_merge(spark):
    assert times(replay.merge(events(spark, (100, 1, 0), (110, 1, 1)), events(spark, (110, 1, 1), (120, 1, 2)))) == [100, 110, 120]
    assert len(times(replay.merge(events(spark, (100, 1, 0)), events(spark, (100, 2, 0))))) == 2


def test_first_arrival(spark):
    rows = events(spark, (150, 1, 1, "first"), (150, 1, 2, "second"), (150, 2, 1, "third"), (150, 1, 1, "duplicate"))
    rows = rows.withColumn("arrival_seq", F.when(F.col("record") == "duplicate", 9).otherwise(F.col("event_index")))
    assert {r["record"] for r in replay.first_arrival(rows).collect()} == {"first", "second", "third"}


def test_erase_takes_the_closing_key(spark):
    zero = F.lit(0).cast("long")
    log = spark.range(100_000).select(F.col("id").alias("event_time"), zero.alias("client_id"), zero.alias("event_index"))
    assert log.count() - replay.erase(log, 40_000, 60_000).count() == 20_001
    assert log.count() - replay.erase(log, 40_000, 60_000, closing_key=False).count() == 20_000


def test_order_of_large_client_ids(spark):
    df = spark.createDataFrame([("c", "s", 5, str(2**63 + 7), 0, "big"), ("c", "s", 5, "3", 0, "small")], "chronicle string, story string, event_time long, client_id string, event_index long, record string")
    log = event_log(df.withColumn("client_id", F.col("client_id").cast("decimal(20,0)")))
    assert [r["record"] for r in replay.replay(log, "c", "s").collect()] == ["small", "big"]


def test_replay_checks_and_callbacks(spark):
    log = events(spark, (3, 1, 0), (1, 1, 0), (2, 1, 0), (2, 1, 0))
    with pytest.raises(InvalidArgument):
        replay.replay(log, "c", "s", 5, 5)
    seen = []

    def callback(row):
        seen.append(row["event_time"])
        if row["event_time"] == 2:
            raise RuntimeError

    assert replay.replay_each(log, "c", "s", 0, None, callback) == 1 and seen == [1, 2, 3]


def test_tail(spark):
    log = events(spark, *[(t, 1, 0) for t in (5, 3, 9, 7)])
    assert [r["event_time"] for r in tail.last_n(log, "c", "s", 2).collect()] == [7, 9]
    assert [r["event_time"] for r in tail.last_n_wide(log, "c", "s", 3).collect()] == [5, 7, 9]
    assert tail.last_n(log, "c", "s", 0).count() == 0 and tail.last_n(log, "c", "s", 99).count() == 4


def test_versions(spark):
    v = kv.versions(events(spark, (5, 2, 0, "b"), (5, 1, 1, "a"), (1, 9, 9, "old")))
    assert kv.latest(v).head()["value"] == "a" and kv.earliest(v).head()["value"] == "old"
    assert kv.get(v, "s", 5).head()["value"] == "a" and kv.get(v, "s", 4).head()["value"] == ""
    with pytest.raises(InvalidArgument):
        kv.value_range(v, "s", 5, 5)


def test_watermark(spark):
    spans = spark.createDataFrame([("x", 0, 10), ("x", 10, 20), ("x", 5, 12), ("x", 25, 30), ("y", 3, 4)], "k string, start long, end long")
    got = {r["k"]: r["watermark"] for r in windows.contiguous_watermark(spans, ["k"]).collect()}
    assert got == {"x": 20, "y": 4}
    late = windows.contiguous_watermark(spans, ["k"], anchor=F.lit(2).cast("long"))
    assert {r["k"]: r["watermark"] for r in late.collect()} == {"x": 20, "y": 2}


def test_merges_keep_the_first_arrival(spark):
    chunk = events(spark, (150, 1, 1, "first"), (150, 1, 2, "second"), (150, 2, 1, "third"))
    other = events(spark, (150, 1, 1, "duplicate"), (160, 1, 1, "new"), (160, 1, 1, "other new"), (400, 1, 1, "outside"))
    merged, left = replay.chunk_merge(chunk, other.withColumn("arrival_seq", F.length("record")), 100, 200)
    assert sorted(r["record"] for r in merged.collect()) == ["first", "new", "second", "third"]
    assert [r["record"] for r in left.collect()] == ["outside"]
    both = replay.merge(events(spark, (1, 1, 0, "z")), events(spark, (1, 1, 0, "a"), (2, 1, 0, "b")))
    assert sorted(r["record"] for r in both.collect()) == ["b", "z"]


def test_split_takes_zero_for_no_watermark_and_unconfirmed_first(spark):
    one = replay.HotResponse(events(spark, (250, 1, 0, "confirmed")), events(spark, (250, 1, 0, "unconfirmed")), 120, 0)
    s = replay.split_hot_range([one], 100, 300)
    assert s.boundary == 120 and [r["record"] for r in s.hot.collect()] == ["unconfirmed"]


def test_hot_range_answers_are_cut(spark):
    held = events(spark, *[(t, 1, 0) for t in range(100, 110)]).withColumn("visible", F.col("event_time") % 2 == 0)
    got = replay.fetch_hot_range(held, 100, 110, 104, 4)
    assert times(got.confirmed) == [104] and times(got.unconfirmed) == [101, 103, 105] and got.truncated and got.hot_floor == 100
    assert not replay.fetch_hot_range(held, 100, 110, 104, 8).truncated


def test_hot_range_answers_are_whole_without_a_bound(spark):
    """More events than a player asks for at once (262,144)."""
    n, zero = 262_150, F.lit(0).cast("long")
    held = spark.range(n).select(
        F.lit("c").alias("chronicle"), F.lit("s").alias("story"), F.col("id").alias("event_time"), zero.cast("decimal(20,0)").alias("client_id"),
        zero.alias("event_index"), F.lit("r").alias("record"), (F.col("id") % 2 == 0).alias("visible"),
    )
    got = replay.fetch_hot_range(held, 0, n, 4)
    assert (got.confirmed.count(), got.unconfirmed.count(), got.truncated) == (n // 2 - 2, n // 2, False)
    assert [r["event_time"] for r in got.confirmed.limit(3).collect()] == [4, 6, 8]


def test_hot_range_answers_have_events_without_a_story(spark):
    held = events(spark, (100, 1, 0), (101, 1, 0), (102, 1, 0)).withColumn("story", F.when(F.col("event_time") != 101, F.col("story")))
    copies = held.withColumn("visible", F.col("event_time") < 102).unionByName(held.withColumn("visible", F.lit(False)))
    got = replay.fetch_hot_range(copies, 100, 110, 101)
    assert times(got.confirmed) == [101] and times(got.unconfirmed) == [102]


def test_copies_and_drains(spark):
    log = events(spark, (5, 0, 0), (7, 0, 0), (7, 0, 1), (9, 0, 0))
    assert times(replay.copy_series(log, 5, 7, 1, 100)) == [5, 7] and times(replay.copy_series(log, 5, 7, 1, 100, closing_key=False)) == [5]
    assert times(replay.copy_series(log, 0, 7, 1, 100)) == [] and times(replay.copy_series(log, 1, 4, 4, 100)) == []
    series, rest = replay.drain(log)
    assert [r["event_time"] for r in series.collect()] == [5, 7, 7, 9] and rest.count() == 0


def test_partial_results_are_asked_for_again(spark):
    log, calls = events(spark, (1, 1, 0)), []

    def read(full_at):
        calls.append(1)
        return replay.ReplayResult(log, len(calls) >= full_at)

    assert replay.retried(lambda: read(3)).count() == 1 and len(calls) == 3
    calls.clear()
    with pytest.raises(PartialResult):
        replay.retried(lambda: read(4))


def test_tails_count_an_event_once(spark):
    log = events(spark, (1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 1, 0), (3, 1, 0))
    assert times(tail.evict_to_capacity(log, 2)) == [2, 3] and times(tail.last_n(log, "c", "s", 3)) == [1, 2, 3]
    assert times(tail.scattered_tail([log, None], 2)) == [2, 3]
    from tidelog.errors import EventLogError

    with pytest.raises(EventLogError):
        tail.scattered_tail([None, None], 2)
    with pytest.raises(PartialResult):
        tail.complete_tail(log.limit(1), 2)


def test_watermark_across_buckets(spark):
    """Stretches of small buckets against a plain fold."""
    import random

    r, rows = random.Random(3), []
    for key in range(30):
        at = r.randrange(50)
        for _ in range(r.randrange(1, 40)):
            rows.append((key, at, at + r.choice((0, 1, 3, 9, 25))))
            at += r.choice((0, 1, 2, 3, 12))
    want = {}
    for key, s, e in sorted(rows):
        if e > s:
            w = want.setdefault(key, s)
            want[key] = max(w, e) if s <= w and not want.get((key, "gap")) else w
            if s > w:
                want[key, "gap"] = True
    df = spark.createDataFrame(rows, "k long, start long, end long").repartition(3)
    got = {x["k"]: x["watermark"] for x in windows.contiguous_watermark(df, ["k"], bucket=7).collect()}
    assert got == {k: w for k, w in want.items() if isinstance(k, int)}
