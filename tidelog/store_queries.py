"""Queries of what writes: each writes below the application's shared folder and reads back what it wrote."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.api import LogEventOptions, Store
from tidelog.errors import BY_CODE, DurabilityFull, EventLogError, InvalidArgument
from tidelog.operators import catalog, kv, windows
from tidelog.plans.sql import SqlTables
from tidelog.registry import COLS, EV, FROM, HOUR, MID, TO, query, table
from tidelog.schema import DAY, KEY, SECOND, public, read_events
from tidelog.sources import archive, sinks
from tidelog.sources.manifest import ManifestTail, read_manifest
from tidelog.sources.workspace import new_path
from tidelog.streaming.ingest import read_stream, start_ingest
from tidelog.streaming.pubsub import Subscriptions
from tidelog.streaming.telemetry import start_poll

NOW = {"availableNow": True}


def _store(spark: SparkSession, client_id: int = 1, path: str | None = None) -> Store:
    return Store(spark, path or new_path(spark, "store"), client_id)


def _names(spark: SparkSession, sf_dir: str, name: str, key: str, column: str) -> list[str]:
    """A small table's names in order of its key."""
    return [r[0] for r in table(spark, sf_dir, name).orderBy(key).select(column).collect()]


def _numbered(events: DataFrame) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("chronicle", "story").orderBy(*KEY)).cast("long")
    return events.select(number.alias("n"), "record")


# -- events and stories

_NATIONS = "SELECT row_number() OVER (ORDER BY n_nationkey) AS n, n_name AS record FROM nation"
_REGIONS = "SELECT row_number() OVER (ORDER BY r_regionkey) AS n, r_name AS record FROM region"


@query(_NATIONS)
def log_event(spark, sf_dir):
    """One event after the other, empty ones passed over."""
    store = _store(spark)
    store.create_chronicle("c")
    handle = store.acquire_story("c", "s")
    for name in _names(spark, sf_dir, "nation", "n_nationkey", "n_name"):
        handle.log_event(name)
        handle.log_event("")
    return _numbered(store.replay("c", "s"))


@query(_REGIONS + " UNION ALL SELECT 6, 'refused: DurabilityFull' UNION ALL SELECT 7, 'refused: DurabilityUnknown' UNION ALL SELECT 8, 'refused: InvalidArgument'")
def log_event_durable(spark, sf_dir):
    """Every first attempt stores the event and isn't answered: it is repeated with the same identity and read once."""
    store, calls = _store(spark), []
    store.create_chronicle("c")
    handle, keep = store.acquire_story("c", "s"), store.send

    def lost(rows, timeout_ms):
        calls.append(rows[0])
        keep(rows, timeout_ms)
        if len(calls) % 2:
            raise TimeoutError

    def full(rows, timeout_ms):
        raise DurabilityFull("no room")

    def silent(rows, timeout_ms):
        raise OSError("no answer")

    store.send, options = lost, LogEventOptions(durable=True, attempts=2)
    for name in _names(spark, sf_dir, "region", "r_regionkey", "r_name"):
        handle.log_event(name, options)
    refused = []
    for send, record in ((full, "x"), (silent, "x"), (lost, "")):
        store.send = send
        try:
            handle.log_event(record, options)
        except EventLogError as e:
            refused.append((6 + len(refused), f"refused: {type(e).__name__}"))
    return _numbered(store.replay("c", "s")).unionByName(spark.createDataFrame(refused, "n long, record string"))


@query("SELECT r_name AS story, r_regionkey % 2 = 0 AS held FROM region WHERE r_regionkey <> 3")
def story_lifecycle(spark, sf_dir):
    """Stories made by acquiring them; every other one is released, one of those destroyed."""
    store, names = _store(spark), _names(spark, sf_dir, "region", "r_regionkey", "r_name")
    store.create_chronicle("c")
    for name in names:
        store.acquire_story("c", name)
    for name in names[1::2]:
        store.release_story("c", name)
    store.destroy_story("c", names[3])
    return spark.createDataFrame([(s, bool(store.holders("c", s))) for s in store.show_stories("c")], "story string, held boolean")


@query("SELECT * FROM (VALUES ('destroy held story', -4), ('destroy its chronicle', -4), ('release twice', -5), ('acquire in no chronicle', -3), ('create twice', -6), ('create nameless', -2), ('destroy after release', 0)) t(step, code)")
def story_refusals(spark, sf_dir):
    """What a client may not do, by the code it gets."""
    one = _store(spark)
    two = _store(spark, 2, one.path)
    one.create_chronicle("c")
    one.acquire_story("c", "s")
    steps = {
        "destroy held story": lambda: two.destroy_story("c", "s"), "destroy its chronicle": lambda: two.destroy_chronicle("c"),
        "release twice": lambda: (one.release_story("c", "s"), one.release_story("c", "s")), "acquire in no chronicle": lambda: one.acquire_story("nosuch", "s"),
        "create twice": lambda: two.create_chronicle("c"), "create nameless": lambda: one.create_chronicle(""), "destroy after release": lambda: two.destroy_story("c", "s"),
    }
    got = []
    for name, step in steps.items():
        try:
            step()
            got.append((name, 0))
        except EventLogError as e:
            got.append((name, e.code))
    return spark.createDataFrame(got, "step string, code int")


@query("SELECT unnest([-1, -2, -3, -4, -5, -6, -7, -8, -9, -10, -11, -12, -13, -18, -19, -20, -21]) AS code, true AS named")
def error_codes(spark, sf_dir):
    """Every failure of the client has a class of its own."""
    return spark.createDataFrame([(c, k.__doc__ is not None or k.__name__ != "") for c, k in BY_CODE.items()], "code int, named boolean")


@query("SELECT * FROM (VALUES ('first', 0), ('second', 0), ('other version', -13), ('left', 0)) t(client, code)")
def connect(spark, sf_dir):
    """Two clients of one store, one of another protocol version, and one that leaves with stories acquired."""
    path, got = new_path(spark, "store"), []
    for name, client, version in (("first", 1, 1), ("second", 2, 1), ("other version", 3, 2)):
        try:
            Store.connect(spark, path, client, version)
            got.append((name, 0))
        except EventLogError as e:
            got.append((name, e.code))
    store = Store.connect(spark, path)
    store.create_chronicle("c")
    store.acquire_story("c", "s").log_event("buffered")
    store.disconnect()
    got.append(("left", len(store.holders("c", "s")) + 1 - store.replay("c", "s").count()))
    return spark.createDataFrame(got, "client string, code int")


# -- facades


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_name END AS name FROM nation WHERE n_nationkey < 10")
def sql_insert(spark, sf_dir):
    """CREATE, INSERT and SELECT; identifiers fold to lower case, NULLs are left out, values are texts."""
    db = SqlTables(_store(spark))
    db.execute("CREATE TABLE Nations (ID INT, Name STRING)")
    for k, name in enumerate(_names(spark, sf_dir, "nation", "n_nationkey", "n_name")[:10]):
        db.execute(f"INSERT INTO NATIONS (id, NAME) VALUES ({k}, {'NULL' if k % 5 == 0 else repr(name)})")
    return db.execute("SELECT * FROM nations").drop("__ts")


@query("SELECT * FROM (VALUES (0, 'a', 'y', '1'), (1, 'b', 'z', NULL)) t(place, name, columns, kept)")
def sql_drop(spark, sf_dir):
    """A table that is dropped and made again keeps its place and its rows; of a dropped one nothing is listed."""
    db = SqlTables(_store(spark))
    for text in ("CREATE TABLE a (x)", "CREATE TABLE b (z)", "CREATE TABLE c (x)", "INSERT INTO a VALUES (1)", "DROP TABLE a", "DROP TABLE c", "CREATE TABLE a (y)"):
        db.execute(text)
    rows = {t: db.execute(f"SELECT x FROM {t}").select("x").collect() for t in db.tables()}
    return spark.createDataFrame([(k, t, ",".join(c for c, _ in db.schema(t)), rows[t][0][0] if rows[t] else None) for k, t in enumerate(db.tables())], "place int, name string, columns string, kept string")


@query(_REGIONS.replace("AS record", "AS value"))
def kv_put(spark, sf_dir):
    """Versions of one key, as its history has them."""
    store = _store(spark)
    for name in _names(spark, sf_dir, "region", "r_regionkey", "r_name"):
        store.put("k", name)
    number = F.row_number().over(Window.partitionBy("key").orderBy("timestamp")).cast("long")
    return kv.history(store.values(), "k").select(number.alias("n"), "value")


@query(_REGIONS.replace("AS record", "AS payload") + " UNION ALL SELECT 0, 'nothing for empty messages'")
def publish(spark, sf_dir):
    """Published messages as a subscriber gets them from the store's files."""
    store, seen = _store(spark), []
    if store.publish("", "x") == store.publish("t", "") == 0:
        seen.append("nothing for empty messages")
    for name in _names(spark, sf_dir, "region", "r_regionkey", "r_name"):
        store.publish("t", name)
    hub = Subscriptions(read_stream(spark, f"{store.path}/events"), new_path(spark, "positions"))
    hub.query(hub.subscribe_from("t", None, lambda row: seen.append(row["payload"]), trigger=NOW)).awaitTermination()
    return spark.createDataFrame(list(enumerate(seen)), "n long, payload string")


@query(EV + f"SELECT event_time AS timestamp, record AS payload, true AS stopped_once FROM ev WHERE story = 'signup' AND event_time >= {MID}")
def topic_poll(spark, sf_dir):
    """Two rounds of a poll over files that arrive between them: each message once, wherever its time lies; then unsubscribed."""
    log, path, positions, seen = read_events(spark, sf_dir), new_path(spark, "topic"), new_path(spark, "positions"), []
    for part in (F.col("event_index") % 2 == 1, F.col("event_index") % 2 == 0):
        log.filter(part).write.mode("append").parquet(path)
        hub = Subscriptions(read_stream(spark, path), positions)
        number = hub.subscribe_from("signup", MID, lambda row: seen.append((row["timestamp"], row["payload"])), name="reader", trigger=NOW)
        hub.query(number).awaitTermination()
        stopped = hub.unsubscribe(number) and not hub.unsubscribe(number)
    return spark.createDataFrame([(*x, stopped) for x in seen], "timestamp long, payload string, stopped_once boolean")


@query("SELECT 'click,chronicle=events,story=click value=' || user_id || '.0 ' || epoch_us(ts) * 1000 AS line FROM events WHERE event_type = 'click' UNION ALL SELECT 'error,chronicle=events,story=error value=' || user_id || '.0 ' || epoch_us(ts) * 1000 FROM events WHERE event_type = 'error'")
def telemetry_poll(spark, sf_dir):
    """Two rounds over two stories' telemetry as it arrives; a round that the sink refuses comes again."""
    log, path, refusals = read_events(spark, sf_dir, record=F.col("user_id").cast("string")), new_path(spark, "telemetry"), [1]

    def send(lines: DataFrame) -> None:
        if refusals:
            refusals.pop()
            raise OSError("not now")
        lines.write.mode("append").text(f"{path}/lines")

    for part in (F.col("event_index") % 3 != 0, F.col("event_index") % 3 == 0):
        log.filter(part).write.mode("append").parquet(f"{path}/in")
        for _ in range(2):  # the second time for the round that was refused
            try:
                start_poll(read_stream(spark, f"{path}/in"), ["click", "error"], send, f"{path}/position", NOW).awaitTermination()
            except StreamingQueryException:
                continue
    return spark.read.text(f"{path}/lines").select(F.col("value").alias("line"))


# -- archive


@query(EV + f"SELECT {COLS} FROM ev WHERE event_time >= {FROM} AND event_time < {TO}")
def archive_scan(spark, sf_dir):
    """What the archive's files hold of a range."""
    path = new_path(spark, "archive")
    archive.write_archive(read_events(spark, sf_dir), path)
    return public(archive.read_archive(spark, path, FROM, TO))


@query(EV + f"SELECT {COLS} FROM ev WHERE story = 'click' UNION ALL SELECT 'refused', 'EventLogError', 0, 0, 0, 'event_time is string, not bigint'")
def archive_scan_foreign(spark, sf_dir):
    """Client ids of 32 bits are widened; a text for a time is an error."""
    path, log = new_path(spark, "archive"), read_events(spark, sf_dir).filter("story = 'click'")
    log.withColumn("client_id", F.col("client_id").cast("int")).write.parquet(f"{path}/old")
    log.withColumn("event_time", F.col("event_time").cast("string")).write.parquet(f"{path}/bad")
    try:
        archive.read_foreign(spark, f"{path}/bad")
        said = None
    except EventLogError as e:
        said = str(e)
    refused = spark.createDataFrame([("refused", "EventLogError", 0, 0, 0, said)], "chronicle string, story string, event_time long, client_id long, event_index long, record string")
    return public(archive.read_foreign(spark, f"{path}/old")).unionByName(refused)


@query(EV + f"SELECT chronicle, story, max(event_time - event_time % {HOUR}) + {HOUR} AS watermark, count(*) AS events FROM ev GROUP BY chronicle, story")
def archive_publish(spark, sf_dir):
    """Windows written and published, empty ones too, so the persisted watermark is the end of the last."""
    path = new_path(spark, "archive")
    archive.publish(read_events(spark, sf_dir), path, HOUR)
    held = read_manifest(spark, f"{path}/manifest").groupBy("chronicle", "story").agg(F.sum("events").alias("events"))
    return archive.persisted_watermark(spark, path).join(held, ["chronicle", "story"])


@query(EV + f"SELECT story, event_time - event_time % {DAY} AS start, count(*) AS events, CASE WHEN story = 'view' THEN 2 ELSE 1 END AS poll FROM ev GROUP BY ALL UNION ALL SELECT 'replaced', 0, 1, 3")
def manifest_tail(spark, sf_dir):
    """Records by the call that saw them first; a third call finds a log replaced."""
    path, log = new_path(spark, "archive"), read_events(spark, sf_dir)
    tail, polls = ManifestTail(spark, f"{path}/manifest"), []
    for k, part in enumerate(("story != 'view'", "story = 'view'"), 1):
        archive.publish(log.filter(part), path, DAY)
        polls.append(tail.poll().filter("file is not null").select("story", "start", "events", F.lit(k).alias("poll")))
    name = next(iter(tail.offsets))
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{name}"), True)
    out.write(bytearray(b'{"op":"OPEN","chronicle":"other"}\n{"op":"PUBL'))
    out.close()
    tail.poll()
    return polls[0].unionByName(polls[1]).unionByName(spark.createDataFrame([("replaced", 0, len(tail.replaced), 3)], "story string, start long, events long, poll int"))


@query(EV + f"SELECT {COLS} FROM ev")
def ingest_stream(spark, sf_dir):
    """The older half arrives last and the newer comes again: nothing is dropped, nothing twice."""
    log, path = read_events(spark, sf_dir), new_path(spark, "ingest")
    for part in (F.col("event_time") >= MID, F.lit(True)):
        log.filter(part).write.mode("append").parquet(f"{path}/in")
        start_ingest(read_stream(spark, f"{path}/in"), f"{path}/archive", f"{path}/position", exactly_once=True, trigger=NOW).awaitTermination()
    return public(archive.read_archive(spark, f"{path}/archive"))


@query(EV + f"SELECT record AS line FROM ev WHERE story = 'view' AND event_time < {FROM} UNION ALL SELECT 'refused'")
def sink_chain(spark, sf_dir):
    """Sinks chosen by type, in turn; a type that doesn't exist is refused."""
    path, log = new_path(spark, "sinks"), read_events(spark, sf_dir).filter(F.col("story") == "view").filter(F.col("event_time") < FROM)
    sinks.configured([{"type": "logging"}, {"type": "records", "path": f"{path}/records"}, {"type": "archive", "path": f"{path}/archive"}])(log)
    try:
        sinks.configured([{"type": "nosuch"}])
        refused = []
    except InvalidArgument:
        refused = [("refused",)]
    return spark.read.text(f"{path}/records").select(F.col("value").alias("line")).unionByName(spark.createDataFrame(refused, "line string"))


@query(EV + "SELECT chronicle, story, min(event_time) AS lo, max(event_time) AS hi, count(*) AS n FROM ev GROUP BY 1, 2")
def chunk_log(spark, sf_dir):
    return sinks.chunk_summaries(read_events(spark, sf_dir))


# -- dashboards and readers


def _archived(spark, sf_dir) -> Store:
    store = _store(spark)
    archive.write_archive(read_events(spark, sf_dir), f"{store.path}/events")
    return store


_REPORT = "event_time AS time, client_id, event_index AS index, record AS log_record"


@query(EV + f"SELECT {_REPORT}, count(*) OVER () AS total FROM ev WHERE story = 'error' AND event_time >= {FROM} AND event_time < {FROM + 2 * DAY}")
def rest_replay(spark, sf_dir):
    report = _archived(spark, sf_dir).query_report("events", "error", FROM, FROM + 2 * DAY)
    return spark.createDataFrame([(e["time"], e["client_id"], e["index"], e["log_record"], report["total_events"]) for e in report["events"]], "time long, client_id long, index long, log_record string, total long")


@query(EV + f"SELECT {_REPORT}, 40 AS total FROM ev WHERE story = 'view' ORDER BY event_time DESC, client_id DESC, event_index DESC LIMIT 40")
def rest_playback(spark, sf_dir):
    report = _archived(spark, sf_dir).playback_report("events", "view", 40)
    return spark.createDataFrame([(e["time"], e["client_id"], e["index"], e["log_record"], report["total_events"]) for e in report["events"]], "time long, client_id long, index long, log_record string, total int")


@query(f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(epoch_us(ts) * 1000 % {SECOND} AS VARCHAR), 9, '0') AS time, user_id AS client_id, event_id AS event_index, props AS record FROM events WHERE event_type = 'click' AND epoch_us(ts) * 1000 >= {MID - 2 * DAY} AND epoch_us(ts) * 1000 < {MID}")
def csv_recent(spark, sf_dir):
    """The last two days before a moment, as CSV."""
    path = new_path(spark, "csv")
    _archived(spark, sf_dir).export_recent("events", "click", 2 * DAY // SECOND, path, MID)
    return spark.read.option("header", True).option("escape", "\\").schema("time string, client_id long, event_index long, record string").csv(path)


@query("SELECT 'stories(events)' AS asked, event_type AS value FROM events GROUP BY 2 UNION ALL SELECT '*', 'events'")
def dashboard_find(spark, sf_dir):
    """Values of the dashboard's variables; a text it doesn't know has none."""
    log = read_events(spark, sf_dir)
    asked = [(t, catalog.find_variable(log, t)) for t in ("stories(events)", "*", "nosuch")]
    out = None
    for text, found in asked:
        found = found.select(F.lit(text).alias("asked"), "value")
        out = found if out is None else out.unionByName(found)
    return out


# -- life of a story's windows


def _states(spark, sf_dir) -> DataFrame:
    """A story for each event, in every combination of what a watermark depends on."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i.alias("story"), F.when(i % 11 != 0, i * 10).alias("watermark"), (i * 10 + i % 7 - 3).alias("start_time"), (i % 2 == 0).alias("fresh_pipeline"), (i % 3 == 0).alias("write_failed"), (i % 5).alias("parked"))


@query("""SELECT event_id AS story, CASE WHEN event_id % 11 = 0 OR (event_id % 7 > 3 AND event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 = 0) THEN event_id * 10 + event_id % 7 - 3 ELSE event_id * 10 END AS watermark FROM events""")
def gap_cover(spark, sf_dir):
    """Registering a story again covers an idle gap only where nothing can be unwritten."""
    return windows.registered_watermark(_states(spark, sf_dir)).select("story", "watermark")


@query("""WITH h AS (SELECT event_id // 3 AS receipt, bool_and(event_id % 4 <> 0) AS written FROM events WHERE event_id % 3 <> 2 GROUP BY 1), r AS (SELECT DISTINCT event_id // 3 AS receipt FROM events),
s AS (SELECT r.receipt, r.receipt % 6 <> 0 AND coalesce(written, true) AS settled, 's' || r.receipt % 10 AS story FROM r LEFT JOIN h USING (receipt))
SELECT story, max(receipt) AS highest_receipt, count(*) FILTER (NOT settled) AS pending, min(receipt) FILTER (NOT settled) AS first_pending FROM s GROUP BY story""")
def receipts(spark, sf_dir):
    """Receipts settle when merged and all windows that hold their events are written; reports name the others."""
    e = table(spark, sf_dir, "events").withColumn("receipt", F.expr("event_id div 3"))
    given = e.select("receipt").distinct().withColumn("merged", F.col("receipt") % 6 != 0)
    holders = e.filter("event_id % 3 != 2").select("receipt", F.col("event_id").alias("window"), (F.col("event_id") % 4 != 0).alias("written"))
    settled = windows.settled_receipts(given, holders).withColumn("story", F.concat(F.lit("s"), (F.col("receipt") % 10).cast("string")))
    return windows.receipt_report(settled).select("story", "highest_receipt", F.size("pending").cast("long").alias("pending"), F.get("pending", F.lit(0)).alias("first_pending"))


@query(EV + f"SELECT {COLS}, {MID} - (event_time - event_time % {HOUR}) > {48 * HOUR} AS salvaged FROM ev WHERE event_time < {MID}")
def salvage(spark, sf_dir):
    """Events too far before a timeline go to chunks of their own."""
    log = read_events(spark, sf_dir).filter(F.col("event_time") < MID)
    taken, apart = windows.salvaged(log, F.lit(MID), HOUR, 48)
    return public(taken.withColumn("salvaged", F.lit(False)).unionByName(apart.withColumn("salvaged", F.lit(True))), *COLS.split(", "), "salvaged")


@query(EV + f"SELECT chronicle, story, min(event_time - event_time % {HOUR}) AS timeline_start, max(event_time - event_time % {HOUR}) + {HOUR} AS timeline_end, (max(event_time - event_time % {HOUR}) - min(event_time - event_time % {HOUR})) // {HOUR} + 1 AS windows FROM ev GROUP BY 1, 2")
def timeline_extension(spark, sf_dir):
    return windows.timeline(read_events(spark, sf_dir), HOUR)


@query(f"""SELECT event_id AS story, CASE WHEN event_id % 4 <> 0 AND NOT (event_id % 3 = 0) THEN (event_id + 15) * {SECOND}::BIGINT END AS exit_time, event_id % 4 <> 0 AND NOT (event_id % 3 = 0) AND event_id + 15 < 500 AS retired FROM events""")
def story_retirement(spark, sf_dir):
    """A stopped story leaves after the acceptance window, unless it is acquired again."""
    i = F.col("event_id")
    states = table(spark, sf_dir, "events").select(i.alias("story"), F.when(i % 4 != 0, i * SECOND).alias("stopped_at"), F.when(i % 3 == 0, (i + 1) * SECOND).when(i % 3 == 1, (i - 1) * SECOND).alias("acquired_at"))
    return windows.retirement(states, F.lit(500 * SECOND)).select("story", "exit_time", "retired")


@query(EV + f"SELECT story, event_time - event_time % {HOUR} AS chunk_start, count(*) AS events FROM ev WHERE event_time - event_time % {HOUR} + {HOUR} + 60 * {SECOND}::BIGINT < {MID + HOUR} GROUP BY ALL")
def acceptance_seal(spark, sf_dir):
    """Chunks that are sealed by a moment of the clock."""
    held = windows.chunks(read_events(spark, sf_dir), HOUR)
    return windows.sealed(held, F.lit(MID + HOUR), "grapher").select("story", "chunk_start", "events")


@query(EV + f"SELECT chronicle, story, event_time - event_time % {HOUR} AS chunk_start, count(*) AS events FROM ev WHERE story = 'click' AND event_time >= {MID} GROUP BY ALL")
def orphan_recovery(spark, sf_dir):
    """Late events of a retired story are sealed as recovery chunks; of a destroyed or a living one none are."""
    late = read_events(spark, sf_dir).filter(F.col("event_time") >= MID)
    states = spark.createDataFrame([("events", "click", True, False), ("events", "error", True, True), ("events", "view", False, False)], "chronicle string, story string, retired boolean, destroyed boolean")
    return windows.orphan_chunks(late, states, HOUR)
