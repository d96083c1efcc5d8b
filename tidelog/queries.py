"""One query for each operator, with the same in DuckDB's SQL.

The test table ``events`` stands in for an event log: its types are stories,
users clients, ids indexes and props records.  Its times are unique, so queries
about ties and duplicates make them: by overlapping slices, or by cutting times
to the day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import ids, records, telemetry
from tidelog.operators import analytics, catalog, kv, replay, tail, windows
from tidelog.plans import sql
from tidelog.plans.statements import parse
from tidelog.registry import COLS, EV, FROM, HOUR, MID, ORACLE_SQL, QUERIES, TO, query, table  # noqa: F401
from tidelog.schema import DAY, KEY, public, read_events
from tidelog.streaming.pubsub import messages

# -- replay


@query(EV + f"SELECT {COLS} FROM ev WHERE story = 'purchase' AND event_time >= {FROM} AND event_time < {TO}")
def replay_range(spark, sf_dir):
    return public(replay.replay(read_events(spark, sf_dir), "events", "purchase", FROM, TO))


@query(EV + f"SELECT DISTINCT {COLS} FROM (SELECT * FROM ev WHERE event_time < {TO} UNION ALL SELECT * FROM ev WHERE event_time >= {FROM})")
def replay_merge(spark, sf_dir):
    log = read_events(spark, sf_dir)
    return public(replay.merge(log.filter(replay.in_range(None, TO)), log.filter(replay.in_range(FROM, None))))


_DAYS = "SELECT 'events' AS chronicle, event_type AS story, epoch_us(ts) * 1000 - (epoch_us(ts) * 1000) % 86400000000000 AS event_time, user_id % 10 AS client_id, 0 AS event_index, props AS record, event_id AS arrival_seq FROM events"


def _coarse(spark, sf_dir) -> DataFrame:
    """Events with times cut to the day and ten clients: many share an identity; ``arrival_seq`` orders them."""
    log = read_events(spark, sf_dir).withColumn("arrival_seq", F.col("event_index"))
    return log.withColumn("event_time", windows.chunk_start(F.col("event_time"), DAY)).withColumn("client_id", (F.col("client_id") % 10).cast("decimal(20,0)")).withColumn("event_index", F.lit(0).cast("long"))


@query(f"WITH d AS ({_DAYS}) SELECT {COLS}, arrival_seq FROM d QUALIFY row_number() OVER (PARTITION BY chronicle, story, event_time, client_id, event_index ORDER BY arrival_seq) = 1")
def dedup_first_wins(spark, sf_dir):
    return public(replay.first_arrival(_coarse(spark, sf_dir)), "chronicle", "story", *KEY, "record", "arrival_seq")


@query(f"WITH ev AS (SELECT 'events' AS chronicle, event_type AS story, epoch_us(ts) * 1000 AS event_time, user_id AS client_id, event_id AS event_index, CASE WHEN event_id % 7 = 0 THEN '' ELSE props END AS record FROM events) SELECT {COLS} FROM ev WHERE story = 'click' AND event_time >= {FROM} AND event_time < {TO} AND length(record) > 0")
def ingest_validate(spark, sf_dir):
    log = read_events(spark, sf_dir, record=F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("props")))
    return public(replay.ingestible(log, "click", FROM, TO))


@query(EV + f"SELECT {COLS} FROM ev WHERE event_time < {MID}")
def chunk_merge(spark, sf_dir):
    """A chunk of every other event takes the whole log's events of its window."""
    log = read_events(spark, sf_dir)
    merged, _ = replay.chunk_merge(log.filter((F.col("event_time") % 2 == 0) & replay.in_range(None, TO)), log, 0, MID)
    return public(merged)


@query(f"""WITH d AS ({_DAYS}), a AS (SELECT *, 0 AS tier FROM d WHERE story <> 'view' UNION ALL SELECT * REPLACE ('late ' || record AS record), 1 AS tier FROM d WHERE event_time < {MID})
SELECT {COLS} FROM a QUALIFY row_number() OVER (PARTITION BY story, event_time, client_id, event_index ORDER BY tier, arrival_seq) = 1""")
def chunk_merge_duplicates(spark, sf_dir):
    """Both sides hold many copies of an identity, with different records: the chunk's first arrival stays, else the other's."""
    log = _coarse(spark, sf_dir)
    other = log.withColumn("record", F.concat(F.lit("late "), "record"))
    return public(replay.chunk_merge(log.filter("story != 'view'"), other, 0, MID)[0])


@query(f"WITH d AS ({_DAYS}) SELECT {COLS} FROM d QUALIFY row_number() OVER (PARTITION BY story, event_time, client_id, event_index ORDER BY event_time < {MID} DESC, arrival_seq) = 1")
def merge_first_tier(spark, sf_dir):
    """Tiers whose copies differ: the first tier's first arrival stays."""
    log = _coarse(spark, sf_dir)
    return public(replay.merge(log.filter(replay.in_range(None, MID, False)), log))


@query(EV + f"SELECT {COLS} FROM ev WHERE event_time >= {FROM} AND event_time < {TO}")
def copy_series(spark, sf_dir):
    return public(replay.copy_series(read_events(spark, sf_dir), FROM, TO, FROM - DAY, MID))


@query("WITH e AS (SELECT event_id AS event_time, 0 AS client_id, 0 AS event_index FROM events) SELECT * FROM e WHERE event_time >= 200 AND event_time <= 400")
def copy_series_closing_key(spark, sf_dir):
    zero = F.lit(0).cast("long")
    log = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_time"), zero.alias("client_id"), zero.alias("event_index"))
    return replay.copy_series(log, 200, 400, 1, 10**9)


@query(EV + f", n AS (SELECT row_number() OVER (ORDER BY event_time, client_id, event_index) AS n, event_time, record FROM ev WHERE story = 'error' AND event_time < {FROM}) SELECT n, event_time, record, 0 AS left_over FROM n")
def drain_series(spark, sf_dir):
    """A chunk's events numbered in order of the key, and what is left in it."""
    series, rest = replay.drain(read_events(spark, sf_dir).filter((F.col("story") == "error") & replay.in_range(None, FROM)))
    number = F.row_number().over(Window.partitionBy("story").orderBy(*KEY)).cast("long")
    return series.select(number.alias("n"), "event_time", "record", F.lit(rest.count()).alias("left_over"))


@query("WITH e AS (SELECT event_id AS event_time, 0 AS client_id, 0 AS event_index FROM events) SELECT * FROM e WHERE NOT (event_time >= 200 AND event_time <= 400)")
def erase_range(spark, sf_dir):
    zero = F.lit(0).cast("long")
    log = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("event_time"), zero.alias("client_id"), zero.alias("event_index"))
    return replay.erase(log, 200, 400)


_TIER = "SELECT chronicle, story, event_time, client_id, event_index, '{0} ' || record AS record FROM ev "


def _tier(log: DataFrame, name: str) -> DataFrame:
    return log.withColumn("record", F.concat(F.lit(f"{name} "), "record"))


@query(EV + _TIER.format("archive") + f"WHERE event_time >= {FROM} AND event_time < {FROM + 3 * DAY} UNION ALL " + _TIER.format("hot") + f"WHERE event_time >= {FROM + 3 * DAY} AND event_time < {TO}")
def hot_range_split(spark, sf_dir):
    """Archive below the highest watermark known, hot from there; a watermark of 0 is none.  Records tell the tiers apart."""
    log = read_events(spark, sf_dir)
    recorders = spark.createDataFrame([(FROM + 2 * DAY, FROM), (0, FROM - DAY), (FROM + 3 * DAY, FROM + DAY), (None, None)], "known_w long, hot_floor long")
    return public(replay.scalar_split(_tier(log, "hot"), _tier(log, "archive"), recorders, FROM, TO))


@query(EV + _TIER.format("archive") + f"WHERE event_time >= {FROM} AND event_time < {FROM + 2 * DAY} UNION ALL " + _TIER.format("hot") + f"WHERE event_time >= {FROM + 2 * DAY} AND event_time < {TO}")
def hot_range_split_by_floor(spark, sf_dir):
    """No recorder knows a watermark: the lowest floor divides."""
    log = read_events(spark, sf_dir)
    recorders = spark.createDataFrame([(0, FROM + 4 * DAY), (0, FROM + 2 * DAY)], "known_w long, hot_floor long")
    return public(replay.scalar_split(_tier(log, "hot"), _tier(log, "archive"), recorders, FROM, TO))


@query(EV + f""", p AS (
  SELECT *, 'archive ' || record AS said, 0 AS tier FROM ev WHERE event_time >= {FROM} AND event_time < {FROM + 3 * DAY} AND event_index % 4 <> 0
  UNION ALL SELECT *, 'unconfirmed ' || record, 1 FROM ev WHERE event_time >= {FROM + DAY} AND event_time < {TO} AND event_time // 1000 % 3 = 1 AND event_index % 2 = 0
  UNION ALL SELECT *, 'hot ' || record, 2 FROM ev WHERE event_time >= {FROM + 3 * DAY} AND event_time < {TO}
) SELECT chronicle, story, event_time, client_id, event_index, said AS record FROM p QUALIFY row_number() OVER (PARTITION BY story, event_time, client_id, event_index ORDER BY tier) = 1""")
def replay_plan(spark, sf_dir):
    """Three recorders that know different watermarks, one with unconfirmed events; the archive fills in below the highest and lacks a quarter."""
    log, micros = read_events(spark, sf_dir), F.expr("event_time div 1000")
    held = [_tier(log, "hot").filter((micros % 3 == k) & replay.in_range(FROM + DAY, None)) for k in range(3)]
    unsure = _tier(log, "unconfirmed").filter((micros % 3 == 1) & (F.col("event_index") % 2 == 0) & replay.in_range(FROM + DAY, TO))
    responses = [replay.HotResponse(h, unsure if k == 1 else None, FROM + DAY, FROM + (k + 1) * DAY) for k, h in enumerate(held)]
    archive = _tier(log, "archive").filter(F.col("event_index") % 4 != 0)
    return public(replay.planned_replay(archive, responses, FROM, TO).require())


@query(EV + f"""SELECT 'plan ' || k AS step, read_archive, archive_end, complete FROM (VALUES
  (0, true, {FROM + DAY}, true), (1, true, {TO}, false), (2, true, {FROM + DAY}, false), (3, false, {FROM}, true), (4, true, {TO}, true)) t(k, read_archive, archive_end, complete)""")
def replay_plan_rules(spark, sf_dir):
    """What is read, up to where, and whether the reply is complete: as usual, a recorder missing, one cut short, all hot, nothing hot."""
    held = read_events(spark, sf_dir).limit(0)
    split = lambda w, floor=None: replay.split_hot_range([replay.HotResponse(held, None, floor, w)], FROM, TO)
    plans = [
        replay.plan_replay(split(FROM + DAY), FROM, TO), replay.plan_replay(split(FROM + DAY), FROM, TO, missing=1), replay.plan_replay(split(FROM + DAY), FROM, TO, truncated=True),
        replay.plan_replay(split(0, FROM), FROM, TO), replay.plan_replay(split(0), FROM, TO),
    ]
    return spark.createDataFrame([(f"plan {k}", p.read_archive, p.archive_end, p.complete) for k, p in enumerate(plans)], "step string, read_archive boolean, archive_end long, complete boolean")


@query(EV + f""", c AS (SELECT *, max(event_index % 3 = 0) OVER () AS x, event_index % 3 = 0 AS visible FROM ev WHERE event_time >= {FROM} AND event_time < {TO})
SELECT event_time, client_id, event_index, visible AS confirmed, (SELECT min(event_time) FROM ev) AS hot_floor, {FROM + DAY} AS known_w, false AS truncated FROM c WHERE NOT visible OR event_time >= {FROM + DAY}""")
def hot_range_answer(spark, sf_dir):
    """A recorder's answer: confirmed and unconfirmed events, floor, watermark; copies in two chunks, one of them visible."""
    log = read_events(spark, sf_dir)
    chunks = log.withColumn("visible", F.col("event_index") % 3 == 0).unionByName(log.withColumn("visible", F.lit(False)))
    got = replay.fetch_hot_range(chunks, FROM, TO, FROM + DAY)
    both = got.confirmed.withColumn("confirmed", F.lit(True)).unionByName(got.unconfirmed.withColumn("confirmed", F.lit(False)))
    return public(both.withColumns({"hot_floor": F.lit(got.hot_floor), "known_w": F.lit(got.known_w), "truncated": F.lit(got.truncated)}), *KEY, "confirmed", "hot_floor", "known_w", "truncated")


@query(EV + f"SELECT event_time, record FROM ev WHERE story = 'error' AND event_time >= {FROM} AND event_time < {FROM + DAY}")
def retry_partial(spark, sf_dir):
    """A reader that comes back short twice and then in full."""
    log, calls = read_events(spark, sf_dir), []

    def read() -> replay.ReplayResult:
        calls.append(1)
        rows = replay.replay(log, "events", "error", FROM, FROM + DAY)
        return replay.ReplayResult(rows if len(calls) > 2 else rows.limit(1), len(calls) > 2)

    return replay.retried(read).select("event_time", "record")


@query(EV + f"SELECT event_time, record, count(*) FILTER (event_index % 50 = 0) OVER () AS failed FROM ev WHERE story = 'error' AND event_time >= {FROM} AND event_time < {FROM + 2 * DAY}")
def replay_callback(spark, sf_dir):
    """Events handed to a callback one by one; those it raises at are counted and the replay goes on."""
    seen: list[tuple[int, str]] = []

    def callback(row):
        seen.append((row["event_time"], row["record"]))
        if row["event_index"] % 50 == 0:
            raise RuntimeError("a subscriber's own fault")

    failed = replay.replay_each(read_events(spark, sf_dir), "events", "error", FROM, FROM + 2 * DAY, callback)
    return spark.createDataFrame([(*x, failed) for x in seen], "event_time long, record string, failed long")


@query(EV + f"SELECT {COLS} FROM ev WHERE story = 'view' AND event_time >= {FROM + DAY} AND event_time < {TO} ORDER BY event_time LIMIT 100")
def hot_fetch(spark, sf_dir):
    log = read_events(spark, sf_dir).filter("story = 'view'")
    return public(replay.hot_fetch(log, FROM, TO, FROM + DAY, 100)[0])


# -- tail


@query(EV + f"SELECT {COLS} FROM ev WHERE story = 'click' ORDER BY event_time DESC, client_id DESC, event_index DESC LIMIT 100")
def tail_last_n(spark, sf_dir):
    return public(tail.last_n(read_events(spark, sf_dir), "events", "click", 100))


_TAIL = "QUALIFY row_number() OVER (PARTITION BY story ORDER BY event_time DESC, client_id DESC, event_index DESC) <= "


@query(EV + f"SELECT {COLS} FROM ev {_TAIL} 5")
def tail_per_story(spark, sf_dir):
    return public(tail.last_n_per_story(read_events(spark, sf_dir), 5))


@query(EV + f"SELECT {COLS} FROM ev {_TAIL} 1000")
def tail_capacity_evict(spark, sf_dir):
    """A twice delivered event takes one place."""
    log = read_events(spark, sf_dir)
    return public(tail.evict_to_capacity(log.unionByName(log.filter(replay.in_range(FROM, None))), 1000))


@query(EV + f"SELECT {COLS} FROM ev WHERE story = 'view' ORDER BY event_time DESC, client_id DESC, event_index DESC LIMIT 70")
def tail_scatter_gather(spark, sf_dir):
    """Three recorders with overlapping shares of a story, one of which doesn't answer."""
    log = read_events(spark, sf_dir).filter("story = 'view'")
    shares = [log.filter(F.col("event_index") % 3 != k) for k in range(2)]
    return public(tail.complete_tail(tail.scattered_tail([shares[0], None, shares[1]], 70), 70))


@query(EV + f"SELECT {COLS} FROM ev WHERE story = 'view' ORDER BY event_time DESC, client_id DESC, event_index DESC LIMIT 50")
def live_tail_union(spark, sf_dir):
    log = read_events(spark, sf_dir)
    return public(tail.live_tail(log.filter(replay.in_range(None, MID)), log.filter(replay.in_range(TO, None)), "events", "view", 50))


@query(EV + f"SELECT {COLS} FROM ev WHERE story IN ('click', 'error')")
def fetch_by_sequence(spark, sf_dir):
    """All keys of two stories, and as many that name no event."""
    log = read_events(spark, sf_dir)
    keys = log.filter("story in ('click', 'error')").select("chronicle", "story", *KEY)
    missing = keys.withColumn("event_time", F.col("event_time") + 1)
    return public(tail.fetch(log, keys.unionByName(missing)))


# -- versioned values

def _kv(spark, sf_dir) -> DataFrame:
    return kv.versions(read_events(spark, sf_dir, record=F.rint("value").cast("long")))


_KVR = "WITH kv AS (SELECT event_type AS key, epoch_us(ts) * 1000 AS timestamp, CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR) AS value, user_id AS client_id, event_id AS event_index FROM events) "


@query(_KVR + "SELECT coalesce(arg_min(value, event_index), '') AS value FROM kv WHERE key = 'view' AND timestamp = (SELECT min(timestamp) FROM kv WHERE key = 'view')")
def kv_get(spark, sf_dir):
    values = _kv(spark, sf_dir)
    first = values.filter("key = 'view'").agg(F.min("timestamp")).head()[0]
    return kv.get(values, "view", first)


@query(_KVR + "SELECT * FROM kv WHERE key = 'signup'")
def kv_history(spark, sf_dir):
    return public(kv.history(_kv(spark, sf_dir), "signup"), "key", "timestamp", "value", "client_id", "event_index")


@query(_KVR + f"SELECT * FROM kv WHERE key = 'signup' AND timestamp >= {FROM} AND timestamp < {TO}")
def kv_range(spark, sf_dir):
    return public(kv.value_range(_kv(spark, sf_dir), "signup", FROM, TO), "key", "timestamp", "value", "client_id", "event_index")


@query(_KVR + "SELECT key, min(timestamp) AS timestamp, arg_min(value, timestamp) AS value FROM kv GROUP BY key")
def kv_earliest(spark, sf_dir):
    return kv.earliest(_kv(spark, sf_dir))


@query(f"WITH d AS ({_DAYS}) SELECT story AS key, event_time AS timestamp, arg_min(CAST(arrival_seq AS VARCHAR), client_id * 100000000 + arrival_seq) AS value FROM d WHERE (story, event_time) IN (SELECT (story, max(event_time)) FROM d GROUP BY story) GROUP BY 1, 2")
def kv_latest(spark, sf_dir):
    """Many versions share the newest time here: the first of them by client and index counts."""
    log = _coarse(spark, sf_dir).withColumn("event_index", F.col("arrival_seq"))
    return kv.latest(kv.versions(log, F.col("arrival_seq").cast("string")))


# -- SQL facade

_TABLE = "SELECT epoch_us(ts) * 1000 AS __ts, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'click' "


def _sql(spark, sf_dir, text: str) -> DataFrame:
    s = parse(text)
    log = read_events(spark, sf_dir)
    return sql.select(log.filter(F.col("story") == s.table), ["k"], s)


@query(_TABLE)
def sql_select_all(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT * FROM click")


@query("SELECT epoch_us(ts) * 1000 AS __ts, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS nosuch FROM events WHERE event_type = 'click'")
def sql_project(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT k, nosuch FROM click")


@query(_TABLE + "AND json_extract_string(props, '$.k') = '7'")
def sql_where_eq(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT * FROM click WHERE k = 7")


@query("SELECT epoch_us(ts) * 1000 AS __ts, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.region') IS NULL")
def sql_where_eq_null(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT * FROM click WHERE region = NULL")


@query(_TABLE + f"AND epoch_us(ts) * 1000 BETWEEN {FROM} AND {TO}")
def sql_ts_between(spark, sf_dir):
    return _sql(spark, sf_dir, f"SELECT * FROM click WHERE __ts BETWEEN {FROM} AND {TO};")


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, 'n', 'null' FROM events WHERE event_id % 2 = 0")
def row_codec(spark, sf_dir):
    """Members of JSON objects as texts; JSON null is the text "null", what is no object has no rows."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "n": null}'))).otherwise(F.col("props")).alias("record"))
    junk = rows.limit(5).withColumn("record", F.lit("[1, 2]")).unionByName(rows.limit(5).withColumn("record", F.lit("{oops")))
    return records.decode_row(rows.unionByName(junk), keep=("event_id",))


@query("""WITH ops AS (SELECT event_id AS seq, CASE WHEN event_id % 13 = 5 THEN 'drop_table' ELSE 'create_table' END AS op, 't' || (event_id % 20) AS name FROM events WHERE event_id % 17 <> 3),
d AS (SELECT name, max(seq) FILTER (op = 'drop_table') AS dropped, min(seq) FILTER (op = 'create_table') AS position FROM ops GROUP BY name)
SELECT ops.name, d.position FROM ops JOIN d USING (name) WHERE op = 'create_table' AND (dropped IS NULL OR seq > dropped) GROUP BY 1, 2""")
def catalog_fold(spark, sf_dir):
    op = F.when(F.col("event_id") % 13 == 5, "drop_table").otherwise("create_table")
    made = F.to_json(F.struct(op.alias("op"), F.concat(F.lit("t"), (F.col("event_id") % 20).cast("string")).alias("name")))
    ops = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 17 == 3, "not json").otherwise(made).alias("record"))
    return catalog.fold_tables(ops).select("name", "position")


# -- windows

_CHUNKS = f"SELECT chronicle, story, event_time - event_time % {HOUR} AS chunk_start, event_time - event_time % {HOUR} + {HOUR} AS chunk_end, count(*) AS events FROM ev GROUP BY ALL"


@query(EV + _CHUNKS)
def chunk_tumbling(spark, sf_dir):
    return windows.chunks(read_events(spark, sf_dir), HOUR)


@query(EV + f", c AS ({_CHUNKS}), s AS (SELECT chronicle, story, unnest(generate_series(min(chunk_start), max(chunk_start), {HOUR})) AS chunk_start FROM c GROUP BY 1, 2) SELECT s.chronicle, s.story, s.chunk_start, s.chunk_start + {HOUR} AS chunk_end, coalesce(c.events, 0) AS events FROM s LEFT JOIN c USING (chronicle, story, chunk_start)")
def gap_fill(spark, sf_dir):
    return windows.gap_filled(read_events(spark, sf_dir), HOUR)


@query(EV + f", i AS (SELECT story, event_time AS s, event_time + {2 * HOUR} AS e FROM ev), p AS (SELECT *, max(e) OVER (PARTITION BY story ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i), g AS (SELECT *, sum(CASE WHEN s > coalesce(reach, s) THEN 1 ELSE 0 END) OVER (PARTITION BY story ORDER BY s, e) AS island FROM p) SELECT story, max(e) AS watermark FROM g WHERE island = 0 GROUP BY story")
def contiguous_watermark(spark, sf_dir):
    spans = read_events(spark, sf_dir).select("story", F.col("event_time").alias("start"), (F.col("event_time") + 2 * HOUR).alias("end"))
    return windows.contiguous_watermark(spans, ["story"])


@query(EV + f"SELECT {COLS} FROM ev WHERE event_time >= {FROM}")
def late_data_merge(spark, sf_dir):
    """Events that arrive after later ones are merged in, twice delivered ones once."""
    log = read_events(spark, sf_dir)
    return public(windows.late_merge(log.filter(replay.in_range(TO, None)), log.filter(replay.in_range(FROM, MID))))


_STATUS = f"SELECT event_time - event_time % {HOUR} AS chunk_start, event_time - event_time % {HOUR} + {HOUR} AS chunk_end, story, count(*) AS events FROM ev GROUP BY ALL"


@query(EV + f", c AS ({_STATUS}) SELECT story, chunk_start, chunk_end FROM c WHERE chunk_end <= {MID} AND events % 2 = 1 AND NOT (events % 5 = 0) AND {TO + 9 * DAY} >= chunk_end + {12 * DAY}")
def retention_free(spark, sf_dir):
    held = windows.chunks(read_events(spark, sf_dir), HOUR)
    status = held.withColumns({"shipped": F.lit(True), "receipt_settled": F.col("events") % 2 == 1, "watermark": F.lit(MID), "in_tail": F.col("events") % 5 == 0, "queued": F.lit(False)})
    return windows.freeable(status, F.lit(TO + 9 * DAY), 12 * DAY).select("story", "chunk_start", "chunk_end")


# -- manifest and tombstones

_FILES = "SELECT event_id AS file, event_type AS story, epoch_us(ts) * 1000 AS start_time, epoch_us(ts) * 1000 + (event_id % 48) * 3600000000000 AS end_time, event_id % 3 AS writer_start, event_id % 7 AS incarnation FROM events"


def _files(spark, sf_dir) -> DataFrame:
    e = read_events(spark, sf_dir)
    i = F.col("event_index")
    return e.select("chronicle", i.alias("file"), "story", F.col("event_time").alias("start_time"), (F.col("event_time") + (i % 48) * HOUR).alias("end_time"), (i % 3).alias("writer_start"), (i % 7).alias("incarnation"))


@query(f"WITH f AS ({_FILES}) SELECT file, story, start_time, end_time FROM f WHERE start_time < {TO} AND end_time > {FROM}")
def manifest_prune(spark, sf_dir):
    return catalog.files_for_range(_files(spark, sf_dir), FROM, TO, 48 * HOUR).select("file", "story", "start_time", "end_time")


@query(f"WITH f AS ({_FILES}), d AS (SELECT story, writer_start, max(bound) AS bound FROM (VALUES ('click', 0, 2), ('click', 1, 4), ('click', 1, 3), ('view', 2, 6)) t(story, writer_start, bound) GROUP BY 1, 2) SELECT file, story FROM f LEFT JOIN d USING (story, writer_start) WHERE bound IS NULL OR incarnation > bound")
def incarnation_visibility(spark, sf_dir):
    gone = spark.createDataFrame([("events", "click", 0, 2), ("events", "click", 1, 4), ("events", "click", 1, 3), ("events", "view", 2, 6)], "chronicle string, story string, writer_start long, incarnation_bound long")
    return catalog.visible_files(_files(spark, sf_dir), gone).select("file", "story")


@query(EV + f"SELECT {COLS} FROM ev WHERE story <> 'error' AND NOT (story = 'signup' AND event_time <= {MID})")
def destroy_tombstone(spark, sf_dir):
    gone = spark.createDataFrame([("events", "error", 2**62), ("events", "signup", FROM), ("events", "signup", MID)], "chronicle string, story string, destroyed_at long")
    return public(catalog.without_destroyed(read_events(spark, sf_dir), gone))


@query("SELECT DISTINCT event_type AS story FROM events")
def show_stories(spark, sf_dir):
    return catalog.stories(read_events(spark, sf_dir), "events")


@query("SELECT DISTINCT event_type AS value FROM events WHERE regexp_matches(event_type, '^(s|p)')")
def dashboard_story_var(spark, sf_dir):
    return catalog.stories_like(read_events(spark, sf_dir), "^ev", "^(s|p)")


@query("SELECT event_id, 1000 + event_id AS start_sec, event_id % 4 AS group_id, 77 AS writer_start, event_id % 3 AS incarnation, event_id AS seq FROM events WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL FROM events WHERE event_id % 9 = 0")
def window_file_parse(spark, sf_dir):
    i = F.col("event_id")
    name = F.concat_ws(".", (1000 + i).cast("string"), (i % 4).cast("string"), F.lit("77"), (i % 3).cast("string"), i.cast("string"), F.when(i % 9 == 0, "partial").otherwise("vlen"), F.lit("h5"))
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(k) for k, c in catalog.window_file_parts(name).items()])


@query(r"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'a%2Fb' WHEN event_id % 5 = 1 THEN '%2E%2E' WHEN event_id % 5 = 2 THEN '50%25' WHEN event_id % 5 = 3 THEN '%' ELSE event_type END AS folder FROM events""")
def archive_name_codec(spark, sf_dir):
    i = F.col("event_id") % 5
    name = F.when(i == 0, "a/b").when(i == 1, "..").when(i == 2, "50%").when(i == 3, "").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", catalog.archive_name(name).alias("folder"))


# -- telemetry, dashboards, routing


def _readings(spark, sf_dir) -> DataFrame:
    i, v = F.col("event_id"), F.rint("value").cast("long").cast("string")
    text = F.when(i % 5 == 0, F.concat(F.lit('{"value": '), v, F.lit("}"))).when(i % 5 == 1, F.concat(F.lit("load value = "), v)).when(i % 5 == 2, F.concat(F.lit("cpu "), v, F.lit("% of 8"))).when(i % 5 == 3, F.lit("True")).otherwise(F.lit("idle"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("record"))


_V = "CAST(CAST(round_even(value, 0) AS BIGINT) AS DOUBLE)"


@query(f"SELECT event_id, CASE WHEN event_id % 5 <= 2 THEN {_V} WHEN event_id % 5 = 3 THEN 1.0 END AS number FROM events")
def telemetry_value(spark, sf_dir):
    return _readings(spark, sf_dir).select("event_id", telemetry.single_number(F.col("record")).alias("number"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(event_id AS DOUBLE) END AS a, CASE WHEN event_id % 3 < 2 THEN CAST(user_id AS DOUBLE) END AS b FROM events")
def telemetry_pair(spark, sf_dir):
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(i, F.lit("abc,"), u, F.lit(" bytes"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("rx "), i, F.lit(" tx "), u)).otherwise(F.lit("none"))
    a, b = telemetry.number_pair(F.col("record"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("record")).select("event_id", a.alias("a"), b.alias("b"))


def _telemetry_log(spark, sf_dir) -> DataFrame:
    story = F.when(F.col("event_type") == "view", "network_usage").otherwise(F.concat(F.lit("cpu "), F.col("event_type")))
    record = F.when(F.col("event_type") == "view", F.concat_ws(",", F.col("event_id"), F.col("user_id"))).otherwise(F.col("user_id").cast("string"))
    return read_events(spark, sf_dir, record=record, story=story)


@query("SELECT 'network_usage' AS measurement, 'rx_bytes' AS field, CAST(event_id AS DOUBLE) AS number, epoch_us(ts) * 1000 AS ts_ns FROM events WHERE event_type = 'view' UNION ALL SELECT 'network_usage', 'tx_bytes', CAST(user_id AS DOUBLE), epoch_us(ts) * 1000 FROM events WHERE event_type = 'view' UNION ALL SELECT 'cpu ' || event_type, 'value', CAST(user_id AS DOUBLE), epoch_us(ts) * 1000 FROM events WHERE event_type <> 'view'")
def telemetry_points(spark, sf_dir):
    return telemetry.points(_telemetry_log(spark, sf_dir)).select("measurement", F.explode("fields").alias("field", "number"), "ts_ns")


@query("SELECT CASE WHEN event_type = 'view' THEN 'network_usage,chronicle=events,story=network_usage rx_bytes=' || event_id || '.0,tx_bytes=' || user_id || '.0 ' ELSE 'cpu\\ ' || event_type || ',chronicle=events,story=cpu\\ ' || event_type || ' value=' || user_id || '.0 ' END || epoch_us(ts) * 1000 AS line FROM events")
def line_protocol(spark, sf_dir):
    return telemetry.line_protocol(telemetry.points(_telemetry_log(spark, sf_dir)))


@query("""SELECT event_id, 'load_node_' || user_id || '_a' AS story, '{"timestamp":"' || event_id || '.5","producer":"node ' || user_id || '/a","instance":"i","schema":"load","metrics":{"k":' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE user_id || '.0' END || '}}' AS record FROM events""")
def metric_envelope(spark, sf_dir):
    producer = F.concat(F.lit("node "), F.col("user_id").cast("string"), F.lit("/a"))
    value = F.when(F.col("event_id") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("user_id").cast("double"))
    envelope = telemetry.metric_envelope(F.concat(F.col("event_id").cast("string"), F.lit(".5")), producer, F.lit("i"), F.lit("load"), F.create_map(F.lit("k"), value))
    return table(spark, sf_dir, "events").select("event_id", telemetry.metric_story(F.lit("load"), producer).alias("story"), envelope.alias("record"))


@query("WITH l AS (SELECT event_id, user_id % 50 AS idle, event_id AS total, lag(user_id % 50) OVER w AS i0, lag(event_id) OVER w AS t0 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) SELECT event_id, round(CASE WHEN total <> t0 THEN least(100.0, greatest(0.0, 100.0 * (1 - (idle - i0) / (total - t0)::DOUBLE))) END, 6) AS busy FROM l")
def counter_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 50).alias("idle"), F.col("event_id").alias("total"))
    return analytics.counter_rate(e, "event_type", ["event_id"], "idle", "total").select("event_id", F.round("busy", 6).alias("busy"))


@query("SELECT epoch_us(ts) // 1000 AS time_ms, props AS log, user_id AS client, event_id AS idx FROM events")
def viz_frame(spark, sf_dir):
    return records.dashboard_frame(read_events(spark, sf_dir))


@query("SELECT event_id, epoch_us(ts) % 7 AS recorder FROM events")
def keeper_route(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", ids.recorder_of(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"), 7).alias("recorder"))


@query("SELECT event_id, user_id % 4096 AS ip, (user_id * 7) % 65536 AS port, event_id % 65536 AS pid FROM events")
def client_id_unpack(spark, sf_dir):
    packed = ids.pack_client_id(F.col("user_id") % 4096, (F.col("user_id") * 7) % 65536, F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(k) for k, c in ids.client_id_parts(packed).items()])


_WRAP = "% 18446744073709551616::UHUGEINT"


def _rendezvous() -> str:
    """Each step of the finalizer as a query of its own, for groups and for story and group together."""
    step = lambda name, source, column, keep: (
        f"{name}1 AS (SELECT {keep}, (xor({column}, {column} >> 30) * 13787848793156543929::UHUGEINT) {_WRAP} AS h FROM {source}), "
        f"{name}2 AS (SELECT {keep}, (xor(h, h >> 27) * 10723151780598845931::UHUGEINT) {_WRAP} AS h FROM {name}1), "
        f"{name} AS (SELECT {keep}, xor(h, h >> 31) AS h FROM {name}2)"
    )
    return (
        "WITH g0 AS (SELECT k::UHUGEINT AS x, k AS group_id FROM (VALUES (1), (2), (3), (5), (8)) t(k)), " + step("g", "g0", "x", "group_id")
        + ", s0 AS (SELECT event_id, group_id, xor((event_id * 1000003)::UHUGEINT, h) AS x FROM events, g), " + step("s", "s0", "x", "event_id, group_id")
        + " SELECT event_id, CAST(group_id AS BIGINT) AS group_id FROM s QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY h DESC, group_id) = 1"
    )


@query(_rendezvous())
def story_group(spark, sf_dir):
    """Rendezvous hashing, which wraps at 64 bits."""
    return table(spark, sf_dir, "events").select("event_id", ids.group_of((F.col("event_id") * 1_000_003).cast("long"), [1, 2, 3, 5, 8]).alias("group_id"))


@query("SELECT event_id, 'event : ' || 42 || ':' || epoch_us(ts) * 1000 || ':' || user_id || ':' || event_id || ':' || props AS line FROM events")
def event_to_string(spark, sf_dir):
    return read_events(spark, sf_dir).select(F.col("event_index").alias("event_id"), records.event_line(F.lit(42)).alias("line"))


@query("SELECT u.conv_id, u.turn, 'user: ' || u.text || ', assistant: ' || a.text AS record FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'")
def record_interaction(spark, sf_dir):
    return records.interactions(table(spark, sf_dir, "conversations"))


@query(EV + f"SELECT {COLS} FROM ev WHERE story = 'error' AND event_time >= {FROM} AND event_time < {FROM + 2 * DAY - 1000}")
def day_range_replay(spark, sf_dir):
    return public(replay.replay(read_events(spark, sf_dir), "events", "error", records.parse_time("2024-01-05"), records.parse_time("2024-01-06", end=True)))


@query(EV + f"SELECT story AS topic, event_time AS timestamp, record AS payload, client_id, event_index FROM ev WHERE story = 'signup' AND event_time >= {MID}")
def topic_since(spark, sf_dir):
    return public(messages(read_events(spark, sf_dir), "signup", MID), "topic", "timestamp", "payload", "client_id", "event_index")


# -- tooling

@query("SELECT count(value) AS n, round(min(value), 6) AS min, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max FROM events")
def latency_distribution(spark, sf_dir):
    out = analytics.distribution(table(spark, sf_dir, "events"), F.col("value"))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@query("SELECT event_type, user_id % 5 AS scale, count(*) AS reps, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1, 2")
def perf_rollup(spark, sf_dir):
    out = analytics.rollup_by(table(spark, sf_dir, "events").withColumn("scale", F.col("user_id") % 5), ["event_type", "scale"], "value")
    return out.select("event_type", "scale", "reps", *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")])


@query("SELECT round(1 - count(DISTINCT epoch_us(ts) // 60000000) / count(ts)::DOUBLE, 9) AS ratio FROM events")
def collision_ratio(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("minute", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 60000000"))
    return analytics.collision_ratio(e, "minute").select(F.round("ratio", 9).alias("ratio"))


# -- extensions: not among the event log's own queries


@query("SELECT o_orderkey, o_custkey, event_id, event_type FROM orders ASOF LEFT JOIN (SELECT user_id, ts, event_id, event_type FROM events) e ON o_custkey = e.user_id AND o_orderdate >= e.ts")
def ext_as_of_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("o_custkey", F.col("user_id"))
    out = analytics.as_of(table(spark, sf_dir, "orders"), e, ["o_custkey"], "o_orderdate", "ts", ["event_id", "event_type"])
    return out.select("o_orderkey", "o_custkey", "event_id", "event_type")


@query("WITH m AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t) AS s FROM m) SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS events FROM s GROUP BY user_id, s")
def ext_session_windows(spark, sf_dir):
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")
    out = analytics.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")
    return out.select("user_id", micros("session_start").alias("start_us"), micros("session_end").alias("end_us"), "events")


@query("WITH w AS (SELECT event_type, unnest([epoch_us(ts) - epoch_us(ts) % 21600000000, epoch_us(ts) - epoch_us(ts) % 21600000000 - 21600000000]) AS start_us FROM events) SELECT event_type, start_us, count(*) AS events FROM w GROUP BY 1, 2")
def ext_sliding_windows(spark, sf_dir):
    out = analytics.sliding(table(spark, sf_dir, "events"), "event_type", "ts", "12 hours", "6 hours")
    return out.select("event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', window_start)").alias("start_us"), "events")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_quantity)) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity")).cast("long").alias("quantity"))


@query("SELECT n_name, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def ext_join_rollup(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))
