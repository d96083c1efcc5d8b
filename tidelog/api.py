"""A store of chronicles and stories on Parquet: the library's native client."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import Acquired, ChronicleExists, DurabilityFull, DurabilityUnavailable, DurabilityUnknown, InvalidArgument, NotAcquired, NotExist, VersionMismatch
from tidelog.functions import records, telemetry
from tidelog.operators import kv, replay, tail
from tidelog.operators.catalog import without_destroyed
from tidelog.schema import EVENT_LOG, KEY, SECOND, event_log, ntz_of_micros
from tidelog.sources.archive import read_archive, write_archive
from tidelog.sources.sinks import csv_sink

CATALOG = "story string, chronicle string, op string, client long, at long"
PROTOCOL = 1
#: The event index starts over behind this number.
LAST_INDEX = 2**31 - 1


@dataclass(frozen=True)
class LogEventOptions:
    """``durable``: stored before the call returns, tried ``attempts`` times of ``timeout_ms`` each."""

    durable: bool = False
    timeout_ms: int = 10_000
    attempts: int = 3


@dataclass
class StoryHandle:
    """An acquired story.  Events are buffered and appended together on ``flush``."""

    store: Store
    chronicle: str
    story: str
    held: list[tuple] = field(default_factory=list)

    def log_event(self, record: str, options: LogEventOptions | None = None) -> int:
        """Stamp one event and return its time; buffered unless durable.  An empty record is passed over (0)."""
        if options is not None and options.durable:
            return self.log_event_durable(record, options)
        if not record:
            return 0
        key = self.store._stamp()
        self.held.append((self.chronicle, self.story, *key, record))
        return key[0]

    def log_event_durable(self, record: str, options: LogEventOptions | None = None) -> int:
        """The same, appended before this returns.

        An attempt that isn't answered (TimeoutError, OSError) may have stored
        the event; it is repeated with the same identity, of which reads take one.
        After that no refusal can say that nothing was stored, so it becomes
        DurabilityUnknown, as when no attempt is answered.
        """
        options = options or LogEventOptions(durable=True)
        if not record or options.attempts < 1 or options.timeout_ms < 1:
            raise InvalidArgument("a durable event needs a record, attempts and a time limit")
        key = self.store._stamp()
        row, unanswered = (self.chronicle, self.story, *key, record), False
        for _ in range(options.attempts):
            try:
                self.store.send([row], options.timeout_ms)
                return key[0]
            except (DurabilityUnavailable, DurabilityFull) as e:
                if unanswered:
                    raise DurabilityUnknown("an earlier attempt may have stored the event", key[0]) from e
                raise
            except (TimeoutError, OSError):
                unanswered = True
        raise DurabilityUnknown("no attempt was answered", key[0])

    def flush(self) -> None:
        rows, self.held = self.held, []
        if rows:
            self.store.append_rows(rows)

    def playback(self, n: int = 100) -> DataFrame:
        """The newest ``n`` events, ascending."""
        self.flush()
        return tail.last_n(self.store.log(), self.chronicle, self.story, n)


class Store:
    """Chronicles and stories below one path.  Appends are idempotent by identity: reads take each event once."""

    def __init__(self, spark: SparkSession, path: str, client_id: int = 1):
        self.spark, self.path, self.client_id = spark, path.rstrip("/"), client_id
        self._index, self._last, self._handles = 0, 0, {}
        #: Takes rows and a time limit; raises TimeoutError or OSError if it can't tell whether they were stored.
        self.send: Callable[[list[tuple], int], None] = lambda rows, timeout_ms: self.append_rows(rows)

    @classmethod
    def connect(cls, spark: SparkSession, path: str, client_id: int = 1, version: int = PROTOCOL) -> Store:
        """A client of the store at ``path``, which is made for this protocol version if it is new and must be of it otherwise."""
        store = cls(spark, path, client_id)
        if store._exists("protocol"):
            made_for = spark.read.schema("version int").json(f"{store.path}/protocol").head()[0]
            if made_for != version:
                raise VersionMismatch(f"the store speaks version {made_for}, the client {version}")
        else:
            spark.createDataFrame([(version,)], "version int").coalesce(1).write.json(f"{store.path}/protocol")
        return store

    # -- catalog

    def _operations(self) -> DataFrame:
        return self.spark.read.schema(CATALOG).json(f"{self.path}/catalog") if self._exists("catalog") else self.spark.createDataFrame([], CATALOG)

    def _exists(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _note(self, op: str, chronicle: str, story: str | None = None) -> None:
        self.spark.createDataFrame([(story, chronicle, op, self.client_id, time.time_ns())], CATALOG).coalesce(1).write.mode("append").json(f"{self.path}/catalog")

    def _alive(self) -> DataFrame:
        """chronicle, story (null: the chronicle itself) whose last operation made them."""
        ops = self._operations().filter("op in ('create', 'destroy')")
        gone = ops.filter("op = 'destroy' and story is null").groupBy("chronicle").agg(F.max("at").alias("gone"))
        last = ops.groupBy("chronicle", "story").agg(F.max_by("op", "at").alias("op"), F.max("at").alias("at"))
        return last.join(gone, "chronicle", "left").filter("op = 'create' and (gone is null or at > gone)").select("chronicle", "story")

    def create_chronicle(self, name: str) -> None:
        if not name:
            raise InvalidArgument("a chronicle needs a name")
        if name in self.show_chronicles():
            raise ChronicleExists(name)
        self._note("create", name)

    def show_chronicles(self) -> list[str]:
        return [r["chronicle"] for r in self._alive().filter("story is null").orderBy("chronicle").collect()]

    def show_stories(self, chronicle: str) -> list[str]:
        alive = self._alive().filter(F.col("chronicle") == chronicle)
        if alive.filter("story is null").isEmpty():
            raise NotExist(chronicle)
        return [r["story"] for r in alive.filter("story is not null").orderBy("story").collect()]

    def acquire_story(self, chronicle: str, story: str) -> StoryHandle:
        """The story's handle, the same for a repeated call; a new story is made, its chronicle must exist."""
        if (chronicle, story) not in self._handles:
            if story not in self.show_stories(chronicle):
                self._note("create", chronicle, story)
            self._note("acquire", chronicle, story)
            self._handles[chronicle, story] = StoryHandle(self, chronicle, story)
        return self._handles[chronicle, story]

    def release_story(self, chronicle: str, story: str) -> None:
        handle = self._handles.pop((chronicle, story), None)
        if handle is None:
            raise NotAcquired(f"{chronicle}/{story}")
        handle.flush()
        self._note("release", chronicle, story)

    def holders(self, chronicle: str, story: str) -> list[int]:
        """Clients that hold a story."""
        ops = self._operations().filter((F.col("chronicle") == chronicle) & (F.col("story") == story) & F.col("op").isin("acquire", "release", "destroy"))
        gone = ops.filter("op = 'destroy'").agg(F.max("at")).head()[0] or 0
        last = ops.filter((F.col("at") > gone) & (F.col("op") != "destroy")).groupBy("client").agg(F.max_by("op", "at").alias("op"))
        return sorted(r["client"] for r in last.filter("op = 'acquire'").collect())

    def destroy_story(self, chronicle: str, story: str) -> None:
        if story not in self.show_stories(chronicle):
            raise NotExist(f"{chronicle}/{story}")
        if set(self.holders(chronicle, story)) - {self.client_id}:
            raise Acquired(f"{chronicle}/{story} is held by another client")
        self._handles.pop((chronicle, story), None)
        self._note("destroy", chronicle, story)

    def destroy_chronicle(self, chronicle: str) -> None:
        stories = self.show_stories(chronicle)
        for story in stories:
            if set(self.holders(chronicle, story)) - {self.client_id}:
                raise Acquired(f"{chronicle}/{story} is held by another client")
        for story in stories:
            self.destroy_story(chronicle, story)
        self._note("destroy", chronicle)

    def disconnect(self) -> None:
        for chronicle, story in list(self._handles):
            self.release_story(chronicle, story)

    # -- events

    def _stamp(self) -> tuple[int, int, int]:
        self._last = max(time.time_ns(), self._last + 1)
        self._index = self._index + 1 if self._index < LAST_INDEX else 0
        return self._last, self.client_id, self._index

    def append_rows(self, rows: list[tuple]) -> None:
        write_archive(self._frame(rows), f"{self.path}/events")

    def _frame(self, rows: list[tuple]) -> DataFrame:
        raw = self.spark.createDataFrame(rows, "chronicle string, story string, event_time long, client long, event_index long, record string")
        return event_log(raw.withColumn("client_id", F.col("client").cast("decimal(20,0)")).withColumn("event_ts", ntz_of_micros(F.expr("event_time div 1000"))))

    def append(self, chronicle: str, story: str, record: str) -> int:
        """Append one event and return its time."""
        key = self._stamp()
        self.append_rows([(chronicle, story, *key, record)])
        return key[0]

    def log(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """All events of stories that weren't destroyed since."""
        if not self._exists("events"):
            return self.spark.createDataFrame([], EVENT_LOG)
        rows = read_archive(self.spark, f"{self.path}/events", start, end)
        gone = self._operations().filter("op = 'destroy' and story is not null").select("chronicle", "story", F.col("at").alias("destroyed_at"))
        return without_destroyed(rows, gone)

    def read(self, chronicle: str, story: str, start: int | None = None, end: int | None = None) -> replay.ReplayResult:
        """A range and whether all of it could be read; a store over several sources overrides this."""
        return replay.ReplayResult(replay.replay(self.log(start, end), chronicle, story, start, end))

    def replay(self, chronicle: str, story: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """A complete range: an incomplete one is asked for twice more and refused then."""
        handle = self._handles.get((chronicle, story))
        if handle is not None:
            handle.flush()
        return replay.retried(lambda: self.read(chronicle, story, start, end))

    def flush(self) -> None:
        """Append what all handles hold, so that reads see it."""
        for handle in self._handles.values():
            handle.flush()

    def export_recent(self, chronicle: str, story: str, seconds: int, path: str, now_ns: int | None = None) -> None:
        """Events of the last ``seconds`` as CSV."""
        now_ns = now_ns or time.time_ns()
        csv_sink(path)(self.replay(chronicle, story, max(now_ns - seconds * SECOND, 1), now_ns))

    # -- versioned values

    def put(self, key: str, value: str) -> int:
        if not key or not value:
            raise InvalidArgument("key and value must not be empty")
        return self.append(kv.CHRONICLE, key, value)

    def values(self) -> DataFrame:
        return kv.versions(self.log().filter(F.col("chronicle") == kv.CHRONICLE).transform(replay.deduplicated))

    def publish(self, topic: str, payload: str, chronicle: str = "topics") -> int:
        """Append a message; 0 for an empty topic or payload."""
        return self.append(chronicle, topic, payload) if topic and payload else 0

    def playback_report(self, chronicle: str, story: str, n: int = 100) -> dict:
        """A dashboard's answer: events and how many."""
        if n < 1:
            raise InvalidArgument("num_events must be 1 or more")
        rows = tail.last_n(self.log(), chronicle, story, n).orderBy(*KEY).collect()
        return {"events": [{"time": r["event_time"], "client_id": int(r["client_id"]), "index": r["event_index"], "log_record": r["record"]} for r in rows], "total_events": len(rows)}

    def query_report(self, chronicle: str, story: str, start: int, end: int) -> dict:
        """The same for a range; rows reach the driver, so ranges should be a dashboard's."""
        rows = self.replay(chronicle, story, start, end).collect()
        return {"events": [{"time": r["event_time"], "client_id": int(r["client_id"]), "index": r["event_index"], "log_record": r["record"]} for r in rows], "total_events": len(rows)}

    # -- conversation tools

    def record_interaction(self, chronicle: str, story: str, user: str, assistant: str) -> int:
        return self.append(chronicle, story, f"user: {user}, assistant: {assistant}")

    def retrieve(self, chronicle: str, story: str, path: str, start: str | None = None, end: str | None = None) -> None:
        """Write a story's records, one a line, to ``path``; times as :func:`parse_time` takes them, by default all up to a minute from now."""
        lo = records.parse_time(start) or 1
        hi = records.parse_time(end, end=True) or time.time_ns() + 60 * SECOND
        self.replay(chronicle, story, lo, hi).select(F.coalesce("record", F.lit("")).alias("value")).write.mode("overwrite").text(path)

    # -- metric samples

    def store_metrics(self, samples: DataFrame, container: str) -> None:
        """Append metric samples: ts_ns, producer, instance, schema, metrics (map of doubles)."""
        stamp = F.concat((F.col("ts_ns") / SECOND).cast("long").cast("string"), F.lit("."), F.lpad(F.expr("ts_ns % 1000000000 div 1000").cast("string"), 6, "0"))
        record = telemetry.metric_envelope(stamp, F.col("producer"), F.col("instance"), F.col("schema"), F.col("metrics"))
        number = F.pmod(F.xxhash64("producer", "instance", "schema"), F.lit(2**31))
        rows = samples.select(F.lit(container).alias("chronicle"), telemetry.metric_story(F.col("schema"), F.col("producer")).alias("story"), F.col("ts_ns").alias("event_time"), F.lit(self.client_id).cast("decimal(20,0)").alias("client_id"), number.alias("event_index"), record.alias("record"))
        write_archive(event_log(rows), f"{self.path}/events")
