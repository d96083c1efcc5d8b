"""Topics: a topic is a story, a message an event.

Delivery follows the stream's checkpoint rather than a time watermark, so a
message with the same time as the last one delivered isn't passed over.
"""

from __future__ import annotations

import itertools
import logging
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidelog.schema import KEY

log = logging.getLogger(__name__)


def messages(events: DataFrame, topic: str, since: int | None = None) -> DataFrame:
    """A topic's messages from ``since`` on, as topic, timestamp, payload and the rest of the order."""
    rows = events.filter(F.col("story") == topic)
    if since is not None:
        rows = rows.filter(F.col("event_time") >= since)
    return rows.select(F.col("story").alias("topic"), F.col("event_time").alias("timestamp"), F.col("record").alias("payload"), "client_id", "event_index")


class Subscriptions:
    """Subscribers of a stream of events."""

    def __init__(self, events: DataFrame, checkpoints: str):
        self.events, self.checkpoints = events, checkpoints.rstrip("/")
        self._ids, self._running, self._lock = itertools.count(1), {}, threading.Lock()

    def subscribe(self, topic: str, callback: Callable[[Row], None], poll_ms: int = 100, name: str | None = None) -> int:
        """From now on."""
        return self.subscribe_from(topic, time.time_ns(), callback, poll_ms, name)

    def subscribe_from(self, topic: str, since: int | None, callback: Callable[[Row], None], poll_ms: int = 100, name: str | None = None, trigger: dict | None = None) -> int:
        """Call ``callback`` for each message in order of time; one that raises has been delivered all the same.

        ``name`` keeps the position between runs.
        """
        number = next(self._ids)

        def deliver(batch: DataFrame, _: int) -> None:
            for row in batch.orderBy("timestamp", *KEY[1:]).toLocalIterator():
                try:
                    callback(row)
                except Exception:  # noqa: BLE001
                    log.exception("subscriber %d of %s", number, topic)

        place = f"{self.checkpoints}/{name or f'{topic}-{number}-{time.time_ns()}'}"
        query = messages(self.events, topic, since).writeStream.foreachBatch(deliver).option("checkpointLocation", place).trigger(**(trigger or {"processingTime": f"{poll_ms} milliseconds"})).start()
        with self._lock:
            self._running[number] = query
        return number

    def query(self, number: int):
        return self._running.get(number)

    def unsubscribe(self, number: int) -> bool:
        """True the first time, then False."""
        with self._lock:
            query = self._running.pop(number, None)
        if query is None:
            return False
        query.stop()
        return True
