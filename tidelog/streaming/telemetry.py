"""Telemetry of chosen stories, sent on as it arrives.

The checkpoint takes the place of a time up to which was read, so an event at
that very time isn't passed over; a batch that the sink refuses is sent again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.telemetry import line_protocol, points


def start_poll(events: DataFrame, stories: Sequence[str], send: Callable[[DataFrame], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """``send`` gets each batch as a frame of one column, ``line`` (line protocol)."""
    chosen = events.filter(F.col("story").isin(*stories))
    writer = chosen.writeStream.foreachBatch(lambda batch, _: send(line_protocol(points(batch)))).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
