"""Newest-N reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.errors import EventLogError, PartialResult
from tidelog.operators.replay import deduplicated
from tidelog.schema import IDENTITY, KEY


def _newest() -> list[Column]:
    return [F.col(c).desc() for c in KEY]


def last_n(log: DataFrame, chronicle: str, story: str, n: int) -> DataFrame:
    """A story's newest ``n`` events, ascending, each identity once; fewer if it has fewer.

    Each task keeps its own newest ``n`` and these are merged.
    """
    return last_n_per_story(log.filter((F.col("chronicle") == chronicle) & (F.col("story") == story)), max(n, 0)).orderBy(*KEY)


def last_n_wide(log: DataFrame, chronicle: str, story: str, n: int) -> DataFrame:
    """The same for wide records: the newest keys first, then the records of these alone."""
    rows = log.filter((F.col("chronicle") == chronicle) & (F.col("story") == story))
    keys = rows.select(*IDENTITY).distinct().orderBy(*_newest()).limit(max(n, 0))
    return deduplicated(rows.join(keys, IDENTITY, "left_semi")).orderBy(*KEY)


def last_n_per_story(log: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events of each story, each identity once.  Tasks cut their own to ``n`` keys a story before the shuffle."""
    w = Window.partitionBy("chronicle", "story").orderBy(*_newest())
    return deduplicated(log.withColumn("_n", F.dense_rank().over(w)).filter(F.col("_n") <= n).drop("_n"))


def evict_to_capacity(log: DataFrame, capacity: int = 65_536) -> DataFrame:
    """The tail index after eviction: each story's newest ``capacity`` events."""
    return last_n_per_story(log, capacity)


def live_tail(sealed: DataFrame, unsealed: DataFrame, chronicle: str, story: str, n: int) -> DataFrame:
    """The newest ``n`` of sealed and unsealed events together, each identity once.

    Either side is cut to its own newest ``n`` first.
    """
    return last_n(last_n(sealed, chronicle, story, n).unionByName(last_n(unsealed, chronicle, story, n)), chronicle, story, n)


def fetch(log: DataFrame, keys: DataFrame, most_broadcast: int = 10_000) -> DataFrame:
    """Events of a list of keys (identity columns); keys without an event are passed over.

    Lists of up to ``most_broadcast`` rows are broadcast, longer ones are joined by shuffle.
    """
    keys = keys.select(*IDENTITY).distinct()
    small = keys.limit(most_broadcast + 1).count() <= most_broadcast
    return log.join(F.broadcast(keys) if small else keys, IDENTITY, "left_semi")


def scattered_tail(recorders: Sequence[DataFrame | None], n: int) -> DataFrame:
    """The newest ``n`` of a story held by several recorders, ascending.

    Each recorder gives its newest keys, the winners are chosen among them, and
    their records are fetched after that.  A recorder that doesn't answer is
    None: if none answers that is an error, not an empty tail.
    """
    answered = [r for r in recorders if r is not None]
    if recorders and not answered:
        raise EventLogError("no recorder answered")
    if not answered:
        raise EventLogError("the story has no recorders")
    keys = None
    for r in answered:
        own = r.select(*IDENTITY).distinct().orderBy(*_newest()).limit(max(n, 0))
        keys = own if keys is None else keys.unionByName(own)
    keys = keys.distinct().orderBy(*_newest()).limit(max(n, 0))
    found = None
    for k, r in enumerate(answered):
        own = r.join(keys, IDENTITY, "left_semi").withColumn("_recorder", F.lit(k))
        found = own if found is None else found.unionByName(own)
    return deduplicated(found, "_recorder").drop("_recorder").orderBy(*KEY)


def complete_tail(found: DataFrame, promised: int) -> DataFrame:
    """``found``, refused if it has fewer rows than its keys promised."""
    if found.count() < promised:
        raise PartialResult("fewer records than keys")
    return found
