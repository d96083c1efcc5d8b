"""Registered queries and their SQL, and what their modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.schema import SECOND

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: 2024-01-05, 2024-01-12 and 2024-01-16, in nanoseconds.
FROM, TO, MID = 1_704_412_800 * SECOND, 1_705_017_600 * SECOND, 1_705_363_200 * SECOND
HOUR = 3_600 * SECOND
EV = "WITH ev AS (SELECT 'events' AS chronicle, event_type AS story, epoch_us(ts) * 1000 AS event_time, user_id AS client_id, event_id AS event_index, props AS record, value FROM events) "
COLS = "chronicle, story, event_time, client_id, event_index, record"


def query(oracle: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
