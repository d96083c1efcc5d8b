"""SQL facade: tables are stories whose records are JSON objects of texts.

Types are advisory; values are kept and compared as texts.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.errors import InvalidArgument, QueryTimedOut
from tidelog.operators.catalog import fold_tables
from tidelog.plans.statements import Between, Create, Drop, Equals, Insert, Select, parse
from tidelog.schema import KEY

CHRONICLE = "tables"
METADATA = "__metadata"


def member(column: str, record: str = "record") -> Column:
    """A member of the record's object as text; a JSON null is "null", an absent one NULL."""
    v = F.try_parse_json(record)
    path = "$['" + column.replace("'", "\\'") + "']"
    found = F.try_variant_get(v, path, "string")
    return F.when(F.try_variant_get(v, path, "variant").isNotNull() & F.is_variant_null(F.try_variant_get(v, path, "variant")), "null").otherwise(found)


def is_row(record: str = "record") -> Column:
    """Whether the record is a JSON object; others are passed over."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(record)).startswith("OBJECT"), F.lit(False))


def ts_between(low: int, high: int) -> Column:
    """Both ends included; an order the wrong way round is refused."""
    if low > high:
        raise InvalidArgument("BETWEEN bounds are the wrong way round")
    return (F.col("event_time") >= low) & (F.col("event_time") <= high)


def predicate(where: Equals | Between | None) -> Column:
    if where is None:
        return F.lit(True)
    if isinstance(where, Between):
        return ts_between(where.low, where.high)
    if where.value is None:
        return member(where.column).isNull()
    return member(where.column) == where.value


def select(log: DataFrame, schema: Sequence[str], statement: Select) -> DataFrame:
    """``log``: the table's events.  Columns as texts, ``__ts`` first; all of the schema's for ``*``."""
    rows = log.filter(is_row() & predicate(statement.where)).orderBy(*KEY)
    columns = statement.columns if statement.columns is not None else list(schema)
    return rows.select(F.col("event_time").alias("__ts"), *[F.col("event_time").cast("string").alias(c) if c == "__ts" else member(c).alias(c) for c in columns if c != "__ts"])


class SqlTables:
    """Statements over a store (see :class:`tidelog.api.Store`); the catalog is itself a story of operations."""

    def __init__(self, store, chronicle: str = CHRONICLE):
        self.store, self.chronicle = store, chronicle

    def _catalog(self) -> DataFrame:
        try:
            ops = self.store.replay(self.chronicle, METADATA)
        except QueryTimedOut:  # a cold store has no tables yet
            ops = self.store.log().limit(0)
        return fold_tables(ops.select(F.struct(*KEY).alias("seq"), "record"))

    def tables(self) -> list[str]:
        return [r["name"] for r in self._catalog().orderBy("position").select("name").collect()]

    def schema(self, table: str) -> list[tuple[str, str]] | None:
        found = self._catalog().filter(F.col("name") == table).select("columns").head()
        return None if found is None else [(c["name"], c["type"]) for c in found["columns"] or []]

    def flush(self) -> None:
        """Make what was inserted through handles visible to reads."""
        self.store.flush()

    def _need(self, table: str) -> list[tuple[str, str]]:
        columns = self.schema(table)
        if columns is None:
            raise InvalidArgument(f"no such table: {table}")
        return columns

    def execute(self, sql: str) -> DataFrame | int | None:
        """A SELECT's rows, an INSERT's timestamp, else None."""
        s = parse(sql)
        if isinstance(s, Create):
            names = [c for c, _ in s.columns]
            if s.table.startswith("__") or len(set(names)) != len(names) or any(c.startswith("__") for c in names):
                raise InvalidArgument("reserved or repeated names")
            if self.schema(s.table) is not None:
                raise InvalidArgument(f"table exists: {s.table}")
            self.store.append(self.chronicle, METADATA, json.dumps({"op": "create_table", "name": s.table, "columns": [{"name": n, "type": t} for n, t in s.columns]}))
            return None
        if isinstance(s, Drop):
            self._need(s.table)
            self.store.append(self.chronicle, METADATA, json.dumps({"op": "drop_table", "name": s.table}))
            return None
        names = [c for c, _ in self._need(s.table)]
        if isinstance(s, Insert):
            columns = s.columns if s.columns is not None else names
            if len(columns) != len(s.values) or not set(columns) <= set(names):
                raise InvalidArgument("columns and values don't fit the table")
            row: dict[str, str] = {}
            for c, v in zip(columns, s.values, strict=True):
                if v is not None:
                    row.setdefault(c, v)  # of a column named twice the first value counts
            return self.store.append(self.chronicle, s.table, json.dumps(row))
        return select(self.store.replay(self.chronicle, s.table), names, s)
