"""A batch reader of SQLite tables as a Spark data source, split by rowid ranges.

The file must lie where all executors see it. The schema chooses the columns that are read; conditions that `where`
puts into the option of that name choose the rows, in SQLite's own query:
    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite_table").schema(ddl).option("path", p).option("table", "comments").option("where", where(("likes", ">", 3))).load()

Spark's own offer of filters to sources in Python is not taken: the source keeps the filters of one query for the
next one over the same DataFrame, which then misses rows (seen in 4.1.2).
"""
from __future__ import annotations

import json
import re
import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COMPARED = ("=", "<>", "<", "<=", ">", ">=")
TESTED = ("is null", "is not null")


def where(*conditions: tuple) -> str:
    """Conditions that all must hold, as the option's text: (column, "is null" or "is not null"), (column, "in",
    [values]), or (column, one of COMPARED, value); values are numbers, texts or truth values."""
    clauses([list(c) for c in conditions])
    return json.dumps(conditions)


def clauses(conditions: list) -> tuple[str, list]:
    """The conditions as SQLite's text, each with AND before it, and the values of its places."""
    text, values = "", []
    for name, kind, *rest in conditions:
        many = list(rest[0]) if kind == "in" and rest else rest
        fits = len(rest) == 0 if kind in TESTED else len(rest) == 1 and bool(many) and (kind == "in" or kind in COMPARED)
        if not re.fullmatch(r"\w+", name) or not fits or not all(isinstance(v, bool | int | float | str) for v in many):
            raise ValueError(f"not a condition: {[name, kind, *rest]}")
        text += f' AND "{name}" {kind} ' + ("" if kind in TESTED else "?" if kind in COMPARED else f"({', '.join('?' * len(many))})")
        values += many
    return text, values


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(schema, self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema = schema
        self.path, self.table = options["path"], options["table"]
        if not re.fullmatch(r"\w+", self.table):
            raise ValueError(f"not a table name: {self.table}")
        self.parts = int(options.get("partitions", 8))
        self.also, self.values = clauses(json.loads(options.get("where") or "[]"))

    def _connect(self):
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self):
        with self._connect() as c:
            lo, hi = c.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
        if lo is None:
            return [Range(0, 0)]
        step = max(1, -(-(hi - lo + 1) // self.parts))
        return [Range(a, min(a + step, hi + 1)) for a in range(lo, hi + 1, step)]

    def read(self, partition):
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        casts = [bool if f.dataType.typeName() == "boolean" else None for f in self.schema.fields]
        with self._connect() as c:
            for row in c.execute(f"SELECT {names} FROM {self.table} WHERE rowid >= ? AND rowid < ?{self.also}", (partition.lo, partition.hi, *self.values)):
                yield tuple(v if k is None or v is None else k(v) for v, k in zip(row, casts))
