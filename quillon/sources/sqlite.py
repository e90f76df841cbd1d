"""SQLite tables as a Spark data source, read in ranges of row ids."""

from __future__ import annotations

import sqlite3

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TYPES = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "BLOB": "binary"}


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options ``path``, ``table``, ``rows`` (of a partition, 100,000). The file must be readable from every executor."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        return ", ".join(f"`{c[1]}` {TYPES.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options, [f.name for f in schema.fields])


class SqliteReader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.table, self.rows, self.columns = options["path"], options["table"], int(options.get("rows", 100_000)), columns

    def partitions(self):
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [Range(0, -1)]
        return [Range(a, min(high, a + self.rows - 1)) for a in range(low, high + 1, self.rows)]

    def read(self, partition):
        names = ", ".join(f'"{c}"' for c in self.columns)
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))
