"""connect / cursor / execute in the style of PEP 249, over an engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.engine import Engine
from millrace.session import session

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"


class Error(Exception):
    """An operation on something that is closed or has no result."""


def connect(spark: SparkSession | None = None, base: str | None = None) -> Connection:
    return Connection(Engine(spark or session(), base))


class Connection:
    def __init__(self, engine: Engine) -> None:
        self.engine, self.closed = engine, False

    def _open(self) -> Engine:
        if self.closed:
            raise Error("the connection is closed")
        return self.engine

    def cursor(self) -> Cursor:
        return Cursor(self._open())

    def execute(self, sql: str, parameters: list | dict | None = None) -> Cursor:
        return self.cursor().execute(sql, parameters)

    def execute_many(self, sql: str, rows: list) -> Cursor:
        cursor = self.cursor()
        for row in rows:
            cursor.execute(sql, row)
        return cursor

    executemany = execute_many

    def sql(self, sql: str) -> DataFrame:
        return self._open().sql(sql)

    def to_dict(self, sql: str) -> dict[str, list]:
        """A result by column; for small results, as everything fetched is."""
        df = self.sql(sql)
        rows = df.collect()
        return {c: [r[i] for r in rows] for i, c in enumerate(df.columns)}

    def commit(self) -> None:
        """Each statement has committed already."""

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Cursor:
    """Rows are streamed from the executors partition by partition, not collected."""

    arraysize = 1

    def __init__(self, engine: Engine) -> None:
        self.engine, self.frame, self.rows = engine, None, None

    def execute(self, sql: str, parameters: list | dict | None = None) -> Cursor:
        self.frame = self.engine.sql(sql, parameters)
        self.rows = None
        return self

    def _iter(self):
        if self.frame is None:
            raise Error("nothing was executed")
        if self.rows is None:
            self.rows = self.frame.toLocalIterator()
        return self.rows

    @property
    def description(self) -> list[tuple] | None:
        if self.frame is None:
            return None
        return [(f.name, f.dataType.simpleString(), None, None, None, None, f.nullable) for f in self.frame.schema.fields]

    @property
    def rowcount(self) -> int:
        return -1 if self.frame is None else self.frame.count()

    def fetchone(self) -> tuple | None:
        row = next(self._iter(), None)
        return None if row is None else tuple(row)

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        out = []
        for row in self._iter():
            out.append(tuple(row))
            if len(out) == (size or self.arraysize):
                break
        return out

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self._iter()]

    def __iter__(self):
        return (tuple(r) for r in self._iter())

    def close(self) -> None:
        self.frame = self.rows = None
