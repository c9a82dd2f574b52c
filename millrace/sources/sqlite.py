"""A Python data source over sqlite3, partitioned by ranges of rowid."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def affinity(declared: str):
    """Spark type by SQLite's rules of type affinity."""
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if not d or "BLOB" in d:
        return BinaryType() if d else StringType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return DoubleType()
    return StringType()


#: SQLite's types of cells that a column can give without loss.
_FITTING = {LongType: "'integer','null'", DoubleType: "'integer','real','null'", StringType: "'text','integer','real','null','blob'", BinaryType: "'blob','text','null'"}


class Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__(low)
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        import sqlite3
        from contextlib import closing

        with closing(sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)) as db:
            found = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
            if not found:
                raise ValueError(f"no table {self.options['table']}")
            # Cells may be of another type than their column: a column that holds such is text.
            table = quoted(self.options["table"])
            odd = ", ".join(f"max(typeof({quoted(r[1])}) NOT IN ({_FITTING[type(affinity(r[2]))]}))" for r in found)
            mixed = db.execute(f"SELECT {odd} FROM {table}").fetchone()
        return StructType([StructField(r[1], StringType() if m else affinity(r[2])) for r, m in zip(found, mixed)])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = schema.names
        self.kinds = [f.dataType.typeName() for f in schema.fields]
        self.path, self.table = options["path"], options["table"]
        self.pieces = max(1, int(options.get("partitions", "4")))

    def partitions(self) -> list[Rows]:
        import sqlite3
        from contextlib import closing

        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Rows(0, 0)]
        step = -(-(high - low + 1) // self.pieces)
        return [Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        import sqlite3
        from contextlib import closing

        turn = {"long": int, "double": float, "string": lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v), "binary": lambda v: v.encode() if isinstance(v, str) else bytes(v)}
        casts = [turn[k] for k in self.kinds]
        names = ", ".join(map(quoted, self.columns))
        with closing(sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)) as db:
            for row in db.execute(f"SELECT {names} FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high)):
                yield tuple(None if v is None else f(v) for f, v in zip(casts, row))
