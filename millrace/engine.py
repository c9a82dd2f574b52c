"""The engine: SQL text in, DataFrames out."""

from __future__ import annotations

import re
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace import __version__
from millrace.operators.relational import recursive
from millrace.plans import sqlfront
from millrace.plans.lineage import shared_dir
from millrace.session import prepare
from millrace.sources import tables
from millrace.sources.store import MaterializedViews, Store

EXTENSIONS = ("csv", "json", "parquet", "sqlite", "httpfs")
_TYPES = {"VARCHAR": "STRING", "TEXT": "STRING", "HUGEINT": "DECIMAL(38,0)", "BLOB": "BINARY", "DATETIME": "TIMESTAMP_NTZ", "TIMESTAMP": "TIMESTAMP_NTZ", "UUID": "STRING", "JSON": "STRING", "INTEGER": "INT", "TIME": "BIGINT"}
_SETTINGS = {"recursion_limit": "spark.sql.cteRecursionLevelLimit", "threads": "spark.sql.shuffle.partitions", "timezone": "spark.sql.session.timeZone", "s3_endpoint": "fs.s3a.endpoint", "s3_region": "fs.s3a.endpoint.region", "s3_access_key_id": "fs.s3a.access.key", "s3_secret_access_key": "fs.s3a.secret.key"}
_SECRETS = {"key_id": "fs.s3a.access.key", "secret": "fs.s3a.secret.key", "region": "fs.s3a.endpoint.region", "endpoint": "fs.s3a.endpoint"}
_NAME = r"(`[^`]+`|\"[^\"]+\"|\w+(?:\.\w+)?)"


class Unsupported(ValueError):
    """A statement that has no counterpart here."""


def _plain(name: str) -> str:
    return name.strip("`\"").split(".")[-1].lower()


class Engine:
    """Tables, views and settings of one database.

    ``sql`` runs every statement of a text and returns the last one's rows.
    """

    def __init__(self, spark: SparkSession, base: str | None = None) -> None:
        self.spark = prepare(spark)
        tables.prepare_sql(spark)
        self.store = Store(spark, base or f"{shared_dir(spark)}/db-{uuid.uuid4().hex}")
        self.texts: dict[str, str] = {}
        self.views = MaterializedViews(self.store, self.sql, self._tables_of)
        self.settings: dict[str, str] = {}
        self.extensions = {e: {"installed": e != "httpfs", "loaded": e != "httpfs"} for e in EXTENSIONS}
        self.indexes: dict[str, str] = {}

    # Entry points

    def sql(self, text: str, args: list | dict | None = None) -> DataFrame:
        out = None
        for statement in sqlfront.statements(text):
            out = self._statement(statement.strip(), args)
        return out if out is not None else self._rows([], "status string")

    def register(self, sf_dir: str, sql: str | None = None) -> Engine:
        tables.register(self.spark, sf_dir, sql)
        return self

    def explain(self, text: str, mode: str = "formatted") -> str:
        df = self.sql(text)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    # Statements

    def _rows(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _count(self, n: int) -> DataFrame:
        return self._rows([(n,)], "count long")

    def _done(self, table: str, n: int) -> DataFrame:
        self.views.changed(table)
        return self._count(n)

    def batches(self, parts, schema: str) -> DataFrame:
        """Rows of Arrow batches that the caller holds, which are of a size that the driver can hold."""
        import pyarrow as pa

        held = list(parts)
        if not held:
            return self._rows([], schema)
        kinds = T._parse_datatype_string(schema)
        return self.spark.createDataFrame(pa.Table.from_batches(held).to_pandas(), kinds)

    def function(self, name: str, fn, returns: str) -> None:
        """Makes a Python function of Series (an Arrow UDF) callable from SQL."""
        from pyspark.sql.functions import pandas_udf

        self.spark.udf.register(name, pandas_udf(fn, returns))

    def _query(self, sql: str, args=None) -> DataFrame:
        parts = sqlfront.recursive_union(sql)
        if parts:
            return self._recursive(*parts)
        text = sqlfront.table_functions(sql, self._relation)
        self._expose(text)
        text = sqlfront.rewrite(text)
        return self.spark.sql(text, args=args) if args is not None else self.spark.sql(text)

    def _tables_of(self, sql: str, seen: frozenset = frozenset()) -> set[str]:
        """Stored tables that a statement reads, by way of views too."""
        words = {w.lower() for w in re.findall(r"\w+", sql)} - seen
        found = words & set(self.store.names()) | {f"mv_{n}" for n in words & set(self.views.defined)}
        for name in words & set(self.texts):
            found |= self._tables_of(self.texts[name], seen | {name})
        return found

    def _expose(self, sql: str, seen: frozenset = frozenset()) -> None:
        """Temp views of what a statement names, each of the newest version."""
        words = {w.lower() for w in re.findall(r"\w+", sql)} - seen
        for name in words & set(self.store.names()):
            self.store.read(name).createOrReplaceTempView(name)
        for name in words & set(self.views.defined):
            if self.views.defined[name]["versions"] is not None:
                self.views.read(name).createOrReplaceTempView(name)
        for name in words & set(self.texts):
            self._expose(self.texts[name], seen | {name})
            self._plan(self.texts[name]).createOrReplaceTempView(name)

    def _plan(self, sql: str) -> DataFrame:
        return self.spark.sql(sqlfront.rewrite(sqlfront.table_functions(sql, self._relation)))

    def _relation(self, kind: str, arguments: list[str]) -> str:
        path = arguments[0]
        df = {
            "read_csv_auto": lambda: tables.read_csv_auto(self.spark, path),
            "read_csv": lambda: tables.read_csv_auto(self.spark, path),
            "read_parquet": lambda: tables.read_parquet(self.spark, path),
            "read_json_auto": lambda: tables.read_json_auto(self.spark, path),
            "read_json": lambda: tables.read_json_auto(self.spark, path),
            "sqlite_scan": lambda: tables.sqlite_scan(self.spark, path, arguments[1]),
        }[kind]()
        name = f"file_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(name)
        return name

    def _recursive(self, name: str, columns: list[str], base: str, step: str, query: str) -> DataFrame:
        start = self._query(base)
        start = start.toDF(*columns) if columns else start

        def grow(frontier: DataFrame) -> DataFrame:
            frontier.createOrReplaceTempView(name)
            return self._query(step)

        recursive(start, grow, bound=int(self.settings.get("recursion_limit", 100))).createOrReplaceTempView(name)
        return self._query(query)

    def _statement(self, s: str, args=None) -> DataFrame:
        head = re.match(r"\w*", s)[0].upper()
        handler = getattr(self, f"_{head.lower()}", None) if head in _HANDLED else None
        return handler(s) if handler else self._query(s, args)

    def _match(self, pattern: str, s: str):
        return re.match(pattern.replace("NAME", _NAME), s, re.IGNORECASE | re.DOTALL)

    def _create(self, s: str) -> DataFrame:
        m = self._match(r"CREATE\s+(OR\s+REPLACE\s+)?MATERIALIZED\s+VIEW\s+(IF\s+NOT\s+EXISTS\s+)?NAME\s+AS\s+(.*)$", s)
        if m:
            self.views.create(_plain(m[3]), m[4], bool(m[1]), bool(m[2]), on_commit=self.settings.get("materialized_view_refresh", "manual").lower() in ("on_commit", "incremental"))
            return self._count(0)
        m = self._match(r"CREATE\s+(OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?VIEW\s+NAME\s+AS\s+(.*)$", s)
        if m:
            self._query(m[3]).createOrReplaceTempView(_plain(m[2]))
            self.texts.pop(_plain(m[2]), None)
            if not sqlfront.recursive_union(m[3]) and self._tables_of(m[3]):
                self.texts[_plain(m[2])] = m[3]  # follows its tables
            return self._count(0)
        m = self._match(r"CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?NAME\s+ON\s+NAME", s)
        if m:
            warnings.warn("indexes have no effect: files are pruned by their statistics", stacklevel=4)
            self.indexes[_plain(m[1])] = _plain(m[2])
            return self._count(0)
        m = self._match(r"CREATE\s+(?:OR\s+REPLACE\s+)?SECRET\s+(?:NAME\s*)?\((.*)\)\s*$", s)
        if m:
            conf = self.spark._jsc.hadoopConfiguration()
            for key, value in re.findall(r"(\w+)\s+'((?:[^']|'')*)'", m[2]):
                if key.lower() in _SECRETS:
                    conf.set(_SECRETS[key.lower()], value.replace("''", "'"))
            return self._rows([("secret set",)], "status string")
        m = self._match(r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?NAME\s+AS\s+(.*)$", s)
        if m:
            df = self._query(m[3])
            if m[1] and self.store.exists(_plain(m[2])):
                return self._count(0)
            self.store.create(_plain(m[2]), T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]))
            return self._count(self.store.insert(_plain(m[2]), df))
        m = self._match(r"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?NAME\s*\((.*)\)\s*$", s)
        if m:
            self.store.create(_plain(m[2]), *self._columns(m[3])[:1], if_not_exists=bool(m[1]), **self._columns(m[3])[1])
            return self._count(0)
        return self._query(s)

    def _columns(self, body: str) -> tuple[T.StructType, dict]:
        fields, defaults, keys, checks = [], {}, [], []
        for item in _split(body):
            m = re.match(r"(?:CONSTRAINT\s+\w+\s+)?(PRIMARY\s+KEY|UNIQUE)\s*\(([^)]*)\)", item, re.IGNORECASE)
            if m:
                keys.append([_plain(c.strip()) for c in m[2].split(",")])
                continue
            m = re.match(r"(?:CONSTRAINT\s+\w+\s+)?CHECK\s*\((.*)\)\s*$", item, re.IGNORECASE | re.DOTALL)
            if m:
                checks.append(m[1])
                continue
            if re.match(r"(?:CONSTRAINT\s+\w+\s+)?FOREIGN\s+KEY", item, re.IGNORECASE):
                warnings.warn("FOREIGN KEY isn't enforced", stacklevel=4)
                continue
            m = re.match(r"(`[^`]+`|\"[^\"]+\"|\w+)\s+(\w+(?:\s*\(\s*\d+\s*(?:,\s*\d+\s*)?\))?)(.*)$", item, re.DOTALL)
            if not m:
                raise ValueError(f"can't read the column {item!r}")
            name, kind, rest = m[1].strip("`\""), m[2], m[3]
            base = re.match(r"\w+", kind)[0].upper()
            if base in ("VARCHAR", "CHAR", "TEXT"):
                kind = "STRING"
            elif base == "DECIMAL" and "(" not in kind:
                kind = "DECIMAL(10,2)"
            else:
                kind = _TYPES.get(kind.upper(), kind)
            upper = rest.upper()
            primary = "PRIMARY KEY" in re.sub(r"\s+", " ", upper)
            fields.append(T.StructField(name, T._parse_datatype_string(kind), not (primary or "NOT NULL" in re.sub(r"\s+", " ", upper))))
            if primary or re.search(r"\bUNIQUE\b", upper):
                keys.append([name])
            d = re.search(r"\bDEFAULT\s+('(?:[^']|'')*'|[\w.+-]+(?:\(\))?)", rest, re.IGNORECASE)
            if d:
                defaults[name] = d[1]
            c = re.search(r"\bCHECK\s*\((.*)\)", rest, re.IGNORECASE | re.DOTALL)
            if c:
                checks.append(c[1])
        return T.StructType(fields), {"defaults": defaults, "keys": keys, "checks": checks}

    def _drop(self, s: str) -> DataFrame:
        m = self._match(r"DROP\s+(MATERIALIZED\s+VIEW|TABLE|VIEW|INDEX)\s+(IF\s+EXISTS\s+)?NAME\s*$", s)
        if not m:
            raise Unsupported(s)
        kind, name = re.sub(r"\s+", " ", m[1].upper()), _plain(m[3])
        if kind == "TABLE":
            self.store.drop(name, bool(m[2]))
            self.spark.catalog.dropTempView(name)
        elif kind == "MATERIALIZED VIEW":
            self.views.drop(name, bool(m[2]))
            self.spark.catalog.dropTempView(name)
        elif kind == "VIEW":
            self.texts.pop(name, None)
            if not self.spark.catalog.dropTempView(name) and not m[2]:
                raise ValueError(f"no view {name}")
        elif self.indexes.pop(name, None) is None and not m[2]:
            raise ValueError(f"no index {name}")
        return self._count(0)

    def _refresh(self, s: str) -> DataFrame:
        m = self._match(r"REFRESH\s+MATERIALIZED\s+VIEW\s+(?:CONCURRENTLY\s+)?NAME\s*$", s)
        if not m:
            raise Unsupported(s)
        return self._count(self.views.refresh(_plain(m[1])))

    def _insert(self, s: str) -> DataFrame:
        m = self._match(r"INSERT\s+INTO\s+NAME\s*(\((?:\s*[\w`\"]+\s*,?)+\))?\s*(DEFAULT\s+VALUES|(?:VALUES|SELECT|WITH|\().*?)\s*(ON\s+CONFLICT\s*(\([^)]*\))?\s*DO\s+(NOTHING|UPDATE)\b(?:\s+SET\s+(.*))?)?$", s)
        if not m:
            raise Unsupported(s)
        name = _plain(m[1])
        columns = [c.strip().strip("`\"") for c in m[2].strip("()").split(",")] if m[2] else None
        if m[3].upper().startswith("DEFAULT"):
            return self._done(name, self.store.insert(name, self.spark.range(1).select(), [], None))
        target = [c.strip().strip("`\"") for c in m[5].strip("()").split(",")] if m[5] else None
        pairs = [p.split("=", 1) for p in _split(m[7])] if m[7] else []
        sets = {k.strip().strip("`\""): sqlfront.rewrite(v.strip()) for k, v in pairs} or None
        return self._done(name, self.store.insert(name, self._query(m[3]), columns, m[6].lower() if m[6] else None, target, sets))

    def _update(self, s: str) -> DataFrame:
        m = self._match(r"UPDATE\s+NAME\s+SET\s+(.*)$", s)
        if not m:
            raise Unsupported(s)
        body, where = _cut(m[2], "WHERE")
        pairs = [re.match(r"\s*([\w`\"]+)\s*=(.*)$", p, re.DOTALL) for p in _split(body)]
        sets = {p[1].strip("`\""): sqlfront.rewrite(p[2].strip()) for p in pairs}
        return self._done(_plain(m[1]), self.store.update(_plain(m[1]), sets, sqlfront.rewrite(where) if where else None))

    def _delete(self, s: str) -> DataFrame:
        m = self._match(r"DELETE\s+FROM\s+NAME\s*(?:WHERE\s+(.*))?$", s)
        if not m:
            raise Unsupported(s)
        return self._done(_plain(m[1]), self.store.delete(_plain(m[1]), sqlfront.rewrite(m[2]) if m[2] else None))

    def _alter(self, s: str) -> DataFrame:
        m = self._match(r"ALTER\s+TABLE\s+NAME\s+(.*)$", s)
        name, action = _plain(m[1]), m[2].strip()
        for pattern, run in (
            (r"ADD\s+(?:COLUMN\s+)?(\w+)\s+(.+)$", lambda x: {"add": {x[1]: _TYPES.get(x[2].strip().upper(), x[2])}}),
            (r"DROP\s+(?:COLUMN\s+)?(\w+)\s*$", lambda x: {"drop": [x[1]]}),
            (r"RENAME\s+TO\s+(\w+)\s*$", lambda x: {"rename_to": x[1]}),
            (r"RENAME\s+(?:COLUMN\s+)?(\w+)\s+TO\s+(\w+)\s*$", lambda x: {"rename": {x[1]: x[2]}}),
        ):
            found = re.match(pattern, action, re.IGNORECASE | re.DOTALL)
            if found:
                self.store.alter(name, **run(found))
                self.spark.catalog.dropTempView(name)
                return self._count(0)
        raise Unsupported(s)

    def _show(self, s: str) -> DataFrame:
        what = re.sub(r"\s+", " ", s.strip()).split(" ")[1:]
        kind = what[0].upper() if what else "TABLES"
        if kind == "TABLES":
            views = {t.name for t in self.spark.catalog.listTables() if t.isTemporary and not t.name.startswith("file_")}
            return self._rows([(n,) for n in sorted(views | set(self.store.names()) | set(self.views.defined))], "name string")
        if kind == "COLUMNS":
            df = self._query(f"SELECT * FROM {what[-1]} LIMIT 0")
            return self._rows([(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields], "name string, type string, nullable boolean")
        if kind == "VARIABLES":
            return self._rows(sorted(self.settings.items()), "name string, value string")
        if kind in ("DATABASES", "SCHEMAS"):
            return self._rows([("main",)], "name string")
        if kind == "INDEXES":
            return self._rows(sorted(self.indexes.items()), "name string, table string")
        raise Unsupported(s)

    def _explain(self, s: str) -> DataFrame:
        m = re.match(r"EXPLAIN\s+(ANALYZE\s+)?(VERBOSE\s+)?(.*)$", s, re.IGNORECASE | re.DOTALL)
        df = self._query(m[3])
        if m[1]:
            df.write.format("noop").mode("overwrite").save()
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "extended" if m[2] else "formatted")
        return self._rows([(plan,)], "plan string")

    def _set(self, s: str) -> DataFrame:
        m = re.match(r"SET\s+(?:GLOBAL\s+|SESSION\s+)?([\w.]+)\s*(?:=|TO)\s*(.*)$", s, re.IGNORECASE | re.DOTALL)
        if not m:
            return self._query(s)
        name, value = m[1].lower(), m[2].strip().strip("'")
        hidden = "secret" in name or "key" in name
        self.settings[name] = "***" if hidden else value
        target = _SETTINGS.get(name, m[1] if name.startswith("spark.") else None)
        if target and target.startswith("spark."):
            self.spark.conf.set(target, value)
        elif target:
            self.spark._jsc.hadoopConfiguration().set(target, value)
        return self._rows([(name, self.settings[name])], "name string, value string")

    def _install(self, s: str) -> DataFrame:
        name = s.split()[1].lower().strip("'\"")
        if name not in self.extensions:
            raise ValueError(f"unknown extension {name}")
        self.extensions[name]["installed"] = True
        return self._rows([(name, "installed")], "name string, status string")

    def _load(self, s: str) -> DataFrame:
        name = s.split()[1].lower().strip("'\"")
        if not self.extensions.get(name, {}).get("installed"):
            raise ValueError(f"extension {name} isn't installed")
        self.extensions[name]["loaded"] = True
        return self._rows([(name, "loaded")], "name string, status string")

    def _begin(self, s: str) -> DataFrame:
        raise Unsupported("transactions: each statement commits by itself, as one atomic change")

    _commit = _rollback = _start = _begin

    def version(self) -> str:
        return __version__


_HANDLED = {"CREATE", "DROP", "REFRESH", "INSERT", "UPDATE", "DELETE", "ALTER", "SHOW", "EXPLAIN", "SET", "INSTALL", "LOAD", "BEGIN", "START", "COMMIT", "ROLLBACK"}


def _split(body: str) -> list[str]:
    """Parts between commas outside brackets and strings."""
    out, held, depth = [], [], 0
    for t in sqlfront.tokens(body):
        depth += (t.text == "(") - (t.text == ")")
        if t.text == "," and depth == 0:
            out.append(sqlfront.text(held).strip())
            held = []
        else:
            held.append(t)
    return [*out, sqlfront.text(held).strip()]


def _cut(body: str, word: str) -> tuple[str, str | None]:
    """What lies before and after a keyword outside brackets."""
    ts, depth = sqlfront.tokens(body), 0
    for i, t in enumerate(ts):
        depth += (t.text == "(") - (t.text == ")")
        if depth == 0 and t.word() == word:
            return sqlfront.text(ts[:i]), sqlfront.text(ts[i + 1 :])
    return body, None
