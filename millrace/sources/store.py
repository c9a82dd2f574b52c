"""Managed tables as immutable Parquet folders behind an atomic manifest.

A change never reads and overwrites one path: it writes a new folder, then a manifest
of the next version, whose rename is the commit: of two writers one fails.  INSERT adds
a folder; UPDATE and DELETE write the rewritten rows to a new one.  Old folders stay
for results not read yet until ``vacuum``.  All files go through Hadoop's FileSystem, so the
base may be any shared store.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_MANIFEST = re.compile(r"/_manifest-(\d+)\.json$")


class Conflict(ValueError):
    """Another change of the table was committed first."""


class Store:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    # Files

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self, name: str) -> list[tuple[int, str]]:
        """(version, path) of a table's manifests, the newest last."""
        fs, p = self._fs(f"{self.base}/{name.lower()}")
        if not fs.exists(p):
            return []
        found = [str(s.getPath()) for s in fs.listStatus(p) if s.isFile()]
        return sorted((int(m[1]), f) for f in found if (m := _MANIFEST.search(f)))

    def _read(self, name: str) -> dict | None:
        found = self._versions(name)
        if not found:
            return None
        fs, p = self._fs(found[-1][1])
        with_stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
        finally:
            with_stream.close()
        return json.loads(text)

    def _commit(self, name: str, manifest: dict) -> None:
        """Make ``manifest`` the table's next version; a writer that came second fails."""
        jvm = self.spark._jvm
        fs, target = self._fs(f"{self.base}/{name.lower()}/_manifest-{manifest['version']:012d}.json")
        _, fresh = self._fs(f"{self.base}/{name.lower()}/_new-{uuid.uuid4().hex}.json")
        out = fs.create(fresh)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fresh, target, keep)
        except Exception as error:
            fs.delete(fresh, False)
            if fs.exists(target):
                raise Conflict(f"{name} was changed meanwhile: run the statement again") from error
            raise

    def _forget(self, *parts: str) -> None:
        for part in parts:
            fs, p = self._fs(part)
            fs.delete(p, True)

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Deletes the folders and manifests of all but the last ``keep`` versions; returns the number of folders.

        Results that were asked for and not yet read may rest on older versions, so
        nothing else deletes them.
        """
        found = self._versions(name)
        used = set()
        for _, path in found[-keep:]:
            fs, p = self._fs(path)
            stream = fs.open(p)
            try:
                used |= {x.rsplit("/", 1)[-1] for x in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["parts"]}
            finally:
                stream.close()
        fs, p = self._fs(f"{self.base}/{name.lower()}")
        old = [str(s.getPath()) for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() not in used]
        self._forget(*old, *(path for _, path in found[:-keep]))
        return len(old)

    def _write(self, name: str, df: DataFrame) -> str:
        path = f"{self.base}/{name.lower()}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    # Definition

    def names(self) -> list[str]:
        fs, p = self._fs(self.base)
        if not fs.exists(p):
            return []
        return sorted(n for s in fs.listStatus(p) if s.isDirectory() and not (n := s.getPath().getName()).startswith("_"))

    def exists(self, name: str) -> bool:
        return self._read(name) is not None

    def create(self, name: str, schema: T.StructType | str, if_not_exists: bool = False, defaults: dict[str, str] | None = None, keys: list[list[str]] | None = None, checks: list[str] | None = None) -> None:
        """An empty table; ``keys`` are unique column lists, ``checks`` SQL conditions."""
        if self.exists(name):
            if if_not_exists:
                return
            raise ValueError(f"table {name} exists")
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        self._commit(name, {"schema": schema.jsonValue(), "parts": [], "defaults": defaults or {}, "keys": keys or [], "checks": checks or [], "version": 0})

    def drop(self, name: str, if_exists: bool = False) -> None:
        if not self.exists(name):
            if if_exists:
                return
            raise ValueError(f"no table {name}")
        fs, p = self._fs(f"{self.base}/{name.lower()}")
        fs.delete(p, True)

    def _known(self, name: str) -> dict:
        found = self._read(name)
        if found is None:
            raise ValueError(f"no table {name}")
        return found

    def schema(self, name: str) -> T.StructType:
        return T.StructType.fromJson(self._known(name)["schema"])

    def version(self, name: str) -> int:
        return self._known(name)["version"]

    def read(self, name: str) -> DataFrame:
        found = self._known(name)
        schema = T.StructType.fromJson(found["schema"])
        if not found["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*found["parts"])

    # Change

    def _replace(self, name: str, df: DataFrame, found: dict) -> None:
        part = self._write(name, df)
        try:
            self._commit(name, {**found, "parts": [part], "version": found["version"] + 1})
        except Exception:
            self._forget(part)
            raise

    def _shaped(self, name: str, df: DataFrame, columns: list[str] | None) -> DataFrame:
        """Rows in the table's columns: by name if listed, else by place; defaults fill in."""
        found, schema = self._known(name), self.schema(name)
        if columns is None and len(df.columns) != len(schema):
            raise ValueError("the number of values differs from the number of columns")
        given = dict(zip([c.lower() for c in (columns or schema.names)], df.columns))
        unknown = set(given) - {c.lower() for c in schema.names}
        if unknown:
            raise ValueError(f"no column {sorted(unknown)}")
        out = []
        for f in schema.fields:
            source = given.get(f.name.lower())
            value = F.col(f"`{source}`") if source else F.expr(found["defaults"].get(f.name, "NULL"))
            out.append(value.cast(f.dataType).alias(f.name))
        return df.select(*out)

    def _checked(self, name: str, df: DataFrame) -> None:
        found = self._known(name)
        rules = [f"`{f.name}` IS NOT NULL" for f in self.schema(name).fields if not f.nullable] + found["checks"]
        if rules:
            broken = df.agg(*[F.count(F.when(~F.expr(r), 1)).alias(str(i)) for i, r in enumerate(rules)]).first()
            for rule, n in zip(rules, broken):
                if n:
                    raise ValueError(f"{n} rows break {rule}")

    def _unique(self, name: str, df: DataFrame, keys: list[list[str]]) -> None:
        """Fails where values of a key repeat; rows with a NULL in it don't count."""
        for key in keys:
            if df.dropna(subset=key).groupBy(*key).count().filter("count > 1").limit(1).count():
                raise ValueError(f"values of {key} repeat in {name}")

    def insert(self, name: str, df: DataFrame, columns: list[str] | None = None, on_conflict: str | None = None, target: list[str] | None = None, assignments: dict[str, str] | None = None) -> int:
        """Adds rows and returns their number; ``on_conflict``: None (error), nothing or update.

        ``target`` names the key whose conflicts are handled (the first by default; for
        nothing all of them); a conflict of another key is an error.  An update sets
        ``assignments`` (SQL, where EXCLUDED is the new row), or all columns.
        """
        found = self._known(name)
        part = self._write(name, self._shaped(name, df, columns))
        try:
            n, parts = self._added(name, found, part, on_conflict, target, assignments)
            self._commit(name, {**found, "parts": parts, "version": found["version"] + 1})
        except Exception:
            self._forget(part)
            raise
        if part not in parts:
            self._forget(part)
        return n

    def _added(self, name: str, found: dict, part: str, on_conflict: str | None, target: list[str] | None, assignments: dict[str, str] | None) -> tuple[int, list[str]]:
        """(rows added or changed, the parts of the next version)."""
        schema = T.StructType.fromJson(found["schema"])
        fresh, there = self.spark.read.schema(schema).parquet(part), self.read(name)
        self._checked(name, fresh)
        self._unique("the new rows", fresh, found["keys"])
        wanted = {c.lower() for c in target} if target else None
        handled = [k for k in found["keys"] if wanted is None or {c.lower() for c in k} == wanted]
        if wanted and not handled:
            raise ValueError(f"no key of columns {target}")
        handled = [] if on_conflict is None else handled[:1] if on_conflict == "update" else handled
        for key in found["keys"]:
            if key not in handled and on_conflict != "update" and fresh.dropna(subset=key).join(there, key, "left_semi").limit(1).count():
                raise ValueError(f"a value of {key} exists")
        if not handled:
            return fresh.count(), [*found["parts"], part]
        if on_conflict == "nothing":
            for key in handled:
                fresh = fresh.join(there.select(*key), key, "left_anti").select(*schema.names)
            rest = self._write(name, fresh)
            return self.spark.read.schema(schema).parquet(rest).count(), [*found["parts"], rest]
        key, columns = handled[0], [f"`{c}`" for c in schema.names]
        by = {k.lower(): v for k, v in (assignments or {c: f"EXCLUDED.`{c}`" for c in schema.names}).items()}
        given = fresh.select(F.lit(True).alias("_excluded"), *[F.col(c).alias(f"_excluded_{f}") for c, f in zip(columns, schema.names)])
        met = there.alias(name.lower()).join(given, [F.col(f"{name.lower()}.`{k}`") == F.col(f"`_excluded_{k}`") for k in key], "left")
        values = [(F.when(F.col("_excluded"), F.expr(_excluded(by[f.name.lower()], schema.names)).cast(f.dataType)).otherwise(F.col(f"{name.lower()}.`{f.name}`")) if f.name.lower() in by else F.col(f"{name.lower()}.`{f.name}`")).alias(f.name) for f in schema.fields]
        merged = met.select(*values).unionByName(fresh.join(there.select(*key), key, "left_anti").select(*schema.names))
        rest = self._write(name, merged)
        try:
            out = self.spark.read.schema(schema).parquet(rest)
            self._checked(name, out)
            self._unique(name, out, found["keys"])
        except Exception:
            self._forget(rest)
            raise
        return fresh.count(), [rest]

    def update(self, name: str, assignments: dict[str, Column | str], where: Column | str | None = None) -> int:
        """Sets columns of the rows for which ``where`` is true; returns their number."""
        found, df = self._known(name), self.read(name)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where if where is not None else F.lit(True), F.lit(False))
        by = {k.lower(): F.expr(v) if isinstance(v, str) else v for k, v in assignments.items()}
        unknown = set(by) - {c.lower() for c in df.columns}
        if unknown:
            raise ValueError(f"no column {sorted(unknown)}")
        n = df.filter(hit).count()
        out = df.select(*[(F.when(hit, by[f.name.lower()].cast(f.dataType)).otherwise(F.col(f.name)) if f.name.lower() in by else F.col(f.name)).alias(f.name) for f in df.schema.fields])
        if n:
            self._checked(name, out)
            self._unique(name, out, [k for k in found["keys"] if {c.lower() for c in k} & set(by)])
            self._replace(name, out, found)
        return n

    def delete(self, name: str, where: Column | str | None = None) -> int:
        found, df = self._known(name), self.read(name)
        hit = F.coalesce(F.expr(where) if isinstance(where, str) else where if where is not None else F.lit(True), F.lit(False))
        n = df.filter(hit).count()
        if n:
            self._replace(name, df.filter(~hit), found)
        return n

    def alter(self, name: str, add: dict[str, str] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None, rename_to: str | None = None) -> None:
        found, df = self._known(name), self.read(name)
        for column, kind in (add or {}).items():
            df = df.withColumn(column, F.lit(None).cast(kind))
        df = df.drop(*(drop or [])).withColumnsRenamed(rename or {})
        found["schema"] = df.schema.jsonValue()
        if rename_to:
            if self.exists(rename_to):
                raise ValueError(f"table {rename_to} exists")
            found["parts"] = [self._write(rename_to, df)]
            self._commit(rename_to, found)
            self.drop(name)
        else:
            self._replace(name, df, found)


def _excluded(expression: str, names: list[str]) -> str:
    """SQL with EXCLUDED.column as the columns that carry the new row."""
    by = {n.lower(): n for n in names}
    pattern = r"('(?:[^']|'')*')|\bEXCLUDED\s*\.\s*(?:`([^`]+)`|\"([^\"]+)\"|(\w+))"

    def turn(m: re.Match) -> str:
        return m[1] or "`_excluded_" + by[(m[2] or m[3] or m[4]).lower()] + "`"

    return re.sub(pattern, turn, expression, flags=re.IGNORECASE)


class MaterializedViews:
    """Saved query results with refresh metadata.

    Stale on creation and whenever a table they read, by way of views too, has another
    version than at the last refresh.  Definitions are kept in the store.  A view that
    is refreshed ``on_commit`` follows each change of its tables.
    """

    def __init__(self, store: Store, run, tables_of) -> None:
        self.store, self.run, self.tables_of = store, run, tables_of
        self.defined: dict[str, dict] = {}
        known = store._read("_views")
        if known:
            self.defined = known["views"]
        self.version = known["version"] if known else 0

    def _save(self) -> None:
        self.version += 1
        self.store._commit("_views", {"views": self.defined, "version": self.version, "parts": []})

    def create(self, name: str, query: str, or_replace: bool = False, if_not_exists: bool = False, depends: list[str] | None = None, on_commit: bool = False) -> None:
        name = name.lower()
        if name in self.defined and not or_replace:
            if if_not_exists:
                return
            raise ValueError(f"materialized view {name} exists")
        if name in self.defined:
            self.drop(name)
        used = depends if depends is not None else sorted(self.tables_of(query))
        self.defined[name] = {"query": query, "depends": used, "versions": None, "refreshed": None, "rows": None, "on_commit": on_commit}
        self._save()

    def changed(self, table: str) -> None:
        """Refreshes the views that follow ``table``."""
        for name, view in list(self.defined.items()):
            if view["on_commit"] and table.lower() in view["depends"]:
                self.refresh(name)

    def stale(self, name: str) -> bool:
        view = self.defined[name.lower()]
        return view["versions"] is None or view["versions"] != {t: self.store.version(t) for t in view["depends"]}

    def refresh(self, name: str) -> int:
        """Runs the query into a new version, swaps it in, and returns its rows."""
        import time

        view = self.defined[name.lower()]
        versions = {t: self.store.version(t) for t in view["depends"]}
        df = self.run(view["query"])
        target = f"mv_{name.lower()}"
        if self.store.exists(target) and self.store.schema(target) == df.schema:
            self.store._replace(target, df, self.store._known(target))
        else:
            self.store.drop(target, if_exists=True)
            self.store.create(target, df.schema)
            self.store.insert(target, df)
        view.update(versions=versions, refreshed=time.time(), rows=self.store.read(target).count())
        self._save()
        return view["rows"]

    def read(self, name: str) -> DataFrame:
        if self.defined[name.lower()]["versions"] is None:
            raise ValueError(f"materialized view {name} was never refreshed")
        return self.store.read(f"mv_{name.lower()}")

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name.lower() not in self.defined:
            if if_exists:
                return
            raise ValueError(f"no materialized view {name}")
        del self.defined[name.lower()]
        self._save()
        self.store.drop(f"mv_{name.lower()}", if_exists=True)
