"""Tables of a folder, file relations and the SQL names Spark lacks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: SQL functions of other engines, inlined by the analyzer (no Python involved).
SQL_FUNCTIONS = {
    "strpos": ("s STRING, n STRING", "INT", "instr(s, n)"),
    "starts_with": ("s STRING, p STRING", "BOOLEAN", "startswith(s, p)"),
    "ends_with": ("s STRING, p STRING", "BOOLEAN", "endswith(s, p)"),
    "regexp_matches": ("s STRING, p STRING", "BOOLEAN", "regexp_like(s, p)"),
    "regexp_full_match": ("s STRING, p STRING", "BOOLEAN", "regexp_like(s, '^(?:' || p || ')$')"),
    "is_null": ("s STRING", "BOOLEAN", "s IS NULL"),
    "trunc_number": ("x DOUBLE, d INT", "DOUBLE", "signum(x) * floor(abs(x) * power(10, d)) / power(10, d)"),
    "sql_quote": ("s STRING", "STRING", "coalesce('''' || replace(s, '''', '''''') || '''', 'NULL')"),
    "time_bucket": ("n BIGINT, t TIMESTAMP", "TIMESTAMP", "timestamp_micros(unix_micros(t) - pmod(unix_micros(t), n * 1000000))"),
    "epoch": ("t TIMESTAMP", "BIGINT", "unix_seconds(t)"),
    "epoch_ms": ("t TIMESTAMP", "BIGINT", "unix_millis(t)"),
    "age": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "unix_seconds(a) - unix_seconds(b)"),
    "base64_encode": ("s STRING", "STRING", "base64(encode(s, 'UTF-8'))"),
    "base64_decode": ("s STRING", "STRING", "decode(unbase64(s), 'UTF-8')"),
    "sha256": ("s STRING", "STRING", "sha2(s, 256)"),
    "string_split": ("s STRING, d STRING", "ARRAY<STRING>", "split(s, CASE WHEN d = '' THEN '' ELSE '\\\\Q' || d || '\\\\E' END)"),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, sql: str | None = None) -> None:
    """Temp views of a folder's tables; with ``sql`` only of those it names."""
    used = NAMES if sql is None else [n for n in NAMES if re.search(rf"\b{n}\b", sql, re.IGNORECASE)]
    for name in used:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


_READY = "millrace.sql.ready"


def prepare_sql(spark: SparkSession) -> None:
    """Register the extra SQL names on a session, once."""
    if spark.conf.get(_READY, None) == "true":
        return
    from millrace.functions.similarity import UDFS

    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    for name, fn in UDFS.items():
        spark.udf.register(name, fn)
    spark.conf.set(_READY, "true")


def read_csv_auto(spark: SparkSession, path: str, infer: bool = False, multiline: bool = True) -> DataFrame:
    """CSV with a header; text columns, '' as NULL (``infer``: types from the data).

    Quotes in quoted fields are doubled.  Fields may hold line breaks, so a file is read
    by one task; ``multiline=False`` says that none does, and large files are split.
    The last setting keeps a NUL before a quote, which is that setting's default.
    """
    return spark.read.csv(path, header=True, inferSchema=infer, nullValue="", emptyValue="", quote='"', escape='"', charToEscapeQuoteEscaping='"', multiLine=multiline)


def read_json_auto(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array, or one object a line; numbers are BIGINT or DOUBLE."""
    head = spark.read.text(path, wholetext=False).limit(1).collect()
    array = bool(head) and head[0][0].lstrip().startswith("[")
    return spark.read.json(path, multiLine=array)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def sqlite_scan(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    """A table of a SQLite file, read in ranges of rowid by the ``sqlite`` data source."""
    from millrace.sources.sqlite import SqliteSource

    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite").options(path=path, table=table, partitions=str(partitions)).load()


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: list[str] | None = None) -> None:  # noqa: A002
    """CSV (with header; white space around values stays), JSON or Parquet."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if format == "csv":
        writer.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif format in ("json", "parquet", "orc"):
        writer.format(format).save(path)
    else:
        raise ValueError(f"unknown format {format}")
