import sqlite3

import pytest

from millrace.engine import Engine
from millrace.sources import tables


def test_csv_json_parquet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, None, 2.5)], "id int, s string, x double")
    for kind in ("csv", "json", "parquet", "orc"):
        tables.write(df, str(tmp_path / kind), kind)
    csv = tables.read_csv_auto(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, csv.collect())) == [("1", "a,b", None), ("2", None, "2.5")]
    assert dict(tables.read_csv_auto(spark, str(tmp_path / "csv"), infer=True).dtypes)["id"] == "int"
    assert sorted((r.id, r.s, r.x) for r in tables.read_json_auto(spark, str(tmp_path / "json")).collect()) == [(1, "a,b", None), (2, None, 2.5)]
    (tmp_path / "array.json").write_text('[{"id": 1, "n": {"k": [1, 2]}},\n {"id": 2}]')
    assert tables.read_json_auto(spark, str(tmp_path / "array.json")).count() == 2
    e = Engine(spark)
    got = e.sql(f"SELECT a.id, b.s FROM read_parquet('{tmp_path}/parquet') a JOIN read_csv_auto('{tmp_path}/csv') b ON a.id = CAST(b.id AS INT) WHERE a.x > 1")
    assert [tuple(r) for r in got.collect()] == [(2, None)]
    with pytest.raises(ValueError):
        tables.write(df, str(tmp_path / "no"), "xml")


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "my t" (id INTEGER PRIMARY KEY, name TEXT, x REAL, b BLOB, n NUMERIC)')
        db.executemany('INSERT INTO "my t" VALUES (?, ?, ?, ?, ?)', [(i, f"n{i}" if i % 3 else None, i / 2, bytes([i % 256]), i) for i in range(1, 301)])
        db.execute("CREATE TABLE bare (a INT)")
    df = tables.sqlite_scan(spark, path, "my t", partitions=7)
    assert df.rdd.getNumPartitions() == 7 and df.count() == 300
    assert [f.dataType.typeName() for f in df.schema.fields] == ["long", "string", "double", "binary", "double"]
    assert df.filter("name IS NULL").count() == 100 and df.agg({"id": "sum"}).first()[0] == 45150
    assert tables.sqlite_scan(spark, path, "bare").count() == 0
    assert Engine(spark).sql(f"SELECT max(x) FROM sqlite_scan('{path}', 'my t')").first()[0] == 150.0


def test_store_survives_a_new_engine(spark, tmp_path):
    base = f"file://{tmp_path}/db"
    a = Engine(spark, base)
    a.sql("CREATE TABLE kept (id BIGINT, d DECIMAL, t TIMESTAMP); INSERT INTO kept VALUES (1, 2.5, TIMESTAMP_NTZ '2024-01-01 00:00:00')")
    b = Engine(spark, base)
    assert str(b.sql("SELECT d FROM kept").first()[0]) == "2.50" and b.store.version("kept") == 1


def test_streaming_windows(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from millrace.streaming import windows as W

    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    aggs = {"n": F.count(F.lit(1))}
    for fn, extra in ((W.tumbling, ["10 minutes"]), (W.sliding, ["10 minutes", "5 minutes"]), (W.sessions, ["2 minutes"])):
        stream = fn(live, "ts", *extra, ["event_type"], aggs)
        name = f"out_{fn.__name__}"
        q = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        batch = fn(events, "ts", *extra, ["event_type"], aggs)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, batch.collect()))
    seen = []
    W.refresh_on_arrival(live, str(tmp_path / "cp"), lambda df, n: seen.append(df.count())).awaitTermination()
    assert sum(seen) == events.count()
    assert W.distinct_within(events, "ts", "1 hour", ["event_type"]).count() == events.select("event_type").distinct().count()


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'x "q" y'), (2, "two\nlines"), (3, "a,b")], "id int, s string")
    tables.write(df.coalesce(1), str(tmp_path / "csv"), "csv")
    assert sorted(map(tuple, tables.read_csv_auto(spark, str(tmp_path / "csv")).collect())) == [("1", 'x "q" y'), ("2", "two\nlines"), ("3", "a,b")]


def test_sqlite_cells_of_other_types(spark, tmp_path):
    path = str(tmp_path / "b.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, n INTEGER, x REAL)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(1, 5, 1.5), (2, "many", 2), (3, None, None)])
    assert sorted(map(tuple, tables.sqlite_scan(spark, path, "t").collect())) == [(1, "5", 1.5), (2, "many", 2.0), (3, None, None)]


def test_csv_keeps_white_space_and_controls(spark, tmp_path):
    from millrace.plans.catalogue import QUERIES

    texts = [" a", "a\t ", "\n", "\r\n x", " ", 'q"\0', "\0", "\x1f", "a\rb", '",\n"', "", None]
    langs = [" en", "en ", "", None]
    rows = [(i, t, langs[i % 4]) for i, t in enumerate(texts)]
    for t in tables.NAMES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["read_csv_auto"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(i, t or None, lang) for i, t, lang in rows]
