"""Cutting lineage in storage that all executors share.

Nothing here is kept on one executor: a lost executor costs a re-read, never a
result.  The folder is ``spark.checkpoint.dir`` of the session; only where that
is unset (tests, a laptop) does a local folder of our own take its place.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and working tables that every executor sees."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` into the shared folder."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


_RECORDS: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the working tables that are written inside."""
    paths: list[str] = []
    _RECORDS.append(paths)
    try:
        yield paths
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not paths]


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Deletes working tables that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def working_folder(spark: SparkSession, name: str = "work") -> str:
    """The path of a new working table or of files in its place; recorded, not made."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for paths in _RECORDS:
        paths.append(path)
    return path


def working_table(df: DataFrame, name: str = "work") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again.

    Columnar and compressed, so smaller than a checkpoint; readers prune columns.
    """
    spark = df.sparkSession
    path = working_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
