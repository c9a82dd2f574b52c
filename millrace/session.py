"""Session settings that give the engine's semantics."""

from __future__ import annotations

from pyspark.sql import SparkSession

from millrace.plans.shipping import ship_by_value

#: What the engine's semantics rest on.
SEMANTICS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "millrace", master: str | None = None, shuffle_partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with the engine's settings; a running session is reused."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    conf = dict(SEMANTICS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    spark = builder.config(map=conf).getOrCreate()
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Put the semantic settings on a session that someone else made."""
    for key, value in SEMANTICS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_by_value()
    return spark
