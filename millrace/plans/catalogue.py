"""The catalogue: query name -> callable, and its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import sqlfront
from millrace.plans.queries_api import API
from millrace.plans.queries_engine import ENGINE
from millrace.plans.queries_sql import SQL
from millrace.session import prepare
from millrace.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _from_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        tables.prepare_sql(spark)
        tables.register(spark, sf_dir, text)
        if sqlfront.recursive_union(text):
            from millrace.engine import Engine

            return Engine(spark).sql(text)
        return spark.sql(sqlfront.rewrite(text))

    return run


def _from_api(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    return run


for _name, (_spark, _duck) in SQL.items():
    QUERIES[_name] = _from_sql(_spark)
    ORACLE[_name] = _duck or _spark
for _name, (_fn, _duck) in (API | ENGINE).items():
    QUERIES[_name] = _from_api(_fn)
    if _duck:
        ORACLE[_name] = _duck
