"""Window functions and frames, GROUPS included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def keys(order: list[tuple[str, bool]] | list[str]) -> list[Column]:
    """Sort keys of (column, ascending): NULLs last ascending, first descending."""
    out = []
    for item in order:
        name, up = (item, True) if isinstance(item, str) else item
        out.append(F.col(name).asc_nulls_last() if up else F.col(name).desc_nulls_first())
    return out


def over(partition: list[str], order: list, rows: tuple[int, int] | None = None, range: tuple | None = None) -> WindowSpec:  # noqa: A002
    spec = Window.partitionBy(*partition).orderBy(*keys(order))
    if rows is not None:
        return spec.rowsBetween(*rows)
    return spec.rangeBetween(*range) if range is not None else spec


def groups(df: DataFrame, fn: Column, partition: list[str], order: list, start: int, end: int, name: str) -> DataFrame:
    """``fn`` over a GROUPS frame: peers are numbered, then a RANGE frame on the number."""
    number = "_peers"
    while number in df.columns:
        number += "_"
    ranked = df.withColumn(number, F.dense_rank().over(over(partition, order)))
    frame = Window.partitionBy(*partition).orderBy(number).rangeBetween(start, end)
    return ranked.withColumn(name, fn.over(frame)).drop(number)


def row_number() -> Column:
    return F.row_number().cast("long")


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition on window functions holds."""
    name = "_qualified"
    while name in df.columns:
        name += "_"
    return df.withColumn(name, condition).filter(F.col(name)).drop(name)
