"""Relational operators as DataFrame compositions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.windows import keys
from millrace.plans.lineage import checkpoint


def _names(df: DataFrame, *wanted: str) -> list[str]:
    out = []
    for name in wanted:
        while name in df.columns or name in out:
            name += "_"
        out.append(name)
    return out


def join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """All join kinds: ``on`` is a condition, or names for USING; None with ``cross``."""
    return left.crossJoin(right) if how == "cross" else left.join(right, on, how)


def semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time.

    One shuffle: both sides are stacked, sorted within their key, and the last right
    row is carried forward.  Of right rows with one time the greatest by columns counts.
    """
    side, at, seen, held = _names(left, "_side", "_at", "_seen", "_held")
    value = F.struct(*[F.col(c) for c in columns])
    lefts = left.select(*left.columns, F.lit(1).alias(side), F.col(left_time).alias(at), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias(held))
    rights = right.select(*[(F.col(b) if b in by else F.lit(None).cast(left.schema[b].dataType)).alias(b) for b in left.columns], F.lit(0).alias(side), F.col(right_time).alias(at), value.alias(held))
    frame = Window.partitionBy(*by).orderBy(F.col(at), F.col(side), F.col(held)).rowsBetween(Window.unboundedPreceding, 0)
    carried = lefts.unionByName(rights).filter(F.col(at).isNotNull()).withColumn(seen, F.last(held, ignorenulls=True).over(frame))
    out = carried.filter(F.col(side) == 1).select(*left.columns, *[F.col(seen)[c].alias(c) for c in columns])
    timeless = left.filter(F.col(left_time).isNull()).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns])
    return out.unionByName(timeless)


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= point < high by an equality on buckets of ``width``, not a nested loop."""
    (bucket,) = _names(left, "_bucket")
    a = left.withColumn(bucket, F.floor(F.col(point) / width))
    b = right.filter(F.col(low) < F.col(high)).withColumn(bucket, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return a.join(b, (a[bucket] == b[bucket]) & (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(bucket)


#: Values of a block of ``pairs_within``.
PAIR_BLOCK = 4096


def pairs_within(df: DataFrame, by: list[str], value: str, low: str, high: str, block: int = PAIR_BLOCK) -> DataFrame:
    """All pairs of rows with equal ``by`` and rising ``value``: a self join on a < b.

    As many rows as pairs, so quadratic in the size of a group; nulls meet nothing, and
    repeated rows count as often as they occur.  Groups are cut into blocks of ``block``
    values in order, and each pair of blocks is one row of two arrays, dealt evenly to
    tasks whatever the groups' sizes: no task holds more than two blocks at once.
    """
    at, last, other, values, others = "_at", "_last", "_other", "_values", "_others"
    named = df.select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(by)], F.col(value).alias("_v")).dropna()
    group = [f"_k{n}" for n in range(len(by))]
    placed = named.withColumn(at, F.floor((F.row_number().over(Window.partitionBy(*group).orderBy("_v")) - 1) / block))
    blocks = placed.groupBy(*group, at).agg(F.collect_list("_v").alias(values))
    ends = placed.groupBy(*group).agg(F.max(at).alias(last))
    # Each block goes to its pairs with itself and all later ones, and with all earlier ones.
    # A fixed number of partitions isn't coalesced: little data, but much work.
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lower = blocks.join(ends, group).select(*group, at, F.explode(F.sequence(at, last)).alias(other), values)
    upper = blocks.select(*group, F.explode(F.sequence(F.lit(0).cast("long"), at)).alias(at + "l"), F.col(at).alias(other), F.col(values).alias(others))
    upper = upper.withColumnRenamed(at + "l", at)
    cell = [*group, at, other]
    cells = lower.repartition(tasks, *cell).hint("merge").join(upper.repartition(tasks, *cell), cell)
    pairs = cells.select(F.explode(values).alias(low), others).select(low, F.explode(others).alias(high))
    return pairs.filter(F.col(low) < F.col(high))


def salted_join(big: DataFrame, small: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """An equality join whose hot keys are spread over ``salts`` tasks (inner, left, left_semi, left_anti)."""
    (salt,) = _names(big, "_salt")
    a = big.withColumn(salt, F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    b = small.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [*on, salt], how).drop(salt)


def union(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
    both = left.union(right)
    return both if all else both.distinct()


def intersect(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
    return left.intersectAll(right) if all else left.intersect(right)


def except_(left: DataFrame, right: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
    return left.exceptAll(right) if all else left.subtract(right)


def top_k(df: DataFrame, order: list, k: int, offset: int = 0) -> DataFrame:
    """The k first rows after ``offset`` in a total order (no global sort: each task keeps k)."""
    ordered = df.orderBy(*keys(order))
    return (ordered.offset(offset) if offset else ordered).limit(k)


def top_k_per(df: DataFrame, partition: list[str], order: list, k: int) -> DataFrame:
    """The k first rows of each partition; Spark prunes before the shuffle."""
    (n,) = _names(df, "_n")
    w = Window.partitionBy(*partition).orderBy(*keys(order))
    return df.withColumn(n, F.row_number().over(w)).filter(F.col(n) <= k).drop(n)


def pivot(df: DataFrame, group: list[str], on: str | list[str], values: list, aggs: dict[str, Column]) -> DataFrame:
    """``values`` x aggregates as columns named ``<value>_<agg>``, rows by ``group``.

    Explicit grouping: other columns don't split rows.  ``values`` are scalars, or
    tuples for several ``on`` columns, or (value, alias) pairs as dict items.
    """
    on = [on] if isinstance(on, str) else on
    pairs = [("_".join(map(str, v)) if isinstance(v, tuple) else str(v), v) for v in values] if not isinstance(values, dict) else list(values.items())
    cells = list(_cells(pairs, on, aggs))
    wanted = reduce(lambda a, b: a | b, [m for _, m, _ in cells])
    # A small aggregation by group and value first; a value that isn't asked for only keeps its group.
    first = df.withColumns({c: F.when(wanted, F.col(c)) for c in on}).groupBy(*group, *on).agg(*[a.alias(n) for n, a in aggs.items()])
    return first.groupBy(*group).agg(*[F.max(F.when(m, F.col(agg))).alias(n) for n, m, agg in cells])


def _cells(pairs, on, aggs):
    for label, value in pairs:
        parts = value if isinstance(value, tuple) else (value,)
        match = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(on, parts)])
        for name in aggs:
            yield f"{label}_{name}", match, name


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str, include_nulls: bool = False, cast: str | None = None) -> DataFrame:
    """Columns as rows of (ids, name, value); NULLs dropped by default."""
    source = df if cast is None else df.select(*ids, *[F.col(c).cast(cast).alias(c) for c in columns])
    out = source.unpivot([F.col(i) for i in ids], [F.col(c) for c in columns], name, value)
    return out if include_nulls else out.filter(F.col(value).isNotNull())


def recursive(base: DataFrame, step, all: bool = False, bound: int = 100) -> DataFrame:  # noqa: A002
    """Recursive query by semi-naive iteration.

    ``step(frontier)`` gives the next rows.  UNION drops rows already reached, UNION
    ALL keeps them; past ``bound`` rounds with rows left it is an error.  Each round is
    checkpointed, so plans stay short and a lost executor costs one round.
    """
    reached = frontier = checkpoint(base if all else base.distinct())
    for _ in range(bound):
        grown = step(frontier).toDF(*base.columns)
        frontier = checkpoint(grown if all else _unseen(grown.distinct(), reached))
        if frontier.isEmpty():
            return reached
        reached = reached.union(frontier) if all else checkpoint(reached.union(frontier))
    raise RecursionError(f"rows are left after {bound} rounds")


def _unseen(rows: DataFrame, reached: DataFrame) -> DataFrame:
    right = reached.select(*[F.col(c).alias(f"_r_{c}") for c in reached.columns])
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(right[f"_r_{c}"]) for c in rows.columns])
    return rows.join(right, same, "left_anti")


def grouping_sets(df: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """GROUPING SETS; NULL where a key isn't grouped."""
    columns = sorted({c for s in sets for c in s}, key=[c for s in sets for c in s].index)
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(*aggs)
