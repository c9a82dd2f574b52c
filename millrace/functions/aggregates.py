"""Aggregate functions as Column builders, NULLs skipped, standard definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def count(x=None) -> Column:
    return F.count(F.lit(1)) if x is None else F.count(_c(x))


def _one(fn):
    return lambda x: fn(_c(x))


def _two(fn):
    return lambda y, x: fn(_c(y), _c(x))


sum, avg, min, max = _one(F.sum), _one(F.avg), _one(F.min), _one(F.max)  # noqa: A001
stddev = stddev_samp = _one(F.stddev_samp)
stddev_pop = _one(F.stddev_pop)
variance = var_samp = _one(F.var_samp)
var_pop = _one(F.var_pop)
median = _one(F.median)
covar_pop, covar_samp, corr = _two(F.covar_pop), _two(F.covar_samp), _two(F.corr)
covar = covar_samp
bool_and, bool_or = _one(F.bool_and), _one(F.bool_or)
regr_count, regr_slope, regr_intercept, regr_r2 = _two(F.regr_count), _two(F.regr_slope), _two(F.regr_intercept), _two(F.regr_r2)
count_distinct, sum_distinct, any_value = _one(F.count_distinct), _one(F.sum_distinct), _one(F.any_value)


def mode(x) -> Column:
    """The most frequent value; of several the least."""
    return F.mode(_c(x), deterministic=True)


def approx_count_distinct(x, rsd: float = 0.02) -> Column:
    return F.approx_count_distinct(_c(x), rsd)


def approx_quantile(x, q: float = 0.5, accuracy: int = 10_000) -> Column:
    return F.approx_percentile(_c(x), F.lit(q), F.lit(accuracy))


def percentile_cont(x: str, p: float = 0.5) -> Column:
    return F.expr(f"percentile_cont({p}) WITHIN GROUP (ORDER BY {x})")


def percentile_disc(x: str, p: float = 0.5) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {x})")


def string_agg(x, by, separator: str = ", ") -> Column:
    """Values joined in the order of ``by`` (needed: arrival order isn't defined)."""
    ordered = F.array_sort(F.collect_list(F.when(_c(x).isNotNull(), F.struct(_c(by).alias("k"), _c(x).cast("string").alias("v")))))
    return F.when(F.count(_c(x)) > 0, F.array_join(F.transform(ordered, lambda e: e["v"]), separator))


def first(x, by) -> Column:
    """First value that isn't NULL in the order of ``by``."""
    return F.min_by(_c(x), F.when(_c(x).isNotNull(), _c(by)))


def last(x, by) -> Column:
    return F.max_by(_c(x), F.when(_c(x).isNotNull(), _c(by)))


def arg_min(x, by) -> Column:
    return F.min_by(_c(x), _c(by))


def arg_max(x, by) -> Column:
    return F.max_by(_c(x), _c(by))


def filtered(fn, x, condition: Column) -> Column:
    """``fn(x) FILTER (WHERE condition)``."""
    return fn(F.when(condition, _c(x)))
