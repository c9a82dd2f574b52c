"""List, map, struct and variant functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def list_contains(xs, x) -> Column:
    return F.array_contains(_c(xs), x)


def list_position(xs, x) -> Column:
    return F.array_position(_c(xs), x)


def list_extract(xs, i: int) -> Column:
    """1-based; NULL outside."""
    return F.try_element_at(_c(xs), F.lit(i))


array_extract = list_extract


def list_zip(*xs) -> Column:
    return F.arrays_zip(*map(_c, xs))


def list_where(xs, mask) -> Column:
    """Elements whose mask is true."""
    kept = F.filter(F.arrays_zip(_c(xs).alias("x"), _c(mask).alias("m")), lambda p: p["m"])
    return F.transform(kept, lambda p: p["x"])


def list_select(xs, places) -> Column:
    return F.transform(_c(places), lambda i: F.try_element_at(_c(xs), i))


def list_resize(xs, n: int, fill=None) -> Column:
    xs = _c(xs)
    more = F.array_repeat(F.lit(fill), F.greatest(F.lit(n) - F.size(xs), F.lit(0)))
    return F.slice(F.concat(xs, more), 1, n)


def map_contains(m, k) -> Column:
    return F.map_contains_key(_c(m), k)


def struct_pack(**fields) -> Column:
    return F.struct(*[_c(v).alias(k) for k, v in fields.items()])


def struct_extract(s, name: str) -> Column:
    return _c(s).getField(name)


def variant_extract(v, path: str, kind: str) -> Column:
    return F.variant_get(_c(v), path, kind)


def json_extract(s, path: str) -> Column:
    return F.get_json_object(_c(s), path)
