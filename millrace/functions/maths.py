"""Mathematical functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def _real(fn):
    def build(x) -> Column:
        return fn(_c(x).cast("double"))

    return build


abs = lambda x: F.abs(_c(x))  # noqa: E731, A001
sqrt = _real(F.sqrt)
exp = _real(F.exp)
ln = _real(F.ln)
log10 = _real(F.log10)
#: One argument: base 10.
log = log10
log2 = _real(F.log2)
sin, cos, tan = _real(F.sin), _real(F.cos), _real(F.tan)
asin, acos, atan = _real(F.asin), _real(F.acos), _real(F.atan)
degrees, radians = _real(F.degrees), _real(F.radians)


def sign(x) -> Column:
    """-1, 0 or 1."""
    return F.signum(_c(x)).cast("int")


def power(x, y) -> Column:
    return F.pow(_c(x).cast("double"), _c(y).cast("double"))


pow = power  # noqa: A001


def ceil(x) -> Column:
    return F.ceil(_c(x)).cast("double")


ceiling = ceil


def floor(x) -> Column:
    return F.floor(_c(x)).cast("double")


def round(x, places: int = 0) -> Column:  # noqa: A001
    """Half away from zero; places may be negative."""
    return F.round(_c(x), places)


def trunc(x, places: int = 0) -> Column:
    """Towards zero."""
    x, scale = _c(x).cast("double"), float(10**places)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def atan2(y, x) -> Column:
    return F.atan2(_c(y).cast("double"), _c(x).cast("double"))


def pi() -> Column:
    return F.pi()


def random(seed: int | None = None) -> Column:
    return F.rand(seed) if seed is not None else F.rand()


def mod(a, b) -> Column:
    """Truncated remainder; a zero divisor is an error."""
    return _c(a) % _c(b)


def int_div(a, b) -> Column:
    """Integer quotient towards zero."""
    a, b = _c(a), _c(b)
    q = F.abs(a) / F.abs(b)
    return (F.signum(a) * F.signum(b) * F.floor(q)).cast("long")


def bit_and(a, b) -> Column:
    return _c(a).bitwiseAND(_c(b))


def bit_or(a, b) -> Column:
    return _c(a).bitwiseOR(_c(b))


def bit_xor(a, b) -> Column:
    return _c(a).bitwiseXOR(_c(b))


def shift_left(a, n: int) -> Column:
    return F.shiftleft(_c(a), n)


def shift_right(a, n: int) -> Column:
    return F.shiftright(_c(a), n)
