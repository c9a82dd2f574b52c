"""Date and time functions as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000
_TOKENS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DDD": "DDD", "DD": "dd", "HH24": "HH", "HH12": "hh", "HH": "HH", "MI": "mm", "SS": "ss"}
_PERCENT = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a", "f": "SSSSSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": ""}


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def current_date() -> Column:
    return F.current_date()


def current_time() -> Column:
    """Microseconds since midnight, UTC."""
    return F.unix_micros(F.current_timestamp()) % DAY_MICROS


def now() -> Column:
    return F.current_timestamp()


current_timestamp = now


def extract(field: str, x) -> Column:
    """A field as BIGINT; dow counts from Sunday = 0, weeks are ISO, epoch is in seconds."""
    x, f = _c(x), field.lower()
    parts = {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "second": F.second, "doy": F.dayofyear, "week": F.weekofyear, "quarter": F.quarter}
    if f == "dow":
        return (F.dayofweek(x) - 1).cast("long")
    if f == "epoch":
        return epoch(x)
    if f not in parts:
        raise ValueError(f"unknown field {field}")
    return parts[f](x).cast("long")


date_part = extract
for _name in ("year", "month", "day", "hour", "minute", "second", "quarter", "week"):
    globals()[_name] = (lambda f: lambda x: extract(f, x))(_name)


def dayofweek(x) -> Column:
    """Sunday = 1."""
    return F.dayofweek(_c(x)).cast("long")


def dayofyear(x) -> Column:
    return extract("doy", x)


def date_trunc(field: str, x) -> Column:
    return F.date_trunc(field, _c(x))


def date_add(x, days) -> Column:
    """A date stays a date; use ``timestamp_add`` to keep the time of day."""
    return F.date_add(_c(x), days if isinstance(days, Column) else F.lit(days))


def date_sub(x, days) -> Column:
    return F.date_sub(_c(x), days if isinstance(days, Column) else F.lit(days))


def timestamp_add(x, days) -> Column:
    return _c(x) + F.make_dt_interval(days if isinstance(days, Column) else F.lit(days))


def date_diff(end, start) -> Column:
    """Days between dates."""
    return F.datediff(_c(end), _c(start)).cast("long")


def elapsed_days(end, start) -> Column:
    """Whole 24-hour periods between timestamps."""
    micros = F.unix_micros(_c(end).cast("timestamp")) - F.unix_micros(_c(start).cast("timestamp"))
    return (F.signum(micros) * F.floor(F.abs(micros) / DAY_MICROS)).cast("long")


_STAMPS = ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd")
_DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy")


def to_timestamp(s) -> Column:
    """The first of several formats that fits, else NULL."""
    return F.coalesce(*[F.try_to_timestamp(_c(s), F.lit(f)) for f in _STAMPS])


def to_date(s) -> Column:
    return F.coalesce(*[F.try_to_timestamp(_c(s), F.lit(f)) for f in _DATES]).cast("date")


def make_date(y, m, d) -> Column:
    return F.make_date(_c(y), _c(m), _c(d))


def make_timestamp(y, mo, d, h, mi, s) -> Column:
    return F.make_timestamp(*map(_c, (y, mo, d, h, mi, s)))


def epoch(x) -> Column:
    """Whole seconds since 1970."""
    return F.unix_seconds(_c(x).cast("timestamp"))


def epoch_ms(x) -> Column:
    return F.unix_millis(_c(x).cast("timestamp"))


def age(a, b) -> Column:
    """Whole seconds from ``b`` to ``a``."""
    return epoch(a) - epoch(b)


def last_day(x) -> Column:
    return F.last_day(_c(x))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'" if text else ""


def char_pattern(fmt: str) -> str:
    """Spark's pattern for YYYY, MM, DD, HH24, MI, SS; other letters stand for themselves."""
    out, plain, i, names = "", "", 0, sorted(_TOKENS, key=len, reverse=True)
    while i < len(fmt):
        token = next((t for t in names if fmt.startswith(t, i)), None)
        if token:
            out, plain, i = out + _literal(plain) + _TOKENS[token], "", i + len(token)
        else:
            plain, i = plain + fmt[i], i + 1
    return out + _literal(plain)


def percent_pattern(fmt: str) -> str:
    """Spark's pattern for C's percent tokens."""
    out, plain, i = "", "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in _PERCENT:
                raise ValueError(f"unknown token %{fmt[i + 1]}")
            if fmt[i + 1] == "%":
                plain += "%"
            else:
                out, plain = out + _literal(plain) + _PERCENT[fmt[i + 1]], ""
            i += 2
        else:
            plain, i = plain + fmt[i], i + 1
    return out + _literal(plain)


def to_char(x, fmt: str) -> Column:
    return F.date_format(_c(x), char_pattern(fmt))


def strftime(x, fmt: str) -> Column:
    return F.date_format(_c(x), percent_pattern(fmt))


def strptime(s, fmt: str) -> Column:
    return F.to_timestamp(_c(s), percent_pattern(fmt))


def try_strptime(s, fmt: str) -> Column:
    return F.try_to_timestamp(_c(s), F.lit(percent_pattern(fmt)))


def isfinite(x) -> Column:
    return F.when(_c(x).isNotNull(), F.lit(True))


def time_bucket(seconds: int, x) -> Column:
    """Start of the bucket of so many seconds since 1970."""
    width = seconds * 1_000_000
    micros = F.unix_micros(_c(x).cast("timestamp"))
    return F.timestamp_micros((micros - F.pmod(micros, F.lit(width))).cast("long"))
