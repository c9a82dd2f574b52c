import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import datetimes as D
from millrace.functions import maths as M
from millrace.functions import nested as N
from millrace.functions import similarity as SIM
from millrace.functions import strings as S


@pytest.fixture(scope="module")
def value(spark):
    return lambda c: spark.range(1).select(c.alias("v")).first().v


L = F.lit


def test_strings(value):
    assert value(S.translate(L("abc"), "abc", "x")) == "xbc"
    assert value(S.regexp_extract(L("abc"), "z")) is None and value(S.regexp_extract(L("a1b2"), "[0-9]")) == "1"
    assert value(S.quote(L("it's"))) == "'it''s'" and value(S.quote(L(None).cast("string"))) == "NULL"
    assert value(S.substring(L("héllo"), 0, 2)) == "hé" and value(S.position("l", L("héllo"))) == 3
    assert value(S.overlay(L("abc"), "ZZ", 9)) == "abc" and value(S.overlay(L("abcdef"), "ZZ", 2)) == "aZZdef"
    assert value(S.format("{}-{}-{}", L(1), L("x"))) == "1-x-{}" and value(S.split_part(L("a,b"), ",", 5)) == ""
    assert value(S.string_split(L("a.b.c"), ".")) == ["a", "b", "c"] and value(S.string_split(L("abc"), "")) == ["a", "b", "c"]
    assert value(S.like_escape(L("10%"), "10#%", "#")) is True and value(S.similar_to(L("abc123"), "abc[0-9]+")) is True
    assert value(S.similar_to(L("xabc"), "a%")) is False and value(S.concat(L("a"), L(None).cast("string"))) is None
    assert value(S.url_encode(L("a b*~/é"))) == "a%20b%2A~%2F%C3%A9" and value(S.soundex(L("Robert"))) == "R163"
    assert value(S.trim(L("\t a \n"))) == "a" and value(S.initcap(L("hello wORLD"))) == "Hello World"
    assert value(S.hamming(L("karolin"), L("kathrin"))) == 3 and value(S.md5_number(L("a"))) > 0


@pytest.mark.parametrize("bad", [lambda: S.substring(L("abc"), -1, 1), lambda: S.repeat(L("a"), -1), lambda: S.split_part(L("a"), ",", 0), lambda: S.chr(L(200)), lambda: S.hamming(L("a"), L("ab")), lambda: M.mod(L(1), L(0))])
def test_errors(value, bad):
    with pytest.raises(Exception):  # noqa: B017
        value(bad())
    with pytest.raises(ValueError):
        S.lpad(L("a"), 3, "")


def test_similarity():
    assert round(SIM.jaro("MARTHA", "MARHTA"), 4) == 0.9444 and round(SIM.jaro_winkler("DWAYNE", "DUANE"), 4) == 0.84
    assert SIM.damerau("ca", "abc") == 2 and SIM.damerau("abcd", "acbd") == 1 and SIM.damerau("", "ab") == 2
    assert SIM.jaro("", "a") == 0.0 and SIM.jaro("", "") == 1.0


def test_maths(value):
    assert value(M.log(L(1000.0))) == pytest.approx(3) and value(M.trunc(L(-2.567), 1)) == -2.5
    assert value(M.round(L(-2.5))) == -3 and value(M.round(L(1250), -2)) == 1300 and value(M.int_div(L(-7), L(2))) == -3
    assert value(M.sign(L(-3))) == -1 and value(M.ceil(L(1.2))) == 2.0 and math.isnan(value(M.sqrt(L(-1.0))))
    assert value(M.bit_xor(L(6), L(3))) == 5 and value(M.shift_left(L(3), 2)) == 12


def test_dates(value):
    ts = L("2024-02-29 23:30:05").cast("timestamp")
    assert value(D.extract("dow", L("2024-03-03").cast("date"))) == 0 and value(D.dayofweek(L("2024-03-03").cast("date"))) == 1
    assert value(D.elapsed_days(L("2024-03-01 01:00:00").cast("timestamp"), ts)) == 0
    assert value(D.elapsed_days(ts, L("2024-03-02 01:00:00").cast("timestamp"))) == -1
    assert str(value(D.time_bucket(60, ts))) == "2024-02-29 23:30:00" and str(value(D.time_bucket(3600, L("1969-12-31 23:30:00").cast("timestamp")))) == "1969-12-31 23:00:00"
    assert value(D.to_char(ts, "DD/MM/YYYY at HH24:MI:SS")) == "29/02/2024 at 23:30:05" and value(D.strftime(ts, "%j|%y")) == "060|24"
    assert str(value(D.to_date(L("2024/02/29")))) == "2024-02-29" and value(D.to_timestamp(L("no"))) is None
    assert str(value(D.last_day(ts))) == "2024-02-29" and value(D.age(ts, L("2024-02-29 23:30:00").cast("timestamp"))) == 5
    with pytest.raises(ValueError):
        D.extract("fortnight", ts)
    with pytest.raises(ValueError):
        D.strftime(ts, "%Q")


def test_nested(value):
    xs = F.array(L(5), L(6), L(7))
    assert value(N.list_where(xs, F.array(L(True), L(False), L(True)))) == [5, 7] and value(N.list_select(xs, F.array(L(3), L(1)))) == [7, 5]
    assert value(N.list_resize(xs, 5)) == [5, 6, 7, None, None] and value(N.list_resize(xs, 2)) == [5, 6] and value(N.list_extract(xs, 9)) is None
    assert value(N.map_contains(F.create_map(L("a"), L(1)), "a")) is True and value(N.struct_extract(N.struct_pack(a=L(1)), "a")) == 1
    assert value(N.json_extract(L('{"a": {"b": 2}}'), "$.a.b")) == "2" and value(N.variant_extract(F.parse_json(L('{"a": 3}')), "$.a", "int")) == 3
