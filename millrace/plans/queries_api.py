"""Catalogue queries through the DataFrame API and the function library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import aggregates as A
from millrace.functions import datetimes as D
from millrace.functions import maths as M
from millrace.functions import nested as N
from millrace.functions import similarity as SIM
from millrace.functions import strings as S
from millrace.functions import windows as W
from millrace.operators import relational as R
from millrace.sources.tables import load

API: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _select(name: str, table: str, keys: list[str], columns: dict, oracle: dict[str, str] | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return load(spark, sf_dir, table).select(*keys, *[(c() if callable(c) else c).alias(n) for n, c in columns.items()])

    sql = None
    if oracle is not None:
        sql = f"SELECT {', '.join([*keys, *(f'{e} AS {n}' for n, e in oracle.items())])} FROM {table}"
    API[name] = (run, sql)


def _query(sql: str | None = None):
    def wrap(fn):
        API[fn.__name__] = (fn, " ".join(sql.split()) if sql else None)
        return fn

    return wrap


# Strings
_P = ["p_partkey"]
_select("str_length", "part", _P, {"a": lambda: S.length("p_name"), "b": lambda: S.octet_length("p_name"), "c": lambda: S.bit_length("p_name"), "d": lambda: S.char_length("p_type")}, {"a": "CAST(length(p_name) AS INT)", "b": "CAST(strlen(p_name) AS INT)", "c": "CAST(bit_length(p_name) AS INT)", "d": "CAST(length(p_type) AS INT)"})
_select("str_case", "part", _P, {"a": lambda: S.upper("p_name"), "b": lambda: S.lower("p_type"), "c": lambda: S.reverse("p_name"), "d": lambda: S.repeat("p_brand", 2)}, {"a": "upper(p_name)", "b": "lower(p_type)", "c": "reverse(p_name)", "d": "repeat(p_brand, 2)"})
_select("str_concat", "part", _P, {"a": lambda: S.concat("p_name", F.lit("-"), "p_type"), "b": lambda: S.concat(F.col("p_name"), F.lit(None).cast("string")), "c": lambda: S.concat_ws("/", "p_brand", "p_type")}, {"a": "p_name || '-' || p_type", "b": "p_name || NULL::VARCHAR", "c": "concat_ws('/', p_brand, p_type)"})
_select("str_trim", "part", _P, {"a": lambda: S.trim(F.concat(F.lit(" \t"), "p_name", F.lit("\n "))), "b": lambda: S.ltrim(F.concat(F.lit("  "), "p_name")), "c": lambda: S.rtrim(F.concat("p_name", F.lit("  ")))}, {"a": "p_name", "b": "ltrim('  ' || p_name)", "c": "rtrim(p_name || '  ')"})
_select("str_substring", "part", _P, {"a": lambda: S.substring("p_name", 2, 3), "b": lambda: S.substring("p_name", 0, 2), "c": lambda: S.substring("p_name", 4), "d": lambda: S.left("p_name", 3), "e": lambda: S.right("p_name", 3), "f": lambda: S.left("p_name", -1)}, {"a": "substring(p_name, 2, 3)", "b": "substring(p_name, 1, 2)", "c": "substring(p_name, 4)", "d": "left(p_name, 3)", "e": "right(p_name, 3)", "f": "''"})
_select("str_search", "part", _P, {"a": lambda: S.position("a", "p_name"), "b": lambda: S.strpos("p_name", "e"), "c": lambda: S.contains("p_name", "o"), "d": lambda: S.starts_with("p_type", "S"), "e": lambda: S.ends_with("p_type", "S"), "f": lambda: S.instr("p_name", "zz")}, {"a": "CAST(strpos(p_name, 'a') AS INT)", "b": "CAST(strpos(p_name, 'e') AS INT)", "c": "contains(p_name, 'o')", "d": "starts_with(p_type, 'S')", "e": "ends_with(p_type, 'S')", "f": "CAST(strpos(p_name, 'zz') AS INT)"})
_select("str_replace", "part", _P, {"a": lambda: S.replace("p_name", "a", "_"), "b": lambda: S.translate("p_name", "aeiou", "AE"), "c": lambda: S.overlay("p_name", "XX", 2), "d": lambda: S.overlay("p_name", "Q", 2, 3), "e": lambda: S.overlay("p_name", "Q", 999)}, {"a": "replace(p_name, 'a', '_')", "b": "translate(p_name, 'aeiou', 'AEiou')", "c": "left(p_name, 1) || 'XX' || substring(p_name, 4)", "d": "left(p_name, 1) || 'Q' || substring(p_name, 5)", "e": "p_name"})
_select("str_pad", "part", _P, {"a": lambda: S.lpad("p_brand", 12, "*"), "b": lambda: S.rpad("p_brand", 12), "c": lambda: S.lpad("p_name", 3)}, {"a": "lpad(p_brand, 12, '*')", "b": "rpad(p_brand, 12, ' ')", "c": "lpad(p_name, 3, ' ')"})
_select("str_split", "part", _P, {"a": lambda: S.split_part("p_type", " ", 1), "b": lambda: S.split_part("p_type", " ", 9), "c": lambda: F.size(S.string_split("p_type", " ")), "d": lambda: F.element_at(S.regexp_split_to_array("p_type", "[ AEIOU]"), 1)}, {"a": "split_part(p_type, ' ', 1)", "b": "split_part(p_type, ' ', 9)", "c": "CAST(len(string_split(p_type, ' ')) AS INT)", "d": "string_split_regex(p_type, '[ AEIOU]')[1]"})
_select("str_regexp", "part", _P, {"a": lambda: S.regexp_matches("p_name", "[0-9]{3}"), "b": lambda: S.regexp_replace("p_name", "[aeiou]", "#"), "c": lambda: S.regexp_extract("p_name", "([0-9]+)", 1), "d": lambda: S.regexp_extract("p_name", "zzz"), "e": lambda: S.regexp_full_match("p_brand", "Brand#[0-9]+")}, {"a": "regexp_matches(p_name, '[0-9]{3}')", "b": "regexp_replace(p_name, '[aeiou]', '#', 'g')", "c": "nullif(regexp_extract(p_name, '([0-9]+)', 1), '')", "d": "NULL::VARCHAR", "e": "regexp_full_match(p_brand, 'Brand#[0-9]+')"})
_select("str_codes", "part", _P, {"a": lambda: S.ascii("p_name"), "b": lambda: S.chr(F.lit(65) + F.col("p_partkey") % 26), "c": lambda: S.quote(F.concat("p_name", F.lit("'s"))), "d": lambda: S.format("<{}|{}>", "p_brand", "p_size")}, {"a": "CAST(ascii(p_name) AS INT)", "b": "chr(CAST(65 + p_partkey % 26 AS INT))", "c": "'''' || replace(p_name || '''s', '''', '''''') || ''''", "d": "'<' || p_brand || '|' || p_size || '>'"})
_select("str_digest", "part", _P, {"a": lambda: S.md5("p_name"), "b": lambda: S.sha256("p_name"), "c": lambda: S.base64_encode("p_name"), "d": lambda: S.base64_decode(S.base64_encode("p_name")), "e": lambda: S.sha1("p_name")}, {"a": "md5(p_name)", "b": "sha256(p_name)", "c": "base64(encode(p_name))", "d": "p_name", "e": "sha1(p_name)"})
_select("str_url", "part", _P, {"a": lambda: S.url_encode(F.concat("p_type", F.lit("/~*é&"))), "b": lambda: S.url_decode(S.url_encode("p_type"))}, {"a": "url_encode(p_type || '/~*é&')", "b": "p_type"})
_select("str_distance", "part", _P, {"a": lambda: S.levenshtein("p_name", "p_brand"), "b": lambda: S.hamming(S.lpad("p_name", 8, "x"), S.lpad("p_brand", 8, "y")), "c": lambda: F.round(SIM.jaro_similarity("p_name", "p_brand"), 6), "d": lambda: F.round(SIM.jaro_winkler_similarity("p_name", "p_type"), 6), "e": lambda: SIM.damerau_levenshtein("p_name", "p_brand")}, {"a": "CAST(levenshtein(p_name, p_brand) AS INT)", "b": "CAST(hamming(lpad(p_name, 8, 'x'), lpad(p_brand, 8, 'y')) AS BIGINT)", "c": "round(jaro_similarity(p_name, p_brand), 6)", "d": "round(jaro_winkler_similarity(p_name, p_type), 6)", "e": "CAST(damerau_levenshtein(p_name, p_brand) AS BIGINT)"})
_select("str_accents", "documents", ["doc_id"], {"a": lambda: SIM.strip_accents(F.lower("lang")), "b": lambda: S.length(SIM.nfc_normalize("text"))}, {"a": "strip_accents(lower(lang))", "b": "CAST(length(nfc_normalize(text)) AS INT)"})
_select("str_no_oracle", "part", _P, {"a": lambda: S.initcap("p_type"), "b": lambda: S.soundex("p_name"), "c": lambda: S.similar_to("p_name", "%[0-9]+"), "d": lambda: S.like_escape("p_name", "%#_%", "#")}, None)

# Mathematics
_L = ["l_orderkey", "l_linenumber"]
_select("math_basic", "lineitem", _L, {"a": lambda: M.abs(F.col("l_linenumber") - 4), "b": lambda: M.sign(F.col("l_quantity") - 25), "c": lambda: M.ceil("l_extendedprice"), "d": lambda: M.floor("l_extendedprice"), "e": lambda: M.round("l_extendedprice", 1), "f": lambda: M.trunc("l_discount", 1), "g": lambda: M.mod("l_orderkey", F.lit(7)), "h": lambda: M.int_div("l_orderkey", F.lit(7))}, {"a": "abs(l_linenumber - 4)", "b": "CAST(sign(l_quantity - 25) AS INT)", "c": "ceil(l_extendedprice)", "d": "floor(l_extendedprice)", "e": "round(l_extendedprice, 1)", "f": "trunc(l_discount * 10) / 10", "g": "l_orderkey % 7", "h": "l_orderkey // 7"})
_select("math_power", "lineitem", _L, {"a": lambda: F.round(M.sqrt("l_quantity"), 8), "b": lambda: F.round(M.power("l_quantity", F.lit(2)), 6), "c": lambda: F.round(M.exp("l_discount"), 8), "d": lambda: F.round(M.ln("l_quantity"), 8), "e": lambda: F.round(M.log("l_quantity"), 8), "f": lambda: F.round(M.log2("l_quantity"), 8), "g": lambda: F.round(M.log10("l_extendedprice"), 8)}, {"a": "round(sqrt(l_quantity), 8)", "b": "round(pow(l_quantity, 2), 6)", "c": "round(exp(l_discount), 8)", "d": "round(ln(l_quantity), 8)", "e": "round(log(l_quantity), 8)", "f": "round(log2(l_quantity), 8)", "g": "round(log10(l_extendedprice), 8)"})
_select("math_trig", "lineitem", _L, {"a": lambda: F.round(M.sin("l_quantity"), 7), "b": lambda: F.round(M.cos("l_quantity"), 7), "c": lambda: F.round(M.tan("l_discount"), 7), "d": lambda: F.round(M.asin("l_discount"), 7), "e": lambda: F.round(M.acos("l_discount"), 7), "f": lambda: F.round(M.atan("l_quantity"), 7), "g": lambda: F.round(M.atan2("l_quantity", "l_tax"), 7), "h": lambda: F.round(M.degrees("l_tax"), 7), "i": lambda: F.round(M.radians("l_quantity"), 7), "j": lambda: F.round(M.pi(), 8)}, {"a": "round(sin(l_quantity), 7)", "b": "round(cos(l_quantity), 7)", "c": "round(tan(l_discount), 7)", "d": "round(asin(l_discount), 7)", "e": "round(acos(l_discount), 7)", "f": "round(atan(l_quantity), 7)", "g": "round(atan2(l_quantity, l_tax), 7)", "h": "round(degrees(l_tax), 7)", "i": "round(radians(l_quantity), 7)", "j": "round(pi(), 8)"})
_select("math_random", "region", ["r_regionkey"], {"ok": lambda: M.random().between(0, 1)}, {"ok": "random() BETWEEN 0 AND 1"})

# Dates
_O = ["o_orderkey"]
_F = {"year": "year", "month": "month", "day": "day", "hour": "hour", "minute": "minute", "second": "second", "dow": "dow", "doy": "doy", "week": "week", "quarter": "quarter", "epoch": "epoch"}
_select("dt_extract", "events", ["event_id"], {f"x_{k}": (lambda f: lambda: D.extract(f, "ts"))(k) for k in _F}, {f"x_{k}": ("CAST(floor(extract(epoch FROM ts)) AS BIGINT)" if k == "epoch" else f"CAST(extract({v} FROM ts) AS BIGINT)") for k, v in _F.items()})
_select("dt_parts", "orders", _O, {"a": lambda: D.dayofweek("o_orderdate"), "b": lambda: D.dayofyear("o_orderdate"), "c": lambda: D.last_day("o_orderdate"), "d": lambda: D.date_part("year", "o_orderdate"), "e": lambda: D.isfinite("o_orderdate")}, {"a": "CAST(dayofweek(o_orderdate) + 1 AS BIGINT)", "b": "CAST(dayofyear(o_orderdate) AS BIGINT)", "c": "last_day(o_orderdate)", "d": "CAST(year(o_orderdate) AS BIGINT)", "e": "isfinite(o_orderdate)"})
_select("dt_trunc", "events", ["event_id"], {f"t_{k}": (lambda f: lambda: D.date_trunc(f, "ts").cast("timestamp_ntz"))(k) for k in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")}, {f"t_{k}": f"CAST(date_trunc('{k}', ts) AS TIMESTAMP)" for k in ("year", "quarter", "month", "week", "day", "hour", "minute", "second")})
_select("dt_arith", "orders", _O, {"a": lambda: D.date_add(F.to_date("o_orderdate"), 30), "b": lambda: D.date_sub(F.to_date("o_orderdate"), 7), "c": lambda: D.date_diff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")), "d": lambda: D.timestamp_add("o_orderdate", 2).cast("timestamp_ntz")}, {"a": "CAST(o_orderdate AS DATE) + 30", "b": "CAST(o_orderdate AS DATE) - 7", "c": "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))", "d": "o_orderdate + INTERVAL 2 DAY"})
_select("dt_elapsed", "events", ["event_id"], {"a": lambda: D.elapsed_days("ts", F.lit("2020-01-01 06:00:00").cast("timestamp_ntz")), "b": lambda: D.age("ts", F.lit("2020-01-01 06:00:00").cast("timestamp_ntz")), "c": lambda: D.epoch_ms("ts"), "d": lambda: D.time_bucket(900, "ts").cast("timestamp_ntz")}, {"a": "date_sub('day', TIMESTAMP '2020-01-01 06:00:00', ts)", "b": "CAST(floor(epoch(ts)) - epoch(TIMESTAMP '2020-01-01 06:00:00') AS BIGINT)", "c": "epoch_us(ts) // 1000", "d": "time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01')"})
_select("dt_format", "events", ["event_id"], {"a": lambda: D.to_char("ts", "YYYY-MM-DD HH24:MI:SS"), "b": lambda: D.strftime("ts", "%Y/%m/%d %H:%M:%S %j"), "c": lambda: D.strptime(D.strftime("ts", "%Y-%m-%d %H:%M:%S"), "%Y-%m-%d %H:%M:%S").cast("timestamp_ntz"), "d": lambda: D.to_timestamp(D.to_char("ts", "YYYY-MM-DD HH24:MI:SS")).cast("timestamp_ntz"), "e": lambda: D.to_date(D.to_char("ts", "YYYY-MM-DD"))}, {"a": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "b": "strftime(ts, '%Y/%m/%d %H:%M:%S %j')", "c": "date_trunc('second', ts)", "d": "date_trunc('second', ts)", "e": "CAST(ts AS DATE)"})
_select("dt_make", "orders", _O, {"a": lambda: D.make_date(D.extract("year", "o_orderdate").cast("int"), F.lit(2), F.lit(3)), "b": lambda: D.make_timestamp(F.lit(2001), F.lit(2), F.lit(3), F.lit(4), F.lit(5), F.lit(6)).cast("timestamp_ntz")}, {"a": "make_date(CAST(year(o_orderdate) AS INT), 2, 3)", "b": "make_timestamp(2001, 2, 3, 4, 5, 6)"})
_select("dt_current", "region", ["r_regionkey"], {"a": lambda: D.current_date().isNotNull(), "b": lambda: D.now().isNotNull(), "c": lambda: D.current_time().between(0, D.DAY_MICROS)}, {"a": "true", "b": "true", "c": "true"})


# Ordered and approximate aggregates
@_query("SELECT o_custkey, arg_min(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS f, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS l FROM orders GROUP BY o_custkey")
def agg_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("o_orderdate", "o_orderkey")
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(A.first("o_orderkey", order).alias("f"), A.last("o_orderkey", order).alias("l"))


@_query("SELECT o_custkey, string_agg(o_orderstatus, ';' ORDER BY o_orderkey) AS s FROM orders GROUP BY o_custkey")
def agg_string_agg_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(A.string_agg("o_orderstatus", "o_orderkey", ";").alias("s"))


@_query()
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(A.approx_count_distinct("l_partkey").alias("n"))


@_query()
def agg_approx_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(A.approx_quantile("l_quantity", 0.5).alias("q"))


# Operators
@_query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k_per(load(spark, sf_dir, "orders"), ["o_custkey"], [("o_totalprice", False), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@_query("SELECT o_orderkey, sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)::DOUBLE AS s FROM orders")
def win_groups_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
    out = W.groups(load(spark, sf_dir, "orders"), exact, ["o_custkey"], ["o_orderpriority"], -1, 1, "s")
    return out.select("o_orderkey", F.col("s").cast("double").alias("s"))


@_query("""SELECT l_returnflag, CAST(sum(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS O_total, count(*) FILTER (WHERE l_linestatus = 'O') AS O_n, CAST(sum(l_linenumber) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS F_total, count(*) FILTER (WHERE l_linestatus = 'F') AS F_n FROM lineitem GROUP BY l_returnflag""")
def pivot_multi_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.pivot(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linestatus", ["O", "F"], {"total": F.sum("l_linenumber"), "n": F.count(F.lit(1))})
    return out.fillna(0, ["O_n", "F_n"])


@_query("SELECT a.event_id, b.event_id AS prior FROM events a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.event_type = 'click'")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    clicks = events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("prior"))
    return R.asof_join(clicks, bought, ["user_id"], "ts", "ts", ["prior"]).select("event_id", "prior")


@_query("SELECT p_partkey, b.k FROM part JOIN (SELECT n_nationkey AS k, n_nationkey * 40.0 + 900 AS lo, n_nationkey * 40.0 + 970 AS hi FROM nation) b ON p_retailprice >= b.lo AND p_retailprice < b.hi")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") * 40.0 + 900).alias("lo"), (F.col("n_nationkey") * 40.0 + 970).alias("hi"))
    return R.range_join(load(spark, sf_dir, "part"), bands, "p_retailprice", "lo", "hi", 70.0).select("p_partkey", "k")


@_query("SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment WHERE a.c_custkey < b.c_custkey")
def join_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pairs_within(load(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", "x", "y")


@_query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return R.salted_join(load(spark, sf_dir, "lineitem"), small, ["l_suppkey"], 4).select("l_orderkey", "l_linenumber", "s_name")


@_query("WITH RECURSIVE r(k) AS (SELECT 0::BIGINT UNION SELECT (s_suppkey * 7) % 23 FROM supplier, r WHERE s_suppkey = (r.k + 3) % 23) SELECT k FROM r")
def recursive_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = load(spark, sf_dir, "supplier").select("s_suppkey")
    start = spark.range(1).select(F.col("id").alias("k"))
    step = lambda f: f.join(supplier, F.col("s_suppkey") == (F.col("k") + 3) % 23).select((F.col("s_suppkey") * 7 % 23).alias("k"))
    return R.recursive(start, step, bound=200)


@_query("SELECT vec_id, list_contains(embedding, 0) AS c, embedding[1] AS f, CAST(len(embedding) AS INT) AS n FROM embeddings")
def nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", N.list_contains("embedding", F.lit(0.0).cast("float")).alias("c"), N.list_extract("embedding", 1).alias("f"), F.size(N.list_where("embedding", F.transform("embedding", lambda x: x.isNotNull()))).alias("n"))


@_query("SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS v FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start FROM events) GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.streaming.windows import tumbling

    out = tumbling(load(spark, sf_dir, "events"), "ts", "10 minutes", ["event_type"], {"n": F.count(F.lit(1)), "v": F.round(F.sum("value"), 4)})
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "v")
