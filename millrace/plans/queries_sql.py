"""Catalogue queries as SQL text through the engine's front end.

Each entry is (Spark text, DuckDB text or None for the same text).
"""

from __future__ import annotations

SQL: dict[str, tuple[str, str | None]] = {}


def _add(name: str, spark: str, duck: str | None = None) -> None:
    SQL[name] = (" ".join(spark.split()), " ".join(duck.split()) if duck else None)


# Scan, projection, filter, expressions
_add("scan_all", "SELECT * FROM orders")
_add("project_arith", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS gross, l_orderkey + l_linenumber AS s, l_orderkey - l_linenumber AS d, l_orderkey * 2 AS m, l_orderkey % 7 AS r FROM lineitem")
_add("project_star", "SELECT n.*, r_name FROM nation n JOIN region ON n_regionkey = r_regionkey")
_add("int_division", "SELECT l_orderkey, l_linenumber, l_orderkey // 7 AS q, l_orderkey / 8 AS x FROM lineitem")
_add("filter_and_or_not", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 OR l_discount >= 0.09) AND NOT l_returnflag = 'N'")
_add("filter_in_list", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 3, 5)")
_add("filter_not_in", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 3, 5)")
_add("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
_add("filter_between_symmetric", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN SYMMETRIC 12 AND 10", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN least(12, 10) AND greatest(12, 10)")
_add("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%' AND p_type NOT LIKE 'S%'")
_add("filter_ilike", "SELECT p_partkey FROM part WHERE p_type ILIKE '%BRASS%' OR p_name ILIKE 'P%1'")
_add("filter_like_escape", "SELECT p_partkey FROM part WHERE p_name LIKE '%#_%' ESCAPE '#' OR p_name LIKE '%##%' ESCAPE '#'")
_add("filter_regexp", "SELECT c_custkey, regexp_matches(c_name, '[0-9]*7$') AS hit FROM customer")
_add("null_3vl", "SELECT l_orderkey, l_linenumber, (nullif(l_returnflag, 'N') = 'R') AS eq, (nullif(l_returnflag, 'N') = 'R' AND l_quantity > 25) AS a, (nullif(l_returnflag, 'N') = 'R' OR l_quantity > 25) AS o, NOT (nullif(l_returnflag, 'N') = 'R') AS n FROM lineitem")
_add("is_null", "SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') IS NULL AS a, nullif(l_returnflag, 'N') IS NOT NULL AS b FROM lineitem")
_add("is_true", "SELECT l_orderkey, l_linenumber, (nullif(l_returnflag, 'N') = 'R') IS TRUE AS a, (nullif(l_returnflag, 'N') = 'R') IS NOT FALSE AS b, (nullif(l_returnflag, 'N') = 'R') IS NULL AS c FROM lineitem")
_add("is_distinct_from", "SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') IS DISTINCT FROM nullif(l_linestatus, 'O') AS d, nullif(l_returnflag, 'N') IS NOT DISTINCT FROM NULL AS e FROM lineitem")
_add("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
_add("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code FROM orders")
_add("cast_matrix", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR(20)) AS s, CAST(l_quantity AS BIGINT) AS i, CAST(l_linenumber AS DOUBLE) AS d, CAST(CAST(l_linenumber AS VARCHAR(9)) AS INTEGER) AS back, CAST(l_shipdate AS DATE) AS day FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) AS s, CAST(l_quantity AS BIGINT) AS i, CAST(l_linenumber AS DOUBLE) AS d, CAST(CAST(l_linenumber AS VARCHAR) AS INTEGER) AS back, CAST(l_shipdate AS DATE) AS day FROM lineitem")
_add("try_cast", "SELECT p_partkey, try_cast(p_name AS INT) AS a, try_cast(CAST(p_size AS STRING) AS INT) AS b FROM part", "SELECT p_partkey, try_cast(p_name AS INT) AS a, try_cast(CAST(p_size AS VARCHAR) AS INT) AS b FROM part")
_add("unary_minus", "SELECT l_orderkey, l_linenumber, -l_quantity AS a, -(l_linenumber) AS b FROM lineitem")
_add("bitwise", "SELECT l_orderkey, l_linenumber, l_orderkey & 12 AS a, l_orderkey | 3 AS o, l_orderkey ^ 5 AS x, shiftleft(l_orderkey, 2) AS l, shiftright(l_orderkey, 1) AS r FROM lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey & 12 AS a, l_orderkey | 3 AS o, xor(l_orderkey, 5) AS x, l_orderkey << 2 AS l, l_orderkey >> 1 AS r FROM lineitem")
_add("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
_add("values_only", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")
_add("select_without_from", "SELECT 1 + 1 AS two, 'x' || 'y' AS xy, CAST(NULL AS INT) AS nothing")
_add("empty_result", "SELECT o_orderkey FROM orders WHERE 1 = 0")
_add("cond_functions", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), 'none') AS c, greatest(l_quantity, 25.0) AS g, least(l_quantity, 25.0) AS l FROM lineitem", "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), 'none') AS c, greatest(l_quantity, 25.0::DOUBLE) AS g, least(l_quantity, 25.0::DOUBLE) AS l FROM lineitem")

# Joins
_add("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_add("join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber")
_add("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 150000")
_add("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
_add("join_full", "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey AND c_nationkey < 12")
_add("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_add("join_comma", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
_add("join_using", "SELECT l_orderkey, l_linenumber, t.flag FROM lineitem JOIN (SELECT o_orderkey AS l_orderkey, o_orderstatus AS flag FROM orders) t USING (l_orderkey)")
_add("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_add("join_non_equi", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_nationkey > r_regionkey * 5")
_add("join_or", "SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey OR n_nationkey = s_suppkey")
_add("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
_add("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
_add("join_null_keys", "SELECT a.id AS x, b.id AS y FROM (VALUES (1, 10), (2, NULL)) a(id, k) JOIN (VALUES (3, NULL), (4, 10)) b(id, k) ON a.k = b.k")
_add("join_lateral", "SELECT n_name, t.m FROM nation, LATERAL (SELECT max(c_acctbal) AS m FROM customer WHERE c_nationkey = n_nationkey) t")
_add("join_three_way", "SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name")

# Aggregation
_AGG = {
    "agg_count": ("count(*) AS a, count(nullif(l_linestatus, 'O')) AS b", None),
    "agg_sum": ("round(sum(l_quantity), 2) AS a, sum(l_linenumber) AS b", "round(sum(l_quantity), 2) AS a, CAST(sum(l_linenumber) AS BIGINT) AS b"),
    "agg_avg": ("round(avg(l_extendedprice), 4) AS a, round(avg(l_linenumber), 6) AS b", None),
    "agg_min_max": ("min(l_extendedprice) AS a, max(l_extendedprice) AS b, min(l_shipdate) AS c, max(l_linestatus) AS d", None),
    "agg_stddev_samp": ("round(stddev_samp(l_quantity), 6) AS a, round(stddev(l_discount), 6) AS b", None),
    "agg_stddev_pop": ("round(stddev_pop(l_quantity), 6) AS a", None),
    "agg_var_samp": ("round(var_samp(l_quantity), 6) AS a, round(variance(l_discount), 8) AS b", None),
    "agg_var_pop": ("round(var_pop(l_quantity), 6) AS a", None),
    "agg_median": ("round(median(l_extendedprice), 4) AS a", None),
    "agg_percentile_cont": ("round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity), 4) AS a, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS b", None),
    "agg_percentile_disc": ("percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS a, percentile_disc(0.9) WITHIN GROUP (ORDER BY l_extendedprice) AS b", None),
    "agg_covar": ("round(covar_pop(l_quantity, l_extendedprice), 2) AS a, round(covar_samp(l_quantity, l_extendedprice), 2) AS b", None),
    "agg_corr": ("round(corr(l_quantity, l_extendedprice), 8) AS a", None),
    "agg_regr": ("regr_count(l_extendedprice, l_quantity) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS s, round(regr_intercept(l_extendedprice, l_quantity), 2) AS i, round(regr_r2(l_extendedprice, l_quantity), 8) AS r", "CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS s, round(regr_intercept(l_extendedprice, l_quantity), 2) AS i, round(regr_r2(l_extendedprice, l_quantity), 8) AS r"),
    "agg_arg_min_max": ("arg_min(l_linenumber, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) AS a, arg_max(l_partkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) AS b", None),
    "agg_bool": ("bool_and(l_quantity > 0) AS a, bool_or(l_quantity > 49) AS b, bool_and(l_discount > 0.01) AS c", None),
    "agg_distinct": ("count(DISTINCT l_suppkey) AS a, sum(DISTINCT l_linenumber) AS b", "count(DISTINCT l_suppkey) AS a, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS b"),
    "agg_filter": ("count(*) FILTER (WHERE l_quantity > 25) AS a, round(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2) AS b", None),
    "agg_several_of_one_name": ("round(sum(l_quantity), 2) AS a, round(sum(l_extendedprice), 2) AS b, round(sum(l_tax), 4) AS c", None),
}
for _name, (_spark, _duck) in _AGG.items():
    _q = "SELECT l_returnflag, l_linestatus, {} FROM lineitem GROUP BY l_returnflag, l_linestatus"
    _add(_name, _q.format(_spark), _q.format(_duck) if _duck else None)
_add("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS q, min(l_shipdate) AS d FROM lineitem")
_add("agg_global_empty", "SELECT count(*) AS n, sum(l_quantity) AS q, min(l_orderkey) AS m FROM lineitem WHERE l_quantity < 0")
_add("agg_string_agg", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_add("agg_mode", "SELECT l_returnflag, mode(l_linestatus, true) AS m FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, l_linestatus AS m FROM (SELECT l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_linestatus) AS r FROM lineitem GROUP BY l_returnflag, l_linestatus) WHERE r = 1")
_add("agg_null_keys", "SELECT nullif(l_returnflag, 'N') AS f, count(*) AS n FROM lineitem GROUP BY nullif(l_returnflag, 'N')")
_add("having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 1000")
_add("groupby_expr", "SELECT year(o_orderdate) AS y, o_orderkey % 3 AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_orderkey % 3", "SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderkey % 3 AS m, count(*) AS n FROM orders GROUP BY year(o_orderdate), o_orderkey % 3")
_add("groupby_alias_ordinal", "SELECT upper(o_orderstatus) AS s, o_orderpriority, count(*) AS n FROM orders GROUP BY s, 2")
_add("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_add("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_add("grouping_sets", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus, l_linenumber), ())")

# Windows
_WIN = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_WINS = {
    "win_row_number": (f"CAST(row_number() OVER ({_WIN}) AS BIGINT) AS w", None),
    "win_rank": ("CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS w", None),
    "win_dense_rank": ("CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS w", None),
    "win_percent_rank": ("round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 8) AS w", None),
    "win_cume_dist": ("round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 8) AS w", None),
    "win_ntile": (f"CAST(ntile(4) OVER ({_WIN}) AS BIGINT) AS w", None),
    "win_lag": (f"lag(o_totalprice) OVER ({_WIN}) AS w, lag(o_orderkey, 2, -1) OVER ({_WIN}) AS v", f"lag(o_totalprice) OVER ({_WIN}) AS w, lag(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER ({_WIN}) AS v"),
    "win_lead": (f"lead(o_totalprice) OVER ({_WIN}) AS w, lead(o_orderkey, 2, -1) OVER ({_WIN}) AS v", f"lead(o_totalprice) OVER ({_WIN}) AS w, lead(o_orderkey, 2, CAST(-1 AS BIGINT)) OVER ({_WIN}) AS v"),
    "win_first_value": (f"first_value(o_orderkey) OVER ({_WIN} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS w", None),
    "win_last_value": (f"last_value(o_orderkey) OVER ({_WIN} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS w", None),
    "win_nth_value": (f"nth_value(o_orderkey, 3) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w", None),
    "win_sum_rows": (f"round(sum(o_totalprice) OVER ({_WIN} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 2) AS w", None),
    "win_avg_rows": (f"round(avg(o_totalprice) OVER ({_WIN} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS w", None),
    "win_count_rows": (f"count(nullif(o_orderstatus, 'O')) OVER ({_WIN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w", None),
    "win_min_max": (f"min(o_totalprice) OVER ({_WIN} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w, max(o_totalprice) OVER ({_WIN}) AS v", None),
    "win_range": ("count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS w", None),
    "win_groups": ("count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS w", None),
    "win_whole_partition": ("round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS w, count(*) OVER () AS v", None),
    "win_frame_before_start": (f"sum(o_orderkey) OVER ({_WIN} ROWS BETWEEN 5 PRECEDING AND 4 PRECEDING) AS w", f"CAST(sum(o_orderkey) OVER ({_WIN} ROWS BETWEEN 5 PRECEDING AND 4 PRECEDING) AS BIGINT) AS w"),
}
for _name, (_spark, _duck) in _WINS.items():
    _add(_name, f"SELECT o_orderkey, {_spark} FROM orders", f"SELECT o_orderkey, {_duck} FROM orders" if _duck else None)
_add("qualify_top1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
_add("qualify_alias", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F' QUALIFY r <= 2", "SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r <= 2")
_add("window_over_aggregate", "SELECT o_orderstatus, count(*) AS n, CAST(rank() OVER (ORDER BY count(*) DESC) AS BIGINT) AS r FROM orders GROUP BY o_orderstatus")

# Order, limit
_add("order_multi_nulls", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY s ASC NULLS LAST, o_totalprice DESC, o_orderkey")
_add("order_nulls_first", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY s DESC NULLS FIRST, o_orderkey")
_add("order_expression", "SELECT o_orderkey FROM orders ORDER BY o_totalprice % 100, o_orderkey")
_add("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100")
_add("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")

# Set operations
_add("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT c_nationkey FROM customer")
_add("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_add("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_add("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
_add("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
_add("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
_add("setop_precedence", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_nationkey > 20")
_add("setop_order_limit", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region ORDER BY k DESC LIMIT 12")

# Subqueries, CTEs
_add("scalar_sub", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
_add("correlated_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer")
_add("exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_add("not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_add("in_sub", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_add("not_in_sub", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_add("not_in_sub_null", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation)")
_add("cte_chain", "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT avg(s) AS m FROM a) SELECT o_custkey FROM a, b WHERE s > 1.5 * m")
_add("cte_columns", "WITH t(k, v) AS (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) SELECT k, v FROM t WHERE v > 3")
_add("cte_reuse", "WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.k, a.n FROM t a JOIN (SELECT max(n) AS m FROM t) b ON a.n = b.m")
_add("derived_table", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) t WHERE n > 10")
_add("recursive_numbers", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t")
_add("recursive_union_dedupe", "WITH RECURSIVE t(n) AS (SELECT 1 AS n UNION SELECT (n * 2) % 11 FROM t) SELECT n FROM t")

# Reshaping
_add("pivot_sum", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem) PIVOT (sum(l_linenumber) FOR l_linestatus IN ('O' AS o, 'F' AS f))", "SELECT l_returnflag, CAST(sum(l_linenumber) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS o, CAST(sum(l_linenumber) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS f FROM lineitem GROUP BY l_returnflag")
_add("unpivot", "SELECT * FROM (SELECT o_orderkey, o_custkey AS cust, nullif(o_orderkey % 2, 0) AS odd FROM orders) UNPIVOT (v FOR name IN (cust, odd))", "SELECT o_orderkey, 'cust' AS name, o_custkey AS v FROM orders UNION ALL SELECT o_orderkey, 'odd', o_orderkey % 2 FROM orders WHERE o_orderkey % 2 <> 0")
_add("unpivot_include_nulls", "SELECT * FROM (SELECT o_orderkey, o_custkey AS cust, nullif(o_orderkey % 2, 0) AS odd FROM orders) UNPIVOT INCLUDE NULLS (v FOR name IN (cust, odd))", "SELECT o_orderkey, 'cust' AS name, o_custkey AS v FROM orders UNION ALL SELECT o_orderkey, 'odd', nullif(o_orderkey % 2, 0) FROM orders")

# Composite
_add("q1_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
_add("q3_shipping", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
_add("q5_local_supplier", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
_add("q6_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
_add("q10_returned", "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
_add("q12_priority", "SELECT l_linestatus, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o_orderpriority <> '1-URGENT' THEN 1 ELSE 0 END) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus", "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linestatus")
_add("q14_promo", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 4) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey")
_add("q18_large_orders", "SELECT o_custkey, o_orderkey, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) GROUP BY o_custkey, o_orderkey")
_add("q22_idle_customers", "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_nationkey")
_add("events_by_hour", "SELECT event_type, CAST(time_bucket(3600, ts) AS TIMESTAMP_NTZ) AS bucket, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY event_type, time_bucket(3600, ts)", "SELECT event_type, date_trunc('hour', ts) AS bucket, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY event_type, date_trunc('hour', ts)")
_add("json_field", "SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
_add("nested_vectors", "SELECT vec_id, size(embedding) AS n, round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * x), 3) AS norm FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 3) AS norm FROM embeddings")
