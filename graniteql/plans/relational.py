"""Shapes of queries: projection, joins, aggregation, subqueries, windows, order, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import aligned, full_using, groups_frame, grouping_mask, mark_in, qualify
from .base import Suite

SUITE = Suite()
QUERIES, ORACLE = SUITE.queries, SUITE.oracle

# --- projection and shape

SUITE.sql("shape_star", "SELECT n.*, r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
SUITE.sql("shape_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
SUITE.sql("shape_cte", "WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey), b(k, n) AS (SELECT k, n * 2 FROM a WHERE n > 1) SELECT a.k, a.n, b.n AS m FROM a LEFT JOIN b ON a.k = b.k")
SUITE.sql("shape_derived", "SELECT t.k, t.total FROM (SELECT o_custkey, round(sum(o_totalprice), 2) FROM orders GROUP BY o_custkey) AS t(k, total) WHERE t.total > 100000")
SUITE.sql("shape_values", "SELECT column1, column2, column1 * 2 AS twice FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) v", "SELECT column1, column2, column1 * 2 AS twice FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) v(column1, column2)")
SUITE.sql("shape_nested_cte", "WITH a AS (WITH b AS (SELECT r_regionkey AS k, r_name AS v FROM region) SELECT k + 1 AS k, v FROM b) SELECT k, v FROM a WHERE k > 2")
SUITE.sql("shape_having_no_group", "SELECT count(*) AS n, max(c_acctbal) AS m FROM customer HAVING count(*) > 10")
SUITE.sql("shape_no_from", "SELECT 1 + 1 AS two, upper('x') AS x")
SUITE.sql("shape_ordinals_aliases", "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1 HAVING n > 1 ORDER BY 2 DESC, seg")
SUITE.sql("shape_hidden_order", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")

# --- joins

SUITE.sql("join_inner_residual", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate > o.o_orderdate AND l.l_quantity > 10")
SUITE.sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
SUITE.sql("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000")
SUITE.sql("join_full", "SELECT a.k AS ak, b.k AS bk, a.n, b.m FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY c_nationkey) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS m FROM supplier GROUP BY s_nationkey) b ON a.k = b.k")
SUITE.sql("join_semi", "SELECT o_orderkey, o_custkey FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 49")
SUITE.sql("join_anti", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
SUITE.sql("join_using", "SELECT k, a.v AS av, b.v AS bv FROM (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey > 8) b USING (k)")
SUITE.sql("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
SUITE.sql("join_null_keys", "SELECT a.x, b.y FROM (VALUES (1), (NULL), (2), (2)) a(x) LEFT JOIN (VALUES (2, 'p'), (NULL, 'q'), (2, 'r')) b(x, y) ON a.x = b.x")
SUITE.sql("join_self", "SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND a.c_mktsegment = b.c_mktsegment WHERE a.c_custkey < 40")
SUITE.sql("join_many", "SELECT r_name, n_name, count(DISTINCT s_suppkey) AS s, count(DISTINCT c_custkey) AS c FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name")

# --- aggregation

SUITE.sql("agg_basic", "SELECT l_returnflag, count(*) AS n, count(l_tax) AS m, sum(l_linenumber) AS s, min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag",
  "SELECT l_returnflag, count(*) AS n, count(l_tax) AS m, CAST(sum(l_linenumber) AS DECIMAL(38,0)) AS s, min(l_shipdate) AS lo, max(l_shipdate) AS hi, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag")
SUITE.sql("agg_decimal", "SELECT l_linestatus, sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS s, round(avg(CAST(l_extendedprice AS DECIMAL(15,2))), 6) AS a FROM lineitem GROUP BY l_linestatus",
  "SELECT l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS s, round(avg(CAST(l_extendedprice AS DECIMAL(15,2))), 6) AS a FROM lineitem GROUP BY l_linestatus")
SUITE.sql("agg_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS c, sum(DISTINCT l_linenumber) AS s, round(avg(DISTINCT l_quantity), 6) AS a, min(DISTINCT l_tax) AS m FROM lineitem GROUP BY l_returnflag",
  "SELECT l_returnflag, count(DISTINCT l_suppkey) AS c, CAST(sum(DISTINCT l_linenumber) AS DECIMAL(38,0)) AS s, round(avg(DISTINCT l_quantity), 6) AS a, min(DISTINCT l_tax) AS m FROM lineitem GROUP BY l_returnflag")
SUITE.sql("agg_distinct_tuple", "SELECT count(DISTINCT o_custkey, o_orderstatus) AS n FROM orders", "SELECT count(DISTINCT (o_custkey, o_orderstatus)) AS n FROM orders")
SUITE.sql("agg_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS hi, round(sum(value) FILTER (WHERE user_id % 2 = 0), 2) AS even, max(value) FILTER (WHERE user_id < 0) AS none FROM events GROUP BY event_type")
SUITE.sql("agg_arg_order", "SELECT o_orderstatus, max(o_totalprice ORDER BY o_orderkey) AS m, count(o_custkey ORDER BY o_orderdate DESC) AS n FROM orders GROUP BY o_orderstatus")
SUITE.sql("agg_empty_input", "SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderdate) AS m, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0")
SUITE.sql("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING count(*) > 5 AND sum(o_totalprice) > 100000")
SUITE.sql("agg_expression_keys", "SELECT extract(year FROM o_orderdate) AS y, o_orderkey % 5 AS k, count(*) AS n FROM orders GROUP BY extract(year FROM o_orderdate), o_orderkey % 5")
SUITE.sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus, o_orderpriority) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (), ())")
SUITE.sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_linestatus) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
SUITE.sql("agg_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n, grouping_id(c_nationkey, c_mktsegment) AS g FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
SUITE.sql("agg_sets_product", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus), CUBE (o_orderpriority)")
SUITE.sql("agg_high_cardinality", "SELECT l_orderkey, l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_orderkey, l_suppkey")

# --- subqueries

SUITE.sql("sub_scalar", "SELECT o_orderkey, o_totalprice > (SELECT avg(o_totalprice) FROM orders) AS above, (SELECT max(c_acctbal) FROM customer WHERE c_custkey < 0) AS none FROM orders")
SUITE.sql("sub_scalar_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
SUITE.sql("sub_count_bug", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS n FROM customer")
SUITE.sql("sub_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)")
SUITE.sql("sub_not_exists", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
SUITE.sql("sub_exists_value", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS none FROM customer")
SUITE.sql("sub_in", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
SUITE.sql("sub_not_in_null", "SELECT x FROM (VALUES (1), (2), (NULL)) t(x) WHERE x NOT IN (SELECT y FROM (VALUES (2), (NULL)) s(y))")
_MATRIX = "(VALUES (1, 'match', 10), (2, 'miss', 99), (3, 'rhs_null', 99), (4, 'lhs_null', NULL), (5, 'empty', 10), (6, 'multi', 20)) o(case_id, grp, probe)"
_INNER = "(VALUES ('match', 10), ('miss', 10), ('rhs_null', 10), ('rhs_null', NULL), ('lhs_null', 10), ('multi', 20), ('multi', 20)) i(grp, k)"
SUITE.sql("sub_in_value", f"SELECT case_id, probe IN (SELECT k FROM {_INNER}) AS a, probe NOT IN (SELECT k FROM {_INNER}) AS b, probe IN (SELECT k FROM {_INNER} WHERE k < 0) AS c, (probe IN (SELECT k FROM {_INNER} WHERE k IS NOT NULL)) IS NULL AS d FROM {_MATRIX}")
SUITE.sql("sub_in_value_correlated", f"SELECT case_id, probe IN (SELECT k FROM {_INNER} WHERE i.grp = o.grp) AS a, CASE WHEN probe NOT IN (SELECT k FROM {_INNER} WHERE i.grp = o.grp) THEN 'out' ELSE 'in or null' END AS b FROM {_MATRIX}")
SUITE.sql("sub_in_or", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < -900) OR o_totalprice > 450000")
SUITE.sql("sub_in_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) IN (SELECT r_regionkey + 3 FROM region)")
SUITE.sql("sub_nested", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
SUITE.sql("sub_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > (SELECT 1.5 * avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) t)")

# --- windows

SUITE.sql("win_ranks", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d FROM orders")
SUITE.sql("win_ntile", "SELECT c_custkey, ntile(7) OVER (ORDER BY c_acctbal, c_custkey) AS t FROM customer")
SUITE.sql("win_distribution", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS p, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS c FROM customer")
SUITE.sql("win_lag_lead", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, lead(value, 2, -1.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, lag(event_type, 1, 'first') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS c FROM events")
SUITE.sql("win_first_last", "SELECT o_orderkey, first_value(o_totalprice) OVER w AS f, last_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
SUITE.sql("win_aggregates", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, sum(o_custkey) OVER (PARTITION BY o_orderstatus) AS s, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS m, min(o_orderkey) OVER () AS lo FROM orders",
  "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus) AS DECIMAL(38,0)) AS s, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS m, min(o_orderkey) OVER () AS lo FROM orders")
SUITE.sql("win_rows_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS a, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS n FROM events")
SUITE.sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size), 2) AS s FROM part")
SUITE.sql("win_groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_type ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n, max(p_partkey) OVER (PARTITION BY p_type ORDER BY p_size GROUPS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM part")
SUITE.sql("win_qualify", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn <= 2")
SUITE.sql("win_after_group", "SELECT c_nationkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, c_nationkey) AS r FROM customer GROUP BY c_nationkey QUALIFY rank() OVER (ORDER BY count(*) DESC, c_nationkey) <= 10")
SUITE.sql("win_null_order", "SELECT x, row_number() OVER (ORDER BY x) AS a, row_number() OVER (ORDER BY x DESC) AS b, row_number() OVER (ORDER BY x NULLS FIRST) AS c FROM (VALUES (3), (NULL), (1), (2)) t(x)",
  "SELECT x, row_number() OVER (ORDER BY x NULLS LAST) AS a, row_number() OVER (ORDER BY x DESC NULLS LAST) AS b, row_number() OVER (ORDER BY x NULLS FIRST) AS c FROM (VALUES (3), (NULL), (1), (2)) t(x)")

# --- order and limits

SUITE.sql("sort_multi_key", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem ORDER BY l_orderkey DESC, l_partkey, l_suppkey NULLS FIRST, l_linenumber LIMIT 200")
SUITE.sql("sort_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 5")
SUITE.sql("sort_fetch", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 3 ROWS FETCH FIRST 4 ROWS ONLY", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 4 OFFSET 3")
SUITE.sql("sort_limit_comma", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 2, 5", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5 OFFSET 2")

# --- set operations

_A = "(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000)"
_B = "(SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0)"
for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT"), ("intersect_all", "INTERSECT ALL"), ("except_all", "EXCEPT ALL")):
    SUITE.sql(f"set_{_name}", f"{_A} {_op} {_B}")
SUITE.sql("set_nulls", "(VALUES (1, NULL), (1, NULL), (NULL, 2), (3, 3)) INTERSECT ALL (VALUES (1, NULL), (1, NULL), (NULL, 2), (4, 4))",
  "SELECT * FROM ((SELECT * FROM (VALUES (1, NULL), (1, NULL), (NULL, 2), (3, 3)) a(column1, column2)) INTERSECT ALL (SELECT * FROM (VALUES (1, NULL), (1, NULL), (NULL, 2), (4, 4)) b(column1, column2)))")
SUITE.sql("set_tree", f"({_A} UNION {_B}) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) ORDER BY k LIMIT 12")
SUITE.sql("set_widening", "SELECT n_nationkey AS v FROM nation UNION ALL SELECT c_acctbal FROM customer WHERE c_custkey < 10 UNION ALL SELECT CAST(1.5 AS DECIMAL(5,2))")

# --- analytics over events, in the manner of web logs

SUITE.sql("log_count", "SELECT count(*) AS n FROM events")
SUITE.sql("log_filter_count", "SELECT count(*) AS n FROM events WHERE event_type <> 'view'")
SUITE.sql("log_sums", "SELECT round(sum(value), 2) AS s, count(*) AS n, round(avg(value), 6) AS a FROM events")
SUITE.sql("log_distinct_users", "SELECT count(DISTINCT user_id) AS n FROM events")
SUITE.sql("log_min_max", "SELECT min(ts) AS lo, max(ts) AS hi FROM events")
SUITE.sql("log_top_types", "SELECT event_type, count(*) AS n FROM events WHERE event_type <> '' GROUP BY event_type ORDER BY n DESC, event_type")
SUITE.sql("log_users_by_type", "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10")
SUITE.sql("log_top_users", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
SUITE.sql("log_user_type_minute", "SELECT user_id, extract(minute FROM ts) AS m, event_type, count(*) AS n FROM events GROUP BY user_id, m, event_type ORDER BY n DESC, user_id, m, event_type LIMIT 10")
SUITE.sql("log_point_lookup", "SELECT event_id, user_id FROM events WHERE user_id = 42")
SUITE.sql("log_text_search", "SELECT count(*) AS n FROM pages WHERE url LIKE '%example.com%'")
SUITE.sql("log_text_groups", "SELECT regexp_replace(url, '^https?://(?:m\\.|blog\\.)?([^/?#]+).*$', '\\1') AS host, count(*) AS n, min(length(url)) AS shortest FROM pages WHERE url <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, host LIMIT 25".replace("\\\\", "\\"),
  "SELECT regexp_replace(url, '^https?://(?:m\\.|blog\\.)?([^/?#]+).*$', '\\1') AS host, count(*) AS n, min(length(url)) AS shortest FROM pages WHERE url <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, host LIMIT 25".replace("\\\\", "\\"))
SUITE.sql("log_wide_sums", "SELECT " + ", ".join(f"round(sum(value + {i}), 2) AS s{i:02}" for i in range(30)) + " FROM events")
SUITE.sql("log_two_keys", "SELECT user_id, event_type, count(*) AS n, round(avg(value), 6) AS a FROM events GROUP BY user_id, event_type")
SUITE.sql("log_by_hour", "SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' GROUP BY date_trunc('hour', ts) ORDER BY h LIMIT 20 OFFSET 10")
SUITE.sql("log_sorted_text", "SELECT props, event_id FROM events WHERE props LIKE '%1%' ORDER BY props, event_id LIMIT 10")
SUITE.sql("log_sorted_time", "SELECT * FROM events WHERE props LIKE '%9}' ORDER BY ts LIMIT 10")
SUITE.sql("log_sorted_both", "SELECT props, ts, event_id FROM events WHERE event_type <> '' ORDER BY ts, props LIMIT 10")
SUITE.sql("log_phrase_counts", "SELECT props, count(*) AS n FROM events WHERE props <> '' GROUP BY props ORDER BY n DESC, props LIMIT 10")
SUITE.sql("log_phrase_users", "SELECT props, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY props ORDER BY u DESC, props LIMIT 10")
SUITE.sql("log_type_phrase", "SELECT event_type, props, count(*) AS n FROM events WHERE props <> '' GROUP BY event_type, props ORDER BY n DESC, event_type, props LIMIT 10")
SUITE.sql("log_type_measures", "SELECT event_type, round(sum(value), 2) AS s, count(*) AS n, round(avg(value), 6) AS a, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10")
SUITE.sql("log_user_type", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10")
SUITE.sql("log_text_firsts", "SELECT props, min(event_type) AS t, count(*) AS n FROM events WHERE event_type LIKE '%ic%' AND props <> '' GROUP BY props ORDER BY n DESC, props LIMIT 10")
SUITE.sql("log_text_minima", "SELECT props, min(event_type) AS t, min(ts) AS first, count(*) AS n, count(DISTINCT user_id) AS u FROM events WHERE event_type LIKE 'c%' AND event_type NOT LIKE '%.x.%' GROUP BY props ORDER BY n DESC, props LIMIT 10")
SUITE.sql("log_text_lengths", "SELECT event_type, avg(length(props)) AS l, count(*) AS n FROM events WHERE props <> '' GROUP BY event_type HAVING count(*) > 100 ORDER BY l DESC, event_type LIMIT 25")
SUITE.sql("log_constant_group", "SELECT 1 AS one, event_type, count(*) AS n FROM events GROUP BY 1, event_type ORDER BY n DESC, event_type LIMIT 10")
SUITE.sql("log_shifted_keys", "SELECT user_id, user_id - 1 AS a, user_id - 2 AS b, user_id - 3 AS c, count(*) AS n FROM events GROUP BY user_id, user_id - 1, user_id - 2, user_id - 3 ORDER BY n DESC, user_id LIMIT 10")
SUITE.sql("log_filtered_pages", "SELECT url, count(*) AS n FROM pages WHERE page_id >= 10 AND url <> '' GROUP BY url ORDER BY n DESC, url LIMIT 10")
SUITE.sql("log_offset", "SELECT event_type, user_id, count(*) AS n FROM events WHERE user_id > 0 GROUP BY event_type, user_id ORDER BY n DESC, event_type, user_id LIMIT 10 OFFSET 100")
SUITE.sql("log_case_groups", "SELECT CASE WHEN value < 5 AND event_type = 'view' THEN 'low' ELSE event_type END AS src, user_id, count(*) AS n FROM events GROUP BY src, user_id ORDER BY n DESC, src, user_id LIMIT 10")
SUITE.sql("log_in_list", "SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE user_id IN (1, 6, 42) AND ts >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY user_id, CAST(ts AS DATE) ORDER BY n DESC, user_id, d LIMIT 10 OFFSET 2")
SUITE.sql("log_by_minute", "SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-14 00:00:00' AND ts < TIMESTAMP '2024-01-16 00:00:00' GROUP BY date_trunc('minute', ts) ORDER BY date_trunc('minute', ts) LIMIT 10 OFFSET 20")
SUITE.sql("log_distinct_texts", "SELECT count(DISTINCT props) AS n FROM events")

# --- what QUALIFY, GROUPS frames and intervals reach

SUITE.sql("win_qualify_hidden", "SELECT o.o_orderkey, o_totalprice FROM orders o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2 ORDER BY o.o_custkey, o_totalprice + 1 DESC, o_orderkey LIMIT 50")
SUITE.sql("win_groups_join", "SELECT o_orderkey, c_name, count(*) OVER (PARTITION BY c_nationkey ORDER BY o.o_orderstatus GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o_totalprice > 100000")
SUITE.sql("win_groups_grouped", "SELECT o_custkey % 50 AS k, sum(o_totalprice) > 0 AS x, sum(count(*)) OVER (ORDER BY o_custkey % 50 GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM orders GROUP BY o_custkey % 50")
SUITE.sql("win_groups_star", "SELECT *, count(*) OVER w AS n FROM nation WINDOW w AS (ORDER BY n_regionkey GROUPS BETWEEN 1 PRECEDING AND 1 PRECEDING) QUALIFY n > 0 ORDER BY n_nationkey")
SUITE.sql("type_interval_compare", "SELECT n_nationkey AS k, i > INTERVAL '45 days' AS more, i = INTERVAL '1 month 2 days' AS same FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN INTERVAL '1 month 2 days' ELSE INTERVAL '2 months 1 hour' END AS i FROM nation)")
SUITE.sql("type_interval_max", "SELECT n_regionkey AS k, max(i) = INTERVAL '2 months 1 hour' AS hi, min(i) < INTERVAL '33 days' AS lo FROM (SELECT n_regionkey, CASE WHEN n_nationkey % 3 = 0 THEN INTERVAL '1 month 2 days' ELSE INTERVAL '2 months 1 hour' END AS i FROM nation) GROUP BY n_regionkey")
SUITE.sql("type_unsigned", "SELECT CAST(n_nationkey AS UBIGINT) + 0 AS a, CAST('18446744073709551615' AS UBIGINT) = 18446744073709551615 AS b FROM nation", "SELECT CAST(n_nationkey AS DECIMAL(38,0)) AS a, true AS b FROM nation")

# --- the same operators for DataFrames


@SUITE.df("SELECT n_nationkey AS k, n_regionkey IN (SELECT CASE WHEN r_regionkey > 1 THEN r_regionkey END FROM region) AS x FROM nation")
def df_mark_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("CASE WHEN r_regionkey > 1 THEN r_regionkey END AS v")
    return mark_in(spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_regionkey", values, "v", "x").selectExpr("n_nationkey AS k", "x")


@SUITE.df("SELECT p_partkey, count(*) OVER (PARTITION BY p_type ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM part")
def df_groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return groups_frame(parts, ["p_type"], [F.col("p_size").asc_nulls_last()], -1, 0, n=F.count("*")).select("p_partkey", "n")


@SUITE.df("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def df_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")) == 1
    return qualify(spark.read.parquet(f"{sf_dir}/orders.parquet"), best).select("o_orderkey")


@SUITE.df("SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x FULL JOIN (SELECT c_custkey AS k, c_name AS b FROM customer WHERE c_custkey % 7 = 0) y USING (k)")
def df_full_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS k", "n_name AS a")
    right = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 7 = 0").selectExpr("c_custkey AS k", "c_name AS b")
    return full_using(left, right, ["k"]).select("k", "a", "b")


@SUITE.df("SELECT CAST(n_nationkey AS DOUBLE) AS v FROM nation EXCEPT SELECT s_acctbal FROM supplier")
def df_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = aligned(spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey AS v"), spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("s_acctbal"))
    return one.subtract(two)


@SUITE.df("SELECT n_regionkey AS k, GROUPING(n_regionkey) * 2 + GROUPING(n_nationkey) AS m, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def df_grouping_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = spark.read.parquet(f"{sf_dir}/nation.parquet").rollup("n_regionkey", "n_nationkey")
    return rolled.agg(grouping_mask("n_regionkey", "n_nationkey").alias("m"), F.count("*").alias("n")).selectExpr("n_regionkey AS k", "m", "n")
