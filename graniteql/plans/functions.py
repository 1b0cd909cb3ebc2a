"""Scalar functions, types, casts, literals and predicates (one query each)."""

from __future__ import annotations

from .base import Suite

SUITE = Suite()
QUERIES, ORACLE = SUITE.queries, SUITE.oracle

SUITE.sql("fn_substring", """
SELECT c_custkey, substring(c_name, 3, 4) AS a, substr(c_name, -3) AS b, substr(c_name, 0, 2) AS c, substring(c_name FROM 2 FOR 5) AS d, substr(c_name, -4, 2) AS e,
  substr(c_name, CAST(c_custkey % 3 AS INT), 3) AS f FROM customer""")
SUITE.sql("fn_length_case", "SELECT p_partkey, length(p_name) AS n, char_length(p_brand) AS m, lower(p_type) AS lo, upper(p_name) AS up FROM part",
  "SELECT p_partkey, length(p_name) AS n, length(p_brand) AS m, lower(p_type) AS lo, upper(p_name) AS up FROM part")
SUITE.sql("fn_unicode_length", "SELECT doc_id, length(text) AS n, lower(substr(text, 1, 20)) AS u, lower(substr(text, -20)) AS l FROM documents")
SUITE.sql("fn_trim", """
SELECT c_custkey, trim('  ' || c_mktsegment || ' ') AS a, ltrim(c_mktsegment, 'AB') AS b, rtrim(c_mktsegment, 'GNI') AS c, trim(c_name, 'Cr0') AS d, trim(chr) AS e
FROM (SELECT *, ' \tx' AS chr FROM customer) t""")
SUITE.sql("fn_trim_sides", "SELECT TRIM(BOTH 'B' FROM c_mktsegment) AS a, TRIM(LEADING 'AM' FROM c_mktsegment) AS b, TRIM(TRAILING 'E' FROM c_mktsegment) AS c, count(*) AS n FROM customer GROUP BY 1, 2, 3")
SUITE.sql("fn_concat", "SELECT o_orderkey, concat(o_orderstatus, NULL, '-', o_orderpriority) AS a, o_orderstatus || o_orderpriority AS b, o_orderstatus || NULL AS c FROM orders")
SUITE.sql("fn_replace", "SELECT c_custkey, replace(c_name, '0', 'o') AS a, replace(c_mktsegment, 'U', '') AS b FROM customer")
SUITE.sql("fn_regexp_replace", r"SELECT c_custkey, regexp_replace(c_name, '([a-z]+)#0*', '<\1>$') AS a, regexp_replace(c_mktsegment, '[AEIOU]', '') AS b FROM customer",
  r"SELECT c_custkey, regexp_replace(c_name, '([a-z]+)#0*', '<\1>$', 'g') AS a, regexp_replace(c_mktsegment, '[AEIOU]', '', 'g') AS b FROM customer")
SUITE.sql("fn_starts_ends_contains", "SELECT p_partkey, starts_with(p_name, 'Part') AS a, ends_with(p_name, '7') AS b, contains(p_brand, '#2') AS c FROM part")
SUITE.sql("fn_coalesce_nullif", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, nullif(o_orderkey % 3, 0) AS b, coalesce(NULL, NULL, o_custkey) AS c FROM orders")
SUITE.sql("fn_abs", "SELECT c_custkey, abs(c_acctbal) AS a, abs(-c_custkey) AS b, abs(CAST(c_acctbal AS DECIMAL(15,2))) AS c FROM customer")
SUITE.sql("fn_ceil_floor", """
SELECT c_custkey, ceil(c_acctbal) AS a, floor(c_acctbal) AS b, ceil(c_custkey) AS c, floor(CAST(c_acctbal AS DECIMAL(15,2))) AS d, ceiling(CAST(c_acctbal AS DECIMAL(15,2))) AS e FROM customer""",
  """SELECT c_custkey, ceil(c_acctbal) AS a, floor(c_acctbal) AS b, CAST(c_custkey AS DOUBLE) AS c, CAST(floor(CAST(c_acctbal AS DECIMAL(15,2))) AS DECIMAL(15,0)) AS d, CAST(ceil(CAST(c_acctbal AS DECIMAL(15,2))) AS DECIMAL(15,0)) AS e FROM customer""")
SUITE.sql("fn_round", """
SELECT c_custkey, round(CAST(c_acctbal AS DECIMAL(15,2)), 1) AS a, round(CAST(c_acctbal AS DECIMAL(15,2))) AS b, round(c_custkey, -2) AS c, round(c_custkey / 8, 0) AS d FROM customer""",
  """SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(15,2)), 1) AS DECIMAL(15,1)) AS a, CAST(round(CAST(c_acctbal AS DECIMAL(15,2))) AS DECIMAL(15,0)) AS b, round(c_custkey, -2) AS c, round(c_custkey / 8, 0) AS d FROM customer""")
SUITE.sql("fn_extract", """
SELECT event_id, extract(year FROM ts) AS y, extract(month FROM ts) AS mo, date_part('day', ts) AS d, extract(hour FROM ts) AS h, extract(minute FROM ts) AS mi, extract(second FROM ts) AS s,
  year(ts) AS y2, month(ts) AS m2, day(ts) AS d2 FROM events""")
SUITE.sql("fn_date_trunc", """
SELECT event_id, date_trunc('year', ts) AS y, date_trunc('month', ts) AS m, date_trunc('day', ts) AS d, date_trunc('hour', ts) AS h, date_trunc('minute', ts) AS mi, date_trunc('second', ts) AS s FROM events""",
  """SELECT event_id, CAST(date_trunc('year', ts) AS DATE) AS y, CAST(date_trunc('month', ts) AS DATE) AS m, CAST(date_trunc('day', ts) AS DATE) AS d, date_trunc('hour', ts) AS h, date_trunc('minute', ts) AS mi, date_trunc('second', ts) AS s FROM events""")
SUITE.sql("fn_to_timestamp_seconds", "SELECT o_orderkey, to_timestamp_seconds(o_orderkey * 86399) AS t FROM orders", "SELECT o_orderkey, make_timestamp(CAST(o_orderkey * 86399 * 1000000 AS BIGINT)) AS t FROM orders")
SUITE.sql("fn_epoch_days", "SELECT o_orderkey, CAST(o_orderkey AS DATE) AS d FROM orders", "SELECT o_orderkey, DATE '1970-01-01' + CAST(o_orderkey AS INTEGER) AS d FROM orders")
SUITE.sql("fn_at_time_zone", """
SELECT column1 AS local, (column1 AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS u, (column1 AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS ny
FROM (VALUES (TIMESTAMP '2024-01-15 12:00:00'), (TIMESTAMP '2024-07-15 12:00:00.123456'), (TIMESTAMP '2024-11-03 03:30:00'), (CAST(NULL AS TIMESTAMP))) t""",
  """SELECT column1 AS local, (column1 AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS u, (column1 AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS ny
FROM (VALUES (TIMESTAMP '2024-01-15 12:00:00'), (TIMESTAMP '2024-07-15 12:00:00.123456'), (TIMESTAMP '2024-11-03 03:30:00'), (CAST(NULL AS TIMESTAMP))) t(column1)""")
SUITE.sql("fn_uuid", """
SELECT o_orderkey, CAST(CAST(concat('A0EEBC99-9C0B-4EF8-BB6D-', substr(concat('000000000000', CAST(o_orderkey AS VARCHAR)), -12)) AS UUID) AS VARCHAR) AS u FROM orders""")
SUITE.sql("fn_interval_arithmetic", """
SELECT event_id, ts + INTERVAL '1' DAY AS a, ts - INTERVAL '2 hours 30 minutes' AS b, ts + INTERVAL '3' MONTH AS c, ts - INTERVAL '1-2' YEAR TO MONTH AS d,
  ts + INTERVAL '1 10:20:30.5' DAY TO SECOND AS e, ts + INTERVAL '1 month 2 days 3 hours' AS f FROM events""",
  """SELECT event_id, ts + INTERVAL '1' DAY AS a, ts - INTERVAL '2 hours 30 minutes' AS b, ts + INTERVAL '3' MONTH AS c, ts - INTERVAL '14' MONTH AS d,
  ts + INTERVAL '1 day 10 hours 20 minutes 30.5 seconds' AS e, ts + INTERVAL '1 month 2 days 3 hours' AS f FROM events""")
SUITE.sql("fn_date_interval", """
SELECT d, d + INTERVAL '1' MONTH AS a, d - INTERVAL '1' DAY AS b, d + INTERVAL '1 month 3 hours' AS c, d + INTERVAL '1' YEAR AS e
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) t""",
  """SELECT d, CAST(d + INTERVAL '1' MONTH AS DATE) AS a, CAST(d - INTERVAL '1' DAY AS DATE) AS b, d + INTERVAL '1 month 3 hours' AS c, CAST(d + INTERVAL '1' YEAR AS DATE) AS e
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) t""")
SUITE.sql("type_casts", """
SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS a, o_orderkey::VARCHAR AS b, CAST(o_orderdate AS DATE) AS c, CAST('42' AS BIGINT) AS d, CAST(o_orderkey AS DOUBLE) AS e,
  CAST('true' AS BOOLEAN) AS f, CAST(o_orderkey AS DECIMAL) AS g, CAST('2024-02-29' AS DATE) AS h, CAST('2024-02-29 12:30:45.5' AS TIMESTAMP) AS i, CAST(o_custkey AS SMALLINT) AS j FROM orders""",
  """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS a, o_orderkey::VARCHAR AS b, CAST(o_orderdate AS DATE) AS c, CAST('42' AS BIGINT) AS d, CAST(o_orderkey AS DOUBLE) AS e,
  true AS f, CAST(o_orderkey AS DECIMAL(18,3)) AS g, DATE '2024-02-29' AS h, TIMESTAMP '2024-02-29 12:30:45.5' AS i, CAST(o_custkey AS BIGINT) AS j FROM orders""")
SUITE.sql("type_literals", "SELECT 1 AS a, 3000000000 AS b, 2.50 AS c, 1e3 AS d, 'it''s' AS e, TRUE AS f, DATE '2024-02-29' AS g, TIMESTAMP '2024-01-01 00:00:00.000001' AS h, 'a\\b' AS i, '' AS j")
SUITE.sql("type_decimal_arithmetic", """
SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) + CAST(1.005 AS DECIMAL(6,3)) AS a, CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.07 AS DECIMAL(4,2)) AS b,
  CAST(o_totalprice AS DECIMAL(12,2)) / CAST(3 AS DECIMAL(4,2)) AS c, CAST(o_totalprice AS DECIMAL(12,2)) - 1 AS d FROM orders""",
  """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) + CAST(1.005 AS DECIMAL(6,3)) AS DECIMAL(14,3)) AS a, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.07 AS DECIMAL(4,2)) AS DECIMAL(17,4)) AS b,
  CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) / 3.0::DOUBLE AS c, CAST(CAST(o_totalprice AS DECIMAL(12,2)) - 1 AS DECIMAL(13,2)) AS d FROM orders""")
SUITE.sql("expr_arithmetic", "SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity - l_tax AS b, -l_quantity AS c, l_orderkey % 7 AS d, l_orderkey / 4 AS e, +l_linenumber AS f, l_extendedprice / l_quantity AS g FROM lineitem")
SUITE.sql("expr_case", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS a, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS b,
  CASE WHEN o_orderkey % 2 = 0 THEN 10 / (o_orderkey % 2 + 1) ELSE NULL END AS c FROM orders""")
SUITE.sql("pred_comparisons", "SELECT count(*) FILTER (WHERE l_quantity = 10) AS eq, count(*) FILTER (WHERE l_quantity <> 10) AS ne, count(*) FILTER (WHERE l_quantity < 10) AS lt, count(*) FILTER (WHERE l_quantity >= 10 AND NOT l_tax > 0.04) AS ge FROM lineitem")
SUITE.sql("pred_three_valued", """
SELECT column1 AS a, column2 AS b, column1 AND column2 AS x, column1 OR column2 AS y, NOT column1 AS z, column1 IS TRUE AS t, column1 IS NOT FALSE AS f, column1 IS NULL AS n
FROM (VALUES (TRUE, TRUE), (TRUE, FALSE), (TRUE, NULL), (FALSE, FALSE), (FALSE, NULL), (CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN))) v""",
  """SELECT column1 AS a, column2 AS b, column1 AND column2 AS x, column1 OR column2 AS y, NOT column1 AS z, coalesce(column1, false) AS t, coalesce(column1, true) AS f, column1 IS NULL AS n
FROM (VALUES (TRUE, TRUE), (TRUE, FALSE), (TRUE, NULL), (FALSE, FALSE), (FALSE, NULL), (CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN))) v(column1, column2)""")
SUITE.sql("pred_in_between", "SELECT o_orderkey, o_orderstatus IN ('F', NULL) AS a, o_orderkey NOT IN (1, 2, 3) AS b, o_totalprice BETWEEN 1000 AND 200000 AS c, o_custkey NOT BETWEEN 5 AND 50 AS d FROM orders")
SUITE.sql("pred_like", r"SELECT c_custkey, c_name LIKE 'Customer%1' AS a, c_mktsegment NOT LIKE '%U_L%' AS b, 'a%b' LIKE 'a!%b' ESCAPE '!' AS c, 'a\b' LIKE 'a\b' AS d, c_name LIKE '%' || CAST(c_custkey AS VARCHAR) AS e FROM customer")
SUITE.sql("pred_filter_conjuncts", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_discount > 0.05 AND (l_returnflag = 'R' OR l_linestatus = 'O') AND l_quantity < 5")
