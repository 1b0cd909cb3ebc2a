"""Sources, sinks and the table store: each query writes what it then reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import work_folder
from .base import Suite, engine_for

SUITE = Suite()
QUERIES, ORACLE = SUITE.queries, SUITE.oracle


def script(name: str, statements: list[str], oracle: str, store: bool = True, params: list | None = None) -> None:
    """The result of the last statement; {dir} is a new folder of the run."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = work_folder(spark, name)
        engine = engine_for(spark, sf_dir, " ".join(statements), f"{folder}/store" if store else None)
        session = engine.session()
        for text in statements[:-1]:
            session.execute(text.replace("{dir}", folder))
        return session.execute(statements[-1].replace("{dir}", folder), params).df

    QUERIES[name], ORACLE[name] = run, oracle


# --- files

script("src_csv_round_trip", ["COPY (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer) TO '{dir}/c.csv' (HEADER true)",
  "SELECT * FROM read_csv('{dir}/c.csv') WHERE c_acctbal > 0"], "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0", store=False)
script("src_csv_options", ["COPY (SELECT n_nationkey AS k, concat(n_name, '; \"x\"') AS v FROM nation) TO '{dir}/n.csv' (DELIMITER ';', HEADER false)",
  "SELECT column0 AS k, column1 AS v FROM read_csv('{dir}/n.csv', delimiter = ';', header = false)"], "SELECT CAST(n_nationkey AS BIGINT) AS k, concat(n_name, '; \"x\"') AS v FROM nation", store=False)
script("src_csv_aggregate", ["COPY (SELECT event_id, user_id, event_type, value FROM events) TO '{dir}/e.csv'",
  "SELECT event_type, count(*) AS n, round(sum(value), 2) AS s FROM read_csv('{dir}/e.csv') WHERE user_id % 2 = 0 GROUP BY event_type"],
  "SELECT event_type, count(*) AS n, round(sum(value), 2) AS s FROM events WHERE user_id % 2 = 0 GROUP BY event_type", store=False)
script("src_parquet_glob", ["COPY (SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0) TO '{dir}/p/a.parquet'", "COPY (SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 1) TO '{dir}/p/b.parquet'",
  "SELECT count(*) AS n, min(p_partkey) AS lo, max(p_name) AS hi FROM read_parquet('{dir}/p/*.parquet')"], "SELECT count(*) AS n, min(p_partkey) AS lo, max(p_name) AS hi FROM part", store=False)
script("src_parquet_union", ["COPY (SELECT s_suppkey AS k, s_name AS a FROM supplier) TO '{dir}/u/a.parquet'", "COPY (SELECT s_suppkey AS k, s_acctbal AS b FROM supplier) TO '{dir}/u/b.parquet'",
  "SELECT k, a, b FROM read_parquet('{dir}/u/*.parquet', union_by_name = true)"], "SELECT s_suppkey AS k, s_name AS a, CAST(NULL AS DOUBLE) AS b FROM supplier UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier", store=False)
script("src_parquet_widening", ["COPY (SELECT n_nationkey AS k, CAST(n_nationkey AS DECIMAL(8,2)) AS d FROM nation) TO '{dir}/w/a.parquet'", "COPY (SELECT c_custkey AS k, CAST(c_acctbal AS DECIMAL(12,4)) AS d FROM customer) TO '{dir}/w/b.parquet'",
  "SELECT k, d FROM read_parquet('{dir}/w/*.parquet', schema_mode = 'safe_widening')"], "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(n_nationkey AS DECIMAL(12,4)) AS d FROM nation UNION ALL SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,4)) FROM customer", store=False)


@SUITE.df("SELECT o_orderkey, o_orderstatus AS st, CAST(o_orderkey % 3 AS BIGINT) AS n, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 1")
def src_hive_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed partition keys, and files pruned by them."""
    folder = work_folder(spark, "hive")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "o_totalprice", "o_orderstatus AS st", "o_orderkey % 3 AS n")
    orders.write.partitionBy("st", "n").parquet(f"{folder}/orders")
    text = f"SELECT o_orderkey, st, n, o_totalprice FROM read_parquet('{folder}/orders', hive_partitioning = true) WHERE st = 'F' AND n = 1"
    return engine_for(spark, sf_dir, "").execute(text).df


script("src_copy_parquet_types", ["COPY (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS p, CAST(o_orderdate AS DATE) AS d, o_orderdate AS t, o_orderkey % 2 = 0 AS b FROM orders) TO '{dir}/o.parquet' (FORMAT parquet)",
  "SELECT * FROM read_parquet('{dir}/o.parquet')"], "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS p, CAST(o_orderdate AS DATE) AS d, o_orderdate AS t, o_orderkey % 2 = 0 AS b FROM orders", store=False)

# --- store

_ORDERS = "CREATE TABLE o AS SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(15,2)) AS p FROM orders"
_ALL = "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, CAST(o_totalprice AS DECIMAL(15,2)) AS p FROM orders"
script("dml_create_insert", ["CREATE TABLE n (k INT, v TEXT, d DECIMAL(10,2))", "INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation", "INSERT INTO n VALUES (100, NULL, 1.25), (101, 'x', NULL)", "SELECT * FROM n"],
  "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v, CAST(n_regionkey AS DECIMAL(10,2)) AS d FROM nation UNION ALL VALUES (100, NULL, 1.25), (101, 'x', NULL)")
script("dml_update", [_ORDERS, "UPDATE o SET p = p + 1, s = lower(s) WHERE c % 3 = 0", "SELECT * FROM o"], f"SELECT k, c, CASE WHEN c % 3 = 0 THEN lower(s) ELSE s END AS s, CAST(CASE WHEN c % 3 = 0 THEN p + 1 ELSE p END AS DECIMAL(15,2)) AS p FROM ({_ALL})")
script("dml_update_from", [_ORDERS, "UPDATE o SET s = x.seg FROM (SELECT c_custkey, c_mktsegment AS seg FROM customer WHERE c_acctbal > 0) x WHERE o.c = x.c_custkey", "SELECT * FROM o"],
  f"SELECT k, c, coalesce(x.c_mktsegment, s) AS s, p FROM ({_ALL}) o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) x ON o.c = x.c_custkey")
script("dml_delete", [_ORDERS, "DELETE FROM o WHERE p > 200000 OR s = 'P'", "SELECT * FROM o"], f"SELECT * FROM ({_ALL}) WHERE NOT (p > 200000 OR s = 'P')")
script("dml_delete_using", [_ORDERS, "DELETE FROM o USING customer x WHERE o.c = x.c_custkey AND x.c_mktsegment = 'BUILDING'", "SELECT * FROM o"], f"SELECT * FROM ({_ALL}) WHERE c NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
script("dml_returning", [_ORDERS, "DELETE FROM o WHERE k % 10 = 0 RETURNING k, p * 2 AS twice"], f"SELECT k, CAST(p * 2 AS DECIMAL(26,2)) AS twice FROM ({_ALL}) WHERE k % 10 = 0")
script("dml_truncate", [_ORDERS, "TRUNCATE o", "INSERT INTO o VALUES (1, 2, 'F', 3)", "SELECT * FROM o"], "SELECT CAST(1 AS BIGINT) AS k, CAST(2 AS BIGINT) AS c, 'F' AS s, CAST(3 AS DECIMAL(15,2)) AS p")
script("ddl_alter", [_ORDERS, "ALTER TABLE o ADD COLUMN note TEXT DEFAULT 'new'", "ALTER TABLE o RENAME COLUMN p TO price", "ALTER TABLE o DROP COLUMN s", "ALTER TABLE o RENAME TO q", "SELECT * FROM q"], f"SELECT k, c, p AS price, 'new' AS note FROM ({_ALL})")
script("ddl_views", [_ORDERS, "CREATE VIEW totals AS SELECT c, sum(p) AS t FROM o GROUP BY c", "CREATE TEMP VIEW big AS SELECT * FROM totals WHERE t > 500000", "SELECT * FROM big"], f"SELECT c, CAST(sum(p) AS DECIMAL(38,2)) AS t FROM ({_ALL}) GROUP BY c HAVING sum(p) > 500000")
script("ddl_schemas", ["CREATE SCHEMA a", "CREATE TABLE a.t AS SELECT r_regionkey AS k FROM region", "SELECT k FROM a.t"], "SELECT r_regionkey AS k FROM region")
script("txn_rollback_commit", [_ORDERS, "BEGIN", "DELETE FROM o", "ROLLBACK", "BEGIN", "DELETE FROM o WHERE s = 'O'", "COMMIT", "SELECT * FROM o"], f"SELECT * FROM ({_ALL}) WHERE s <> 'O'")
script("store_upkeep", [_ORDERS, "INSERT INTO o SELECT * FROM o", "DELETE FROM o WHERE k % 2 = 0", "COMPACT o", "ANALYZE o", "VACUUM", "CHECKPOINT", "SELECT * FROM o"], f"SELECT * FROM (SELECT * FROM ({_ALL}) UNION ALL SELECT * FROM ({_ALL})) WHERE k % 2 <> 0")
script("store_copy_from", ["COPY (SELECT c_custkey, c_name FROM customer) TO '{dir}/c.csv'", "CREATE TABLE c (k BIGINT, n TEXT)", "COPY c FROM '{dir}/c.csv' (HEADER true)", "SELECT * FROM c"], "SELECT c_custkey AS k, c_name AS n FROM customer")
script("catalog_tables", ["CREATE TABLE z (a INT, b TEXT)", "CREATE VIEW y AS SELECT a FROM z", "SELECT table_name, column_name, ordinal_position, data_type FROM information_schema.columns"],
  "SELECT * FROM (VALUES ('y', 'a', 1, 'bigint'), ('z', 'a', 1, 'bigint'), ('z', 'b', 2, 'string')) t(table_name, column_name, ordinal_position, data_type)")
script("catalog_show", ["CREATE TABLE z (a INT)", "SHOW TABLES"], "SELECT 'z' AS name, 'main' AS schema_name")
script("prepared_parameters", ["SELECT o_orderkey, ? AS tag FROM orders WHERE o_custkey = $2 OR o_totalprice > $3"], "SELECT o_orderkey, 'x' AS tag FROM orders WHERE o_custkey = 7 OR o_totalprice > 450000", store=False, params=["x", 7, 450000.0])
