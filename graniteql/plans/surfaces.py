"""What isn't a SELECT over tables: registered sources, rendering, plans, backup, recovery, HTTP, command line, and the
statements that the dialect refuses. Each query does the whole round and returns what came out."""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession

from ..cli import main
from ..http.server import serve
from ..session import Engine
from ..sources.files import remove, work_folder
from ..store.database import Store
from .base import Suite, engine_for

SUITE = Suite()
QUERIES, ORACLE = SUITE.queries, SUITE.oracle


def _fails(f) -> bool:
    try:
        f()
    except Exception:  # noqa: BLE001 - any refusal will do
        return True
    return False


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _ok(names: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n in names) + ") t(what, ok)"


# --- statements that are refused, a name for each

REFUSED = {
    "order by all": "SELECT * FROM t ORDER BY ALL",
    "limit expression": "SELECT a FROM t LIMIT a",
    "distinct on": "SELECT DISTINCT ON (a) a FROM t",
    "join without equality": "SELECT 1 FROM t JOIN t AS u ON t.a < u.a",
    "natural join": "SELECT 1 FROM t NATURAL JOIN t AS u",
    "unknown table": "SELECT * FROM nowhere",
    "unknown column": "SELECT nothing FROM t",
    "unknown function": "SELECT frobnicate(a) FROM t",
    "two statements": "SELECT 1; SELECT 2",
    "scalar subquery of two columns": "SELECT (SELECT a, b FROM t)",
    "scalar subquery of many rows": "SELECT (SELECT a FROM t)",
    "quantified comparison": "SELECT a FROM t WHERE a > ALL (SELECT b FROM t)",
    "window in where": "SELECT a FROM t WHERE row_number() OVER (ORDER BY a) = 1",
    "window in having": "SELECT a FROM t GROUP BY a HAVING row_number() OVER (ORDER BY a) = 1",
    "qualify without window": "SELECT a FROM t QUALIFY a = 1",
    "groups without order": "SELECT count(*) OVER (GROUPS CURRENT ROW) FROM t",
    "union of unlike widths": "SELECT a FROM t UNION SELECT a, b FROM t",
    "order by expression of a set": "SELECT a FROM t UNION SELECT b FROM t ORDER BY a + 1",
    "aggregate in where": "SELECT a FROM t WHERE sum(b) > 1",
    "column not grouped": "SELECT a, b FROM t GROUP BY a",
    "unsigned below zero": "SELECT CAST(a - 100 AS UBIGINT) FROM t",
    "cast of text": "SELECT CAST('x' AS INT) FROM t",
    "overflow": "SELECT 9223372036854775807 + a FROM t",
}


@SUITE.df(_ok(sorted(REFUSED)))
def reject_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Engine(spark).session()
    session.execute("CREATE TEMP VIEW t AS SELECT * FROM (VALUES (1, 2), (3, 4)) v(a, b)")
    found = [(name, _fails(lambda text=text: session.execute(text).fetchall())) for name, text in sorted(REFUSED.items())]
    return _rows(spark, found, "what string, ok boolean")


SUITE.sql("sub_guarded", "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 0 THEN (SELECT max(r_regionkey) FROM region) WHEN n_regionkey = 2 THEN (SELECT min(r_regionkey) FROM region WHERE r_regionkey > n_regionkey) END AS x FROM nation",
  "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 2 THEN (SELECT min(r_regionkey) FROM region WHERE r_regionkey > 2) END AS x FROM nation")

# --- sources


@SUITE.df("SELECT c_custkey, c_name FROM customer")
def src_csv_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gzip files, told by their content."""
    folder = work_folder(spark, "compressed")
    spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name").repartition(2).write.option("header", "true").option("compression", "gzip").csv(f"{folder}/c")
    return Engine(spark).execute(f"SELECT * FROM read_csv('{folder}/c/*.gz')").df


@SUITE.df("SELECT n_nationkey AS k, n_name AS v FROM nation")
def src_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several files of one schema."""
    folder, session = work_folder(spark, "files"), engine_for(spark, sf_dir, "nation").session()
    for i in range(3):
        session.execute(f"COPY (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey % 3 = {i}) TO '{folder}/n{i}.csv'")
    return session.execute(f"SELECT k, v FROM read_csv('{folder}/*.csv')").df


@SUITE.df(_ok(["changed while it ran", "schemas differ"]))
def src_csv_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that change while a query runs, and files of different schemas."""
    folder, session = work_folder(spark, "refused"), engine_for(spark, sf_dir, "nation").session()
    session.execute(f"COPY (SELECT n_nationkey AS k FROM nation) TO '{folder}/a.csv'")
    result = session.execute(f"SELECT * FROM read_csv('{folder}/*.csv')")
    remove(spark, f"{folder}/a.csv")
    session.execute(f"COPY (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3) TO '{folder}/a.csv'")
    changed = _fails(result.fetchall)
    session.execute(f"COPY (SELECT n_nationkey AS k, n_name AS v FROM nation) TO '{folder}/b.csv'")
    found = [("changed while it ran", changed), ("schemas differ", _fails(lambda: session.execute(f"SELECT * FROM read_csv('{folder}/*.csv')").fetchall()))]
    return _rows(spark, found, "what string, ok boolean")


@SUITE.df("SELECT r_regionkey AS k, r_name AS v FROM region")
def src_external_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered source that another engine on the same store finds."""
    folder = work_folder(spark, "externals")
    Engine(spark, f"{folder}/store").add_external("r", "parquet", f"{sf_dir}/region.parquet")
    return Engine(spark, f"{folder}/store").execute("SELECT r_regionkey AS k, r_name AS v FROM r").df


@SUITE.df("SELECT n_nationkey AS k, n_name AS v FROM nation")
def src_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered folder whose files get another column: REFRESH TABLE takes it over."""
    folder = work_folder(spark, "refresh")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    nation.selectExpr("n_nationkey AS k").write.parquet(f"{folder}/n")
    engine = Engine(spark)
    engine.register_parquet("n", f"{folder}/n")
    nation.selectExpr("n_nationkey AS k", "n_name AS v").write.mode("overwrite").parquet(f"{folder}/n")
    engine.execute("REFRESH TABLE n")
    return engine.execute("SELECT k, v FROM n").df


@SUITE.df("SELECT 'csv' AS how, r_regionkey || ',' || r_name AS line FROM region UNION ALL SELECT 'jsonl', '{\"r_regionkey\": ' || r_regionkey || ', \"r_name\": \"' || r_name || '\"}' FROM region UNION ALL VALUES ('csv', 'r_regionkey,r_name')")
def src_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = engine_for(spark, sf_dir, "region").execute("SELECT r_regionkey, r_name FROM region")
    return _rows(spark, [(how, line) for how in ("csv", "jsonl") for line in result.render(how)], "how string, line string")


# --- the store and its surfaces


@SUITE.df(_ok(["analyze", "formatted"]))
def explain_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = engine_for(spark, sf_dir, "nation").session()
    (plain,), (run,) = (session.execute(f"{how} SELECT n_regionkey, count(*) FROM nation WHERE n_nationkey > 3 GROUP BY 1").fetchall()[0] for how in ("EXPLAIN", "EXPLAIN ANALYZE"))
    found = [("formatted", "PushedFilters" in plain and "HashAggregate" in plain), ("analyze", "rows: 5" in run)]
    return _rows(spark, sorted(found), "what string, ok boolean")


@SUITE.df("SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_custkey % 2 = 1")
def store_backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "backup")
    engine = engine_for(spark, sf_dir, "customer", f"{folder}/store")
    engine.execute("CREATE TABLE c AS SELECT c_custkey AS k, c_name AS n FROM customer")
    engine.execute("DELETE FROM c WHERE k % 2 = 0")
    engine.backup(f"{folder}/copy")
    return Engine.restore(spark, f"{folder}/copy", f"{folder}/again").execute("SELECT * FROM c").df


@SUITE.df("SELECT r_regionkey AS k FROM region")
def store_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest that was cut off is passed over; what goes over the quota leaves nothing."""
    folder = work_folder(spark, "recovery")
    engine = engine_for(spark, sf_dir, "region nation", f"{folder}/store")
    engine.execute("CREATE TABLE r AS SELECT r_regionkey AS k FROM region")
    store = engine.store
    out = store.manifests.fs.create(store.manifests._path(99), False)
    out.write(bytearray(b'{"generation": 99'))
    out.close()
    small = engine_for(spark, sf_dir, "nation", f"{folder}/store")
    small.store = Store(small.spark, f"{folder}/store", quota=10)
    if not _fails(lambda: small.execute("INSERT INTO r SELECT n_nationkey FROM nation")):
        raise AssertionError("the quota was passed over")
    return Engine(spark, f"{folder}/store").execute("SELECT * FROM r").df


_KEPT = "SELECT o_orderkey AS k, o_orderstatus AS s FROM orders"


@SUITE.df(f"SELECT k, s FROM ({_KEPT}) WHERE s <> 'P' UNION ALL SELECT k + 10000000, 'new' FROM ({_KEPT}) WHERE s = 'F'")
def store_vacuum_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VACUUM of another session while a transaction is open: what it has written and what it reads stay."""
    engine = engine_for(spark, sf_dir, "orders", f"{work_folder(spark, 'vacuum')}/store")
    one, two = engine.session(), engine.session()
    one.execute(f"CREATE TABLE o AS {_KEPT}")
    one.execute("BEGIN")
    one.execute("INSERT INTO o SELECT k + 10000000, 'new' FROM o WHERE s = 'F'")
    two.execute("DELETE FROM o WHERE s = 'P'")
    two.execute("VACUUM")
    one.execute("COMMIT")
    two.execute("VACUUM")
    return engine.execute("SELECT * FROM o").df


@SUITE.df(f"SELECT k, CASE WHEN k % 3 = 1 THEN 'one' ELSE s END AS s FROM ({_KEPT}) WHERE k % 3 <> 2 UNION ALL SELECT -1, 'x'")
def txn_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transactions that change different rows of a table both commit; of two that change the same, the first."""
    engine = engine_for(spark, sf_dir, "orders", f"{work_folder(spark, 'rebase')}/store")
    one, two = engine.session(), engine.session()
    one.execute(f"CREATE TABLE o AS {_KEPT}")
    for session in (one, two):
        session.execute("BEGIN")
    one.execute("UPDATE o SET s = 'one' WHERE k % 3 = 1")
    two.execute("DELETE FROM o WHERE k % 3 = 2")
    two.execute("INSERT INTO o VALUES (-1, 'x')")
    two.execute("COMMIT")
    one.execute("COMMIT")
    for session in (one, two):
        session.execute("BEGIN")
        session.execute("UPDATE o SET s = s WHERE k % 3 = 0")
    two.execute("COMMIT")
    if not _fails(lambda: one.execute("COMMIT")):
        raise AssertionError("two changes of the same rows were committed")
    return engine.execute("SELECT * FROM o").df


@SUITE.df("SELECT n_nationkey AS k, n_name AS v FROM nation")
def http_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submit, wait, page through the result, delete it; writing statements and a missing token are refused."""
    server = serve(engine_for(spark, sf_dir, "nation"), token="secret")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(method: str, path: str, body: object = None, token: str = "secret") -> tuple[int, dict]:
        asked = urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", None if body is None else json.dumps(body).encode(), {"Authorization": f"Bearer {token}"}, method=method)
        try:
            with urllib.request.urlopen(asked, timeout=300) as f:
                return f.status, json.loads(f.read() or b"{}")
        except urllib.error.HTTPError as e:
            return e.code, {}

    try:
        refused = call("POST", "/v1/queries", {"sql": "DROP TABLE t"})[0], call("GET", "/v1/info", token="")[0], call("GET", "/healthz")[0]
        name = call("POST", "/v1/queries", {"sql": "SELECT n_nationkey AS k, n_name AS v FROM nation"})[1]["id"]
        while call("GET", f"/v1/queries/{name}")[1]["state"] == "running":
            time.sleep(0.1)
        rows, after = [], -1
        while after is not None:
            page = call("GET", f"/v1/queries/{name}/results?limit=7&after={after}")[1]
            rows += [tuple(r) for r in page["rows"]]
            after = page["after"]
        gone = call("DELETE", f"/v1/queries/{name}")[0], call("GET", f"/v1/queries/{name}")[0]
    finally:
        server.shutdown()
    if (refused, gone) != ((400, 401, 200), (204, 404)):
        raise AssertionError(f"unexpected answers {refused} {gone}")
    return _rows(spark, rows, "k long, v string")


@SUITE.df("SELECT 'query' AS how, r_regionkey || ',' || r_name AS line FROM region UNION ALL SELECT 'shell', r_regionkey || ',' || r_name FROM region UNION ALL VALUES ('query', 'r_regionkey,r_name'), ('shell', 'r_regionkey,r_name')")
def cli_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query by the command line, and the same typed into the shell."""
    text, out = "SELECT r_regionkey, r_name FROM region", {"query": [], "shell": []}
    main(["--format", "csv", "-c", text], engine_for(spark, sf_dir, "region"), out["query"].append)
    main(["--format", "csv", "shell"], engine_for(spark, sf_dir, "region"), out["shell"].append, iter([f"{text};", ".quit"]))
    lines = [(how, line) for how, found in out.items() for line in "\n".join(found).splitlines() if "," in line]
    return _rows(spark, lines, "how string, line string")
