"""DataFrame operators, the command line, the HTTP surface, and the driver's entry."""

import json
import subprocess
import sys
import threading
import time
import urllib.error
import urllib.request
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graniteql.cli import main
from graniteql.http.server import check_read_only, serve
from graniteql.operators import relational as R
from graniteql.session import Engine
from graniteql.sql.parser import SqlError

REPO = Path(__file__).resolve().parents[1]


def test_mark_in(spark):
    left = spark.sql("SELECT * FROM VALUES (1, 'match', 10), (2, 'miss', 99), (3, 'rhs', 99), (4, 'lhs', NULL), (5, 'empty', 10), (6, 'empty', NULL) AS t(id, grp, x)")
    right = spark.sql("SELECT * FROM VALUES ('match', 10), ('miss', 10), ('rhs', 10), ('rhs', NULL), ('lhs', 10) AS t(g, y)")
    found = {r["id"]: r["m"] for r in R.mark_in(left, "x", right, "y", "m", [("grp", "g")]).collect()}
    assert found == {1: True, 2: False, 3: None, 4: None, 5: False, 6: False}
    assert {r["id"]: r["m"] for r in R.mark_in(left, "x", right, "y", "m").collect()} == {1: True, 2: None, 3: None, 4: None, 5: True, 6: None}
    assert all(r["m"] is False for r in R.mark_in(left, "x", right.filter("false"), "y", "m").collect())


def test_groups_frame_and_qualify(spark):
    df = spark.sql("SELECT * FROM VALUES (1), (1), (2), (5) AS t(x)")
    found = sorted((r["x"], r["s"]) for r in R.groups_frame(df, [], [F.col("x")], -1, 0, s=F.sum("x")).collect())
    assert found == [(1, 2), (1, 2), (2, 4), (5, 7)]
    from pyspark.sql import Window

    assert R.qualify(df, F.row_number().over(Window.partitionBy("x").orderBy("x")) == 1).count() == 3


def test_aligned_and_using(spark):
    a, b = R.aligned(spark.sql("SELECT 1 AS x, NULL AS y"), spark.sql("SELECT 2L AS p, CAST(1.5 AS DECIMAL(5,2)) AS q"))
    assert a.dtypes == b.dtypes == [("x", "bigint"), ("y", "decimal(5,2)")]
    with pytest.raises(ValueError):
        R.aligned(spark.sql("SELECT 1"), spark.sql("SELECT 'x'"))
    assert R.full_using(spark.range(3), spark.range(2, 5), ["id"]).count() == 5
    mask = spark.range(4).selectExpr("id % 2 AS a", "id AS b").rollup("a", "b").agg(R.grouping_mask("a", "b").alias("g"))
    assert {r["g"] for r in mask.collect()} == {0, 1, 3}


def test_cli(spark, tmp_path):
    engine, out = Engine(spark, f"file://{tmp_path}/s"), []
    assert main(["--format", "csv", "-c", "CREATE TABLE t AS SELECT 1 AS x; SELECT x, NULL AS y FROM t", "--csv-null", "-"], engine, out.append) == 0
    assert out[-2:] == ["x,y", "1,-"]
    assert main(["-c", "SELECT nope"], engine, out.append) == 1
    out.clear()
    main(["shell"], engine, out.append, [".tables\n", "SELECT x\n", "FROM t;\n", "SELECT nope;\n", ".help\n", ".what\n", ".quit\n", "SELECT 1;\n"])
    text = "\n".join(out)
    assert "(1 row)" in text and "error:" in text and "unknown command .what" in text and out[-1].startswith("unknown")
    main(["profile", "SELECT 1 AS x"], engine, out.append)
    assert any("1 rows in" in x for x in out)
    main(["backup", f"file://{tmp_path}/b"], engine, out.append)
    main(["--store", f"file://{tmp_path}/r", "restore", f"file://{tmp_path}/b"], engine, out.append)
    assert Engine(spark, f"file://{tmp_path}/r").execute("SELECT x FROM t").fetchall() == [(1,)]
    spark.range(3).write.parquet(f"{tmp_path}/ext")
    out.clear()
    main(["datasource", "add", "e", "parquet", f"file://{tmp_path}/ext"], engine, out.append)
    assert out == ["e"]


def test_read_only_surface():
    for good in ("SELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a", "SHOW TABLES", "DESCRIBE t", "EXPLAIN SELECT 1", "VALUES (1)"):
        check_read_only(good)
    for bad in ("DROP TABLE t", "SELECT * FROM read_csv('/etc/passwd')", "SELECT (SELECT count(*) FROM read_parquet('x'))", "COPY t TO 'x'", "BEGIN", "EXPLAIN SELECT * FROM read_csv('x')"):
        with pytest.raises(SqlError):
            check_read_only(bad)


def test_http(spark):
    engine = Engine(spark)
    engine.register_parquet("nation", "/root/testdata/sf0.001/nation.parquet")
    server = serve(engine, token="secret")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def call(method, path, body=None, token="secret"):
        r = urllib.request.Request(base + path, json.dumps(body).encode() if body is not None else None, {"Authorization": f"Bearer {token}"}, method=method)
        try:
            with urllib.request.urlopen(r) as f:
                return f.status, f.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    assert call("GET", "/healthz", token="")[0] == 200 and call("GET", "/v1/info", token="")[0] == 401
    assert call("POST", "/v1/queries", {"sql": "DROP TABLE x"})[0] == 400
    status, data = call("POST", "/v1/queries", {"sql": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < ? ORDER BY n_nationkey", "params": [10]})
    name = json.loads(data)["id"]
    assert status == 202
    for _ in range(300):
        state = json.loads(call("GET", f"/v1/queries/{name}")[1])
        if state["state"] != "running":
            break
        time.sleep(0.1)
    assert state["state"] == "done" and state["rows"] == 10
    page = json.loads(call("GET", f"/v1/queries/{name}/results?limit=4")[1])
    assert [r[0] for r in page["rows"]] == [0, 1, 2, 3]
    rest = json.loads(call("GET", f"/v1/queries/{name}/results?limit=100&after={page['after']}")[1])
    assert [r[0] for r in rest["rows"]] == list(range(4, 10)) and rest["after"] is None
    assert json.loads(call("GET", f"/v1/queries/{name}/results?format=ndjson&limit=1")[1]) == {"n_nationkey": 0, "n_name": "NATION_0"}
    assert call("DELETE", f"/v1/queries/{name}")[0] == 204 and call("GET", f"/v1/queries/{name}")[0] == 404
    with pytest.raises(SqlError):
        serve(engine, "0.0.0.0")
    server.shutdown()


def test_entry_without_the_corpus_subpackage(tmp_path):
    """The rest imports and lists its queries when the corpus subpackage and the pipeline are gone."""
    for name in ("graniteql", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else None
    (tmp_path / "graniteql").mkdir()
    for p in (REPO / "graniteql").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "graniteql" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tpch_q01' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-P", "-c", f"import sys; sys.path.insert(0, {str(tmp_path)!r}); {code}"], capture_output=True, text=True, cwd=tmp_path)
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    sys.path.insert(0, str(REPO))
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
