"""What the dialect accepts, rejects, types and raises."""

import datetime
import re
from decimal import Decimal

import pytest

from graniteql.functions.scalar import interval_parts
from graniteql.session import Engine
from graniteql.sql import commands, emit
from graniteql.sql.emit import Emitter
from graniteql.sql.parser import SqlError, parse_query


@pytest.fixture(scope="module")
def session(spark):
    return Engine(spark).session()


def one(session, text, *params):
    (row,) = session.execute(text, list(params)).fetchall()
    return row


@pytest.mark.parametrize(
    "text",
    [
        "SELECT DISTINCT ON (a) a FROM t", "SELECT TOP 5 a FROM t", "SELECT a FROM t GROUP BY ALL", "SELECT a FROM t ORDER BY ALL", "SELECT * FROM a NATURAL JOIN b",
        "SELECT * FROM a CROSS JOIN b", "SELECT * FROM a, LATERAL (SELECT 1) b", "WITH RECURSIVE a AS (SELECT 1) SELECT * FROM a", "SELECT a FROM t UNION BY NAME SELECT a FROM s",
        "SELECT a ILIKE 'x' FROM t", "SELECT a = ANY (SELECT 1)", "SELECT TRY_CAST(a AS INT)", "SELECT first_value(a IGNORE NULLS) OVER ()", "SELECT lag(a) IGNORE NULLS OVER () FROM t",
        "WITH a AS (SELECT 1), A AS (SELECT 2) SELECT 1", "SELECT a FROM t LIMIT 5 PERCENT", "SELECT sum(a) FILTER (WHERE b) OVER () FROM t", "SELECT", "SELECT 1 1 1", "SELECT 'open",
        "VALUES (1, 2), (3)", "SELECT a FROM t LIMIT a", "SELECT CASE END", "SELECT 1;;SELECT 2",
    ],
)
def test_parser_rejects(text):
    with pytest.raises(SqlError):
        parse_query(text)


@pytest.mark.parametrize(
    "text",
    [
        "SELECT unknown_function(1)", "SELECT sum(DISTINCT x) OVER () FROM (VALUES (1)) t(x)", "SELECT x FROM (VALUES (1)) t(x) QUALIFY x > 1", "SELECT ntile(0) OVER () FROM (VALUES (1)) t(x)",
        "SELECT row_number() FROM (VALUES (1)) t(x)", "SELECT * FROM (VALUES (1)) a(x) JOIN (VALUES (1)) b(y) ON a.x < b.y", "SELECT sum('a')", "SELECT CAST(1 AS NOTYPE)", "SELECT CAST(1 AS DECIMAL(40,2))",
        "SELECT date_part('century', DATE '2024-01-01')", "SELECT x FROM (VALUES (1)) t(x) UNION SELECT 1 ORDER BY x + 1", "SELECT * FROM read_json('x')", "SELECT * FROM read_csv('x', nope = 1)",
        "SELECT 'a' LIKE 'b' ESCAPE 'cc'", "SELECT ?", "SELECT substr('a')", "SELECT count(*) OVER (GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM (VALUES (1)) t(x)",
    ],
)
def test_translation_rejects(session, text):
    with pytest.raises(SqlError):
        session.execute(text)


@pytest.mark.parametrize(
    "text",
    ["SELECT 1 / 0", "SELECT 1 % 0", "SELECT 1.0e0 / 0", "SELECT CAST('x' AS INT)", "SELECT CAST('nope' AS UUID)", "SELECT (SELECT x FROM (VALUES (1), (2)) t(x))", "SELECT CAST(99999999999 AS DECIMAL(5,0))",
     "SELECT 9223372036854775807 + 1", "SELECT abs(-9223372036854775807 - 1)", "SELECT TIMESTAMP '2024-03-10 02:30:00' AT TIME ZONE 'America/New_York'", "SELECT regexp_replace('a', '(', 'b')", "SELECT substr(x, 1, y) FROM (VALUES ('abc', -1)) t(x, y)"],
)
def test_execution_errors(session, text):
    with pytest.raises(Exception):  # noqa: B017 - Spark's errors have many classes
        session.execute(text).fetchall()


def test_types(session):
    kinds = dict(session.execute("SELECT CAST(1 AS INT) a, CAST(1 AS UBIGINT) b, CAST(1 AS REAL) c, CAST(1 AS DECIMAL) d, CAST(1 AS DECIMAL(7)) e, CAST('x' AS CHAR(3)) f, X'ff' g, TIMESTAMP '2024-01-01 00:00:00' h, CAST('12:30:00' AS TIME) i, sum(1) j, avg(2.5) k, count() l, 7 / 2 m, ceil(3) n, row_number() OVER () o").schema)
    assert kinds == {"a": "bigint", "b": "decimal(20,0)", "c": "double", "d": "decimal(18,3)", "e": "decimal(7,0)", "f": "string", "g": "binary", "h": "timestamp_ntz", "i": "time(6)", "j": "decimal(38,0)", "k": "double", "l": "bigint", "m": "double", "n": "double", "o": "bigint"}


def test_values(session):
    assert one(session, r"SELECT 'a\b', concat('a', NULL), substr('abcdef', 0, 2), substr('abcdef', -2), 7 / 2, '$1' || regexp_replace('xay', '(a)', '<\1$>')") == (r"a\b", "a", "a", "ef", 3.5, "$1x<a$>y")
    assert one(session, "SELECT DATE '2024-01-31' + INTERVAL '1' MONTH, CAST(0 AS DATE), date_trunc('month', TIMESTAMP '2024-02-29 10:00:00'), extract(second FROM TIMESTAMP '2024-01-01 00:00:03.9')") == (datetime.date(2024, 2, 29), datetime.date(1970, 1, 1), datetime.date(2024, 2, 1), 3)
    assert one(session, "SELECT TIMESTAMP '2024-11-03 01:30:00' AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC'") == (datetime.datetime(2024, 11, 3, 6, 30),)
    assert one(session, "SELECT TIMESTAMP '2024-04-07 01:45:00' AT TIME ZONE 'Australia/Lord_Howe' AT TIME ZONE 'UTC'") == (datetime.datetime(2024, 4, 6, 15, 15),)
    assert one(session, "SELECT CAST(2.345 AS DECIMAL(5,2)), round(2.5), round(-2.5), round(1234, -2), CAST('A0EEBC99-9C0B-4EF8-BB6D-6BB9BD380A11' AS UUID)") == (Decimal("2.35"), Decimal("3"), Decimal("-3"), 1200, "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11")


def test_lazy_branches(session):
    assert session.execute("SELECT CASE WHEN x = 0 THEN -1 ELSE 10 % x END AS y FROM (VALUES (0), (3)) t(x) ORDER BY y").fetchall() == [(-1,), (1,)]


def test_parameters(session):
    assert one(session, "SELECT ?, ?, $1, ?", 5, "it's \\", None) == (5, "it's \\", 5, None)
    prepared = session.prepare("SELECT x FROM (VALUES (1), (2), (3)) t(x) WHERE x >= ? ORDER BY x")
    assert [prepared.execute(n).fetchall() for n in (2, 3)] == [[(2,), (3,)], [(3,)]]
    day = datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert one(session, "SELECT ?, ?, ?, ?", day, day.date(), Decimal("1.50"), b"\x01") == (day, day.date(), Decimal("1.50"), bytearray(b"\x01"))


@pytest.mark.parametrize(("value", "low", "high", "parts"), [("1 year 2 months", None, None, (14, 0, 0)), ("-3", "DAY", None, (0, -3, 0)), ("1-2", "YEAR", "MONTH", (14, 0, 0)), ("1 02:03:04.5", "DAY", "SECOND", (0, 1, 7_384_500_000)), ("2 weeks 1 hour", None, None, (0, 14, 3_600_000_000)), ("-0:30", None, None, (0, 0, -1_800_000_000))])
def test_intervals(value, low, high, parts):
    assert interval_parts(value, low, high) == parts


def test_explain_and_result(session):
    ((text,),) = session.execute("EXPLAIN SELECT 1 AS x").fetchall()
    assert "Physical Plan" in text
    assert "rows: 1" in session.execute("EXPLAIN ANALYZE SELECT 1 AS x").fetchall()[0][0]
    result = session.execute("SELECT x FROM (VALUES (1), (2), (3)) t(x)")
    assert sum(b.num_rows for b in result.batches(2)) == 3 and result.metrics()["rows"] == 3
    assert list(session.execute("SELECT 1 AS a, NULL AS b, 'x,\"y' AS c").render("csv", "NULL")) == ["a,b,c", '1,NULL,"x,""y"']
    assert list(session.execute("SELECT 1 AS a, 'é' AS b").render("jsonl")) == ['{"a": 1, "b": "é"}']
    assert list(session.execute("SELECT 1 AS a").render())[-1] == "(1 row)"


def test_commands():
    assert [commands.parse(x).name for x in commands.split("SELECT ';'; BEGIN READ ONLY; DROP TABLE IF EXISTS a.b")] == ["query", "begin", "drop_table"]
    for bad in ("INSERT INTO t (a) VALUES (1)", "UPDATE t SET a = 1, A = 2", "CREATE TEMP TABLE t (a INT)", "COPY t (a) TO 'x'", "NONSENSE", "SHOW EVERYTHING", "MERGE INTO t USING s ON 1 = 1"):
        with pytest.raises(SqlError):
            commands.parse(bad)


def test_settings_of_the_caller_stay(spark):
    before = spark.conf.get("spark.sql.timestampType")
    Engine(spark).execute("SELECT 1")
    assert spark.conf.get("spark.sql.timestampType") == before != "TIMESTAMP_NTZ"


@pytest.fixture(scope="module")
def leaves(spark):
    """Rows with 300 matches in each of two tables, with one in one of them, with none; null keys."""
    engine = Engine(spark)
    many = lambda shift: ", ".join(f"(1, {i + shift}, {i % 7})" for i in range(300))
    for name, rows in (("hub", "(1, 'x', 5), (2, 'x', NULL), (3, NULL, 7), (NULL, 'y', 9), (4, 'z', 1)"), ("a", many(0) + ", (2, 8, NULL), (NULL, 9, 1), (3, NULL, 2)"), ("b", many(1000) + ", (4, 8, NULL), (4, 9, 3), (9, 1, 1)")):
        engine.register(name, engine.execute(f"SELECT * FROM (VALUES {rows}) t(k, {'g, w' if name == 'hub' else 'v, u'})").df)
    return engine.session()


@pytest.mark.parametrize(
    ("text", "parted"),
    [
        ("SELECT g, count(DISTINCT a.v) AS x, count(DISTINCT b.v) AS y FROM hub LEFT JOIN a ON hub.k = a.k LEFT JOIN b ON b.k = hub.k GROUP BY g", True),
        ("SELECT g AS h, max(b.v) + 1, sum(DISTINCT a.u), count(DISTINCT w) FROM hub h LEFT JOIN a ON h.k = a.k AND a.v > 5 AND w < 9 LEFT JOIN b ON b.k = h.k WHERE w > 0 GROUP BY h HAVING count(DISTINCT a.v) >= 0 ORDER BY 2 DESC, h", True),
        ("SELECT count(DISTINCT coalesce(a.v, -1)) AS x, min(coalesce(b.u, w)) AS y, count(DISTINCT g) FILTER (WHERE b.v IS NULL) AS z, avg(DISTINCT a.u + 1) FROM hub LEFT JOIN a ON hub.k = a.k LEFT JOIN b ON b.k = hub.k", True),
        ("SELECT upper(g) AS g, count(DISTINCT a.v) AS x, count(DISTINCT b.v, b.u) AS y FROM hub JOIN a ON hub.k = a.k JOIN b ON b.k = hub.k GROUP BY ROLLUP (hub.g)", None),
        ("SELECT hub.g, count(DISTINCT a.v) AS x, max(b.v) AS y FROM hub JOIN a ON hub.k = a.k LEFT JOIN b ON b.k = hub.k SEMI JOIN b c ON c.k = hub.k GROUP BY hub.g", True),
        ("SELECT hub.k, count(DISTINCT a.v) AS x, count(DISTINCT b.v) AS y FROM hub JOIN a ON hub.k = a.k JOIN b ON b.k = hub.k GROUP BY 1 ORDER BY max(b.v) DESC, 1", True),
        ("SELECT g, count(DISTINCT a.v) AS x, count(DISTINCT b.v) AS y FROM hub LEFT JOIN a ON hub.k = a.k LEFT JOIN b ON b.k = a.k GROUP BY g", False),
        ("SELECT g, count(DISTINCT a.v) AS x, count(DISTINCT b.v + a.v) AS y FROM hub LEFT JOIN a ON hub.k = a.k LEFT JOIN b ON b.k = hub.k GROUP BY g", False),
        ("SELECT g, count(DISTINCT a.v) AS x, count(b.v) AS y FROM hub LEFT JOIN a ON hub.k = a.k LEFT JOIN b ON b.k = hub.k GROUP BY g", False),
        ("SELECT g, count(DISTINCT a.v) AS x, count(DISTINCT b.v) AS y FROM hub LEFT JOIN a ON hub.k = a.k LEFT JOIN b ON b.k = hub.k WHERE b.v > 1100 GROUP BY g", False),
        ("SELECT g, count(DISTINCT a.v) AS x, max(b.v) AS y FROM (SELECT * FROM hub LIMIT 2) hub LEFT JOIN a ON hub.k = a.k LEFT JOIN b ON b.k = hub.k GROUP BY g", False),
    ],
)
def test_leaves_of_a_join(leaves, monkeypatch, text, parted):
    """Tables joined to the same rows don't meet where only aggregates see them; the rows stay the same."""
    sql, df = leaves.translate(text), leaves.execute(text).df
    if parted is not None:
        assert (" UNION ALL " in sql) == parted
    if "LIMIT" in text:
        return
    monkeypatch.setattr(Emitter, "by_leaves", lambda *_: None)
    plain = leaves.execute(text).df
    assert df.dtypes == plain.dtypes and sorted(df.collect(), key=repr) == sorted(plain.collect(), key=repr)


@pytest.mark.parametrize(
    ("text", "joined"),
    [
        ("SELECT k, v, count(*) OVER () AS n, min(v) OVER (PARTITION BY u) AS lo, sum(v) OVER (PARTITION BY u, k) AS s FROM a", 3),
        ("SELECT v, max(v) OVER (PARTITION BY k ORDER BY v) AS m, count(u) OVER (PARTITION BY k) AS n, avg(v) OVER w AS a FROM a WINDOW w AS (PARTITION BY u)", 1),
        ("SELECT *, sum(u) OVER (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) / count(*) OVER () AS share FROM a t ORDER BY v + 1 DESC, u LIMIT 20", 2),
        ("SELECT k AS g, count(*) AS n, sum(count(*)) OVER () AS whole, max(max(v)) OVER (PARTITION BY k % 2) AS top FROM a GROUP BY k HAVING count(*) > 0 QUALIFY whole > 1", 2),
        ("SELECT DISTINCT g, max(v) OVER (PARTITION BY g, 1) AS m FROM hub h LEFT JOIN a ON h.k = a.k WHERE w > 0 QUALIFY count(*) OVER (PARTITION BY g) > 0", 1),
        ("SELECT k, count(*) OVER (PARTITION BY k ORDER BY u GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n, max(v) OVER () AS m FROM a", 1),
        ("SELECT g, (SELECT max(n) FROM (SELECT count(*) OVER (PARTITION BY u) AS n FROM a) t) AS n FROM hub", 1),
        ("SELECT k, max(u) OVER (PARTITION BY k) AS m FROM a WHERE k < 0", 1),
        ("SELECT v, sum(v) OVER (ORDER BY v) AS s, row_number() OVER (ORDER BY v, u) AS r FROM b", 0),
        ("SELECT k, n, sum(n) OVER () AS s FROM (SELECT k, count(*) AS n FROM a GROUP BY 1) t", 1),
        ("SELECT k, count(*) AS n, sum(count(*)) OVER () AS s FROM a GROUP BY 1", 0),
        ("SELECT k, s, max(s) OVER () AS m FROM (SELECT k, sum(v / 3) AS s FROM a GROUP BY k) t", 0),
        ("SELECT count(*) OVER () AS n FROM (SELECT * FROM a LIMIT 5) t", 0),
    ],
)
@pytest.mark.parametrize("hot", [2, 1000])
def test_whole_partitions(leaves, monkeypatch, text, joined, hot):
    """Aggregates over whole partitions are joined, so that no task holds a partition's rows; the rows stay the same."""
    monkeypatch.setattr(emit, "HOT_KEYS", hot)
    sql, df = leaves.translate(text), leaves.execute(text).df
    assert len(set(re.findall(r"AS (__whole\d+) ", sql.replace(")", " ")))) == joined
    monkeypatch.setattr(Emitter, "whole_windows", lambda *_: set())
    plain = leaves.execute(text).df
    assert df.dtypes == plain.dtypes and sorted(df.collect(), key=repr) == sorted(plain.collect(), key=repr)


def test_whole_partitions_without_windows(leaves):
    """No task gets all rows, or all of a key."""
    plan = leaves.execute("SELECT v, min(k) OVER () AS lo FROM a").df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    plan = leaves.execute("SELECT v, sum(v) OVER (PARTITION BY u) AS s FROM a").df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Window \[.*\n(.*Project.*\n)*.*Join LeftAnti", plan) and plan.count("Window [") == 1
