"""The table store: changes, snapshots, conflicts, recovery, backup."""

import os
import threading

import pytest

from graniteql.session import Engine
from graniteql.sources.files import SourceError
from graniteql.store.manifest import Conflict, StoreError


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/store")
    e.execute("CREATE TABLE t (id INT, grp TEXT, val DECIMAL(10,2))")
    e.execute("INSERT INTO t VALUES (1, 'a', 1.5), (2, 'b', 2.5), (3, NULL, NULL)")
    return e


def rows(e, text="SELECT * FROM t ORDER BY id"):
    return [tuple(str(x) if x is not None else None for x in r) for r in e.execute(text).fetchall()]


def test_changes(engine):
    assert engine.execute("UPDATE t SET val = val + 1 WHERE id < 3 RETURNING id").df.count() == 2
    assert engine.execute("DELETE FROM t WHERE grp IS NULL").fetchall() == [("ok", 1)]
    assert rows(engine) == [("1", "a", "2.50"), ("2", "b", "3.50")]
    assert engine.execute("DELETE FROM t WHERE id = 99").fetchall() == [("ok", 0)]
    assert engine.execute("UPDATE t SET val = 0 WHERE id = 99").fetchall() == [("ok", 0)]
    engine.execute("INSERT INTO t SELECT id + 10, grp, val FROM t")
    assert len(rows(engine)) == 4


def test_update_from_several_matches(engine):
    engine.execute("UPDATE t SET grp = s.g FROM (VALUES (1, 'z'), (1, 'y'), (1, 'x')) s(k, g) WHERE t.id = s.k")
    assert rows(engine)[0][1] == "x"  # the least of the new values


def test_errors(engine):
    for bad in ("INSERT INTO t VALUES (1)", "CREATE TABLE t (a INT)", "DROP TABLE nope", "ALTER TABLE t ADD COLUMN id INT", "CREATE TABLE x.t (a INT)", "DROP SCHEMA main", "COMMIT", "CREATE TABLE d (a INT, A INT)", "UPDATE t SET nope = 1", "DROP VIEW nope"):
        with pytest.raises(StoreError):
            engine.execute(bad)
    engine.execute("DROP TABLE IF EXISTS nope")


def test_isolation(engine):
    a, b = engine.session(), engine.session()
    a.execute("BEGIN")
    a.execute("INSERT INTO t VALUES (4, 'd', 4)")
    count = "SELECT count(*) FROM t"
    assert a.execute(count).fetchall() == [(4,)] and b.execute(count).fetchall() == [(3,)]
    b.execute("CREATE TABLE other (x INT)")
    a.execute("COMMIT")  # another table was changed meanwhile, which is no conflict
    assert b.execute(count).fetchall() == [(4,)] and b.execute("SELECT count(*) FROM other").fetchall() == [(0,)]


def test_first_committer_wins(engine):
    a, b = engine.session(), engine.session()
    for s in (a, b):
        s.execute("BEGIN")
        s.execute("UPDATE t SET val = 9 WHERE id = 1")
    a.execute("COMMIT")
    with pytest.raises(Conflict):
        b.execute("COMMIT")
    assert rows(engine)[0][2] == "9.00"


def test_concurrent_commits(engine):
    failures = []

    def work(i):
        try:
            engine.execute(f"CREATE TABLE c{i} AS SELECT {i} AS x")
        except Exception as e:  # noqa: BLE001
            failures.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures
    assert [engine.execute(f"SELECT x FROM c{i}").fetchall() for i in range(4)] == [[(i,)] for i in range(4)]


def test_rollback_and_read_only(engine, tmp_path):
    s = engine.session()
    files = set(os.listdir(tmp_path / "store/data"))
    with pytest.raises(RuntimeError), s.begin():
        s.execute("INSERT INTO t VALUES (5, 'e', 5)")
        raise RuntimeError
    assert len(rows(engine)) == 3
    assert {f for f in os.listdir(tmp_path / "store/data") if f.startswith("rows")} == {f for f in files if f.startswith("rows")}
    s.execute("BEGIN READ ONLY")
    with pytest.raises(StoreError):
        s.execute("DELETE FROM t")
    s.execute("ROLLBACK")


def test_a_cut_off_manifest_is_skipped(engine, tmp_path):
    folder = tmp_path / "store/manifests"
    last = max(f for f in os.listdir(folder) if f.endswith(".json"))
    with open(folder / f"{int(last[:-5]) + 1:012d}.json", "w") as f:
        f.write('{"generation": 99, "tab')
    assert len(rows(engine)) == 3
    engine.execute("INSERT INTO t VALUES (4, 'd', 4)")
    assert len(rows(engine)) == 4


def test_alter(engine):
    for x in ("ADD COLUMN note TEXT DEFAULT 'n'", "DROP COLUMN val", "RENAME COLUMN grp TO g", "RENAME TO q"):
        engine.execute(f"ALTER TABLE t {x}")
        if x.startswith("ADD"):
            engine.execute("INSERT INTO t VALUES (4, 'd', 4, 'own')")
    assert rows(engine, "SELECT * FROM q ORDER BY id") == [("1", "a", "n"), ("2", "b", "n"), ("3", None, "n"), ("4", "d", "own")]
    engine.execute("ALTER TABLE q ADD COLUMN val INT")  # the old column's values don't come back
    assert rows(engine, "SELECT count(val) FROM q") == [("0",)]


def test_upkeep(engine, tmp_path):
    for i in range(3):
        engine.execute(f"INSERT INTO t VALUES ({i + 10}, 'x', {i})")
    engine.execute("DELETE FROM t WHERE id = 10")
    before = rows(engine)
    for x in ("COMPACT t", "ANALYZE", "CHECKPOINT", "VACUUM"):
        engine.execute(x)
    assert rows(engine) == before
    assert len(os.listdir(tmp_path / "store/data")) == 1
    assert rows(engine, "SELECT row_count, segment_count FROM information_schema.native_tables") == [("5", "1")]


def test_views_and_schemas(engine):
    s = engine.session()
    s.execute("CREATE VIEW v(k) AS SELECT id FROM t WHERE val > 2")
    s.execute("CREATE OR REPLACE VIEW v AS SELECT id AS k FROM t WHERE val > 1")
    assert s.execute("SELECT count(*) FROM v").fetchall() == [(2,)]
    s.execute("CREATE SCHEMA a")
    s.execute("CREATE TABLE a.t AS SELECT 1 AS x")
    assert s.execute("SELECT x FROM a.t").fetchall() == [(1,)] and s.execute("SELECT count(*) FROM main.t").fetchall() == [(3,)]
    with pytest.raises(StoreError):
        s.execute("DROP SCHEMA a")
    assert ("t", "a") in s.execute("SHOW TABLES").fetchall() and ("a",) in s.execute("SHOW SCHEMAS").fetchall()
    s.execute("DROP VIEW v")
    s.execute("DROP TABLE a.t")
    s.execute("DROP SCHEMA a")


def test_backup_and_quota(engine, spark, tmp_path):
    engine.backup(f"file://{tmp_path}/copy")
    engine.execute("TRUNCATE t")
    again = Engine.restore(spark, f"file://{tmp_path}/copy", f"file://{tmp_path}/second")
    assert len(rows(again)) == 3 and rows(engine) == []
    with pytest.raises(StoreError):
        engine.backup(f"file://{tmp_path}/copy")
    small = Engine(spark, f"file://{tmp_path}/third", quota=10)
    with pytest.raises(StoreError, match="quota"):
        small.execute("CREATE TABLE x AS SELECT 1 AS a")


def test_externals(engine, spark, tmp_path):
    where = f"file://{tmp_path}/ext"
    spark.range(5).write.parquet(where)
    engine.add_external("e", "parquet", where)
    spark.range(5, 8).write.mode("append").parquet(where)
    assert rows(engine, "SELECT count(*) FROM e") == [("8",)]  # files are listed anew
    assert engine.list_externals() == ["e"]
    spark.range(3).selectExpr("id", "id AS more").write.mode("overwrite").parquet(where)
    assert len(engine.execute("SELECT * FROM e").df.columns) == 1  # the schema stays until it is refreshed
    engine.execute("REFRESH TABLE e")
    assert len(engine.execute("SELECT * FROM e").df.columns) == 2
    engine.remove_external("e")
    assert engine.list_externals() == []


def test_ingest(engine, spark, tmp_path):
    from graniteql.streaming.ingest import ingest

    engine.execute("CREATE TABLE s (id BIGINT)")
    source = f"file://{tmp_path}/in"
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(source)
        ingest(engine, source, "s", f"{tmp_path}/ck").awaitTermination()
    assert rows(engine, "SELECT count(*) FROM s") == [("7",)]


def test_vacuum_and_open_transactions(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/s")
    one = engine.session()
    one.execute("CREATE TABLE t AS SELECT 1 AS a")
    one.execute("BEGIN")
    one.execute("INSERT INTO t VALUES (2)")
    with pytest.raises(StoreError):
        one.execute("VACUUM")
    assert engine.execute("VACUUM").fetchall() == [("ok", 0)]
    one.execute("COMMIT")
    assert sorted(engine.execute("SELECT a FROM t").fetchall()) == [(1,), (2,)]
    with engine.store.begin() as t:
        lost = engine.session()
        t.tables.insert(["t"], spark.sql("SELECT CAST(3 AS BIGINT)"))
        import shutil

        shutil.rmtree(f"{tmp_path}/s/data/{t.tables.table(['t'])['segments'][-1]['path']}")
        with pytest.raises(StoreError):
            t.commit()
    assert sorted(lost.execute("SELECT a FROM t").fetchall()) == [(1,), (2,)]
    assert not [p for p in (tmp_path / "s" / "open").iterdir() if not p.name.startswith(".")]


def test_changes_of_a_table_as_such_conflict(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/s")
    one, two = engine.session(), engine.session()
    one.execute("CREATE TABLE t AS SELECT 1 AS a")
    for text in ("ALTER TABLE t ADD COLUMN b INT", "COMPACT t", "TRUNCATE t"):
        one.execute("BEGIN")
        one.execute("DELETE FROM t WHERE a = 1")
        two.execute("INSERT INTO t SELECT * FROM t")
        two.execute(text)
        with pytest.raises(Conflict):
            one.execute("COMMIT")


def test_files_that_change_stop_a_load(spark, tmp_path):
    spark.sql("SELECT 1 AS a").write.parquet(f"{tmp_path}/f")
    engine = Engine(spark, f"file://{tmp_path}/s")
    session = engine.session()
    session.execute("CREATE TABLE t (a BIGINT)")
    insert = session._change

    def late(f):
        def run(tables):
            out = f(tables)
            spark.sql("SELECT 2 AS a").write.mode("overwrite").parquet(f"{tmp_path}/f")
            return out

        return insert(run)

    session._change = late
    with pytest.raises(SourceError):
        session.execute(f"INSERT INTO t SELECT a FROM read_parquet('file://{tmp_path}/f')")
    assert engine.execute("SELECT * FROM t").fetchall() == []


def test_batches_and_copied_rows(spark, tmp_path):
    engine = Engine(spark)
    (batch,) = engine.execute("SELECT 1 AS a, 'x' AS a, CAST(1.5 AS DECIMAL(5,2)) AS c").batches()
    assert batch.schema.names == ["a", "a", "c"] and [c.to_pylist()[0] for c in batch.columns[:2]] == [1, "x"]
    assert str(batch.schema.types[2]) == "decimal128(5, 2)"
    for name in ("x.csv", "x.parquet"):
        assert engine.execute(f"COPY (SELECT * FROM (VALUES (1), (2), (3)) t(a)) TO 'file://{tmp_path}/{name}'").fetchall() == [("ok", 3)]
