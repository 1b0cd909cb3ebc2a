"""Files: CSV and its compressions, Parquet schema modes, Hive partitions, COPY."""

import gzip

import pytest

from graniteql.session import Engine
from graniteql.sources.files import SourceError
from graniteql.sources.parquet import partition_type, read_parquet


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def put(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{path}"


def read(engine, where, options=""):
    r = engine.execute(f"SELECT * FROM read_csv('{where}'{options})")
    return r.schema, sorted(r.fetchall(), key=repr)


def test_csv_inference(engine, tmp_path):
    schema, rows = read(engine, put(tmp_path / "a.csv", "id,name,score,ok,day\n1,x,1.5,true,2024-01-02\n2,,2,false,\n"))
    assert [t for _, t in schema] == ["bigint", "string", "double", "boolean", "date"]
    assert rows[1][1] is None and rows[1][4] is None
    assert read(engine, put(tmp_path / "b.csv", "1,x\n2,y\n"))[0] == [("column0", "bigint"), ("column1", "string")]
    assert read(engine, put(tmp_path / "c.csv", "name,city\nann,rome\n"))[0] == [("name", "string"), ("city", "string")]
    assert len(read(engine, put(tmp_path / "d.csv", "a;b\n1;'x;y'\n"), ", delimiter = ';', quote = ''''")[1]) == 1


def test_csv_quotes_and_newlines(engine, tmp_path):
    _, rows = read(engine, put(tmp_path / "q.csv", 'id,t\n1,"a ""b"", c"\n2,"two\nlines"\n3,é\n'))
    assert [r[1] for r in rows] == ['a "b", c', "two\nlines", "é"]


@pytest.mark.parametrize("name", ["z.csv", "z.csv.gz", "z.txt"])
def test_csv_gzip_by_content(engine, tmp_path, name):
    members = gzip.compress(b"id,t\n1,a\n") + gzip.compress(b"2,b\n")
    assert read(engine, put(tmp_path / name, members))[1] == [(1, "a"), (2, "b")]


def test_csv_zstd_by_content(engine, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    c = zstandard.ZstdCompressor()
    assert read(engine, put(tmp_path / "z.csv", c.compress(b"id,t\n1,a\n") + c.compress(b"2,b\n")))[1] == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("data", ["a,b\n1\n", "a,b\n1,2,3\n", b"a,b\n1,\xff\xfe\n", "", "a,a\n1,2\n"])
def test_csv_errors(engine, tmp_path, data):
    with pytest.raises(SourceError):
        read(engine, put(tmp_path / "bad.csv", data), ", header = true")


def test_csv_late_errors(engine, tmp_path):
    where = put(tmp_path / "late.csv", "a,b\n" + "1,2\n" * 20 + "x,2\n")
    with pytest.raises(Exception):  # noqa: B017
        read(engine, where, ", sample_size = 5")
    with pytest.raises(SourceError):
        read(engine, "file:///nowhere/*.csv")


def test_csv_many_files(engine, tmp_path):
    put(tmp_path / "m1.csv", "id,t\n1,a\n")
    put(tmp_path / "m2.csv", "id,t\n2,b\n")
    assert len(read(engine, f"file://{tmp_path}/m*.csv")[1]) == 2
    put(tmp_path / "m3.csv", "id,t\nx,b\n")
    with pytest.raises(SourceError):
        read(engine, f"file://{tmp_path}/m*.csv")


def test_locations_hold_no_secrets(engine):
    for bad in ("s3://key:secret@bucket/x", "s3://bucket/x?aws_secret=1", ""):
        with pytest.raises(SourceError):
            read(engine, bad)


def test_parquet_modes(spark, tmp_path):
    spark.sql("SELECT 1 AS k, CAST(1.5 AS DECIMAL(10,2)) AS d").write.parquet(f"{tmp_path}/p/a")
    spark.sql("SELECT 2L AS k, CAST(2.25 AS DECIMAL(12,4)) AS d, 'x' AS s").write.parquet(f"{tmp_path}/p/b")
    where = f"file://{tmp_path}/p"
    with pytest.raises(SourceError):
        read_parquet(spark, where)
    with pytest.raises(SourceError):
        read_parquet(spark, where, schema_mode="union")
    df = read_parquet(spark, where, schema_mode="safe_widening")
    assert df.dtypes == [("k", "bigint"), ("d", "decimal(12,4)"), ("s", "string")] and df.count() == 2
    with pytest.raises(SourceError):
        read_parquet(spark, where, schema_mode="strict", union_by_name=True)
    with pytest.raises(SourceError):
        read_parquet(spark, where, schema_mode="loose")


def test_hive(spark, tmp_path):
    spark.sql("SELECT id, id % 2 = 0 AS flag, id % 3 AS n, date_add(DATE '2024-01-01', CAST(id AS INT)) AS dt, IF(id = 1, NULL, 'v') AS s FROM range(6)").write.partitionBy("flag", "n", "dt", "s").parquet(f"{tmp_path}/h")
    df = read_parquet(spark, f"file://{tmp_path}/h", hive_partitioning=True)
    assert dict(df.dtypes) == {"id": "bigint", "flag": "boolean", "n": "bigint", "dt": "date", "s": "string"}
    assert df.filter("flag").count() == 3 and df.filter("s IS NULL").count() == 1
    plan = df.filter("n = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(n" in plan
    assert [partition_type(x) for x in (["1", None], ["true", "FALSE"], ["2024-01-01"], ["1", "x"], [None])] == ["bigint", "boolean", "date", "string", "string"]


def test_pushdown(spark):
    engine = Engine(spark)
    engine.spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = engine.execute("SELECT l_orderkey FROM read_parquet('/root/testdata/sf0.001/lineitem.parquet') WHERE l_quantity > 10.0 AND l_returnflag = 'R'").df
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan


def test_copy(engine, tmp_path):
    where = f"file://{tmp_path}/out.csv"
    engine.execute(f"COPY (SELECT * FROM (VALUES (1, 'a;b', NULL), (2, 'say \"x\"', '')) t(i, s, n)) TO '{where}' (DELIMITER ';', NULL 'nil')")
    assert (tmp_path / "out.csv").read_text() == 'i;s;n\n1;"a;b";nil\n2;"say ""x""";""\n'
    engine.execute(f"COPY (SELECT 1 AS x) TO '{where}'")
    assert (tmp_path / "out.csv").read_text() == "x\n1\n"
    assert [p.name for p in tmp_path.iterdir() if "writing" in p.name] == []
    for bad in ("(FORMAT json)", "(NOPE 1)", "(ENCODING 'latin1')"):
        with pytest.raises(SourceError):
            engine.execute(f"COPY (SELECT 1 AS x) TO '{where}' {bad}")


def test_registered(engine, tmp_path):
    put(tmp_path / "r1.csv", "id,t\n1,a\n")
    engine.register_csv("reg", f"file://{tmp_path}/r*.csv")
    put(tmp_path / "r2.csv", "id,t\n2,b\n")
    assert engine.execute("SELECT count(*) FROM reg").fetchall() == [(2,)]
    with pytest.raises(SourceError):
        engine.register_csv("REG", f"file://{tmp_path}/r*.csv")
    assert engine.execute("DESCRIBE reg").fetchall() == [("id", "bigint"), ("t", "string")]


def test_registered_dataframes(engine, spark):
    engine.register("own", engine.spark.range(3))
    engine.register("other", spark.range(2, 6))
    assert engine.execute("SELECT count(*) FROM own JOIN other ON own.id = other.id").fetchall() == [(1,)]
    assert engine.execute("SELECT o.id FROM other AS o ORDER BY o.id LIMIT 1").fetchall() == [(2,)]


def test_files_must_not_change_under_a_query(engine, tmp_path):
    where = put(tmp_path / "s.csv", "id,t\n1,a\n")
    result = engine.execute(f"SELECT * FROM read_csv('{where}')")
    put(tmp_path / "s.csv", "id,t\n1,a\n2,b\n3,c\n")
    with pytest.raises(SourceError):
        result.fetchall()


def test_strict_parquet_compares_each_of_many_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for i in range(65):
        pq.write_table(pa.table({"a": [i], "b": [i]}), tmp_path / f"f{i:02}.parquet")
    assert read_parquet(spark, str(tmp_path)).count() == 65
    for other in ({"a": [1]}, {"b": [1], "a": [1]}):
        pq.write_table(pa.table(other), tmp_path / "f40.parquet")
        with pytest.raises(SourceError, match="schemas differ"):
            read_parquet(spark, str(tmp_path))
