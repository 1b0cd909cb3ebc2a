"""Engine, sessions, prepared statements and results."""

from __future__ import annotations

import datetime
import decimal
import time
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .functions.scalar import quote
from .sources.csv import read_csv, sniff, CsvOptions
from .sources.files import File, SourceError, list_files
from .sources.parquet import read_parquet
from .sources.sinks import copy_to, render
from .sql import commands
from .sql.emit import Emitter, Scope, ident
from .sql.parser import Node, Parser, SqlError, parse_query
from .store.database import Store, Transaction
from .store.manifest import StoreError
from .store.tables import ROW, Tables
from .types import spark_type

CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.legacy.consecutiveStringLiterals.enabled": "false",
}


def tuned(spark: SparkSession) -> SparkSession:
    """A session of its own on the same cluster: the caller's settings, views and catalog stay as they are."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in CONF.items():
        try:
            own.conf.set(key, value)
        except Exception:  # noqa: BLE001 - a Spark without one of these types runs all that doesn't use it
            continue
    return own


#: Operators that give the same rows each time they run, as long as their expressions do and sums are exact.
_STEADY = {"Project", "Filter", "Join", "Aggregate", "Union", "Distinct", "Except", "Intersect", "Sort", "SubqueryAlias", "View", "LogicalRelation", "LocalRelation", "OneRowRelation", "Range", "WithCTE", "CTERelationDef", "CTERelationRef"}


def repeatable(plan: Any) -> bool:
    """Whether an analyzed plan gives the same rows if it is run twice: no LIMIT, no windows, whose order may leave ties
    open, no random numbers and no sums of floating numbers, which depend on the order of the rows."""

    def each(seq: Any) -> Iterator[Any]:
        return (seq.apply(i) for i in range(seq.size()))

    def exact(e: Any) -> bool:
        if e.getClass().getSimpleName() not in ("Sum", "Average") or e.dataType().simpleString() not in ("float", "double"):
            return all(map(exact, each(e.children())))
        return False

    if plan.getClass().getSimpleName() not in _STEADY or not all(e.deterministic() for e in each(plan.expressions())):
        return False
    if plan.getClass().getSimpleName() == "Aggregate" and not all(map(exact, each(plan.expressions()))):
        return False
    return all(map(repeatable, each(plan.children()))) and all(map(repeatable, each(plan.subqueries())))


def unchanged(spark: SparkSession, files: dict[str, list[File]]) -> None:
    """The files that a statement was planned over must still be those (by path, size and time)."""
    for location, before in files.items():
        try:
            now = list_files(spark, location)
        except SourceError:
            now = []
        known = {f.path: f for f in now}
        if any(known.get(f.path) != f for f in before):
            raise SourceError(f"files at {location} changed while the query ran")


class Result:
    """Rows of a statement: lazy, pulled in batches, and cancellable."""

    def __init__(self, df: DataFrame, query_id: str | None = None, files: dict[str, list[File]] | None = None):
        self.df, self.query_id, self.files = df, query_id or uuid.uuid4().hex, files or {}
        self.started = self.seconds = self.rows = None

    @property
    def schema(self) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.df.schema.fields]

    def __iter__(self) -> Iterator[Any]:
        sc, t = self.df.sparkSession.sparkContext, time.time()
        sc.setJobGroup(self.query_id, "query", True)
        self.rows = 0
        for row in self.df.toLocalIterator():
            self.rows += 1
            yield row
        self.seconds = time.time() - t
        unchanged(self.df.sparkSession, self.files)

    def fetchall(self) -> list[tuple]:
        return [tuple(r) for r in self]

    def batches(self, size: int = 8192) -> Iterator[pa.RecordBatch]:
        """Arrow batches of the result's types, made by the tasks; one partition is on the driver at a time. Columns
        may share a name."""
        names, df = self.df.columns, self.df.toDF(*(f"c{i}" for i in range(len(self.df.columns))))
        kinds = to_arrow_schema(df.schema) if names else pa.schema([])
        if not names:
            return

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, size):
                    part = batch.slice(i, size)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as out:
                        out.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

        out = Result(df.mapInArrow(encode, "data binary"), self.query_id, self.files)
        self.rows = 0
        for (data,) in out:
            for batch in pa.ipc.open_stream(data):
                self.rows += batch.num_rows
                yield pa.RecordBatch.from_arrays([c.cast(k) if c.type != k else c for c, k in zip(batch.columns, kinds.types, strict=True)], names)
        self.seconds = out.seconds

    def cancel(self) -> None:
        self.df.sparkSession.sparkContext.cancelJobGroup(self.query_id)

    def metrics(self) -> dict[str, Any]:
        return {"query_id": self.query_id, "rows": self.rows, "seconds": self.seconds}

    def render(self, how: str = "table", null: str = "") -> Iterator[str]:
        return render(self.df, how, null)


class External:
    """A registered source: files are listed anew for each query, the schema stays as it was until refreshed."""

    def __init__(self, kind: str, location: str, options: dict[str, Any], schema: list[list[str]] | None = None):
        self.kind, self.location, self.options, self.schema = kind, location, options, schema

    def read(self, spark: SparkSession) -> DataFrame:
        if self.kind == "csv":
            return read_csv(spark, self.location, [(n, t) for n, t in self.schema] if self.schema else None, **self.options)
        df = read_parquet(spark, self.location, **self.options)
        if self.schema is None:
            return df
        found = dict(df.dtypes)
        missing = [n for n, t in self.schema if found.get(n) != t]
        if missing:
            raise SourceError(f"column {missing[0]} of the registered table has changed; REFRESH TABLE takes the files' schema")
        return df.select(*(f"`{n}`" for n, _ in self.schema))

    def refresh(self, spark: SparkSession) -> None:
        if self.kind == "csv":
            files = list_files(spark, self.location)
            options = CsvOptions(**self.options)
            schemas = [sniff(spark, f, options)[0] for f in files]
            if any(s != schemas[0] for s in schemas):
                raise SourceError("the files' schemas differ")
            self.schema = [list(c) for c in schemas[0]]
        else:
            self.schema = None
            self.schema = [list(c) for c in self.read(spark).dtypes]

    def state(self) -> dict[str, Any]:
        return {"kind": self.kind, "location": self.location, "options": self.options, "schema": self.schema}


class Engine:
    """One Spark cluster and, if a folder is given, one table store there."""

    def __init__(self, spark: SparkSession | None = None, store: str | None = None, quota: int | None = None):
        self.spark = tuned(spark or SparkSession.builder.getOrCreate())
        self.store = Store(self.spark, store, quota) if store else None
        self.registered: dict[str, External | DataFrame] = {}

    def session(self) -> "Session":
        return Session(self)

    def execute(self, text: str, params: list | None = None) -> Result:
        return self.session().execute(text, params)

    def register(self, name: str, df: DataFrame) -> None:
        """A DataFrame under a name, of whatever session."""
        self.registered[name.lower()] = df

    def register_parquet(self, name: str, location: str, **options: Any) -> None:
        self._register(name, External("parquet", location, options))

    def register_csv(self, name: str, location: str, **options: Any) -> None:
        self._register(name, External("csv", location, options))

    def _register(self, name: str, source: External) -> None:
        if name.lower() in self.registered:
            raise SourceError(f"{name} is registered already")
        source.refresh(self.spark)
        self.registered[name.lower()] = source

    def refresh_table(self, name: str) -> None:
        found = self.registered.get(name.lower())
        if isinstance(found, External):
            found.refresh(self.spark)
            return
        if self.store:
            with self.store.begin() as t:
                key = Tables.key([name])
                if key in t.tables.state["externals"]:
                    source = External(**t.tables.state["externals"][key])
                    source.refresh(self.spark)
                    t.tables.state["externals"][key] = source.state()
                    t.tables.touched.add(key)
                    return
        raise SourceError(f"no registered table {name}")

    def add_external(self, name: str, kind: str, location: str, **options: Any) -> None:
        """A registered source that the store remembers."""
        source = External(kind, location, options)
        source.refresh(self.spark)
        with self._store().begin() as t:
            key = Tables.key([name])
            if any(key in t.tables.state[k] for k in ("externals", "tables", "views")):
                raise StoreError(f"{name} exists")
            t.tables.state["externals"][key] = source.state()
            t.tables.touched.add(key)

    def list_externals(self) -> list[str]:
        return sorted(k.split(".", 1)[1] for k in self._store().manifests.latest()["externals"])

    def remove_external(self, name: str) -> None:
        with self._store().begin() as t:
            if t.tables.state["externals"].pop(Tables.key([name]), None) is None:
                raise StoreError(f"no external source {name}")
            t.tables.touched.add(Tables.key([name]))

    def backup(self, target: str) -> None:
        self._store().backup(target)

    @classmethod
    def restore(cls, spark: SparkSession, backup: str, target: str) -> "Engine":
        Store.restore(tuned(spark), backup, target)
        return cls(spark, target)

    def _store(self) -> Store:
        if self.store is None:
            raise StoreError("the engine has no store")
        return self.store


class Prepared:
    """A statement with parameters ? or $n, parsed once and run with typed values."""

    def __init__(self, session: "Session", text: str):
        self.session, self.text = session, text
        Parser(text)
        commands.parse(text)

    def execute(self, *params: Any) -> Result:
        return self.session.execute(self.text, list(params))


def literal(value: Any) -> str:
    """A Python value as Spark text of its own type."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"({value}L)" if -(1 << 63) < value < 1 << 63 else f"CAST('{value}' AS DECIMAL(38,0))"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, decimal.Decimal):
        return f"({value:f}BD)"
    if isinstance(value, datetime.datetime):
        return f"TIMESTAMP_{'NTZ' if value.tzinfo is None else 'LTZ'} '{value.isoformat(sep=' ')}'"
    if isinstance(value, datetime.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    if isinstance(value, str):
        return quote(value)
    raise SqlError(f"a parameter can't be a {type(value).__name__}")


class Session:
    """Statements one after the other, with temporary views and maybe an open transaction."""

    def __init__(self, engine: Engine):
        self.engine, self.spark = engine, engine.spark
        self.views: dict[str, str] = {}
        self.transaction: Transaction | None = None
        self.files: dict[str, list[File]] = {}

    # --- translation

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    def begin(self, read_only: bool = False) -> Transaction:
        """A transaction that this session's statements run in until it ends."""
        if self.transaction is not None and self.transaction.open:
            raise StoreError("a transaction is open already")
        self.transaction = self.engine._store().begin(read_only)
        return self.transaction

    def _tables(self) -> Tables | None:
        if self.transaction is not None and self.transaction.open:
            return self.transaction.tables
        if self.engine.store is None:
            return None
        store = self.engine.store
        return Tables(self.spark, store.root, store.manifests.latest(), store.quota)

    def translate(self, text: str, params: list | None = None) -> str:
        """The Spark SQL of a query."""
        return self._emitter(params).query(parse_query(text))

    def _emitter(self, params: list | None = None, tables: Tables | None = None, seen: tuple[str, ...] = ()) -> Emitter:
        tables = tables or self._tables()
        local: dict[str, str] = {}

        def analyze(sql: str) -> list[tuple[str, str]]:
            return [(f.name, f.dataType.simpleString()) for f in self.spark.sql(sql).schema.fields]

        def function(name: str, args: list) -> str:
            return self._scan_function(name, args, local)

        def table(path: list[str]) -> str | None:
            key = ".".join(p.lower() for p in path)
            if key not in local:
                found = self._resolve(path, tables, params, seen)
                if found is None:
                    return None
                local[key] = self._view(found)
            return local[key]

        def steady(sql: str) -> bool:
            try:
                return repeatable(self.spark.sql(sql)._jdf.queryExecution().analyzed())
            except Exception:  # noqa: BLE001 - it refers to what is around it
                return False

        return Emitter(analyze, function, table, [literal(p) for p in params or []], steady)

    def _view(self, df: DataFrame) -> str:
        """A view of this session; of a DataFrame of another session, one that all sessions see."""
        name = f"__v{uuid.uuid4().hex}"
        if df.sparkSession is self.spark:
            df.createOrReplaceTempView(name)
            return ident(name)
        df.createOrReplaceGlobalTempView(name)
        return f"global_temp.{ident(name)}"

    def _resolve(self, path: list[str], tables: Tables | None, params: list | None, seen: tuple[str, ...]) -> DataFrame | None:
        if path[0].lower() == "information_schema" and len(path) == 2:
            return self.system_table(path[1].lower(), tables)
        name = path[-1].lower() if len(path) == 1 or path[0].lower() == "main" else None
        if name in self.views:
            return self._run_view(self.views[name], tables, (*seen, name))
        if tables is not None:
            key = Tables.key(path)
            if tables.has(path):
                return tables.scan(path)
            if key in tables.state["views"]:
                if key in seen:
                    raise SqlError(f"view {'.'.join(path)} refers to itself")
                return self._run_view(tables.state["views"][key], tables, (*seen, key))
            if key in tables.state["externals"]:
                return self._external(External(**tables.state["externals"][key]))
        found = self.engine.registered.get(name) if name else None
        return self._external(found) if isinstance(found, External) else found

    def _external(self, source: External) -> DataFrame:
        self.files[source.location] = list_files(self.spark, source.location)
        return source.read(self.spark)

    def _run_view(self, text: str, tables: Tables | None, seen: tuple[str, ...]) -> DataFrame:
        return self.spark.sql(self._emitter(None, tables, seen).query(parse_query(text)))

    def _scan_function(self, name: str, args: list, local: dict[str, str]) -> str:
        """read_csv and read_parquet; equal calls of a statement share one scan."""
        if name not in ("read_csv", "read_parquet"):
            raise SqlError(f"unknown table function {name}")
        allowed = {"read_csv": {"header", "delimiter", "quote", "escape", "sample_size", "compression"}, "read_parquet": {"union_by_name", "schema_mode", "hive_partitioning"}}[name]
        where, options = None, {}
        for key, e in args:
            value = self._constant(e)
            if key is None:
                if where is not None:
                    raise SqlError(f"{name} takes one location")
                where = value
            elif key not in allowed or key in options:
                raise SqlError(f"unknown or repeated argument {key} of {name}")
            else:
                options[key] = value
        if not isinstance(where, str):
            raise SqlError(f"{name} takes a location")
        spec = f"{name}|{where}|{sorted(options.items())}"
        if spec not in local:
            reader = read_csv if name == "read_csv" else read_parquet
            self.files[where] = list_files(self.spark, where)
            local[spec] = self._view(reader(self.spark, where, **options))
        return local[spec]

    @staticmethod
    def _constant(e: Node) -> Any:
        if e.kind == "string":
            return e.value
        if e.kind == "literal":
            return {"TRUE": True, "FALSE": False, "NULL": None}[e.word]
        if e.kind == "number" and e.text.isdigit():
            return int(e.text)
        raise SqlError("arguments of table functions are constants")

    # --- statements

    def execute(self, text: str, params: list | None = None) -> Result:
        c = commands.parse(text)
        self.files = {}
        df = self._command(c, params)
        return Result(df, files=self.files if c.name == "query" else None)

    def script(self, text: str) -> list[Result]:
        return [self.execute(s) for s in commands.split(text)]

    def _message(self, text: str = "ok", rows: int | None = None) -> DataFrame:
        return self.spark.createDataFrame([(text, rows)], "status string, rows long")

    def _command(self, c: commands.Command, params: list | None) -> DataFrame:
        return getattr(self, "_do_" + c.name)(c, params)

    def _do_query(self, c, params) -> DataFrame:
        return self.spark.sql(self._emitter(params).query(c.q))

    def _do_explain(self, c, params) -> DataFrame:
        df = self._do_query(c, params)
        lines = [df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))]
        if c.analyze:
            t = time.time()
            rows = df.count()
            lines.append(f"rows: {rows}, seconds: {time.time() - t:.3f}")
        return self.spark.createDataFrame([("\n".join(lines),)], "explain_value string")

    def _do_begin(self, c, params) -> DataFrame:
        self.begin(c.read_only)
        return self._message()

    def _do_commit(self, c, params) -> DataFrame:
        self._open_transaction().commit()
        return self._message()

    def _do_rollback(self, c, params) -> DataFrame:
        self._open_transaction().rollback()
        return self._message()

    def _open_transaction(self) -> Transaction:
        if self.transaction is None or not self.transaction.open:
            raise StoreError("no transaction is open")
        return self.transaction

    def _change(self, f) -> DataFrame:
        """f(tables) in the open transaction, or in one of its own."""
        if self.transaction is not None and self.transaction.open:
            if self.transaction.read_only:
                raise StoreError("the transaction is read only")
            out = f(self.transaction.tables)
            unchanged(self.spark, self.files)
            return out
        with self.engine._store().begin() as t:
            out = f(t.tables)
            unchanged(self.spark, self.files)  # else nothing is committed
            return out

    def _names(self) -> list[tuple[str, str, str]]:
        out = [("main", n, "VIEW") for n in self.views] + [("main", n, "EXTERNAL") for n in self.engine.registered]
        tables = self._tables()
        if tables is not None:
            for kind, label in (("tables", "BASE TABLE"), ("views", "VIEW"), ("externals", "EXTERNAL")):
                out += [(*k.split(".", 1), label) for k in tables.state[kind]]
        return sorted(set(out))

    def _do_show_tables(self, c, params) -> DataFrame:
        return self.spark.createDataFrame([(n, s) for s, n, _ in self._names()], "name string, schema_name string")

    def _schemas(self) -> list[str]:
        tables = self._tables()
        return sorted({"main", "information_schema", *(tables.state["schemas"] if tables else [])})

    def _do_show_schemas(self, c, params) -> DataFrame:
        return self.spark.createDataFrame([(s,) for s in self._schemas()], "name string")

    def _relation(self, path: list[str]) -> DataFrame:
        found = self._resolve(path, self._tables(), None, ())
        if found is None:
            raise SqlError(f"no table {'.'.join(path)}")
        return found

    def _do_describe(self, c, params) -> DataFrame:
        return self.spark.createDataFrame([(n, t) for n, t in self._relation(c.path).dtypes], "column_name string, column_type string")

    def system_table(self, name: str, tables: Tables | None) -> DataFrame:
        if name == "schemata":
            return self.spark.createDataFrame([(s,) for s in self._schemas()], "schema_name string")
        if name == "tables":
            return self.spark.createDataFrame(self._names(), "table_schema string, table_name string, table_type string")
        if name == "columns":
            rows = [(s, n, col, i + 1, t) for s, n, _ in self._names() for i, (col, t) in enumerate(self._relation([s, n]).dtypes)]
            return self.spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, data_type string")
        if name == "native_tables" and tables is not None:
            rows = [(*k.split(".", 1), sum(s["rows"] for s in t["segments"]) - sum(d["rows"] for d in t["deletes"]), len(t["segments"]), sum(s["bytes"] for s in t["segments"])) for k, t in tables.state["tables"].items()]
            return self.spark.createDataFrame(rows, "table_schema string, table_name string, row_count long, segment_count long, byte_size long")
        raise SqlError(f"no system table {name}")

    def _do_refresh(self, c, params) -> DataFrame:
        self.engine.refresh_table(c.path[-1])
        return self._message()

    def _do_create_view(self, c, params) -> DataFrame:
        text = c.text
        if c.columns:
            text = f"SELECT * FROM ({text}) AS v({', '.join(chr(34) + n + chr(34) for n in c.columns)})"
        self.spark.sql(self._emitter().query(parse_query(text))).schema  # noqa: B018 - a view must be sound
        if c.temporary or self.engine.store is None:
            name = c.path[-1].lower()
            if name in self.views and not c.replace:
                raise SqlError(f"view {name} exists")
            self.views[name] = text
            return self._message()

        def store(tables: Tables) -> DataFrame:
            key = Tables.key(c.path)
            if key in tables.state["tables"] or (key in tables.state["views"] and not c.replace):
                raise StoreError(f"{'.'.join(c.path)} exists")
            tables.state["views"][key] = text
            tables.touched.add(key)
            return self._message()

        return self._change(store)

    def _do_drop_view(self, c, params) -> DataFrame:
        if self.views.pop(c.path[-1].lower(), None) is not None:
            return self._message()

        def drop(tables: Tables) -> DataFrame:
            key = Tables.key(c.path)
            if tables.state["views"].pop(key, None) is None and not c.if_exists:
                raise StoreError(f"no view {'.'.join(c.path)}")
            tables.touched.add(key)
            return self._message()

        if self.engine.store is None:
            if c.if_exists:
                return self._message()
            raise SqlError(f"no view {'.'.join(c.path)}")
        return self._change(drop)

    def _do_create_table(self, c, params) -> DataFrame:
        def create(tables: Tables) -> DataFrame:
            kinds = [(n, "string" if (k := spark_type(*t)) == "UUID" else k.lower()) for n, t in c.columns]
            tables.create(c.path, kinds, c.replace)
            return self._message(rows=0)

        return self._change(create)

    def _do_create_table_as(self, c, params) -> DataFrame:
        def create(tables: Tables) -> DataFrame:
            rows = self.spark.sql(self._emitter(params, tables).query(c.q))
            kinds = [(n, "string" if t == "void" else t) for n, t in rows.dtypes]
            tables.create(c.path, kinds, c.replace, rows)
            return self._message(rows=tables.table(c.path)["segments"][-1]["rows"])

        return self._change(create)

    def _returned(self, rows: DataFrame, returning: list[Node] | None, name: str) -> DataFrame:
        """RETURNING over the changed rows, or their number."""
        if returning is None:
            return self._message(rows=rows.count())
        view = self._view(rows)
        emitter = self._emitter()
        scope = Scope([], f"{view} AS {ident(name)}", None)
        return self.spark.sql(f"SELECT {', '.join(emitter.item(i, scope) for i in returning)} FROM {scope.source}")

    def _do_insert(self, c, params) -> DataFrame:
        def insert(tables: Tables) -> DataFrame:
            rows = self.spark.sql(self._emitter(params, tables).query(c.q))
            return self._returned(tables.insert(c.path, rows), c.returning, c.path[-1])

        return self._change(insert)

    def _matches(self, tables: Tables, c, params, values: list[tuple[str, Node]]) -> DataFrame:
        """Row numbers of the target (joined with the source) that satisfy WHERE, with values computed there."""
        emitter = self._emitter(params, tables)
        target = self._view(tables.scan(c.target.path, True))
        alias = c.target.alias or c.target.path[-1]
        source = f"{target} AS {ident(alias)}"
        if c.source is not None:
            source += f", {emitter.ref(c.source, [], None)}"
        scope = Scope([], source, None)
        items = [*(f"{ident(alias)}.{ident(c)} AS {ident(c)}" for c in ROW), *(f"{emitter.e(e, scope)} AS {ident('_new_' + n)}" for n, e in values)]
        where = f" WHERE {emitter.conjuncts(c.where, scope)}" if c.where is not None else ""
        return self.spark.sql(f"SELECT {', '.join(items)} FROM {source}{where}")

    def _do_update(self, c, params) -> DataFrame:
        def update(tables: Tables) -> DataFrame:
            for n, _ in c.sets:
                tables._find(c.target.path, n)
            matches = self._matches(tables, c, params, c.sets)
            return self._returned(tables.update(c.target.path, matches, [n for n, _ in c.sets]), c.returning, c.target.path[-1])

        return self._change(update)

    def _do_delete(self, c, params) -> DataFrame:
        def delete(tables: Tables) -> DataFrame:
            return self._returned(tables.delete(c.target.path, self._matches(tables, c, params, [])), c.returning, c.target.path[-1])

        return self._change(delete)

    def _simple(self, f) -> DataFrame:
        def run(tables: Tables) -> DataFrame:
            f(tables)
            return self._message()

        return self._change(run)

    def _do_truncate(self, c, params) -> DataFrame:
        return self._simple(lambda t: t.truncate(c.path))

    def _do_drop_table(self, c, params) -> DataFrame:
        return self._simple(lambda t: None if c.if_exists and not t.has(c.path) else t.drop(c.path))

    def _do_create_schema(self, c, params) -> DataFrame:
        return self._simple(lambda t: t.create_schema(c.path[0]))

    def _do_drop_schema(self, c, params) -> DataFrame:
        return self._simple(lambda t: None if c.if_exists and c.path[0].lower() not in t.state["schemas"] else t.drop_schema(c.path[0]))

    def _do_add_column(self, c, params) -> DataFrame:
        default = self._emitter(params).e(c.default, Scope([], None, None)) if c.default is not None else None
        return self._simple(lambda t: t.add_column(c.path, c.column, spark_type(*c.type).lower(), default))

    def _do_drop_column(self, c, params) -> DataFrame:
        return self._simple(lambda t: t.drop_column(c.path, c.column))

    def _do_rename_column(self, c, params) -> DataFrame:
        return self._simple(lambda t: t.rename_column(c.path, c.column, c.to))

    def _do_rename_table(self, c, params) -> DataFrame:
        return self._simple(lambda t: t.rename(c.path, c.to))

    def _do_copy_to(self, c, params) -> DataFrame:
        df = self.spark.sql(self._emitter(params).query(c.q)) if c.q is not None else self._relation(c.path)
        return self._message(rows=copy_to(self.spark, df, c.location, c.options, lambda: unchanged(self.spark, self.files)))

    def _do_copy_from(self, c, params) -> DataFrame:
        options = dict(c.options)
        kind = str(options.pop("format", "parquet" if c.location.endswith(".parquet") else "csv")).lower()
        if "null" in options:
            raise SqlError("COPY FROM takes no NULL option")

        def load(tables: Tables) -> DataFrame:
            self.files[c.location] = list_files(self.spark, c.location)
            if kind == "parquet":
                rows = read_parquet(self.spark, c.location)
            else:
                columns = [(x["name"], x["type"]) for x in tables.table(c.path)["columns"]]
                rows = read_csv(self.spark, c.location, columns, positional=True, **{k: v for k, v in options.items() if k != "encoding"})
            return self._returned(tables.insert(c.path, rows), None, "")

        return self._change(load)

    def _each(self, c, f) -> DataFrame:
        def run(tables: Tables) -> DataFrame:
            for path in [c.path] if c.path else [k.split(".", 1) for k in list(tables.state["tables"])]:
                f(tables, path)
            return self._message()

        return self._change(run)

    def _do_compact(self, c, params) -> DataFrame:
        return self._each(c, lambda t, path: t.compact(path))

    def _do_analyze(self, c, params) -> DataFrame:
        return self._each(c, lambda t, path: t.analyze(path))

    def _do_vacuum(self, c, params) -> DataFrame:
        if self.transaction is not None and self.transaction.open:
            raise StoreError("VACUUM doesn't run inside a transaction")
        return self._message(rows=self.engine._store().vacuum())

    def _do_checkpoint(self, c, params) -> DataFrame:
        self.engine._store().checkpoint()
        return self._message()
