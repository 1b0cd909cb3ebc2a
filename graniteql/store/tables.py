"""Tables of a store: scans, changes and upkeep over a manifest's state.

A table is a list of Parquet segments less its delete vectors. Columns have numbers: files hold ``c1``, ``c2``...,
and names, order, defaults and renames live in the manifest, so most ALTERs write nothing. Every row has a number
of its own for good: its segment's (``_seg``, drawn at random, so that writers need not agree on it) and its place
there (``_row``). All changes append: DELETE writes row numbers, UPDATE writes these and new rows.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import remove
from .manifest import StoreError

ROW = ("_seg", "_row")
ROW_SCHEMA = "_seg long, _row long"


class Tables:
    """state: a manifest's content, changed in place. Nothing is visible to others until it is published."""

    def __init__(self, spark: SparkSession, root: str, state: dict[str, Any], quota: int | None = None):
        self.spark, self.root, self.state, self.quota = spark, root.rstrip("/"), state, quota
        self.touched: set[str] = set()

    # --- names

    @staticmethod
    def key(path: list[str]) -> str:
        if len(path) > 2:
            raise StoreError(f"too many parts in {'.'.join(path)}")
        return ".".join(p.lower() for p in (path if len(path) == 2 else ["main", *path]))

    def table(self, path: list[str]) -> dict[str, Any]:
        found = self.state["tables"].get(self.key(path))
        if found is None:
            raise StoreError(f"no table {'.'.join(path)}")
        return found

    def has(self, path: list[str]) -> bool:
        return self.key(path) in self.state["tables"]

    def _touch(self, path: list[str]) -> None:
        self.touched.add(self.key(path))

    def _number(self) -> int:
        self.state["next"] += 1
        return self.state["next"] - 1

    # --- reading

    def scan(self, path: list[str], with_row: bool = False) -> DataFrame:
        """Current rows. Segments that share a physical schema are one scan; deletes are one anti-join by row number."""
        t = self.table(path)
        columns = t["columns"]
        by_ids: dict[tuple, list[str]] = {}
        for s in t["segments"]:
            by_ids.setdefault(tuple(map(tuple, s["columns"])), []).append(f"{self.root}/data/{s['path']}")
        parts = []
        for ids, paths in by_ids.items():
            held = dict(ids)
            schema = ", ".join([*(f"c{i} {kind}" for i, kind in ids), ROW_SCHEMA])
            df = self.spark.read.schema(schema).parquet(*paths)
            parts.append(df.select(*(self._column(c, held).alias(c["name"]) for c in columns), *ROW))
        if not parts:
            schema = ", ".join([*(f"`{c['name']}` {c['type']}" for c in columns), ROW_SCHEMA])
            return self._out(self.spark.createDataFrame([], schema), with_row)
        rows = reduce(DataFrame.unionByName, parts)
        if t["deletes"]:
            gone = self.spark.read.schema(ROW_SCHEMA).parquet(*(f"{self.root}/data/{d['path']}" for d in t["deletes"]))
            rows = rows.join(gone, list(ROW), "left_anti")
        return self._out(rows, with_row)

    @staticmethod
    def _out(df: DataFrame, with_row: bool) -> DataFrame:
        return df if with_row else df.drop(*ROW)

    @staticmethod
    def _column(c: dict, held: dict) -> Column:
        if c["id"] in held:
            return F.col(f"c{c['id']}").cast(c["type"])
        return F.expr(c["default"]).cast(c["type"]) if c.get("default") else F.lit(None).cast(c["type"])

    # --- writing

    def _write(self, df: DataFrame, kind: str) -> tuple[str, int, int]:
        path = f"{kind}-{uuid.uuid4().hex}"
        full = f"{self.root}/data/{path}"
        df.write.parquet(full)
        p = self.spark._jvm.org.apache.hadoop.fs.Path(full)
        size = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
        if self.quota is not None and size + sum(s["bytes"] for t in self.state["tables"].values() for s in t["segments"]) > self.quota:
            remove(self.spark, full)
            raise StoreError("the store's quota is used up")
        schema = df.schema
        return path, self.spark.read.schema(schema).parquet(full).count(), size

    def _append(self, path: list[str], rows: DataFrame) -> DataFrame:
        """Adds rows whose columns are in the table's order; returns what was added, reread."""
        t = self.table(path)
        columns = t["columns"]
        if len(rows.columns) != len(columns):
            raise StoreError(f"{len(columns)} columns are needed, not {len(rows.columns)}")
        physical = rows.toDF(*(f"c{c['id']}" for c in columns))
        physical = physical.select(*(F.col(f"c{c['id']}").cast(c["type"]).alias(f"c{c['id']}") for c in columns))
        physical = physical.withColumn(ROW[0], F.lit(uuid.uuid4().int >> 66)).withColumn(ROW[1], F.monotonically_increasing_id())
        segment, count, size = self._write(physical, "rows")
        t["segments"].append({"path": segment, "rows": count, "bytes": size, "columns": [[c["id"], c["type"]] for c in columns]})
        self._touch(path)
        added = self.spark.read.parquet(f"{self.root}/data/{segment}")
        return added.select(*(F.col(f"c{c['id']}").alias(c["name"]) for c in columns))

    def create(self, path: list[str], columns: list[tuple[str, str]], replace: bool = False, rows: DataFrame | None = None) -> None:
        key = self.key(path)
        if key.split(".")[0] not in self.state["schemas"]:
            raise StoreError(f"no schema {key.split('.')[0]}")
        if (key in self.state["tables"] and not replace) or key in self.state["views"]:
            raise StoreError(f"{'.'.join(path)} exists")
        if len({n.lower() for n, _ in columns}) != len(columns):
            raise StoreError("repeated column name")
        self.state["tables"][key] = {"columns": [{"id": self._number(), "name": n, "type": k} for n, k in columns], "segments": [], "deletes": [], "stats": None}
        self._touch(path)
        if rows is not None:
            self._append(path, rows)

    def insert(self, path: list[str], rows: DataFrame) -> DataFrame:
        return self._append(path, rows)

    def _delete_rows(self, path: list[str], numbers: DataFrame) -> int:
        file, count, size = self._write(numbers.select(*ROW), "gone")
        if count:
            self.table(path)["deletes"].append({"path": file, "rows": count, "bytes": size})
            self._touch(path)
        return count

    def delete(self, path: list[str], matches: DataFrame) -> DataFrame:
        """matches: row numbers to go, maybe repeated. Returns the rows that went."""
        t = self.table(path)
        before = self.scan(path, True)
        numbers = self._freeze(matches.select(*ROW).distinct())
        self._delete_rows(path, numbers)
        assert t is self.table(path)
        return before.join(numbers, list(ROW), "left_semi").drop(*ROW)

    def update(self, path: list[str], matches: DataFrame, changed: list[str]) -> DataFrame:
        """matches: row numbers and new values under ``_new_<column>``. Of several matches of a row, the least in
        the order of the new values counts, so reruns agree. Returns the rows as they are now."""
        order = Window.partitionBy(*ROW).orderBy(*(F.col(f"_new_{c}").asc_nulls_last() for c in changed))
        one = matches.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")
        one = self._freeze(one.select(*ROW, *(f"_new_{c}" for c in changed)))
        before = self.scan(path, True)
        names = [c["name"] for c in self.table(path)["columns"]]
        low = {c.lower(): c for c in changed}
        after = before.join(one, list(ROW)).select(*((F.col(f"_new_{low[n.lower()]}") if n.lower() in low else F.col(f"`{n}`")).alias(n) for n in names))
        added = self._append(path, after)
        self._delete_rows(path, one)
        return added

    def share_rows(self, one: list[str], two: list[str]) -> bool:
        """Whether two lists of delete vectors have a row in common."""
        a, b = (self.spark.read.schema(ROW_SCHEMA).parquet(*(f"{self.root}/data/{x}" for x in paths)) for paths in (one, two))
        return not a.join(b, list(ROW), "left_semi").isEmpty()

    def _freeze(self, df: DataFrame) -> DataFrame:
        """Matches are written once: they are used twice, and must not change as the table does."""
        path = f"{self.root}/data/work-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def truncate(self, path: list[str]) -> None:
        t = self.table(path)
        t["segments"], t["deletes"], t["stats"] = [], [], None
        self._touch(path)

    def drop(self, path: list[str]) -> None:
        self.table(path)
        del self.state["tables"][self.key(path)]
        self._touch(path)

    # --- columns and names

    def _find(self, path: list[str], name: str) -> dict[str, Any]:
        for c in self.table(path)["columns"]:
            if c["name"].lower() == name.lower():
                return c
        raise StoreError(f"no column {name}")

    def add_column(self, path: list[str], name: str, kind: str, default: str | None) -> None:
        t = self.table(path)
        if any(c["name"].lower() == name.lower() for c in t["columns"]):
            raise StoreError(f"column {name} exists")
        t["columns"].append({"id": self._number(), "name": name, "type": kind, "default": default})
        self._touch(path)

    def drop_column(self, path: list[str], name: str) -> None:
        t = self.table(path)
        c = self._find(path, name)
        if len(t["columns"]) == 1:
            raise StoreError("a table keeps one column at least")
        t["columns"].remove(c)
        self._touch(path)

    def rename_column(self, path: list[str], name: str, to: str) -> None:
        c = self._find(path, name)
        if any(o is not c and o["name"].lower() == to.lower() for o in self.table(path)["columns"]):
            raise StoreError(f"column {to} exists")
        c["name"] = to
        self._touch(path)

    def rename(self, path: list[str], to: str) -> None:
        key = self.key(path)
        new = f"{key.split('.')[0]}.{to.lower()}"
        if new in self.state["tables"] or new in self.state["views"]:
            raise StoreError(f"{to} exists")
        self.state["tables"][new] = self.table(path)
        del self.state["tables"][key]
        self.touched |= {key, new}

    def create_schema(self, name: str) -> None:
        if name.lower() in self.state["schemas"]:
            raise StoreError(f"schema {name} exists")
        self.state["schemas"].append(name.lower())
        self.touched.add(f"schema {name.lower()}")

    def drop_schema(self, name: str) -> None:
        low = name.lower()
        if low == "main" or low not in self.state["schemas"]:
            raise StoreError(f"can't drop schema {name}")
        if any(k.startswith(low + ".") for kind in ("tables", "views") for k in self.state[kind]):
            raise StoreError(f"schema {name} isn't empty")
        self.state["schemas"].remove(low)
        self.touched.add(f"schema {low}")

    # --- upkeep

    def compact(self, path: list[str], target_bytes: int = 128 << 20) -> None:
        """All segments into files of about the target size, without deleted rows."""
        t = self.table(path)
        if len(t["segments"]) < 2 and not t["deletes"]:
            return
        size = sum(s["bytes"] for s in t["segments"])
        rows = self.scan(path).repartition(max(1, -(-size // target_bytes)))
        t_old = t["segments"], t["deletes"]
        t["segments"], t["deletes"] = [], []
        try:
            self._append(path, rows)
        except Exception:
            t["segments"], t["deletes"] = t_old
            raise

    def analyze(self, path: list[str]) -> int:
        t = self.table(path)
        n = self.scan(path).count()
        t["stats"] = {"rows": n, "bytes": sum(s["bytes"] for s in t["segments"]), "files": len(t["segments"])}
        self._touch(path)
        return n

    def files(self) -> set[str]:
        return {x["path"] for t in self.state["tables"].values() for kind in ("segments", "deletes") for x in t[kind]}

