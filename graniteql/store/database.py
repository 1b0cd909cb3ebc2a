"""A store as a whole: snapshots, transactions, upkeep, backup."""

from __future__ import annotations

import copy
import uuid
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import SparkSession

from ..sources.files import exists, remove
from .manifest import Conflict, Manifests, StoreError
from .tables import ROW_SCHEMA, Tables


class Transaction:
    """Snapshot isolation: reads see the generation it began with and its own changes. Appended rows, and deletions and
    updates of other rows of the same table, are put on top of what others have committed; of two that change a row,
    or one of which changes the table as such, the first to commit wins. Left as a context manager, it commits, or
    rolls back on an error."""

    def __init__(self, store: "Store", read_only: bool = False):
        self.store, self.read_only, self.open = store, read_only, True
        base = store.manifests.latest()
        self.base = copy.deepcopy(base)
        self.mark = store.marks.put(base["generation"])
        self.tables = Tables(store.spark, store.root, copy.deepcopy(base), store.quota)

    def commit(self) -> None:
        self._end()
        try:
            self._publish()
        finally:
            self.store.marks.drop(self.mark)

    def _publish(self) -> None:
        touched = self.tables.touched
        if not touched:
            return
        if self.read_only:
            raise StoreError("the transaction is read only")
        new = self.tables.files() - Tables(self.store.spark, self.store.root, self.base).files()
        if missing := [f for f in sorted(new) if not exists(self.store.spark, f"{self.store.root}/data/{f}")]:
            raise StoreError(f"{missing[0]}, which this transaction has written, is gone")
        for _ in range(100):
            now = self.store.manifests.latest()
            merged = self._merged(now, touched)
            try:
                self.store.manifests.publish(merged, now["generation"])
                return
            except Conflict:
                continue
        raise Conflict("the store is too busy")

    def _merged(self, now: dict[str, Any], touched: set[str]) -> dict[str, Any]:
        """This transaction's tables over the latest generation, if nobody else changed these."""
        mine, merged = self.tables.state, copy.deepcopy(now)
        for key in touched:
            if key.startswith("schema "):
                name = key[7:]
                if (name in now["schemas"]) != (name in self.base["schemas"]):
                    raise Conflict(f"schema {name} was changed by another transaction")
                merged["schemas"] = [s for s in merged["schemas"] if s != name] + ([name] if name in mine["schemas"] else [])
                continue
            for kind in ("tables", "views", "externals"):
                if now[kind].get(key) != self.base[kind].get(key):
                    if kind != "tables" or (rebased := self._rebased(key, now["tables"].get(key))) is None:
                        raise Conflict(f"{key} was changed by another transaction")
                    merged[kind][key] = rebased
                    continue
                merged[kind].pop(key, None)
                if key in mine[kind]:
                    merged[kind][key] = mine[kind][key]
        merged["next"] = max(now["next"], mine["next"])  # numbers need be unique in a table only
        return merged

    def _rebased(self, key: str, theirs: dict[str, Any] | None) -> dict[str, Any] | None:
        """A table after others' appended rows and deletions, and then ours; None if one of us did more than that, or
        both deleted (or updated) the same row."""
        base, mine = self.base["tables"].get(key), self.tables.state["tables"].get(key)
        if base is None or mine is None or theirs is None or not base["columns"] == mine["columns"] == theirs["columns"]:
            return None
        names = {kind: [{x["path"] for x in t[kind]} for t in (base, mine, theirs)] for kind in ("segments", "deletes")}
        if any(not before <= mine_ & theirs_ for before, mine_, theirs_ in names.values()):
            return None
        added = {kind: [[x for x in t[kind] if x["path"] not in names[kind][0]] for t in (mine, theirs)] for kind in names}
        one, two = added["deletes"]
        if one and two and self.tables.share_rows([d["path"] for d in one], [d["path"] for d in two]):
            return None
        out = copy.deepcopy(theirs)
        for kind in names:
            out[kind] += copy.deepcopy(added[kind][0])
        return {**out, "stats": None}

    def rollback(self) -> None:
        if self.open:
            self._end()
            for path in self.tables.files() - Tables(self.store.spark, self.store.root, self.base).files():
                remove(self.store.spark, f"{self.store.root}/data/{path}")
            self.store.marks.drop(self.mark)

    def _end(self) -> None:
        if not self.open:
            raise StoreError("the transaction is over")
        self.open = False

    def __enter__(self) -> "Transaction":
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        if self.open:
            self.rollback() if kind else self.commit()


class Marks:
    """A small file for each open transaction, so that upkeep leaves alone what it needs. Times are the file system's."""

    LONGEST = 86_400_000

    def __init__(self, spark: SparkSession, root: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.folder = self.path(f"{root}/open")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, generation: int | None) -> str:
        name = f"{'none' if generation is None else generation}-{uuid.uuid4().hex}"
        self.fs.create(self.path(self.folder, name), False).close()
        return name

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(self.folder, name), False)

    def open(self) -> tuple[int, set[int]]:
        """When the oldest began, and the generations they began with."""
        found = [(s.getModificationTime(), s.getPath().getName().split("-")[0]) for s in self.fs.listStatus(self.folder)]
        now = max(t for t, _ in found)
        found = [(t, g) for t, g in found if now - t < self.LONGEST]
        return min(t for t, _ in found), {int(g) for _, g in found if g != "none"}


class Store:
    def __init__(self, spark: SparkSession, root: str, quota: int | None = None):
        self.spark, self.root, self.quota = spark, root.rstrip("/"), quota
        self.manifests, self.marks = Manifests(spark, self.root), Marks(spark, self.root)

    def begin(self, read_only: bool = False) -> Transaction:
        return Transaction(self, read_only)

    def vacuum(self, keep_generations: int = 1) -> int:
        """Removes files that neither the newest generations need nor a transaction that is open now, and returns how
        many. What was written since the oldest open one began stays, as does what its generation holds. A transaction
        whose process died counts as open for a day (``Marks.LONGEST``). Readers of older generations fail."""
        own = self.marks.put(None)
        try:
            since, bases = self.marks.open()
            kept = set(self.manifests.numbers()[-keep_generations:]) | (bases & set(self.manifests.numbers()))
            used: set[str] = set()
            for n in kept:
                state = self.manifests.read(n)
                if state:
                    used |= Tables(self.spark, self.root, state).files()
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            gone = 0
            if fs.exists(path):
                for s in fs.listStatus(path):
                    if s.getPath().getName() not in used and s.getModificationTime() < since:
                        fs.delete(s.getPath(), True)
                        gone += 1
            return gone
        finally:
            self.marks.drop(own)

    def checkpoint(self) -> None:
        """Keeps the latest generation only."""
        self.manifests.forget(self.manifests.latest()["generation"])

    def backup(self, target: str) -> None:
        """A copy of the latest generation: its files first, the manifest last, so an unfinished copy isn't a store."""
        state = self.manifests.latest()
        if exists(self.spark, f"{target}/manifests"):
            raise StoreError(f"{target} holds a store already")
        wanted = [(x["path"], [f"c{i} {k}" for i, k in x["columns"]] if "columns" in x else []) for t in state["tables"].values() for kind in ("segments", "deletes") for x in t[kind]]

        def copied_file(x: tuple[str, list[str]]) -> None:
            rows = self.spark.read.schema(", ".join([*x[1], ROW_SCHEMA])).parquet(f"{self.root}/data/{x[0]}")
            rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/data/{x[0]}")

        with ThreadPoolExecutor(8) as pool:  # each a job of its own, whose tasks copy
            list(pool.map(copied_file, wanted))
        copied = Manifests(self.spark, target)
        copied.publish({k: v for k, v in state.items() if k != "complete"}, 0)

    @classmethod
    def restore(cls, spark: SparkSession, backup: str, target: str) -> "Store":
        cls(spark, backup).backup(target)
        return cls(spark, target)
