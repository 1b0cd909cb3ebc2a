"""Generations of a table store: immutable JSON manifests, published by exclusive creation.

A manifest names every segment and delete vector of every table, so a reader that holds one sees a snapshot. The
next generation's file can be created once only; who comes second finds it there and has lost the race.
"""

from __future__ import annotations

import copy
import json
import os
import uuid
from typing import Any

from pyspark.sql import SparkSession


class StoreError(ValueError):
    """The store can't do what was asked."""


class Conflict(StoreError):
    """Another transaction committed a change to the same table first."""


EMPTY: dict[str, Any] = {"generation": 0, "schemas": ["main"], "tables": {}, "views": {}, "externals": {}, "next": 1}


class Manifests:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.folder)

    def _path(self, generation: int):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.folder, f"{generation:012d}.json")

    def numbers(self) -> list[int]:
        names = (s.getPath().getName() for s in self.fs.listStatus(self.folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, generation: int) -> dict[str, Any] | None:
        """None for one that was cut off while it was written."""
        stream = self.fs.open(self._path(generation))
        try:
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()
        try:
            found = json.loads(text)
        except ValueError:
            return None
        return found if found.get("complete") else None

    def latest(self) -> dict[str, Any]:
        for n in reversed(self.numbers()):
            found = self.read(n)
            if found is not None:
                return found
        return copy.deepcopy(EMPTY)

    def publish(self, state: dict[str, Any], base: int) -> dict[str, Any]:
        """Writes the state as the next generation, if the latest whole one is still ``base``."""
        newer = [n for n in self.numbers() if n > base]
        if any(self.read(n) is not None for n in newer):
            raise Conflict("another transaction has committed")
        number = max([base, *newer]) + 1  # past those that were cut off
        state = {**state, "generation": number, "complete": True}
        if not self._place(number, json.dumps(state, sort_keys=True).encode("utf-8")):
            raise Conflict("another transaction has committed")
        return state

    def _place(self, number: int, data: bytes) -> bool:
        """Puts a whole file under its name at once; False if the name is taken. Locally that is a hard link, else a
        rename, which refuses a taken name on HDFS and its like."""
        target, temporary = self._path(number), self.spark._jvm.org.apache.hadoop.fs.Path(self.folder, f".{uuid.uuid4().hex}")
        out = self.fs.create(temporary, False)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        try:
            if self.fs.getScheme() == "file":
                os.link(temporary.toUri().getPath(), target.toUri().getPath())
                return True
            return not self.fs.exists(target) and self.fs.rename(temporary, target)
        except FileExistsError:
            return False
        finally:
            self.fs.delete(temporary, False)

    def forget(self, keep: int) -> None:
        """Drops generations older than ``keep``."""
        for n in self.numbers():
            if n < keep:
                self.fs.delete(self._path(n), False)
