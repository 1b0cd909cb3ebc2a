"""Locations and files, through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


class SourceError(ValueError):
    """A location or its files aren't as asked for."""


@dataclass(frozen=True)
class File:
    path: str
    size: int
    modified: int


def _path(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def check_location(location: str) -> str:
    """A location of a local path, file:// or an object store; keys and passwords don't belong in it."""
    if not location:
        raise SourceError("an empty location")
    if re.match(r"^[a-z0-9]+://[^/]*@", location) or re.search(r"[?&](aws_|access_?key|secret|token|password)", location, re.I):
        raise SourceError("a location must not hold credentials")
    return re.sub(r"^s3://", "s3a://", location)


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder for files of this run: below spark.checkpoint.dir, which all executors share. Only where that is
    unset and everything runs in this process, a temporary folder does."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise SourceError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="graniteql-")
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    atexit.register(_quietly, spark, path)
    return path


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone at exit; only a leftover remains
        pass


def list_files(spark: SparkSession, location: str, suffixes: tuple[str, ...] = ()) -> list[File]:
    """The data files of a file, folder or glob, in order of path; hidden ones are left out."""
    fs, path = _path(spark, check_location(location))
    found = []
    for status in fs.globStatus(path) or []:
        if status.isDirectory():
            it = fs.listFiles(status.getPath(), True)
            while it.hasNext():
                found.append(it.next())
        else:
            found.append(status)
    root = location.rstrip("/")
    out = []
    for s in found:
        name = s.getPath().toString()
        inner = name.split(root.split("*")[0], 1)[-1]
        if not any(p.startswith(("_", ".")) for p in inner.split("/") if "=" not in p):
            out.append(File(name, s.getLen(), s.getModificationTime()))
    if suffixes:
        out = [f for f in out if f.path.lower().endswith(suffixes)] or out
    if not out:
        raise SourceError(f"no files at {location}")
    return sorted(out, key=lambda f: f.path)


def head(spark: SparkSession, path: str, size: int = 1 << 16) -> bytes:
    """The first bytes of a file."""
    fs, p = _path(spark, path)
    n = min(size, fs.getFileStatus(p).getLen())
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)) if n else b""
    finally:
        stream.close()


def remove(spark: SparkSession, location: str) -> None:
    fs, path = _path(spark, location)
    fs.delete(path, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames; what stood at the target is replaced."""
    fs, a = _path(spark, source)
    _, b = _path(spark, target)
    fs.delete(b, True)
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise SourceError(f"can't rename {source} to {target}")


def exists(spark: SparkSession, location: str) -> bool:
    fs, path = _path(spark, location)
    return fs.exists(path)
