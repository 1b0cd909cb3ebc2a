"""Lines that many documents share, by levelled sorted runs of line hashes.

Documents come in batches of rising ids. Each batch's new line keys are merge-anti-joined with the runs so far
and written as a sorted run of their own, with the document that owns each key; a level with too many runs is
compacted, two runs merged into one of the next level. A line whose key another, earlier document owns is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, partitions, with_ids

RUN = "k1 long, k2 long, owner long"
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def _lines(text: K.Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts and ends of all lines (\n-split, empty ones too), and the number in each text."""
    n = np.diff(text.offsets)
    breaks = np.flatnonzero(text.data == 10)
    owner = np.searchsorted(text.offsets, breaks, side="right") - 1
    counts = np.bincount(owner, minlength=text.n) + 1
    at = np.cumsum(counts) - counts
    starts = np.insert(breaks + 1, np.searchsorted(breaks, text.offsets[:-1]), text.offsets[:-1])
    ends = np.insert(breaks, np.searchsorted(breaks, text.offsets[1:]), text.offsets[1:])
    assert len(starts) == len(ends) == counts.sum() and len(at) == len(n)
    return starts, ends, counts


def _keys(text: K.Text, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Line number, text number and the ends of the key of each line whose key is long enough; and all lines."""
    starts, ends, counts = _lines(text)
    text.split_words()
    i, j = np.searchsorted(text.starts, starts), np.searchsorted(text.ends, ends, side="right")
    full = np.flatnonzero(j > i)
    low, high = text.starts[i[full]], text.ends[j[full] - 1]
    points = text.before(K._LEAD, np.stack([low, high], 1).reshape(-1)).reshape(-1, 2)
    long = points[:, 1] - points[:, 0] >= least
    full, low, high = full[long], low[long], high[long]
    return full, K.per_row(counts)[full], low, high, (starts, ends, counts)


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """(rid, k1, k2): the distinct keys of each document."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for a, _, text in K.Text.of(batch.column(1)):
                _, row, low, high, _ = _keys(text, least)
                one, two = (K.span_hash(text.data, low, high, i, True) for i in (0, 1))
                order = np.lexsort((two, one, row))
                row, one, two = row[order], one[order], two[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(rid[a + row[new]]), pa.array(K.signed(one[new])), pa.array(K.signed(two[new]))], ["rid", "k1", "k2"])

    return docs.select("rid", "text").mapInArrow(step, "rid long, k1 long, k2 long")


class LineRuns:
    """Sorted runs in levels. A run is a table bucketed by key, each bucket one sorted file, and read in that order: so
    a batch is merged with it, and two runs with each other, without moving or sorting the run again, a row of each in
    memory at a time. A level holds ``fanout`` runs at most; one more, and its two oldest become one of the next."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 3, buckets: int | None = None):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.made = 0

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        """Scans of runs tell their order; the session's own setting comes back after."""
        before = self.spark.conf.get(_ORDERED, None)
        self.spark.conf.set(_ORDERED, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(_ORDERED) if before is None else self.spark.conf.set(_ORDERED, before)

    def _write(self, rows: DataFrame) -> str:
        """Rows that are dealt by key already."""
        name = f"run{self.made}"
        self.made += 1
        table = f"{self.scratch.root.rsplit('/', 1)[1]}_{name}".replace("-", "_")
        with self._in_order():
            rows.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", f"{self.scratch.root}/{name}").option("compression", "zstd").saveAsTable(table)
        return table

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unknown(self, batch: DataFrame) -> DataFrame:
        """Of (k1, k2, owner), one row a key, those whose key no run holds."""
        for name in self.runs():
            batch = batch.join(self.spark.table(name).hint("merge"), ["k1", "k2"], "left_anti")
        return batch

    def merged(self, one: str, two: str) -> DataFrame:
        """The rows of two runs, which share no key, merged."""
        a, b = self.spark.table(one), self.spark.table(two).withColumnRenamed("owner", "other")
        return a.join(b.hint("merge"), ["k1", "k2"], "full").select("k1", "k2", F.coalesce("owner", "other").alias("owner"))

    def add(self, keys: DataFrame) -> None:
        """(k1, k2, rid): the keys of documents later than all before."""
        batch = keys.groupBy("k1", "k2").agg(F.min("rid").alias("owner"))
        if self.buckets != partitions(self.spark):
            batch = batch.repartition(self.buckets, "k1", "k2")
        self.levels[0].append(self._write(self.unknown(batch)))
        level = 0
        while len(self.levels[level]) > self.fanout:
            one, two = self.levels[level][:2]
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self.merged(one, two)))
            self.levels[level] = self.levels[level][2:]
            for name in (one, two):
                self._forget(name)
            level += 1

    def _forget(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.scratch.drop(table.rsplit("_", 1)[1])

    def close(self) -> DataFrame:
        """All keys with their owners, read from the runs' files; the tables' names are given up."""
        rows = None
        for name in self.runs():
            run = self.spark.read.schema(RUN).parquet(f"{self.scratch.root}/{name.rsplit('_', 1)[1]}")
            rows = run if rows is None else rows.unionByName(run)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return rows if rows is not None else self.spark.createDataFrame([], RUN)


def dedup_lines(spark: SparkSession, docs: DataFrame, least: int = 10, batches: int = 4, fanout: int = 2, id_col: str = "doc_id") -> DataFrame:
    r"""One row a document: doc_id, rid, text (what is left), n_lines (before), n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of ``least`` code points or
    more that two documents hold lose all their lines but those of the smallest id. Null and empty texts are one
    empty line. Null ids come last; rows that share an id are documents of their own, ordered by text. Extra
    columns are ignored; an empty table gives an empty one. batches and fanout change the runs, not the result.
    """
    scratch = Scratch(spark, "lines")
    rows = with_ids(spark, docs, id_col, ["text"], scratch)
    keys = scratch.write(line_keys(rows, least), "keys")
    bounds = sorted(set(rows.approxQuantile("rid", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    runs = LineRuns(spark, scratch, fanout)
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = keys
        if low is not None:
            part = part.filter(F.col("rid") > int(low))
        if high is not None:
            part = part.filter(F.col("rid") <= int(high))
        runs.add(part)
    owners = runs.close()
    lost = keys.join(owners, ["k1", "k2"]).filter(F.col("rid") != F.col("owner"))
    lists = lost.groupBy("rid").agg(F.collect_list("k1").alias("lost"))  # within a document one hash will do
    joined = rows.join(lists.hint("merge"), "rid", "left").select("rid", "doc_id", "text", "lost")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text in K.Text.of(batch.column(2)):
                yield _without(batch.slice(a, b - a), text, least)

    return joined.mapInArrow(step, "rid long, doc_id long, text string, n_lines long, n_dropped long")


def _without(batch: pa.RecordBatch, text: K.Text, least: int) -> pa.RecordBatch:
    full, row, low, high, (starts, ends, counts) = _keys(text, least)
    lost = batch.column(3)
    size = lost.value_lengths().fill_null(0).to_numpy()
    flat = lost.flatten().to_numpy().view(np.uint64)
    dropped = np.zeros(len(starts), bool)
    if len(flat):
        # only texts that lose something need their hashes again; of these, the lines that equal a lost key
        some = size[row] > 0
        full, row, low, high = full[some], row[some], low[some], high[some]
        owner = np.concatenate([K.per_row(size), row])
        key = np.concatenate([flat, K.span_hash(text.data, low, high, 0, True)])
        order = np.lexsort((key, owner))
        new = np.ones(len(order), bool)
        new[1:] = (owner[order][1:] != owner[order][:-1]) | (key[order][1:] != key[order][:-1])
        group = np.cumsum(new) - 1
        marked = np.zeros(int(group[-1]) + 1, bool)
        marked[group[order < len(flat)]] = True
        of = np.empty(len(order), np.int64)
        of[order] = group
        dropped[full] = marked[of[len(flat) :]]
    n_dropped = np.bincount(K.per_row(counts)[dropped], minlength=text.n)
    at = np.concatenate([[0], np.cumsum(counts)])
    data = memoryview(text.data)
    kept = []
    for i in range(text.n):
        if n_dropped[i]:
            stay = at[i] + np.flatnonzero(~dropped[at[i] : at[i + 1]])
            kept.append(b"\n".join([data[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
        else:
            kept.append(bytes(data[text.offsets[i] : text.offsets[i + 1]]))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64)), pa.array(n_dropped.astype(np.int64))],
        ["rid", "doc_id", "text", "n_lines", "n_dropped"],
    )
