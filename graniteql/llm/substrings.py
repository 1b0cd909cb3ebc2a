"""Repeated passages by seed and extend.

Seeds are winnowed anchors: of the 8-word runs in every 20-word window the one of least hash. Each window so
belongs to one anchor, and equal windows to equal anchors at equal places. Documents meet on their anchors. There
an occurrence is extended both ways over all windows that its anchor governs (up to the next anchors): where the
whole extension equals an earlier occurrence's, all its windows repeat at once. Only occurrences whose extensions
differ though the anchors agree, the ends of repeats, are compared window by window. Neighbouring repeated windows
make up the maximal repeats, none shorter than the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, partitions, with_ids

_HELD = 400_000
_MEETING = "key long, f long, rid long, s int, n int, known boolean"
_NAMES = [x.split()[0] for x in _MEETING.split(", ")]


def anchors(text: K.Text, length: int, k: int) -> list[np.ndarray]:
    """key, f, text number, first governed window, number of governed windows; one entry an anchor occurrence.

    f hashes the first and the last governed window, which hold all its words, with the anchor's place among them.
    """
    text.split_words()
    words, first = text.word_hash(), text.first
    grams, at = K.windows(words, first, k)
    spread = np.full(len(words) + length, np.iinfo(np.uint64).max, np.uint64)
    spread[at] = grams
    counts = np.maximum(np.diff(first) - length + 1, 0)
    row = K.per_row(counts)
    start = np.arange(int(counts.sum())) + np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    if not len(start):
        return [np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))]
    w = length - k + 1
    view = np.lib.stride_tricks.sliding_window_view(spread, w)
    anchor = np.empty(len(start), np.int64)
    for i in range(0, len(start), 1 << 16):
        part = start[i : i + (1 << 16)]
        anchor[i : i + (1 << 16)] = part + view[part].argmin(axis=1)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(start)))
    begin, place = start[at], anchor[at]
    whole = K.windows(text.word_hash(which=1), first, length)[0]
    f = K.joined(whole[at], whole[at + n - 1]) ^ K.mix(((place - begin) * 1024 + n).astype(np.uint64))
    return [spread[place], f, row[at], begin - first[row[at]], n]


def _met(key: np.ndarray, f: np.ndarray, rid: np.ndarray, s: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of occurrences that agree in key and f only the earliest goes to the meeting; the others repeat for sure
    and go along under keys of their own. So a passage that all documents share reaches its partition once a task."""
    order = np.lexsort((s, rid, f, key))
    key, f, rid, s, n = key[order], f[order], rid[order], s[order], n[order]
    known = np.zeros(len(key), bool)
    known[1:] = (key[1:] == key[:-1]) & (f[1:] == f[:-1])
    key = np.where(known, K.mix(rid.astype(np.uint64) + s.astype(np.uint64)), key)
    for i in range(0, len(key), 50_000):
        j = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(K.signed(key[j])), pa.array(K.signed(f[j])), pa.array(rid[j]), pa.array(s[j].astype(np.int32)), pa.array(n[j].astype(np.int32)), pa.array(known[j])], _NAMES)


class _Held:
    """Occurrences held until there are enough to merge."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.size = 0

    def add(self, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size > _HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            self.parts, self.size = [], 0
            yield from _met(*columns)


def _meet(batches: Iterator[pa.RecordBatch], ends: bool) -> Iterator[pa.RecordBatch]:
    """Sorted occurrences -> (rid, s, n, open): repeated windows (open false), and with ``ends`` the earliest of
    each extension where extensions differ (open true). Holds one row between batches, so a frequent anchor is no
    matter of memory."""
    key = f = None
    classes, pending = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fs, rid, s, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        known = batch.column(5).to_numpy(zero_copy_only=False)
        new_key, new_f = np.ones(len(keys), bool), np.ones(len(keys), bool)
        new_key[1:] = keys[1:] != keys[:-1]
        new_f[1:] = new_key[1:] | (fs[1:] != fs[:-1])
        new_key[0] = keys[0] != key
        new_f[0] = new_key[0] or fs[0] != f
        # an entry that is known to repeat has a key of its own; it neither opens a class nor closes one
        new_f |= known
        gone = known | ~new_f
        outs = [(rid[gone], s[gone], n[gone], False)]
        if ends:
            group = np.cumsum(new_key) - (1 if new_key[0] else 0)
            lead = new_f & ~known
            per = np.bincount(group[lead], minlength=int(group[-1]) + 1)
            if not new_key[0]:
                if per[0] and pending is not None:
                    outs.append((*(np.array([x]) for x in pending), True))
                    pending = None
                per[0] += classes
            else:
                pending = None
            open_ = lead & (per[group] > 1)
            outs.append((rid[open_], s[open_], n[open_], True))
            classes = int(per[-1])
            last = np.flatnonzero(lead & (group == group[-1]))
            if classes == 1 and len(last):
                pending = (rid[last[0]], s[last[0]], n[last[0]])
            elif classes > 1:
                pending = None
        key, f = keys[-1], fs[-1]
        for r, b, m, o in outs:
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)), pa.array(b.astype(np.int32)), pa.array(m.astype(np.int32)), pa.array(np.full(len(r), o))], ["rid", "s", "n", "open"])


def _by_key(rows: DataFrame, n: int, ends: bool) -> DataFrame:
    sorted_rows = rows.repartition(n, "key").sortWithinPartitions("key", "f", "rid", "s")
    return sorted_rows.mapInArrow(lambda it: _meet(it, ends), "rid long, s int, n int, open boolean")


def _lists(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rid").agg(F.collect_list(F.struct("s", "n")).alias("runs")).hint("shuffle_hash")


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and number of windows of all listed runs."""
    flat = column.flatten()
    row = K.per_row(column.value_lengths().fill_null(0).to_numpy().astype(np.int64))
    return row, flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)


def drop_repeats(spark: SparkSession, docs: DataFrame, length: int = 20, k: int = 8, id_col: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, rid, text (the kept words joined by one space), n_words, n_removed, removed.

    removed: the maximal repeats, as (start, end) in words. A word goes if a window of ``length`` words covers it
    that also starts earlier: in a smaller id, or before in the same document. Windows are judged on the input. Null
    and empty texts, and such of fewer words, lose nothing. Null ids come last; rows that share an id are documents
    of their own, ordered by text. Extra columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(spark, "substrings")
    rows = with_ids(spark, docs, id_col, ["text"], scratch)
    n_parts = partitions(spark)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for a, _, text in K.Text.of(batch.column(1)):
                key, f, row, s, n = anchors(text, length, k)
                yield from held.add([key, f, rid[a + row], s, n])
        yield from held.flush()

    met = scratch.write(_by_key(rows.select("rid", "text").mapInArrow(seed, _MEETING), n_parts, True), "met")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            rid = batch.column(0).to_numpy()
            for a, b, text in K.Text.of(batch.column(1)):
                text.split_words()
                row, s, n = _runs(batch.column(2).slice(a, b - a))
                own, start = np.repeat(row, n), np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                order = np.lexsort((start, own))
                own, start = own[order], start[order]
                at = text.first[own] + start
                found = [K.windows(text.word_hash(which=i), text.first, length) for i in (0, 1)]
                one, two = (value[np.searchsorted(place, at)] for value, place in found)
                yield from held.add([one, two, rid[a + own], start, np.ones(len(own), np.int64)])
        yield from held.flush()

    ends = rows.select("rid", "text").join(_lists(met.filter("open")), "rid")
    more = _by_key(ends.mapInArrow(compare, _MEETING), n_parts, False)
    gone = met.filter(~F.col("open")).select("rid", "s", "n").unionByName(more.select("rid", "s", "n"))
    joined = rows.join(_lists(gone), "rid", "left").select("rid", "doc_id", "text", "runs")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text in K.Text.of(batch.column(2)):
                yield _kept(batch.slice(a, b - a), text, length)

    return joined.mapInArrow(keep, "rid long, doc_id long, text string, n_words long, n_removed long, removed array<struct<start:long,end:long>>")


def _kept(batch: pa.RecordBatch, text: K.Text, length: int) -> pa.RecordBatch:
    text.split_words()
    row, s, n = _runs(batch.column(3))
    total = len(text.starts)
    steps = np.zeros(total + 1, np.int64)
    np.add.at(steps, text.first[row] + s, 1)
    np.add.at(steps, text.first[row] + s + n - 1 + length, -1)
    gone = np.cumsum(steps[:-1]) > 0
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[text.first])

    low, high = K.runs(total, lambda a, b: ~gone[a:b], text.first)
    own = np.searchsorted(text.first, low, side="right") - 1
    ends = np.bincount(own, minlength=text.n)
    spans = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(low - text.first[own]), pa.array(high - text.first[own])], ["start", "end"]),
    )

    kept = np.flatnonzero(~gone)
    of = np.searchsorted(text.first, kept, side="right") - 1
    size = text.ends[kept] - text.starts[kept] + 1  # with the space after it
    last = np.ones(len(kept), bool)
    last[:-1] = of[1:] != of[:-1]
    size[last] -= 1
    bounds = np.concatenate([[0], np.cumsum(size)])
    source = np.repeat(text.starts[kept] - bounds[:-1], size) + np.arange(int(bounds[-1]))
    data = np.append(text.data, np.uint8(32))[source]
    data[bounds[1:][~last] - 1] = 32
    offsets = bounds[np.searchsorted(of, np.arange(text.n + 1))]
    out = pa.StringArray.from_buffers(text.n, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))
    return pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), out, pa.array(text.n_words.astype(np.int64)), pa.array(removed.astype(np.int64)), spans],
        ["rid", "doc_id", "text", "n_words", "n_removed", "removed"],
    )
