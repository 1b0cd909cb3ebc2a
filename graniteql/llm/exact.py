"""Exact duplicates by a cuckoo-filter index.

Texts are compared by the SHA-256 of what is left without white space. Digests are dealt to partitions; in each
a cuckoo filter answers "surely new" fast, and its hits are verified against the bucketed content, the live
digests themselves. The filter takes deletions, and one that overflows is rebuilt larger from the stored keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, partitions, with_ids, without

_SPACE = b" \t\n\v\f\r"
_FLUSH = 100_000
_PER_PARTITION = 250_000
ENTRY = "digest binary, keep_rid long, keep_id long, keep_size long, n long"
_NULL = np.iinfo(np.int64).min


class CuckooIndex:
    """Live digests with their entries: a cuckoo filter whose slots lead to the content. Works on batches.

    A bucket has four slots, each a 16-bit fingerprint and the place of the entry it stands for; a digest's two buckets
    differ by the hash of its fingerprint, so an entry can be moved knowing its fingerprint only. Digests are uniform,
    and their bytes serve as hashes. Where no fingerprint fits, a digest is surely new; a hit is compared with the
    stored digest.
    """

    SLOTS = 4
    KICKS = 256

    def __init__(self, buckets: int = 256):
        self.digests, self.values = np.zeros((16, 4), np.uint64), np.zeros((16, 4), np.int64)
        self.alive = np.zeros(16, bool)
        self.used = self.live = self.resized = self.false_hits = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.marks = np.zeros((buckets, self.SLOTS), np.uint16)
        self.places = np.zeros((buckets, self.SLOTS), np.int64)

    def _home(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = np.maximum(digests[:, 0].astype(np.uint16), 1)
        return mark, (digests[:, 1] & np.uint64(self.mask)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return (bucket ^ (mark.astype(np.int64) * 0x5BD1E995 >> 7)) & self.mask

    def _fill(self, mark: np.ndarray, bucket: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Puts what has a free slot in its bucket there; returns which are left."""
        left = np.ones(len(mark), bool)
        for slot in range(self.SLOTS):
            free = np.flatnonzero(left & (self.marks[bucket, slot] == 0))
            one = free[np.unique(bucket[free], return_index=True)[1]]  # of those that share a bucket one a slot
            self.marks[bucket[one], slot], self.places[bucket[one], slot] = mark[one], place[one]
            left[one] = False
        return left

    def _put(self, place: np.ndarray) -> bool:
        """Fingerprints of the entries at these places; False if some found no slot."""
        mark, bucket = self._home(self.digests[place])
        for kick in range(self.KICKS):
            left = self._fill(mark, bucket, place)
            mark, bucket, place = mark[left], self._other(bucket[left], mark[left]), place[left]
            left = self._fill(mark, bucket, place)
            mark, bucket, place = mark[left], bucket[left], place[left]
            if not len(mark):
                return True
            # one entry a bucket takes a slot, and what was there goes on to its other bucket
            one = np.unique(bucket, return_index=True)[1]
            slot = kick % self.SLOTS
            at = bucket[one]
            out_mark, out_place = self.marks[at, slot].copy(), self.places[at, slot].copy()
            self.marks[at, slot], self.places[at, slot] = mark[one], place[one]
            mark[one], place[one] = out_mark, out_place
            bucket[one] = self._other(at, out_mark)
        return False

    def _grow(self) -> None:
        """Twice the buckets, filled again from the stored keys."""
        buckets = self.mask + 1
        while True:
            buckets *= 2
            self.resized += 1
            self._clear(buckets)
            if self.live <= 3.4 * buckets and self._put(np.flatnonzero(self.alive[: self.used])):
                return

    def _slots(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and slot of each live digest, -1 for others."""
        mark, home = self._home(digests)
        bucket, slot = np.full(len(mark), -1, np.int64), np.full(len(mark), -1, np.int64)
        for where in (home, self._other(home, mark)):
            for i in range(self.SLOTS):
                hit = np.flatnonzero((bucket < 0) & (self.marks[where, i] == mark))
                same = (self.digests[self.places[where[hit], i]] == digests[hit]).all(1)
                self.false_hits += int((~same).sum())
                bucket[hit[same]], slot[hit[same]] = where[hit[same]], i
        return bucket, slot

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Places of the entries, -1 where a digest isn't live."""
        bucket, slot = self._slots(digests)
        return np.where(bucket >= 0, self.places[bucket, slot], -1)

    def insert(self, digests: np.ndarray, values: np.ndarray) -> None:
        """Adds different digests that aren't live."""
        need = self.used + len(digests)
        if need > len(self.digests):
            size = max(need, 2 * len(self.digests))
            self.digests, self.values, self.alive = (np.concatenate([x, np.zeros((size - len(x), *x.shape[1:]), x.dtype)]) for x in (self.digests, self.values, self.alive))
        place = np.arange(self.used, need)
        self.digests[place], self.values[place], self.alive[place] = digests, values, True
        self.used, self.live = need, self.live + len(digests)
        if self.live > 3.4 * (self.mask + 1) or not self._put(place):
            self._grow()

    def delete(self, digests: np.ndarray) -> np.ndarray:
        """Takes out different digests; which of them were live."""
        bucket, slot = self._slots(digests)
        found = bucket >= 0
        bucket, slot = bucket[found], slot[found]
        self.alive[self.places[bucket, slot]] = False
        self.marks[bucket, slot] = 0
        self.live -= int(found.sum())
        return found

    def merge(self, digests: np.ndarray, values: np.ndarray) -> None:
        """Entries [rid, id, size, n] of any digests: of equal ones the larger size stays, then the smaller rid, and the
        n's are added up."""
        digests, values = _best(digests, values)
        at = self.find(digests)
        old = at >= 0
        if old.any():
            now, new = self.values[at[old]], values[old]
            better = (new[:, 2] > now[:, 2]) | ((new[:, 2] == now[:, 2]) & (new[:, 0] < now[:, 0]))
            kept = np.where(better[:, None], new, now)
            kept[:, 3] = now[:, 3] + new[:, 3]
            self.values[at[old]] = kept
        if not old.all():
            self.insert(digests[~old], values[~old])

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        here = np.flatnonzero(self.alive[: self.used])
        return self.digests[here], self.values[here]


def _best(digests: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry a digest: largest size, then smallest rid, and the sum of n."""
    if len(digests) < 2:
        return digests, values
    order = np.lexsort((values[:, 0], -values[:, 2], *digests.T))
    d = digests[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]).any(1)]))
    out = values[order[first]]
    out[:, 3] = np.add.reduceat(values[order, 3], first)
    return d[first], out


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Digests as four words each, and the four numbers; a null number is the least long."""
    column = batch.column(0)
    raw = np.frombuffer(b"".join(column.to_pylist()), "<u8")
    numbers = [batch.column(i).fill_null(_NULL).to_numpy(zero_copy_only=False) for i in range(1, 5)]
    return raw.reshape(-1, 4).astype(np.uint64), np.stack(numbers, 1) if batch.num_rows else np.zeros((0, 4), np.int64)


def digests(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns, digest and size (code points of the original text); a null text counts as empty."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys))
            for a, b, text in K.Text.of(column):
                data, at = text.data.tobytes(), text.offsets.tolist()
                found = [hashlib.sha256(data[s:e].translate(None, _SPACE)).digest() for s, e in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keys))), pa.array(found, pa.binary()), pa.array(text.code_points())], [*keys, "digest", "size"])

    schema = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keys)
    return docs.select(*keys, "text").mapInArrow(step, f"{schema}digest binary, size long")


def _emit(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    digests, values = index.entries()
    for i in range(0, len(digests), 20_000):
        raw, part = digests[i : i + 20_000].astype("<u8").tobytes(), values[i : i + 20_000]
        keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(part), [None, pa.py_buffer(raw)]).cast(pa.binary())
        columns = [pa.array(np.ascontiguousarray(part[:, k]), mask=part[:, k] == _NULL) for k in range(4)]
        yield pa.RecordBatch.from_arrays([keys, *columns], ["digest", "keep_rid", "keep_id", "keep_size", "n"])


def _gather(batches: Iterator[pa.RecordBatch], flush: int | None) -> Iterator[pa.RecordBatch]:
    """Entries merged through an index: the larger text stays, then the smaller rid. flush: entries held at most."""
    index = CuckooIndex()
    for batch in batches:
        index.merge(*_arrays(batch))
        if flush and index.live > flush:
            yield from _emit(index)
            index = CuckooIndex()
    yield from _emit(index)


def build_index(spark: SparkSession, rows: DataFrame, total: int) -> DataFrame:
    """(rid, doc_id, digest, size) -> one entry a digest. Each task first merges what it has, so that copies of
    one text reach its partition once a task at most."""
    entries = rows.select("digest", F.col("rid").alias("keep_rid"), F.col("doc_id").alias("keep_id"), F.col("size").alias("keep_size"), F.lit(1).cast("long").alias("n"))
    partial = entries.mapInArrow(lambda it: _gather(it, _FLUSH), ENTRY)
    n = max(partitions(spark), -(-total // _PER_PARTITION))
    return partial.repartition(n, "digest").mapInArrow(lambda it: _gather(it, None), ENTRY)


def update_index(spark: SparkSession, index: DataFrame, added: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """A stored index after deletions, then insertions: entries like ``index``, deleted has a column digest.

    A deleted digest is no longer live, whatever the number of its copies. Write the result to a new place.
    """
    names = [x.split()[0] for x in ENTRY.split(", ")]
    parts = [index.select(*names, F.lit(0).alias("act"))]
    if deleted is not None:
        parts.append(deleted.select("digest", *(F.lit(0).cast("long").alias(c) for c in names[1:]), F.lit(1).alias("act")))
    if added is not None:
        parts.append(added.select(*names, F.lit(2).alias("act")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = CuckooIndex()
        for batch in batches:
            act = batch.column(5).to_numpy()
            for i, j in ((0, np.searchsorted(act, 1)), (np.searchsorted(act, 1), np.searchsorted(act, 2)), (np.searchsorted(act, 2), len(act))):
                if i == j:
                    continue
                digests, values = _arrays(batch.slice(i, j - i))
                if act[i] == 1:
                    live.delete(np.unique(digests, axis=0))
                else:
                    live.merge(digests, values)
        yield from _emit(live)

    n = max(partitions(spark), -(-rows.count() // _PER_PARTITION))
    return rows.repartition(n, "digest").sortWithinPartitions("act").mapInArrow(step, ENTRY)


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """One row a document: doc_id, rid, digest, size, keep_id, keep_rid, group_size, kept.

    Of texts equal without white space the longest in code points stays, then the smallest id. Null texts count
    as empty and are copies of each other. Repeated ids are rows of their own (of rows equal in all, any one
    stays); null ids come last. An empty table gives an empty one; extra columns are ignored.
    """
    scratch = scratch or Scratch(spark, "exact")
    rows = scratch.write(digests(with_ids(spark, docs, id_col, ["text"], scratch), "rid", "doc_id"), "digests")
    index = build_index(spark, rows, rows.count())
    out = rows.join(index.withColumnRenamed("n", "group_size"), "digest")
    return out.select("doc_id", "rid", "digest", "size", "keep_id", "keep_rid", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns.

    Copies are found by id where ids are unique; otherwise (null or repeated ids) each document is compared as
    a row with a number of its own. The cases of ``exact_dedup`` hold.
    """
    scratch = Scratch(spark, "exact")
    others = [c for c in docs.columns if c not in (id_col, "text")]
    held = docs.select(F.col(id_col), F.col("text"), F.struct(*(F.col(f"`{c}`") for c in others)).alias("others") if others else F.lit(None).cast("string").alias("others"))
    rows = with_ids(spark, held, id_col, ["text", "others"], scratch)
    gone = exact_dedup(spark, rows.drop("doc_id"), "rid", scratch).filter("not kept").select(F.col("doc_id").alias("rid"))
    out = without(rows, scratch.write(gone, "gone"))
    back = {id_col: F.col("doc_id"), "text": F.col("text")}
    return out.select(*((back[c] if c in back else F.col("others").getField(c)).alias(c) for c in docs.columns))
