"""Near duplicates by weighted minhashing.

Texts are bags of five-word shingles with TF-IDF weights. Signatures come from improved consistent weighted
sampling, whose samples of two texts agree with the probability of their weighted Jaccard similarity. Bands of
samples make buckets; texts are compared with the least of their bucket exactly, then those that failed with the
others near enough, and documents with links make up classes.

* Document frequencies count all documents. Shingles that too few of them hold weigh 1, by a share of all, so weights
  don't depend on the size of the corpus; those above it, 2**20 at most whatever the corpus, are counted exactly.
* Equal word sequences are one class before anything else, so copies cost one row each.
* A bucket gives one pair a member, with its least member; weighted Jaccard distance is a metric, so of those
  that failed only texts whose distance to the least differs by 0.2 or less can be linked.
* Each of those that failed is a pivot once, and all of its bucket that it may be linked to are compared with it,
  exactly. Pivots come in rounds of growing numbers, and members that have come to one class by then need no more, so
  all rounds together are needed only where a bucket's texts aren't linked. Members and pivots travel in blocks, never
  as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .scratch import Scratch, likely_rows, partitions, with_ids, without

_BITS = 22
_PIECES = 1024
_FREQUENT = 1 << 20
_DRAWS = 1 << 17
_FIRST_PIVOTS = 32
#: Pivots and members of a bucket that meet in one task.
_PIVOTS, _MEMBERS = 512, 1024


@dataclass(frozen=True)
class Settings:
    """idf runs from idf_floor (a shingle of all documents) to 1 (of few documents): with a high floor a group's
    size hardly changes whether its members are alike."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 20
    rows: int = 5
    idf_floor: float = 0.85


def entries(text: K.Text, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of the distinct shingles; a shorter text is one shingle of all its words."""
    text.split_words()
    items = text.word_hash(lower=True)
    value, at = K.windows(items, text.first, words)
    own = np.searchsorted(text.first, at, side="right") - 1
    n = text.n_words
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        value = np.concatenate([value, K.text_hash(items, text.first)[short]])
        own = np.concatenate([own, short])
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return own[at], value[at], np.diff(np.append(at, len(own)))


def _slot(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - _BITS)).astype(np.int64)


class Idf:
    """Weights of the frequent shingles; all others weigh 1."""

    def __init__(self, shingles: np.ndarray, frequency: np.ndarray, documents: int, least: int, floor: float):
        order = np.argsort(shingles)
        self.shingles = shingles[order]
        share = np.log(documents / np.clip(frequency[order], 1, documents)) / np.log(documents / least) if documents > least else np.ones(len(order))
        self.weight = (floor + (1 - floor) * np.minimum(share, 1)).astype(np.float32)
        self.slots: np.ndarray | None = None

    def of(self, value: np.ndarray) -> np.ndarray:
        if self.slots is None:  # not a part of what is broadcast
            self.slots = np.zeros(1 << _BITS, bool)
            self.slots[_slot(self.shingles)] = True
        out = np.ones(len(value), np.float32)
        maybe = np.flatnonzero(self.slots[_slot(value)])
        if len(maybe):
            spot = np.minimum(np.searchsorted(self.shingles, value[maybe]), len(self.shingles) - 1)
            hit = self.shingles[spot] == value[maybe]
            out[maybe[hit]] = self.weight[spot[hit]]
        return out


def idf(spark: SparkSession, rows: DataFrame, s: Settings, scratch: Scratch) -> Idf:
    """Counts shingles in two passes over all texts. The first sums up 2**22 hash slots; ``least`` is a 2**20th of
    what all documents hold, so 2**20 shingles at most occur in as many, all of them in slots that have as much. The
    second counts the shingles of those slots one by one. The driver gets the slots' numbers, then the frequent
    shingles."""
    width = (1 << _BITS) // _PIECES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(1 << _BITS, np.uint32), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, text in K.Text.of(batch.column(0)):
                np.add.at(table, _slot(entries(text, s.words)[1]), np.uint32(1))
        if n:
            pieces = [pa.compress(table[i : i + width].tobytes(), "zstd", asbytes=True) for i in range(0, len(table), width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(_PIECES, dtype=np.int32)), pa.array(pieces, pa.binary()), pa.array([n] + [0] * (_PIECES - 1), pa.int64())], ["piece", "counts", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, n = None, np.zeros(width, np.int64), 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64()), pa.array([int(total.sum())])], ["piece", "counts", "n", "mass"])
        for batch in batches:
            for piece, packed, more in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if piece != now and now is not None:
                    yield done()
                    total, n = np.zeros(width, np.int64), 0
                now = piece
                n += more
                total += np.frombuffer(pa.decompress(packed, 4 * width, "zstd", asbytes=True), np.uint32)
        if now is not None:
            yield done()

    parts = rows.select("text").mapInArrow(count, "piece int, counts binary, n long").repartition(partitions(spark), "piece").sortWithinPartitions("piece")
    parts = scratch.write(parts.mapInArrow(add, "piece int, counts binary, n long, mass long"), "slots")
    sums = parts.agg(F.sum("n").alias("n"), F.sum("mass").alias("mass")).first()
    documents, least = sums["n"] or 0, max(1, -(-(sums["mass"] or 0) // _FREQUENT))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [p * width + np.flatnonzero(np.frombuffer(c, np.int64) >= least) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32))], ["slot"])

    marked = np.zeros(1 << _BITS, bool)
    marked[parts.select("piece", "counts").mapInArrow(full, "slot int").toArrow().column(0).to_numpy()] = True
    scratch.drop("slots")
    if not marked.any():
        return Idf(np.zeros(0, np.uint64), np.zeros(0, np.int64), documents, least, s.idf_floor)
    sent = spark.sparkContext.broadcast(np.packbits(marked))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, size = np.unpackbits(sent.value).astype(bool), [], 0
        for batch in batches:
            for _, _, text in K.Text.of(batch.column(0)):
                value = entries(text, s.words)[1]
                held.append(np.unique(value[here[_slot(value)]], return_counts=True))
                size += len(held[-1][0])
                if size > 1 << 20:
                    held, size = [_summed(held)], 0
                    if len(held[0][0]) > 1 << 19:
                        yield _counted(held.pop())
        if held:
            yield _counted(_summed(held))

    counts = rows.select("text").mapInArrow(single, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    table = counts.toArrow()
    return Idf(table.column("shingle").to_numpy().view(np.uint64), table.column("n").to_numpy(), documents, least, s.idf_floor)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    value, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return value, np.bincount(at, np.concatenate([x[1] for x in parts]), len(value)).astype(np.int64)


def _counted(found: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(K.signed(found[0])), pa.array(found[1].astype(np.int64))], ["shingle", "n"])


def weights(value: np.ndarray, count: np.ndarray, idf: Idf) -> np.ndarray:
    return (1 + np.log(count.astype(np.float32))) * idf.of(value)


_TABLES: list[np.ndarray] = []


def _draws() -> list[np.ndarray]:
    """A pool of draws: r ~ Gamma(2, 1), its inverse, log c - r with c ~ Gamma(2, 1), and beta ~ U(0, 1)."""
    if not _TABLES:
        u = ((K.stream(101, 5 * _DRAWS) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
        u = u.reshape(5, _DRAWS)
        r = -np.log(u[0] * u[1])
        _TABLES.extend(x.astype(np.float32) for x in (r, 1 / r, np.log(-np.log(u[2] * u[3])) - r, u[4]))
    return _TABLES


def signatures(own: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """n rows of k samples by improved consistent weighted sampling; rows without shingles are zero.

    For each sample, an element of weight S has t = floor(ln S / r + beta) and a = ln c - r (t - beta + 1); the
    element of least a is taken together with its t. The element's hash says which r, c and beta it draws.
    """
    out = np.zeros((n, k), np.uint32)
    if not len(own):
        return out
    r, inverse, log_c, beta = _draws()
    first = np.flatnonzero(np.diff(own, prepend=-1))
    rows = own[first]
    log_w = np.log(weight)
    place = np.arange(len(own), dtype=np.int64)
    shift = np.uint64(64 - _DRAWS.bit_length() + 1)
    for j, salt in enumerate(K.stream(202, k)):
        i = ((value * (salt | np.uint64(1))) >> shift).view(np.int64)
        b = beta.take(i)
        t = inverse.take(i)
        t *= log_w
        t += b
        np.floor(t, out=t)
        b -= t
        b *= r.take(i)
        b += log_c.take(i)
        bits = b.view(np.int32)  # as signed integers in the same order
        bits ^= (bits >> 31) & np.int32(0x7FFFFFFF)
        least = bits.astype(np.int64)
        least <<= 32
        least |= place
        at = np.minimum.reduceat(least, first) & 0xFFFFFFFF
        out[rows, j] = K.mix(value[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0xD1342543DE82EF95)).astype(np.uint32)
    return out


def _sign(rows: DataFrame, idf, s: Settings) -> DataFrame:
    """(rid, f1, f2, size, sig): f1 and f2 hash the whole word sequence."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text in K.Text.of(batch.column(1), K.CHUNK_BYTES // 2):
                own, value, count = entries(text, s.words)
                sig = signatures(own, value, weights(value, count, idf.value), text.n, s.bands * s.rows)
                whole = [K.text_hash(text.word_hash(lower=True, which=i), text.first, i) for i in (0, 1)]
                width = 4 * s.bands * s.rows
                offsets = pa.py_buffer((np.arange(text.n + 1) * width).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *(pa.array(K.signed(x)) for x in whole), pa.array(np.bincount(own, minlength=text.n).astype(np.int64)), pa.BinaryArray.from_buffers(pa.binary(), text.n, [None, offsets, pa.py_buffer(sig.tobytes())])],
                    ["rid", "f1", "f2", "size", "sig"],
                )

    return rows.select("rid", "text").mapInArrow(step, "rid long, f1 long, f2 long, size long, sig binary")


def verify(spark: SparkSession, rows: DataFrame, pairs: DataFrame, table, s: Settings, scratch: Scratch, name: str, per_task: int = 512) -> DataFrame:
    """(a, b) -> (a, b, sim), the exact weighted Jaccard similarity. Texts travel to b, at most ``per_task`` members
    with one copy of b's text; a frequent b is split over as many tasks as it needs. The requests for texts are
    written under ``name``, as they are used twice."""
    groups = pairs.groupBy("b").agg(F.ceil(F.count("*") / per_task).cast("int").alias("ways"))
    members = pairs.join(groups, "b").select(F.col("a").alias("rid"), "b", F.pmod(F.xxhash64("a"), F.col("ways")).cast("int").alias("way"), F.lit(1).alias("kind"))
    heads = groups.select(F.col("b").alias("rid"), "b", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"), F.lit(0).alias("kind"))
    asked = scratch.write(members.unionByName(heads), name)
    sent = likely_rows(rows.select("rid", "text"), asked).join(asked, "rid")
    sorted_rows = sent.repartition(partitions(spark), "b", "way").sortWithinPartitions("b", "way", "kind", "rid").select("rid", "text", "b", "way", "kind")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            rid, b, kind = (batch.column(c).to_numpy() for c in ("rid", "b", "kind"))
            found_a, found_b, found_sim = [], [], []
            for i0, _, text in K.Text.of(batch.column("text")):
                own, value, weight = _bags(text, table.value, s)
                cut = np.searchsorted(own, np.arange(text.n + 1))
                for i in range(text.n):
                    v, w = value[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]]
                    if kind[i0 + i] == 0:
                        head = (v.copy(), w.copy(), w.sum())
                        continue
                    spot = np.minimum(np.searchsorted(head[0], v), max(len(head[0]) - 1, 0))
                    same = head[0][spot] == v if len(head[0]) else np.zeros(len(v), bool)
                    low = np.minimum(head[1][spot[same]], w[same]).sum()
                    found_a.append(rid[i0 + i])
                    found_b.append(b[i0 + i])
                    found_sim.append(low / max(head[2] + w.sum() - low, 1e-300))
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64()), pa.array(found_sim, pa.float64())], ["a", "b", "sim"])

    return sorted_rows.mapInArrow(step, "a long, b long, sim double")


class _Pivots:
    """Of one bucket's block the pivots, and the classes that pivots and members have come to."""

    def __init__(self, rows: pa.Table, bags: list[tuple[np.ndarray, np.ndarray]], s: Settings):
        self.s, self.rid, self.root, self.sim = s, *(rows.column(c).to_numpy() for c in ("rid", "root", "sim"))
        self.root = self.root.copy()
        self.band = rows.column("band")[0].as_py()
        self.sig = _samples(rows.column("sig"), s)
        self.words = np.unique(np.concatenate([v for v, _ in bags]))
        self.bags = [(np.searchsorted(self.words, v), w) for v, w in bags]
        self.total = np.array([w.sum() for _, w in bags])
        self.dense = np.zeros(len(self.words))
        self.merged: dict[int, int] = {}

    def _now(self, root: np.ndarray) -> np.ndarray:
        names, at = np.unique(root, return_inverse=True)
        out = names.copy()
        for i, x in enumerate(names.tolist()):
            while x in self.merged:
                x = self.merged[x]
            out[i] = x
        return out[at]

    def links(self, rows: pa.RecordBatch, own: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[list[int], list[int]]:
        """Pairs (member, pivot) that are linked, as many as bring classes together."""
        rid, sim, pivot = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "sim", "pivot"))
        root, sig, n = self._now(rows.column("root").to_numpy()), _samples(rows.column("sig"), self.s), rows.num_rows
        total = np.bincount(own, weight, n)
        spot = np.minimum(np.searchsorted(self.words, value), len(self.words) - 1)
        both = self.words[spot] == value
        spot, weight, own = spot[both], weight[both], own[both]
        cut = np.searchsorted(own, np.arange(n + 1))
        a, b = [], []
        for j, (words, w) in enumerate(self.bags):
            # a pair is told in the bucket of its first common band, and of two pivots once
            told = (sig == self.sig[j]).all(2).argmax(1) == self.band
            near = np.abs(sim - self.sim[j]) <= 1 - self.s.threshold + 1e-9
            x = np.flatnonzero(told & near & (root != self.root[j]) & (~pivot | (rid > self.rid[j])))
            if not len(x):
                continue
            self.dense[words] = w
            size = cut[x + 1] - cut[x]
            at = np.repeat(cut[x] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            low = np.bincount(np.repeat(np.arange(len(x)), size), np.minimum(weight[at], self.dense[spot[at]]), len(x))
            self.dense[words] = 0
            x = x[low / np.maximum(total[x] + self.total[j] - low, 1e-300) >= self.s.threshold]
            if not len(x):
                continue
            names, first = np.unique(root[x], return_index=True)
            a += rid[x[first]].tolist()
            b += [int(self.rid[j])] * len(first)
            names = np.append(names, self.root[j])
            new = names.min()
            self.merged |= {int(y): int(new) for y in names if y != new}
            root[np.isin(root, names)] = new
            self.root[np.isin(self.root, names)] = new
        return a, b


def _samples(column: pa.Array, s: Settings) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, s.bands, s.rows)


def _bags(text: K.Text, idf: Idf, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, value, count = entries(text, s.words)
    return own, value, weights(value, count, idf).astype(np.float64)


def _linked(rows: DataFrame, n: int, idf, s: Settings) -> DataFrame:
    """Rows (key, way, kind, rid, root, sim, pivot, band, sig, text), pivots kind 0, members kind 1 -> (a, b), links."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads, bags, pivots = None, [], [], None
        for batch in batches:
            key, way, kind = (batch.column(c).to_numpy() for c in ("key", "way", "kind"))
            for i0, i1, text in K.Text.of(batch.column("text")):
                own, value, weight = _bags(text, idf.value, s)
                cuts = [i0, *(i0 + 1 + np.flatnonzero((np.diff(key[i0:i1]) != 0) | (np.diff(way[i0:i1]) != 0) | (np.diff(kind[i0:i1]) != 0))).tolist(), i1]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    part, group = batch.slice(i, j - i), (key[i], way[i])
                    x, y = np.searchsorted(own, [i - i0, j - i0])
                    if group != now:
                        now, heads, bags, pivots = group, [], [], None
                    if kind[i] == 0:
                        at = np.searchsorted(own, np.arange(i - i0, j - i0 + 1))
                        heads.append(part.drop_columns(["text"]))
                        bags += [(value[u:v].copy(), weight[u:v].copy()) for u, v in zip(at[:-1], at[1:], strict=True)]
                        continue
                    if heads and pivots is None:
                        pivots = _Pivots(pa.Table.from_batches(heads), bags, s)
                    if pivots is not None:
                        a, b = pivots.links(part, own[x:y] - (i - i0), value[x:y], weight[x:y])
                        if a:
                            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    names = ["key", "way", "kind", "rid", "root", "sim", "pivot", "band", "sig", "text"]
    dealt = rows.select(*names).repartition(n, "key", "way").sortWithinPartitions("key", "way", "kind", "rid")
    return dealt.mapInArrow(step, "a long, b long")


def _round(open_: DataFrame, low: int, high: int, s: Settings) -> DataFrame:
    """(rid, key, band, sim, root, m, f) -> rows (rid, ..., way, kind, pivot) of the pivots from number ``low`` to
    ``high`` and those they are to be compared with. Of the ``f`` members of a bucket that failed each has a place
    below f by hash; those before ``low`` have been compared with all. Pivots are dealt into blocks, and so are
    members; each block of the ones meets each of the others."""
    place = F.when(F.col("sim") < s.threshold, F.pmod(F.xxhash64("key", "rid"), F.lit(1 << 30)) * F.col("f") / float(1 << 30))
    rows = open_.withColumn("place", place).filter((F.col("f") > low) & (F.col("place").isNull() | (F.col("place") >= low)))
    rows = rows.withColumn("pivot", F.coalesce(F.col("place") < high, F.lit(False)))
    groups = F.ceil((F.least("f", F.lit(high)) - low) / _PIVOTS).cast("int")
    ways = F.ceil(F.col("m") / _MEMBERS).cast("int")
    rows = rows.withColumn("groups", groups).withColumn("ways", ways)
    spread = F.xxhash64("rid", "key", F.lit(7))
    member = F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda g: F.struct((g * F.col("ways") + F.pmod(spread, F.col("ways"))).cast("int").alias("way"), F.lit(1).alias("kind")))
    block = F.floor((F.col("place") - low) / ((F.least("f", F.lit(high)) - low) / F.col("groups"))).cast("int")
    pivot = F.transform(F.sequence(F.lit(0), F.col("ways") - 1), lambda w: F.struct((F.least(block, F.col("groups") - 1) * F.col("ways") + w).cast("int").alias("way"), F.lit(0).alias("kind")))
    return rows.withColumn("meets", F.when(F.col("pivot"), F.concat(member, pivot)).otherwise(member)).drop("groups", "ways", "place", "f", "m")


def near_duplicates(spark: SparkSession, docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, rid, class_id (least id of its class), class_rid, class_size.

    A class is a component of the links between texts of similarity ``threshold`` or more. Words are lower-cased
    (A-Z). Texts of equal words are always linked, so all texts without a word (nulls too) are one class. Null ids
    come last; rows that share an id are documents of their own. Extra columns are ignored; an empty table gives an
    empty one. A link is missed only if no band of the two signatures agrees: once in 2,700 at similarity 0.8, never
    in practice above 0.85; all texts that share a band are compared exactly, in buckets of any size.
    """
    scratch = Scratch(spark, "minhash")
    rows = with_ids(spark, docs, id_col, ["text"], scratch)
    table = spark.sparkContext.broadcast(idf(spark, rows, s, scratch))
    signed = scratch.write(_sign(rows, table, s), "signed")

    # equal word sequences: the least id stands for all
    same = signed.groupBy("f1", "f2").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"))
    same = scratch.write(same, "same")
    reps = scratch.write(signed.filter("size > 0").join(same.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", "sig"), "reps")

    part = lambda i: F.xxhash64(F.lit(i), F.substring("sig", 4 * s.rows * i + 1, 4 * s.rows))
    parts = F.array(*(part(i) for i in range(s.bands)))
    banded = reps.select("rid", F.posexplode(parts).alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("rid").alias("head"), F.count("*").alias("n")).filter("n > 1")
    members = scratch.write(banded.join(buckets, "key"), "members")

    pairs = scratch.write(members.filter("rid <> head").select(F.col("rid").alias("a"), F.col("head").alias("b")).distinct(), "pairs")
    sims = scratch.write(verify(spark, rows, pairs, table, s, scratch, "asked"), "sims")
    links = sims.filter(F.col("sim") >= s.threshold).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = components(spark, links, scratch)

    # those that failed against the least of a bucket, and all in it that they may still be linked to
    placed = members.join(sims.select(F.col("a").alias("rid"), F.col("b").alias("head"), "sim"), ["rid", "head"], "left")
    placed = placed.withColumn("sim", F.when(F.col("rid") == F.col("head"), F.lit(1.0)).otherwise(F.col("sim")))
    failed = placed.filter(F.col("sim") < s.threshold).groupBy("key").agg(F.max("sim").alias("best"))
    open_ = placed.join(failed, "key").filter(F.col("sim") <= F.col("best") + (1 - s.threshold) + 1e-9)
    sizes = open_.groupBy("key").agg(F.count("*").alias("m"), F.count_if(F.col("sim") < s.threshold).alias("f")).filter("m > 1")
    open_ = scratch.write(open_.join(sizes, "key").select("rid", "key", "band", "sim", "m", "f"), "open")
    low, high, most = 0, _FIRST_PIVOTS, open_.agg(F.max("f")).first()[0] or 0
    while low < most:
        now = open_.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        split = now.filter(F.col("f") > low).groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("two")).filter("one <> two")
        now = scratch.write(_round(now.join(split.select("key"), "key"), low, high, s), f"round{low}")
        if now.isEmpty():
            break
        # each text is fetched once, then goes to where its buckets meet
        asked = now.groupBy("rid", "root").agg(F.collect_list(F.struct("key", "band", "sim", "pivot", "meets")).alias("asked"))
        asked = asked.join(reps, "rid").join(likely_rows(rows.select("rid", "text"), asked), "rid").select("rid", "root", "sig", "text", F.explode("asked").alias("x"))
        asked = asked.select("rid", "root", "sig", "text", "x.*").withColumn("meet", F.explode("meets")).select("*", "meet.way", "meet.kind")
        found = scratch.write(_linked(asked, partitions(spark), table, s), f"found{low}")
        if not found.isEmpty():
            ties = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
            roots = components(spark, ties.unionByName(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), scratch, f"stars{low}_")
        low, high = high, high + 4 * (high - low)

    named = same.join(roots, same["rep"] == roots["node"], "left").select("f1", "f2", F.coalesce("root", "rep").alias("class_rid"), "copies")
    counted = named.groupBy("class_rid").agg(F.sum("copies").alias("class_size"))
    named = scratch.write(named.drop("copies").join(counted, "class_rid"), "named")
    out = signed.select("rid", "f1", "f2").join(named, ["f1", "f2"]).select("rid", "class_rid", "class_size")
    if "rid" in docs.columns and id_col == "rid":
        return out.select(F.col("rid").alias("doc_id"), "rid", F.col("class_rid").alias("class_id"), "class_rid", "class_size")
    ids = rows.select("rid", "doc_id")
    out = out.join(ids, "rid")
    return out.join(ids.select(F.col("rid").alias("class_rid"), F.col("doc_id").alias("class_id")), "class_rid").select("doc_id", "rid", "class_id", "class_rid", "class_size")


def keep_representatives(spark: SparkSession, docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id") -> DataFrame:
    """The documents with one of each class, the least id, with all their columns. The cases of
    ``near_duplicates`` hold."""
    scratch = Scratch(spark, "minhash")
    others = [c for c in docs.columns if c not in (id_col, "text")]
    packed = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("string")
    rows = with_ids(spark, docs.select(F.col(id_col), F.col("text"), packed.alias("others")), id_col, ["text", "others"], scratch)
    gone = scratch.write(near_duplicates(spark, rows.drop("doc_id"), s, "rid").filter("rid <> class_rid").select("rid"), "gone")
    back = {id_col: F.col("doc_id"), "text": F.col("text")}
    return without(rows, gone).select(*((back[c] if c in back else F.col("others").getField(c)).alias(c) for c in docs.columns))
