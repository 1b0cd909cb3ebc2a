"""Concatenate and cut: all documents' tokens in one line, cut into windows of fixed length.

Pass one tokenises each document once and writes its ids with its place in the partition. Pass two turns the
partitions' totals into global offsets (one number a partition on the driver). Pass three cuts each document
at window bounds; a document over a bound leaves one record in each window. Nothing is shuffled.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import Scratch, small

_MARK = "\x01"
_CACHED = 3 << 18
_LONG = 256


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of texts by a tokenizer whose pre-tokens never cross white space, so each distinct word is done once.

    ``_MARK`` between words is a pre-token of its own; the ids between two marks are a word's. Words that hold
    the mark themselves are encoded singly. The table of known words is bounded and only saves time: words are found
    by hash, and then compared byte by byte with the word that the ids are of.
    """

    _open: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # known words in order of hash: where their ids and letters begin, how many there are, whether a word came again
        self.keys, self.again = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.begin, self.count, self.place, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.letters = np.zeros(0, np.uint16), np.zeros(8, np.uint8)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            self.ids = self.ids.astype(np.uint32)

    @classmethod
    def open(cls, path: str) -> "WordTokenizer":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order in which the words were done, the number of ids of each in that order, and all ids."""
        easy = [i for i, w in enumerate(words) if _MARK not in w] if self.mark is not None else []
        hard = [i for i, w in enumerate(words) if _MARK in w] if self.mark is not None else range(len(words))
        sizes, ids = [], []
        for at in range(0, len(easy), 10_000):  # a text of a thousand words each, ten at a time
            part = easy[at : at + 10_000]
            joined = [f" {_MARK} ".join(words[i] for i in part[j : j + 1000]) for j in range(0, len(part), 1000)]
            for found in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
                line = np.array(found.ids, self.ids.dtype)
                cuts = line == self.mark
                at_cuts = np.flatnonzero(cuts)
                sizes.append(np.diff(at_cuts, prepend=-1, append=len(line)) - 1)
                ids.append(line[~cuts])
        for i in hard:
            line = np.array(self.tokenizer.encode(words[i], add_special_tokens=False).ids, self.ids.dtype)
            sizes.append(np.array([len(line)]))
            ids.append(line)
        order = np.array([*easy, *hard], np.int64)
        return order, np.concatenate([*sizes, np.zeros(0, np.int64)]), np.concatenate([*ids, self.ids[:0]])

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """New words, spans of ``data``, in order of hash."""
        raw = memoryview(data)
        order, counts, ids = self.encode([str(raw[a : a + n], "utf-8", "replace") for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)])
        begin, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        begin[order], count[order] = len(self.ids) + np.cumsum(counts) - counts, counts
        place = len(self.letters) - 8 + np.cumsum(sizes) - sizes
        at = np.searchsorted(self.keys, keys)
        new = {"keys": keys, "begin": begin, "count": count, "place": place, "size": sizes, "again": np.zeros(len(keys), bool)}
        for name, values in new.items():
            setattr(self, name, np.insert(getattr(self, name), at, values))
        self.ids = np.concatenate([self.ids, ids])
        self.letters = np.concatenate([self.letters[:-8], data[ragged(starts, sizes)], np.zeros(8, np.uint8)])

    def _forget(self) -> None:
        """Words that came again stay."""
        kept = np.flatnonzero(self.again)
        self.keys, self.begin, self.count, self.place, self.size = (x[kept] for x in (self.keys, self.begin, self.count, self.place, self.size))
        self.ids, self.letters = self.ids[ragged(self.begin, self.count)], np.append(self.letters[ragged(self.place, self.size)], np.zeros(8, np.uint8))
        self.begin, self.place = np.cumsum(self.count) - self.count, np.cumsum(self.size) - self.size
        self.again = np.zeros(len(kept), bool)

    def tokens(self, text: K.Text, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts in a row, each with ``end`` after it, and where each text begins."""
        text.split_words()
        data, sizes = np.append(text.data, np.zeros(8, np.uint8)), text.ends - text.starts
        hashes = text.word_hash()
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        # words that aren't what their hash stands for, and very long ones, are encoded singly
        alone = ~K.same_spans(data, text.starts, sizes, data, text.starts[where][inverse], sizes[where][inverse]) | (sizes > _LONG)
        if len(self.keys) > _CACHED:
            self._forget()
        spot = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        hit = self.keys[spot] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.again[spot[hit]] = True
        old = where[hit]
        right = np.ones(len(keys), bool)
        right[hit] = K.same_spans(data, text.starts[old], sizes[old], self.letters, self.place[spot[hit]], self.size[spot[hit]])
        alone |= ~right[inverse]
        new = ~hit & (sizes[where] <= _LONG)
        if new.any():
            self._learn(keys[new], data, text.starts[where[new]], sizes[where[new]])
        begin, n_ids, ids = np.zeros(len(inverse), np.int64), np.zeros(len(inverse), np.int64), self.ids
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            begin, n_ids = self.begin[spot][inverse], self.count[spot][inverse]
        if alone.any():
            odd = np.flatnonzero(alone)
            raw = memoryview(data)
            order, counts, more = self.encode([str(raw[a:b], "utf-8", "replace") for a, b in zip(text.starts[odd].tolist(), text.ends[odd].tolist(), strict=True)])
            begin[odd[order]], n_ids[odd[order]] = len(ids) + np.cumsum(counts) - counts, counts
            ids = np.concatenate([ids, more])
        stop = text.first[1:]
        ids = np.concatenate([ids, np.array([end], self.ids.dtype)])
        begin, n_ids = np.insert(begin, stop, len(ids) - 1), np.insert(n_ids, stop, 1)
        bounds = np.concatenate([[0], np.cumsum(n_ids)])
        return ids[ragged(begin, n_ids)], bounds[text.first + np.arange(text.n + 1)]


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions begin..begin+size of each run, one run after the other."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()), dtype=np.int64)


def tokenised(docs: DataFrame, path: str, end: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, part, at, n, wide, ids): ids as little-endian words of two bytes, or four where ``wide``."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, at = WordTokenizer.open(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for a, b, text in K.Text.of(batch.column(1)):
                ids, bounds = tokenizer.tokens(text, end)
                width = ids.dtype.itemsize
                offsets = pa.py_buffer((bounds * width).astype(np.int64).tobytes())
                flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, offsets, pa.py_buffer(ids.astype(ids.dtype.newbyteorder("<")).tobytes())])
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(np.full(n, part, np.int32)), pa.array(at + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(np.full(n, width == 4)), flat.cast(pa.binary())],
                    ["doc_id", "part", "at", "n", "wide", "ids"],
                )
                at += int(bounds[-1])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("text")).mapInArrow(step, "doc_id long, part int, at long, n long, wide boolean, ids binary")


def pack(spark: SparkSession, docs: DataFrame, length: int = 4096, path: str | None = None, end: int = 2, id_col: str = "doc_id") -> DataFrame:
    """One row a piece: doc_id, start, length, ids (binary, unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    Every sequence but the last is full. A null or empty text is its end token alone. Rows are packed as they
    come: null or repeated ids are documents like any other, extra columns are ignored, an empty table gives no
    pieces. A text longer than a sequence spans as many as it needs.
    """
    scratch = Scratch(spark, "packing")
    rows = scratch.write(tokenised(docs, path or vocabulary(), end, id_col), "tokens")
    before, offsets = 0, []
    for part, total in sorted(map(tuple, rows.groupBy("part").agg(F.sum("n")).collect())):
        offsets.append((part, before))
        before += total

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in K.chunks(np.concatenate([[0], np.cumsum(batch.column("n").to_numpy())]), 1 << 20):
                yield _pieces(batch.slice(a, b - a), length)

    placed = rows.join(small(spark, offsets, "part int, before long"), "part").select("doc_id", (F.col("before") + F.col("at")).alias("at"), "n", "wide", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _pieces(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
    first, last = at // length, (at + n - 1) // length
    row = K.per_row(last - first + 1)
    sequence = ragged(first, last - first + 1)
    low = np.maximum(sequence * length, at[row])
    size = np.minimum((sequence + 1) * length, (at + n)[row]) - low
    wide = batch.column("wide").to_pylist()
    flat = np.concatenate([np.frombuffer(x, "<u4" if w else "<u2").astype("<u4") for x, w in zip(batch.column("ids").to_pylist(), wide, strict=True)])
    bounds = np.concatenate([[0], np.cumsum(size)]) * 4  # pieces lie in the order of the ids
    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(pa.array(row)), pa.array(low - at[row]), pa.array(size), ids, pa.array(n[row]), pa.array(sequence), pa.array(low - sequence * length)],
        ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def sequences(pieces: DataFrame, length: int = 4096, pad: int = 0) -> DataFrame:
    """Whole sequences: sequence_id, ids (array of longs, padded to ``length``), n_tokens, doc_ids with their spans.

    A sequence holds ``length`` pieces at most, so the grouping is bounded.
    """
    piece = F.struct("offset", "length", "doc_id", "start", "ids")
    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.sum("length").alias("n_tokens"))
    text = F.aggregate("p", F.lit(""), lambda acc, x: F.concat(acc, F.hex(x["ids"])))
    byte = lambda i, k: F.conv(F.substring("h", i * 8 + 1 + 2 * k, 2), 16, 10).cast("long")
    ids = F.transform(F.sequence(F.lit(0), (F.col("n_tokens") - 1).cast("int")), lambda i: byte(i, 0) + byte(i, 1) * 256 + byte(i, 2) * 65536 + byte(i, 3) * 16777216)
    spans = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["offset"].alias("offset"), x["length"].alias("length")))
    return grouped.withColumn("h", text).select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), (F.lit(length) - F.col("n_tokens")).cast("int"))).alias("ids"), "n_tokens", spans.alias("pieces"))
