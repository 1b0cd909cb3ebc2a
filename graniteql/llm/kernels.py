"""Vectorised text kernels over Arrow string columns.

All of them work on the UTF-8 bytes of a batch at once with numpy, so the cost is a few nanoseconds a byte and
no Python object is made per word.  White space is ``[\\x20\\x09-\\x0D]`` throughout, which is ASCII, so byte
positions are safe cut points.  Bytes are gone through in blocks, so a very long text or word costs little more
memory than itself.

Hashes are 64-bit, seeded by constants only, and equal on every machine. Eight bytes (or one item) at a time are
keyed by their place and put through a bijective mixer before they are added up, so no algebra of the text (such as
that of self-similar texts) makes sums meet; two seeds give two independent hashes, and what stands for a text or a
line across documents is a pair of them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 2 << 20
_BLOCK = 1 << 20
_GOLD = U64(0x9E3779B97F4A7C15)
_TURN = U64(0xD6E8FEB86659FD93)
_SEEDS = (np.array([0x243F6A8885A308D3], U64), np.array([0x13198A2E03707344], U64))
_SHORT = 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; returns a new array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit words that depend on the seed only."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * _GOLD)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _is_space(data: np.ndarray) -> np.ndarray:
    return ((data - np.uint8(9)) < 5) | (data == 32)


def _lower(data: np.ndarray) -> np.ndarray:
    return data + ((data - np.uint8(65)) < 26) * np.uint8(32)


def release() -> None:
    """Gives freed memory back to the system: workers live on from task to task, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    if _LIBC:
        _LIBC[0].malloc_trim(0)


def _libc() -> list:
    try:
        found = ctypes.CDLL("libc.so.6")
        return [found] if hasattr(found, "malloc_trim") else []
    except OSError:  # another C library; nothing to trim
        return []


_LIBC = _libc()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, of one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to


class Text:
    """Some whole texts: ``data`` holds their bytes, ``offsets`` where each begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self.n = len(offsets) - 1

    @classmethod
    def of(cls, column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Text]]:
        """The column cut into runs of rows that fit comfortably in memory; long texts are whole."""
        data, offsets = utf8(column)
        for a, b in chunks(offsets, most):
            yield a, b, cls(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        release()

    def split_words(self) -> None:
        """Sets starts, ends (bytes) of the words, and first: the words before each text."""
        self.starts, self.ends = runs(len(self.data), lambda a, b: _is_space(self.data[a:b]), self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets).astype(np.int64)

    def full_lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lines that aren't empty."""
        return runs(len(self.data), lambda a, b: self.data[a:b] == 10, self.offsets)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word_hash(self, lower: bool = False, which: int = 0) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends, which, lower)

    def before(self, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many bytes of the table stand before each of the rising positions."""
        out, total, done = np.empty(len(at), np.int64), 0, 0
        for a in range(0, max(len(self.data), 1), _BLOCK):
            sums = np.concatenate([[0], np.cumsum(table[self.data[a : a + _BLOCK]], dtype=np.int32)])
            to = int(np.searchsorted(at, a + len(sums) - 1, side="right"))
            out[done:to] = total + sums[at[done:to] - a]
            total, done = total + int(sums[-1]), to
        return out

    def per_text(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of the table are in each text."""
        return np.diff(self.before(table, self.offsets))

    def code_points(self) -> np.ndarray:
        return self.per_text(_LEAD)


def runs(n: int, gap: Callable[[int, int], np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs outside the gaps that don't cross ``bounds``; gap(a, b): flags of a..b."""
    found, outside = [], True
    cuts = bounds[(bounds > 0) & (bounds < n)]
    for a in range(0, n, _BLOCK):
        out = gap(a, min(n, a + _BLOCK))
        turn = np.empty_like(out)
        turn[0] = out[0] != outside
        np.not_equal(out[1:], out[:-1], out=turn[1:])
        at = np.flatnonzero(turn)
        cut = np.unique(cuts[np.searchsorted(cuts, a) : np.searchsorted(cuts, a + len(out))]) - a
        cut = cut[~turn[cut] & ~out[cut]]  # within a run: it ends, and another begins
        if len(cut):
            at = np.insert(at, np.repeat(np.searchsorted(at, cut), 2), np.repeat(cut, 2))
        found.append(at + a)
        outside = out[-1]
    if not outside:
        found.append(np.array([n]))
    turns = np.concatenate([np.zeros(0, np.int64), *found])
    return turns[::2], turns[1::2]


_REST = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans in rising order; lower: as if A-Z were a-z."""
    sums, at, n = np.empty(len(starts), U64), 0, len(starts)
    while at < n:
        to = int(np.searchsorted(ends, starts[at] + _BLOCK, side="right"))
        if to <= at:
            sums[at] = _long_sum(data[starts[at] : ends[at]], which, lower)
            at += 1
            continue
        low, high = int(starts[at]), int(ends[to - 1])
        part = np.zeros(high - low + 8, np.uint8)
        part[:-8] = _lower(data[low:high]) if lower else data[low:high]
        begin, size = starts[at:to] - low, ends[at:to] - starts[at:to]
        short = size <= _SHORT
        if short.all():
            sums[at:to] = _short_sums(part, begin, size, which)
        else:
            sums[at + np.flatnonzero(short)] = _short_sums(part, begin[short], size[short], which)
            sums[at + np.flatnonzero(~short)] = _sums(part, begin[~short], size[~short], which)
        at = to
    return mix(sums + (ends - starts).astype(U64) * _GOLD)


def _short_sums(data: np.ndarray, at: np.ndarray, left: np.ndarray, which: int) -> np.ndarray:
    """Eights of all spans side by side: the first of each, then the next of those that have more, and so on."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out, who, key = None, None, _SEEDS[which].copy()
    while True:
        x = eights[at]
        x &= _REST[np.minimum(left, 8)]
        x ^= key
        key += _GOLD
        if out is None:
            out = mix(x)
        else:
            out[who] += mix(x)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        at, left, who = at[more] + 8, left[more] - 8, more if who is None else who[more]


def _sums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: int) -> np.ndarray:
    """The same sums, with the eights of all spans in one array."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = (sizes + 7) >> 3
    first = np.cumsum(n) - n
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    x = eights[np.repeat(starts, n) + (place << 3)]
    x[first + n - 1] &= _REST[sizes - ((n - 1) << 3)]
    key = place.view(U64)
    key *= _GOLD
    key += _SEEDS[which]
    x ^= key
    return np.add.reduceat(mix(x), first)


def _long_sum(span: np.ndarray, which: int, lower: bool) -> np.uint64:
    """The same sum of one span, block by block."""
    total = np.zeros(1, U64)
    for a in range(0, len(span), _BLOCK):
        piece = span[a : a + _BLOCK]
        x = np.zeros((len(piece) + 7) >> 3, U64)
        x.view(np.uint8)[: len(piece)] = _lower(piece) if lower else piece
        key = np.arange(a >> 3, (a >> 3) + len(x), dtype=U64)
        key *= _GOLD
        key += _SEEDS[which]
        total += mix(x ^ key).sum()
    return total[0]


def same_spans(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether data[starts:starts + sizes] equals other[at:at + lengths], byte by byte, for each span. Both arrays end
    with seven bytes or more that are in no span."""
    out = sizes == lengths
    for i in np.flatnonzero(out & (sizes > 512)).tolist():
        out[i] = np.array_equal(data[starts[i] : starts[i] + sizes[i]], other[at[i] : at[i] + sizes[i]])
    who = np.flatnonzero(out & (sizes > 0) & (sizes <= 512))
    one, two = (np.ndarray((max(len(x) - 7, 0),), "<u8", x, strides=(1,)) for x in (data, other))
    a, b, left = starts[who], at[who], sizes[who]
    while len(who):
        rest = _REST[np.minimum(left, 8)]
        out[who] &= (one[a] & rest) == (two[b] & rest)
        more = left > 8
        who, a, b, left = who[more], a[more] + 8, b[more] + 8, left[more] - 8
    return out


def _long_sum(span: np.ndarray, which: int, lower: bool) -> np.uint64:
    total = np.zeros(1, U64)
    for a in range(0, len(span), _BLOCK):
        piece = span[a : a + _BLOCK]
        x = np.zeros((len(piece) + 7) >> 3, U64)
        x.view(np.uint8)[: len(piece)] = _lower(piece) if lower else piece
        key = np.arange(a >> 3, (a >> 3) + len(x), dtype=U64)
        key *= _GOLD
        key += _SEEDS[which]
        total += mix(x ^ key).sum()
    return total[0]


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    x = left * _TURN
    x += right
    return mix(x)


def windows(items: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k items that lie in one text, and the item each run starts at.

    first: the items before each text, and their number. A run's hash is put together from those of its parts of
    1, 2, 4, ... items, each joined by the mixer.
    """
    counts = np.maximum(np.diff(first) - k + 1, 0)
    total = int(counts.sum())
    before = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) if len(counts) else np.zeros(0, np.int64)
    at = np.arange(total, dtype=np.int64) + before
    if not total:
        return np.zeros(0, U64), at
    whole, size, part, width = None, 0, items, 1
    while True:
        if k & width:
            whole = part if whole is None else joined(part[: len(whole) - width], whole[width:])
            size += width
        if size == k:
            return whole[at], at
        part = joined(part[:-width], part[width:])
        width *= 2


def text_hash(items: np.ndarray, first: np.ndarray, which: int = 0) -> np.ndarray:
    """A hash of all the items of each text, in order."""
    counts = np.diff(first)
    place = np.arange(int(first[-1]) - int(first[0]), dtype=U64) - np.repeat((first[:-1] - first[0]).astype(U64), counts)
    place *= _GOLD
    place += _SEEDS[which]
    place ^= items[first[0] : first[-1]]
    out, full = np.zeros(len(counts), U64), np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(mix(place), (first[:-1] - first[0])[full])
    return mix(out + counts.astype(U64) * _GOLD)


def per_row(counts: np.ndarray) -> np.ndarray:
    """Row numbers, each as often as its count says."""
    return np.repeat(np.arange(len(counts), dtype=np.int64), counts)


def covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n items lie in one of the runs of k that start at ``at``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + k, -1)
    return np.cumsum(steps[:-1]) > 0


def again(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of pairs (group, value) that occur twice or more, and of those that occurred before; groups rise."""
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    same = (g[1:] == g[:-1]) & (v[1:] == v[:-1])
    twice, later = np.zeros(len(g), bool), np.zeros(len(g), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same  # lexsort is stable, so the first of equals stays the first
    return twice, later


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)
