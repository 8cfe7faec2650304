"""Columnar text blocks: what the corpus operators share for work on whole texts.

An Arrow string column is cut into blocks of at most ``BLOCK_BYTES`` (a longer
single text is a block of its own), and every step on a block is a numpy pass
over its bytes, so memory is bounded by the block or the longest text. Null
texts are empty texts here; callers that tell them apart look at ``nulls``.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1_000_000
#: Spans longer than this are hashed one by one.
LONG_SPAN = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Byte classes of the two word rules of the contracts.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM_OR_HIGH = np.zeros(256, dtype=bool)
ALNUM_OR_HIGH[0x30:0x3A] = True
ALNUM_OR_HIGH[0x61:0x7B] = True
ALNUM_OR_HIGH[0x80:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Keeps the first so many bytes of eight.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number, the first one lowest; zeros beyond the end."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for k in (1, 2, 4):
        x[:-k] |= x[k:] << np.uint64(8 * k)
    return x


def same_bytes(a: np.ndarray, starts_a: np.ndarray, b: np.ndarray, starts_b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether spans of equal sizes hold the same bytes; a and b are eights() of their data."""
    same = np.ones(len(sizes), bool)
    live, k = np.flatnonzero(sizes > 0), 0
    while len(live):
        keep = _FIRST_BYTES[np.minimum(sizes[live] - k, 8)]
        differ = ((a[starts_a[live] + k] ^ b[starts_b[live] + k]) & keep) != 0
        same[live[differ]] = False
        k += 8
        live = live[~differ]
        live = live[sizes[live] > k]
    return same


class Block:
    """``data``: the UTF-8 bytes of some rows, one after another; ``offsets``: where each row begins, and the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, nulls: np.ndarray):
        self.data, self.offsets, self.first, self.nulls = data, offsets, first, nulls

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())]

    def lowered(self) -> "Block":
        return Block(LOWER[self.data], self.offsets, self.first, self.nulls)

    def spans(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of word bytes; a run ends with its row."""
        m = is_word[self.data]
        if not len(m):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, e = m.copy(), m.copy()
        s[1:] &= ~m[:-1]
        e[:-1] &= ~m[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(m))]
        s[cuts] |= m[cuts]
        e[cuts - 1] |= m[cuts - 1]
        return np.flatnonzero(s), np.flatnonzero(e) + 1

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        """The row that holds each byte position (positions rise)."""
        return np.searchsorted(self.offsets[1:], positions, side="right")

    def first_of_row(self, starts: np.ndarray) -> np.ndarray:
        """For each row and the end: the index of its first span."""
        return np.searchsorted(starts, self.offsets, side="left")

    @functools.cached_property
    def eights(self) -> np.ndarray:
        return eights(self.data)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans: equal bytes, equal hashes, wherever they stand.

        Eight bytes at a time are taken in and mixed by a bijection, so no
        structure of a text makes two spans of it collide; as with any 64-bit
        hash, two of n distinct spans do so with probability n * n / 2 ** 65.
        """
        starts, size = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
        with np.errstate(over="ignore"):
            h = mix64(size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(1))
            live, k = np.arange(len(size)), 0
            if len(size) and int(size.max()) > LONG_SPAN:
                for i in np.flatnonzero(size > LONG_SPAN).tolist():
                    h[i] = xxhash.xxh3_64_intdigest(self.data[starts[i] : starts[i] + size[i]].tobytes())
                live = np.flatnonzero(size <= LONG_SPAN)
            while len(live := live[size[live] > k]):
                x = self.eights[starts[live] + k] & _FIRST_BYTES[np.minimum(size[live] - k, 8)]
                h[live] = mix64(h[live] * np.uint64(0x9E3779B97F4A7C15) ^ x)
                k += 8
        return h


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``limit`` bytes or end."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, (None,)):
        if batch is not None:
            held.append(batch)
        if held and (batch is None or sum(b.nbytes for b in held) >= limit):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of whole rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    if nulls.any():
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield Block(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at, nulls[at:to])
        at = to


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]], empty ones 0."""
    total = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class SpanCache:
    """Remembers what a function gives for distinct byte spans, which are told apart by their bytes.

    The function maps a list of byte strings to (how many values each has, all
    values). When the cache would grow beyond ``limit`` spans it starts afresh, which costs time
    only. Spans of more than ``LONG_SPAN`` bytes are not remembered.
    """

    def __init__(self, function, limit: int = 500_000):
        self.function, self.limit = function, limit
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.begin = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.values = np.zeros(0, np.int32)

    def look_up(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each span between two cuts: where its values begin, and how many they are; and the values."""
        spans = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = spans.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.slots) + len(distinct) > self.limit or len(self.values) > 16 * self.limit:
            self._clear()
        get = self.slots.get
        slot = np.fromiter((get(s, -1) for s in distinct), np.int64, len(distinct))
        new = np.flatnonzero(slot < 0).tolist()
        begin, size, values = self.begin, self.size, self.values
        if new:
            sizes, got = self.function([distinct[i] for i in new])
            slot[new] = np.arange(len(begin), len(begin) + len(new))
            begin = np.concatenate((begin, len(values) + np.cumsum(sizes) - sizes))
            size = np.concatenate((size, sizes))
            values = np.concatenate((values, got))
            self.slots.update((distinct[i], k) for i, k in zip(new, slot[new].tolist()) if len(distinct[i]) <= LONG_SPAN)
            self.begin, self.size, self.values = begin, size, values
        index = slot[coded.indices.to_numpy()]
        return begin[index], size[index], values
