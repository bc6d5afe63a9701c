"""Vectorised text kernels shared by the operators of this subpackage.

An Arrow string column is one UTF-8 buffer plus offsets.  Words, word hashes and
hashes of word windows come from a few numpy passes over that buffer, so no
per-word Python objects are made.  All functions treat null as the empty text.

Hashes are 64-bit.  A span of bytes is read eight at a time; every eight bytes are mixed
with their place before they are summed, so no sum of powers is there to cancel out.
They stand for words and windows where only equality matters; where a wrong match would
change a text (encoded pieces, benchmark hits), the bytes are compared as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes that one numpy pass handles; bounds the memory of a Python worker.
CHUNK_BYTES = 1 << 20

_MIX, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_PLACE, _JOIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Spans, and eight-byte parts of long spans, that are hashed at once.
SPANS = 1 << 17
#: Eight-byte parts that are taken span by span in step; what is left of longer spans is taken apart.
STEPS = 4
_KEPT = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int], negate: bool = False) -> np.ndarray:
    """Table of 256 booleans that is true inside the (inclusive) ranges."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return ~table if negate else table


#: Words as ``[^\x20\x09-\x0D]+``.
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), negate=True)
#: Words as ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on (zeros follow the end), without a copy of each."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def _parts(view: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from ``at`` on, those after the span's ``left`` bytes as zeros."""
    return view[at] & _KEPT[np.minimum(left, 8)]


def _placed(part: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    h = part ^ (np.atleast_1d(place).astype(np.uint64) + np.uint64(1)) * _PLACE
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX2
    h ^= h >> np.uint64(32)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes."""
    view = eights(data)
    out = np.empty(len(starts), dtype=np.uint64)
    for k in range(0, len(starts), SPANS):
        out[k : k + SPANS] = _span_hashes(view, starts[k : k + SPANS], ends[k : k + SPANS])
    return out


def _span_hashes(view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    total = _placed(_parts(view, starts, size), 0)
    for i in range(1, STEPS):
        some = np.flatnonzero(size > 8 * i)
        if not len(some):
            break
        total[some] += _placed(_parts(view, starts[some] + 8 * i, size[some] - 8 * i), i)
    rest = np.flatnonzero(size > 8 * STEPS)
    parts = (size[rest] + 7) // 8 - STEPS
    stop = np.cumsum(parts)
    k = 0
    while k < len(rest):
        to = max(k + 1, int(np.searchsorted(stop, (stop[k - 1] if k else 0) + SPANS, side="right")))
        if to == k + 1:
            total[rest[k : k + 1]] += _long(view, int(starts[rest[k]]), int(ends[rest[k]]))
        else:
            own, n = rest[k:to], parts[k:to]
            first = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(first, n) + STEPS
            at = np.repeat(starts[own], n) + 8 * place
            total[own] += np.add.reduceat(_placed(_parts(view, at, np.repeat(ends[own], n) - at), place), first)
        k = to
    return mix(total + size.astype(np.uint64) * _JOIN)


def _long(view: np.ndarray, start: int, end: int) -> np.ndarray:
    """What the parts of one long span add, some parts at a time."""
    total = np.zeros(1, dtype=np.uint64)
    last = (end - start + 7) // 8
    for k in range(STEPS, last, SPANS):
        place = np.arange(k, min(last, k + SPANS))
        total += np.add.reduce(_placed(_parts(view, start + 8 * place, end - start - 8 * place), place))
    return total


def equal_spans(a: np.ndarray, a0: np.ndarray, a1: np.ndarray, b: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Whether each span of bytes of ``a`` equals that of ``b``; both as views of :func:`eights`."""
    size = a1 - a0
    same = size == b1 - b0
    left = np.flatnonzero(same & (size > 0))
    for i in range(0, 2 * STEPS):
        good = _parts(a, a0[left] + 8 * i, size[left] - 8 * i) == _parts(b, b0[left] + 8 * i, size[left] - 8 * i)
        same[left[~good]] = False
        left = left[good & (size[left] > 8 * i + 8)]
        if not len(left):
            return same
    done = 16 * STEPS
    x, y = (v.base if v.base is not None else v for v in (a, b))
    for k in left.tolist():
        n = int(size[k])
        same[k] = np.array_equal(x[a0[k] + done : a0[k] + n], y[b0[k] + done : b0[k] + n])
    return same


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    base = int(offsets[0])
    return np.frombuffer(data, dtype=np.uint8)[base : int(offsets[-1])], offsets - base


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose text column holds about ``limit`` bytes; one longer text is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = buffer_of(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a slice of texts: byte spans, and the first word of each text."""

    def __init__(self, column: pa.Array, inside: np.ndarray, lower: bool):
        data, self.offsets = buffer_of(column)
        self.raw = data
        self.data = LOWER[data] if lower else data
        n = len(data)
        m = inside[self.data]
        begins, stops = m.copy(), m.copy()
        if n:
            begins[1:] &= ~m[:-1]
            stops[:-1] &= ~m[1:]
            full = np.flatnonzero(np.diff(self.offsets))
            first, last = self.offsets[full], self.offsets[full + 1] - 1
            begins[first] |= m[first]
            stops[last] |= m[last]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self._hash: np.ndarray | None = None

    @property
    def doc(self) -> np.ndarray:
        """The text (its row in the slice) of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.data, self.starts, self.ends)
        return self._hash

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every window of ``length`` words inside one text."""
        h = self.hashes
        n = len(h)
        if n < length:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        # Hashes of one, two, four, ... words from each word on; those that add up to the length are joined.
        made, done, some, width, left = None, 0, h, 1, length
        while left:
            if left & 1:
                made = some if made is None else joined(made[: n - done - width + 1], some[done:])
                done += width
            left >>= 1
            if left:
                some = joined(some[:-width], some[width:])
                width *= 2
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        at = np.flatnonzero(left >= length)
        return at, mix(made[at] + np.uint64(length))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two hashes in order."""
    return mix(mix(a * _JOIN) + b)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values per text, where ``first`` bounds each text's values."""
    out = np.zeros(len(first) - 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values[: first[-1]], first[full], dtype=out.dtype)
    return out
