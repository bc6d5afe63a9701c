"""Cuts a slice of texts into the pieces that a BPE model encodes one by one.

Texts become one array of code points; the pieces of the two public splitting patterns
(one keeps white space and lets a space lead a word, the other drops white space) are
found from runs of equal character class by a few numpy passes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import regex

from .kernels import buffer_of, eights, equal_spans, span_hashes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_APOSTROPHE = 0x27


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, dtype=np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every, at = "".join(map(chr, points)), np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[at[m.start() : m.end()]] = kind
    return table


@cache
def plain_lower() -> np.ndarray:
    """Lower case of each code point that NFC leaves alone in any context and that has one-character lower case; 0 for all others."""
    table = np.zeros(0x110000, dtype=np.uint32)
    table[:0x80] = np.arange(0x80)
    table[0x41:0x5B] += 32
    for i in [*range(0xA0, 0x300), *range(0x370, 0x1100), *range(0x1200, 0xA960), *range(0xAC00, 0xD7A4), *range(0xE000, 0x10000)]:
        ch = chr(i)
        low = ch.lower()
        if len(low) == 1 and unicodedata.category(ch)[0] != "M" and unicodedata.normalize("NFC", ch) == ch and unicodedata.normalize("NFC", low) == low:
            table[i] = ord(low)
    table[0x80:0xA0] = np.arange(0x80, 0xA0)
    return table


class Points:
    """Code points of a slice of texts, and where each text begins."""

    def __init__(self, column: pa.Array):
        self.data, offsets = buffer_of(column)
        self.points = np.frombuffer(self.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        self.at = byte_places(self.data, len(self.points))
        self.offsets = offsets if self.at is None else np.searchsorted(self.at, offsets)

    def runs(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each run of one class inside one text, its class, end)."""
        kind = classes()[points]
        n = len(kind)
        edge = np.ones(n, dtype=bool)
        edge[1:] = kind[1:] != kind[:-1]
        starts = self.offsets[:-1]
        edge[starts[starts < n]] = True
        at = np.flatnonzero(edge)
        return at, kind[at], np.append(at[1:], n)


def byte_places(data: np.ndarray, n: int) -> np.ndarray | None:
    """First byte of each of the ``n`` characters of UTF-8 bytes, and the end; none where all have one byte."""
    return None if n == len(data) else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(UTF-8 bytes of code points, their places as of :func:`byte_places`)."""
    if not len(points) or points.max() < 0x80:
        return points.astype(np.uint8), None
    data = np.frombuffer(points.tobytes().decode("utf-32-le").encode("utf-8"), dtype=np.uint8)
    return data, byte_places(data, len(points))


def _contractions(points: np.ndarray, at: np.ndarray, kind: np.ndarray, end: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs that are an apostrophe which takes letters from the next run, how many letters)."""
    n = len(points)
    maybe = np.flatnonzero((kind[:-1] == OTHER) & (end[:-1] - at[:-1] == 1) & (points[at[:-1]] == _APOSTROPHE) & (kind[1:] == LETTER) & joined)
    one, two = points[at[maybe] + 1], points[np.minimum(at[maybe] + 2, n - 1)]
    long = end[maybe + 1] - at[maybe + 1] >= 2
    takes = np.isin(one, [ord(c) for c in "stmd"]).astype(np.int64)
    for a, b in ("re", "ve", "ll"):
        takes[(one == ord(a)) & (two == ord(b)) & long] = 2
    return maybe[takes > 0], takes[takes > 0]


def spaced_pieces(p: Points) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` as (starts, ends)."""
    points = p.points
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at, kind, end = p.runs(points)
    mark = np.zeros(n + 1, dtype=bool)
    mark[at] = True
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[p.offsets] = True
    follows = np.append(~text_start[at[1:]], False)  # the next run is in the same text
    before = np.flatnonzero((kind == SPACE) & follows)
    last = end[before] - 1
    blank = points[last] == 0x20
    mark[last] = True
    mark[end[before[blank]]] = False
    lead = np.zeros(n + 1, dtype=bool)
    lead[end[before[blank]]] = True
    takers, letters = _contractions(points, at, kind, end, follows[:-1] & ~lead[at[:-1]])
    mark[at[takers] + 1] = False
    mark[at[takers] + 1 + letters] = True
    # A mark set at a text's end is the next text's start, or the end of all.
    starts = np.flatnonzero(mark[:n])
    return starts, np.append(starts[1:], n)


def solid_pieces(p: Points, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+`` in the (lower-cased) points."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at, kind, end = p.runs(points)
    mark = np.zeros(n + 1, dtype=bool)
    mark[at] = True
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[p.offsets] = True
    takers, letters = _contractions(points, at, kind, end, ~text_start[at[1:]])
    mark[at[takers] + 1] = False
    mark[at[takers] + 1 + letters] = True
    each = classes()[points]
    mark[:n] |= each == NUMBER
    starts = np.flatnonzero(mark[:n])
    ends = np.append(starts[1:], n)
    solid = each[starts] != SPACE
    return starts[solid], ends[solid]


class Cache:
    """Encoded pieces by hash, kept by a Python worker between slices and tasks; bounded, and emptied when full.

    A piece's bytes are kept with its ids and compared whenever its hash is found, so
    pieces that share a hash are told apart.
    """

    SLOTS_BITS, MAX_IDS, MAX_BYTES = 20, 2_000_000, 8_000_000

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(1 << self.SLOTS_BITS, dtype=np.uint64)
        self.slot = np.full(1 << self.SLOTS_BITS, -1, dtype=np.int32)
        self.ids, self.offsets = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 14, dtype=np.int64)
        # Eight bytes more than are used, so that eight can be read from any.
        self.bytes, self.bounds = np.zeros(1 << 16, dtype=np.uint8), np.zeros(1 << 14, dtype=np.int64)
        self.n = 0

    def encoded(self, data: np.ndarray, at: np.ndarray | None, starts: np.ndarray, ends: np.ndarray, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in turn, number of each); ``encode`` gives them for the bytes of new pieces.

        Pieces are spans of characters of the UTF-8 ``data``; ``at`` as of :func:`byte_places`.
        """
        if self.offsets[self.n] > self.MAX_IDS or self.bounds[self.n] > self.MAX_BYTES:
            self.reset()
        a, b = (starts, ends) if at is None else (at[starts], at[ends])
        view = eights(data)
        h = self.hashes(data, a, b)
        place = (h >> np.uint64(64 - self.SLOTS_BITS)).astype(np.int64)
        entry = np.where(self.key[place] == h, self.slot[place], -1).astype(np.int64)
        hit = np.flatnonzero(entry >= 0)
        held = np.ndarray((len(self.bytes) - 7,), dtype="<u8", buffer=self.bytes, strides=(1,))
        own = entry[hit]
        entry[hit[~equal_spans(view, a[hit], b[hit], held, self.bounds[own], self.bounds[own + 1])]] = -1
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            _, first, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            model = missing[first][inverse]
            other = ~equal_spans(view, a[missing], b[missing], view, a[model], b[model])
            new = np.concatenate([missing[first], missing[other]])
            raw = data.tobytes()
            pieces = [raw[i:j] for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True)]
            added = self._add(h[new], pieces, *encode(pieces))
            entry[missing] = added[inverse]
            entry[missing[other]] = added[len(first) :]
        begin = self.offsets[entry]
        size = self.offsets[entry + 1] - begin
        return self.ids[ranges(begin, size)], size

    hashes = staticmethod(span_hashes)

    def _add(self, h: np.ndarray, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Entries of the new pieces."""
        self.ids, self.offsets = _filled(self.ids, self.offsets, self.n, ids, lengths, 0)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        self.bytes, self.bounds = _filled(self.bytes, self.bounds, self.n, np.frombuffer(b"".join(pieces), dtype=np.uint8), size, 8)
        entry = np.arange(self.n, self.n + len(h))
        self.n += len(h)
        place = (h >> np.uint64(64 - self.SLOTS_BITS)).astype(np.int64)
        self.key[place], self.slot[place] = h, entry
        return entry


def _filled(values: np.ndarray, bounds: np.ndarray, n: int, more: np.ndarray, lengths: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of ``n`` entries with more entries behind them; both grow by doubling."""
    at = int(bounds[n])
    while len(values) < at + len(more) + spare:
        values = np.concatenate([values, np.zeros_like(values)])
    while len(bounds) < n + len(lengths) + 1:
        bounds = np.concatenate([bounds, np.zeros_like(bounds)])
    values[at : at + len(more)] = more
    bounds[n + 1 : n + 1 + len(lengths)] = at + np.cumsum(lengths)
    return values, bounds


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of each range in turn."""
    total = np.cumsum(lengths)
    n = int(total[-1]) if len(total) else 0
    return np.arange(n) + np.repeat(starts - (total - lengths), lengths)
