"""N-gram Jaccard join: documents whose five-word shingle sets overlap by three quarters.

Texts of one shingle set are one class; all further work is on classes.

1. A first pass counts all shingles, sent packed by hash, and finds the common ones.
   They come last in the global order of shingles, the most common at the very end.
2. A second pass gives each class its size, a parity bitmap, eight minimum hashes, and
   the first quarter of its set in the global order (its prefix): two sets that overlap
   by three quarters share a prefix element.
3. Likely links come from equal minimum hashes and are verified; their components are
   found.
4. Tiles of prefix elements bring together all other pairs: in a tile, in order of size,
   only pairs within the size band of 3/4, of different components, with the element
   early enough in both prefixes, and whose folded bitmaps allow it are taken, so the many
   pairs inside a group of copies and around a common passage never appear, while no link
   is lost.
5. Every candidate is checked in two steps: bits in which the two bitmaps differ bound
   the overlap from above; what is left gets an exact intersection of sorted arrays.

Links of 3 and 5 give the components of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, spread_join
from .kernels import NON_SPACE, Words, buffer_of, chunks, mix
from .mapping import dealt, group_count
from .pretokens import ranges
from .storage import written

SHINGLE = 5
#: Bits of the filter of needed texts; texts that have a shingle if it is common; common shingles that are broadcast.
FILTER_BITS, COMMON_FROM, MOST_COMMON = 25, 4, 1 << 22
#: Shingles that a task holds before it sends them.
HELD = 2_000_000
MIN_HASHES = 8
#: Pairs of a tile that are compared at once; 64-bit words of the signature that goes into the tiles.
PAIRS, SIGNATURE = 1 << 17, 4
#: Prefix elements that one tile task takes, and members that one verifying group takes, about.
TILE, STAR = 1_000_000, 64
#: Pairs of two components that a tile gives at first.
FEW = 4
#: Bytes of text whose shingles one counting group holds, about.
GROUP_BYTES = 16 << 20
_ODD = [np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for i in range(1, MIN_HASHES + 1)]


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text in turn, first of each text and the end)."""
    w = Words(texts, NON_SPACE, lower=True)
    at, h = w.windows(SHINGLE)
    docs, hashes = [np.searchsorted(w.first, at, side="right") - 1], [h]
    for n in range(1, SHINGLE):
        few = np.flatnonzero(w.counts == n)
        if len(few):
            at, h = w.windows(n)
            place = np.searchsorted(at, w.first[few])
            docs.append(few)
            hashes.append(h[place])
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Elements of which two sets that overlap by 3/4 share at least one."""
    return np.where(n > 0, n // 4 + 1, 0)


def _slices(df: DataFrame, array: Callable[[Iterator[pa.RecordBatch]], np.ndarray], combine: np.ufunc, pieces: int = 32) -> np.ndarray:
    """Element by element ``combine`` of one array of fixed size from every task.

    Arrays travel in compressed slices, are combined slice by slice as they stream
    in, and only the combined array reaches the driver.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = array(batches)
        parts = np.array_split(made, pieces)
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([pa.compress(p.tobytes(), "zstd", asbytes=True) for p in parts], pa.binary()), pa.array([p.nbytes for p in parts], pa.int32()), pa.array([p.dtype.str for p in parts])], names=["slice", "data", "size", "kind"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, data, size, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), dtype=kind)
                held[s] = combine(held[s], x) if s in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary()), pa.array([x.nbytes for x in held.values()], pa.int32()), pa.array([x.dtype.str for x in held.values()])], names=["slice", "data", "size", "kind"])

    schema = "slice int, data binary, size int, kind string"
    rows = df.mapInArrow(emit, schema).repartition(pieces, "slice").mapInArrow(join, schema).collect()
    return np.concatenate([np.frombuffer(r.data, dtype=r.kind) for r in sorted(rows, key=lambda r: r.slice)]) if rows else np.zeros(0)


def _code(h: np.ndarray, groups: int) -> np.ndarray:
    """Group and 32 bits that stand for a shingle when it is counted; a clash only misplaces it in the order."""
    return (h >> np.uint64(32)) % np.uint64(groups) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)


def _squeezed(keys: np.ndarray) -> bytes:
    """Ascending 32-bit keys as differences, byte plane by byte plane."""
    steps = np.diff(keys, prepend=keys[:1] * 0)
    return pa.compress(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unsqueezed(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), dtype=np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


class Order:
    """The global order: level of each common shingle (the logarithm of its texts), 0 for all others."""

    def __init__(self, codes: np.ndarray, levels: np.ndarray, groups: int):
        at = np.argsort(codes)
        self.codes, self.levels, self.groups = codes[at], levels[at], groups

    def level(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), dtype=np.uint8)
        if not len(self.codes):
            return out
        if not hasattr(self, "_first"):
            self._first = np.zeros(1 << 24, dtype=bool)
            self._first[(self.codes & np.uint64(0xFFFFFF)).astype(np.int64)] = True
        maybe = np.flatnonzero(self._first[(h & np.uint64(0xFFFFFF)).astype(np.int64)])
        code = _code(h[maybe], self.groups)
        place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        out[maybe] = np.where(self.codes[place] == code, self.levels[place], 0)
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_first"}


def shingle_order(docs: DataFrame, text: str, groups: int, most_common: int = MOST_COMMON) -> Order:
    """Counts every shingle once a text and collects the common ones: those of four texts or more, or of so many that ``most_common`` hold."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()
        for batch in batches:
            for part in chunks(batch, "text"):
                h, first = shingle_sets(part.column(0))
                new = np.ones(part.num_rows, dtype=bool)
                for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    c = _class_of(h[a:b])
                    new[d] = c not in seen
                    if len(seen) < 1_000_000:
                        seen.add(c)
                held.append(_code(h[np.repeat(new, np.diff(first))], groups))
                n += len(held[-1])
                if n > HELD:
                    yield _sent(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield _sent(np.concatenate(held))

    def count(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([_unsqueezed(d, n) for d, n in zip(table.column("keys").to_pylist(), table.column("n").to_pylist(), strict=True)]))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        times = np.diff(np.append(first, len(keys)))
        some = times >= COMMON_FROM
        g = np.uint64(table.column("g")[0].as_py()) << np.uint64(32)
        levels = np.floor(np.log2(times[some])).astype(np.uint8)
        return pa.table({"codes": pa.array([(keys[first[some]].astype(np.uint64) | g).tobytes()], pa.binary()), "levels": pa.array([levels.tobytes()], pa.binary()), "sizes": pa.array([np.bincount(levels, minlength=64).tolist()], pa.list_(pa.int64()))})

    sent = dealt(docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(send, "g int, n int, keys binary"), groups, "g")
    counted = written(sent.groupBy("g").applyInArrow(count, "codes binary, levels binary, sizes array<bigint>"))
    sizes = np.sum([np.zeros(64, dtype=np.int64), *(r.sizes for r in counted.select("sizes").collect())], axis=0)
    above = np.cumsum(sizes[::-1])[::-1]
    least = int(np.argmax(above <= most_common))

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, levels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                levels = np.frombuffer(levels, dtype=np.uint8)
                out.append((np.frombuffer(codes, dtype=np.uint64)[levels >= least].tobytes(), levels[levels >= least].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["codes", "levels"])

    rows = counted.select("codes", "levels").mapInArrow(most, "codes binary, levels binary").collect()
    return Order(np.frombuffer(b"".join(r.codes for r in rows), dtype=np.uint64), np.frombuffer(b"".join(r.levels for r in rows), dtype=np.uint8), groups)


def _sent(codes: np.ndarray) -> pa.RecordBatch:
    codes = np.sort(codes)
    g = (codes >> np.uint64(32)).astype(np.int32)
    edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    spans = list(zip(edges.tolist(), np.append(edges[1:], len(g)).tolist(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(g[edges]), pa.array([b - a for a, b in spans], pa.int32()), pa.array([_squeezed(codes[a:b].astype(np.uint32)) for a, b in spans], pa.binary())], names=["g", "n", "keys"])


def parity_bitmap(h: np.ndarray) -> bytes:
    """Bit i is the parity of the elements hashed to i; four bits or more an element."""
    bits = 64
    while bits < 4 * len(h):
        bits *= 2
    return np.packbits((np.bincount(((h >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """A lower bound of the elements that are in one of two sets only."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def signature(bitmap: bytes) -> bytes:
    """A bitmap folded to 256 bits; a smaller one is filled up with zeros, which folding ignores."""
    x = np.frombuffer(bitmap, dtype=np.uint64)
    while len(x) > SIGNATURE:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes().ljust(8 * SIGNATURE, b"\0")


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether pairs of sets of n and m elements can link by their signatures (rows of ``a`` and ``b``).

    Both are folded to the smaller one's bits; bits that differ are at most the elements
    that differ, so they bound the overlap from above.
    """
    x = a ^ b
    least = np.minimum(n, m)
    wide, half = least > 32, (least > 16) & (least <= 32)
    d = np.bitwise_count(np.bitwise_xor.reduce(x, axis=1)).astype(np.int64)
    d[half] = np.bitwise_count(x[half, :2] ^ x[half, 2:]).sum(axis=1)
    d[wide] = np.bitwise_count(x[wide]).sum(axis=1)
    both = (n + m - d) // 2
    return 100 * both >= 75 * (n + m - both)


def links(n: int, m: int, both: int) -> bool:
    """Whether two sets of n and m elements, ``both`` of them shared, overlap by 3/4."""
    return 100 * both >= 75 * (n + m - both)


def _class_of(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little", signed=True)


def _text_key(t: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True)


def features(docs: DataFrame, key: str, text: str, shared: Broadcast[Order]) -> DataFrame:
    """Per row key, class and size; per class and task also text key, minimum hashes, bitmap, its signature and prefix."""
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                yield _features(part, shared.value, seen)

    return source.mapInArrow(run, f"key {kind}, class bigint, n int, text_key bigint, mins array<bigint>, bitmap binary, sig binary, prefix binary")


def _features(part: pa.RecordBatch, order: Order, seen: set[int]) -> pa.RecordBatch:
    h, first = shingle_sets(part.column(1))
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    full = np.flatnonzero(n)
    mins = np.zeros((len(n), MIN_HASHES), dtype=np.int64)
    for k, odd in enumerate(_ODD):
        if len(full):
            mins[full, k] = np.minimum.reduceat(mix(h * odd), first[full]).astype(np.int64)
    ordered = h[np.lexsort((h, order.level(h), doc))]
    p = prefix_size(n)
    raw, bounds = buffer_of(part.column(1))
    raw, bounds, lo = raw.tobytes(), bounds.tolist(), first.tolist()
    classes, keys, lists, bitmaps, signatures, prefixes = [], [], [], [], [], []
    for d, size in enumerate(n.tolist()):
        own = h[lo[d] : lo[d + 1]]
        c = _class_of(own) if size else None
        classes.append(c)
        if size == 0 or c in seen:
            for x in (keys, lists, bitmaps, signatures, prefixes):
                x.append(None)
            continue
        if len(seen) < 1_000_000:
            seen.add(c)
        keys.append(_text_key(raw[bounds[d] : bounds[d + 1]]))
        lists.append(mins[d])
        bitmaps.append(parity_bitmap(own))
        signatures.append(signature(bitmaps[-1]))
        prefixes.append(ordered[lo[d] : lo[d] + int(p[d])].tobytes())
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(classes, pa.int64()), pa.array(n.astype(np.int32)), pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int64())), pa.array(bitmaps, pa.binary()), pa.array(signatures, pa.binary()), pa.array(prefixes, pa.binary())],
        names=["key", "class", "n", "text_key", "mins", "bitmap", "sig", "prefix"],
    )


def likely_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of a class and one class of its size band that shares a minimum hash, another one for each hash.

    Two bandings, half a band apart, so sets of like size meet in one of them.
    """
    step = float(np.log(4 / 3))
    bands = F.array(*[F.struct(F.lit(i).alias("banding"), F.floor(F.log("n") / step + i / 2).alias("band")) for i in (0, 1)])
    each = classes.select("class", F.inline(bands), "mins").select("class", "banding", "band", F.posexplode("mins").alias("k", "m"))
    group = ["banding", "band", "k", "m"]
    center = F.min_by("class", F.xxhash64("class", "k"))
    least = each.groupBy(*group).agg(center.alias("center"), F.min("class").alias("low"), F.max("class").alias("top")).where("low < top").drop("low", "top")
    return each.join(least, group).where("class <> center").select(F.col("class").alias("a"), F.col("center").alias("b")).distinct()


def with_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds the components of both classes as ``ra`` and ``rb``."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    return pairs


def tile_pairs(classes: DataFrame, roots: DataFrame, tiles: int, most: int | None = None, order: Broadcast[Order] | None = None) -> DataFrame:
    """(a, b, more): pairs of classes of different components that share a prefix element, are in one size band, and whose signatures allow a link.

    Signatures go with the elements that ``order`` knows as common (with all if none is
    given); a rare element gives few pairs.

    With ``most``, a tile gives no more pairs than that of any two components; ``more``
    tells that it left some out.
    """
    known = classes.select("class", "n", "prefix", "sig").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").select("class", F.coalesce("root", "class").alias("root"), "n", "prefix", "sig")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _deal(batch, tiles, order and order.value)

    packed = dealt(known.mapInArrow(deal, "tile int, elements binary, own binary, place binary, class binary, root binary, n binary, signed binary, sig binary"), tiles, "tile")
    found = packed.groupBy("tile").applyInArrow(lambda t: _tile(t, most), "a bigint, b bigint, more boolean")
    return found.groupBy("a", "b").agg(F.max("more").alias("more"))


def _deal(part: pa.RecordBatch, tiles: int, order: Order | None) -> Iterator[pa.RecordBatch]:
    """Prefix elements of a batch packed by tile: few large rows instead of many small ones."""
    c, root, n = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    prefixes = part.column(3).to_pylist()
    sig = np.frombuffer(b"".join(part.column(4).to_pylist()), dtype=np.uint64).reshape(-1, SIGNATURE)
    size = np.array([len(p) // 8 for p in prefixes], dtype=np.int64)
    element = np.frombuffer(b"".join(prefixes), dtype=np.uint64)
    own = np.repeat(np.arange(len(c), dtype=np.int32), size)
    place = (np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
    tile = (element % np.uint64(tiles)).astype(np.int32)
    at = np.argsort(tile, kind="stable")
    tile, element, own, place = tile[at], element[at], own[at], place[at]
    common = np.ones(len(element), dtype=bool) if order is None else order.level(element) > 0
    edges = np.flatnonzero(np.diff(tile, prepend=-1))
    rows: dict[str, list] = {k: [] for k in ("tile", "elements", "own", "place", "class", "root", "n", "signed", "sig")}
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(tile)).tolist(), strict=True):
        rows_of, local = np.unique(own[a:b], return_inverse=True)
        signed = np.zeros(len(rows_of), dtype=bool)
        signed[local[common[a:b]]] = True
        for k, v in zip(rows, (int(tile[a]), element[a:b].tobytes(), local.astype(np.int32).tobytes(), place[a:b].tobytes(), c[rows_of].astype(np.int64).tobytes(), root[rows_of].astype(np.int64).tobytes(), n[rows_of].astype(np.int32).tobytes(), np.packbits(signed).tobytes(), sig[rows_of[signed]].tobytes()), strict=True):
            rows[k].append(v)
        if len(rows["tile"]) >= 4096:
            yield _packed(rows)
            rows = {k: [] for k in rows}
    if rows["tile"]:
        yield _packed(rows)


def _packed(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "tile" else pa.binary()) for k, v in rows.items()], names=list(rows))


def _tile(table: pa.Table, most: int | None) -> pa.Table:
    """Pairs of one tile, each once, the smaller class first."""
    parts = [[np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()] for name, kind in (("elements", np.uint64), ("own", np.int32), ("place", np.int32), ("class", np.int64), ("root", np.int64), ("n", np.int32), ("signed", np.uint8), ("sig", np.uint64))]
    shift = np.cumsum([0, *(len(x) for x in parts[3][:-1])])
    element = np.concatenate(parts[0])
    own = np.concatenate([x + s for x, s in zip(parts[1], shift, strict=True)])
    place = np.concatenate(parts[2])
    c, root, n = (np.concatenate(x)[own] for x in parts[3:6])
    signed = np.concatenate([np.unpackbits(x, count=len(m)) for x, m in zip(parts[6], parts[3], strict=True)]).astype(bool)
    sig = np.concatenate(parts[7]).reshape(-1, SIGNATURE)
    # Where each row's signature is; -1 for none.
    where = np.where(signed, np.cumsum(signed) - 1, -1)[own]
    a, b, more = pairs_of_tile(element, c, root, n, place, most, sig, where)
    return pa.table({"a": pa.array(a), "b": pa.array(b), "more": pa.array(more)})


def pairs_of_tile(element: np.ndarray, c: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray, most: int | None = None, sig: np.ndarray | None = None, where: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that can link, also by their signatures (``sig``, at ``where``, -1 for none), and whose first common element this can be.

    Sets of n and m elements that link share 3 (n + m) / 7 at least; if they share none
    before places i and j, then n - i and m - j are bounds of what they share.
    """
    order = np.lexsort((n, element))
    element, c, root, n, place = element[order], c[order], root[order], n[order].astype(np.int64), place[order].astype(np.int64)
    at_sig = where[order] if where is not None else None
    left = n - place
    first = np.flatnonzero(np.r_[True, element[1:] != element[:-1]]) if len(element) else np.zeros(0, dtype=np.int64)
    if not len(first):
        return (*np.zeros((2, 0), dtype=np.int64), np.zeros(0, dtype=bool))
    mixed = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
    size = np.diff(np.append(first, len(element)))
    found: list[np.ndarray] = []  # rows: lesser and greater component, lesser and greater class, whether pairs were left out
    held = 0

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal found, held
        other = (root[i] != root[j]) & (7 * np.minimum(left[i], left[j]) >= 3 * (n[i] + n[j]))
        i, j = i[other], j[other]
        if sig is not None and len(i):
            good = np.ones(len(i), dtype=bool)
            both = np.flatnonzero((at_sig[i] >= 0) & (at_sig[j] >= 0))
            for k in range(0, len(both), PAIRS):
                some = both[k : k + PAIRS]
                x, y = i[some], j[some]
                good[some] = may_link(sig[at_sig[x]], sig[at_sig[y]], n[x], n[y])
            i, j = i[good], j[good]
        found.append(np.stack([np.minimum(root[i], root[j]), np.maximum(root[i], root[j]), np.minimum(c[i], c[j]), np.maximum(c[i], c[j]), np.zeros(len(i), dtype=np.int64)]))
        held += len(i)
        if held > 1_000_000:
            found = [_distinct(found, most)]
            held = found[0].shape[1] // 2

    short = mixed & (size <= 256)
    at = ranges(first[short], size[short])
    stop = np.repeat(first[short] + size[short], size[short])
    step = 1
    while len(at):
        good = at + step < stop
        at, stop = at[good], stop[good]
        near = 4 * n[at] >= 3 * n[at + step]
        at, stop = at[near], stop[near]
        add(at, at + step)
        step += 1
    for f, s in zip(first[mixed & (size > 256)].tolist(), size[mixed & (size > 256)].tolist(), strict=True):
        # Most of a long list is one component as a rule; the others meet every member.
        own = np.arange(f, f + s)
        values, counts = np.unique(root[own], return_counts=True)
        large = values[counts.argmax()]
        for i in own[root[own] != large].tolist():
            j = own[(root[own] == large) | (own > i)]
            j = j[(4 * n[j] >= 3 * n[i]) & (4 * n[i] >= 3 * n[j])]
            add(np.full(len(j), i), j)
    made = _distinct(found, most)
    return made[2], made[3], made[4] > 0


def _distinct(found: list[np.ndarray], most: int | None) -> np.ndarray:
    """Each pair once, and of two components' pairs the first ``most``, which then say so."""
    if not found:
        return np.zeros((5, 0), dtype=np.int64)
    x = np.concatenate(found, axis=1)
    x = x[:, np.lexsort((-x[4], x[3], x[2], x[1], x[0]))]
    new = np.ones(x.shape[1], dtype=bool)
    new[1:] = (x[:4, 1:] != x[:4, :-1]).any(axis=0)
    x = x[:, new]
    if most is None or not x.shape[1]:
        return x
    begins = np.ones(x.shape[1], dtype=bool)
    begins[1:] = (x[:2, 1:] != x[:2, :-1]).any(axis=0)
    start = np.flatnonzero(begins)
    size = np.diff(np.append(start, x.shape[1]))
    cut = np.maximum.reduceat(x[4], start) > 0
    x[4] = np.repeat((size > most) | cut, size)
    return x[:, np.arange(x.shape[1]) - np.repeat(start, size) < most]


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose bitmaps allow an overlap of 3/4."""
    one = classes.select("class", "n", "bitmap").dropDuplicates(["class"])
    met = pairs.join(one.select(F.col("class").alias("a"), F.col("n").alias("n"), F.col("bitmap").alias("x")), "a").join(one.select(F.col("class").alias("b"), F.col("n").alias("m"), F.col("bitmap").alias("y")), "b")
    met = met.where("4 * n >= 3 * m and 4 * m >= 3 * n").select("a", "b", "n", "m", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            # |both| = (n + m - |differing|) / 2, and differing bits are at most differing elements.
            good = [links(p, q, (p + q - differing_bits(u, v)) // 2) for p, q, u, v in zip(n, m, x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return met.mapInArrow(run, "a bigint, b bigint")


def needed_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over text keys."""
    def bits(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        table = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            for place in _places(batch.column(0).to_numpy(zero_copy_only=False)):
                table[place] = True
        return np.packbits(table)

    made = _slices(keys, bits, np.bitwise_or)
    return made if len(made) else np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)


def _places(keys: np.ndarray) -> list[np.ndarray]:
    k = keys.astype(np.int64).view(np.uint64)
    return [(mix(k * odd) >> np.uint64(64 - FILTER_BITS)).astype(np.int64) for odd in _ODD[:4]]


def sets_of(docs: DataFrame, text: str, needed: DataFrame) -> DataFrame:
    """(class, set) for classes whose text key is needed, and a few more."""
    shared = docs.sparkSession.sparkContext.broadcast(needed_filter(needed.select("text_key")))
    source = docs.select(F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            for part in chunks(batch, "text"):
                raw, bounds = buffer_of(part.column(0))
                raw = raw.tobytes()
                keys = np.array([_text_key(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], dtype=np.int64)
                good = np.ones(len(keys), dtype=bool)
                for place in _places(keys):
                    good &= (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
                # The same text in one task is sent once.
                good &= np.array([k not in seen for k in keys.tolist()], dtype=bool)
                rows = np.flatnonzero(good)
                rows = rows[np.sort(np.unique(keys[rows], return_index=True)[1])]
                if len(seen) < 1_000_000:
                    seen.update(keys[rows].tolist())
                if not len(rows):
                    continue
                h, first = shingle_sets(part.column(0).take(pa.array(rows)))
                sets = [h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "set"])

    return source.mapInArrow(run, "class bigint, set binary")


def verified(pairs: DataFrame, docs: DataFrame, text: str, classes: DataFrame) -> DataFrame:
    """Pairs of classes that link, by exact intersection.

    Sets travel to groups of one center and about ``STAR`` members; a center of many
    members has many groups.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    needed = classes.select("class", "text_key").groupBy("class").agg(F.min("text_key").alias("text_key")).join(ends, "class")
    sets = sets_of(docs, text, needed)
    stars = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).alias("groups"))
    members = pairs.join(stars, "b").select(F.col("b").alias("center"), F.pmod(F.xxhash64("a"), "groups").alias("part"), F.col("a").alias("class"), F.lit(1).alias("member"))
    heads = members.select("center", "part").distinct().select("center", "part", F.col("center").alias("class"), F.lit(0).alias("member"))
    rows = members.unionByName(heads).join(sets, "class").select("center", "part", "member", "class", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in batches:
            a, b = [], []
            for center, part, member, c, s in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                s = np.frombuffer(s, dtype=np.uint64)
                if not member:
                    at, head = (center, part), s
                elif at == (center, part):
                    place = np.minimum(np.searchsorted(head, s), len(head) - 1)
                    if links(len(head), len(s), int((head[place] == s).sum())):
                        a.append(c)
                        b.append(center)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition("center", "part").sortWithinPartitions("center", "part", "member").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``n_shingles``, ``component_id``) of every row.

    Texts are lower-cased (A-Z); words are runs of other characters than space and
    U+0009 to U+000D.  A text's set is its distinct five-word shingles, or its words as
    one shingle if it has fewer.  Texts link if their sets overlap by 3/4 or more;
    ``component_id`` is the least key that links reach.  A null, empty or wordless text
    has no shingle and links with nothing; its component is its own key.  A null key
    takes part with its text, but names a component only where no other key does (as
    null).  Rows with one key and different texts are rows of their own.
    """
    spark = docs.sparkSession
    groups = group_count(docs, text, GROUP_BYTES)
    order = spark.sparkContext.broadcast(shingle_order(docs, text, groups))
    table = written(features(docs, key, text, order))
    classes = table.where("prefix is not null").select("class", "n", "text_key", "mins", "bitmap", "sig", "prefix")
    elements = classes.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    tiles = max(groups, int(elements // TILE) + 1)

    likely = written(likely_pairs(classes))
    roots = components(verified(written(possible(likely, classes)), docs, text, classes))
    for most in (FEW, None):
        pairs = written(tile_pairs(classes, roots, tiles, most, order))
        rest = written(possible(pairs, classes))
        if not rest.isEmpty():
            more = verified(rest, docs, text, classes)
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        # Where nothing was left out, or all of it is one component by now, all pairs have been seen.
        if with_roots(pairs.where("more"), roots).where("ra <> rb").isEmpty():
            break

    rows = table.select("key", "class", F.col("n").cast("long").alias("n_shingles"))
    of_class = rows.where("class is not null").groupBy("class").agg(F.min("key").alias("least")).join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of_class.select("class", "root").join(least, "root").select("class", "component_id")
    alone = rows.where("class is null").select("key", "n_shingles", F.col("key").alias("component_id"))
    out = spread_join(rows.where("class is not null"), named, "class").select("key", "n_shingles", "component_id").unionByName(alone)
    return out.select(F.col("key").alias(key), "n_shingles", "component_id")
