"""Benchmark decontamination: test n-grams as a broadcast hash set, texts as token windows.

Items are cut into windows of thirteen words (a shorter item is one window).  Window
hashes go to every worker in order; a task hashes the windows of its texts, looks them
up, compares the words of every hit with the item's words, and marks the hit words.

A block of benchmark text that is broadcast never exceeds ``block_bytes``, and its index
is a few arrays of about ten times that.  A larger benchmark is scanned block by block
and the blocks' hits are merged by row, so the broadcast does not grow with the benchmark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM, Words, eights, equal_spans
from .mapping import fresh, map_texts
from .storage import written

WINDOW = 13
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20
SPANS = "array<struct<lo:int,hi:int>>"
_SPAN = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])


class Index:
    """Windows of a block of items: of each length the sorted hashes, one place of each window, and in which texts it stands.

    Equal texts are one text with several items.  Texts that share a window are a list of
    its own kind, and windows with equal lists share the list, so a passage of many items
    costs a number a window and one list.
    """

    def __init__(self, ids: Sequence[str | None], texts: Sequence[str | None], window: int = WINDOW):
        by_text: dict[str, set[str]] = {}
        for i, t in zip(ids, texts, strict=True):
            own = by_text.setdefault(t or "", set())
            if i is not None:
                own.add(i)
        self.items = [sorted(x) for x in by_text.values()]
        w = Words(pa.array(list(by_text), pa.large_string()), ALNUM, lower=True)
        self.data, self.starts, self.ends = w.data, w.starts.astype(np.int32), w.ends.astype(np.int32)
        view = eights(self.data)
        #: Texts of each list; the first lists are those of one text each.
        self.lists: list[np.ndarray] = []
        numbers: dict[bytes, int] = {}
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in np.unique(np.minimum(window, w.counts[w.counts > 0])).tolist():
            at, h = w.windows(length)
            doc = (np.searchsorted(w.first, at, side="right") - 1).astype(np.int32)
            if length < window:
                own = w.counts[doc] == length
                at, h, doc = at[own], h[own], doc[own]
            order = np.lexsort((at, doc, h))
            at, h, doc = at[order].astype(np.int32), h[order], doc[order]
            # A window is new where its hash is, or where its words differ from those of the same hash before it.
            new = np.ones(len(h), dtype=bool)
            again = np.flatnonzero(h[1:] == h[:-1]) + 1
            new[again] = ~equal_words(view, self.starts, self.ends, at[again], view, self.starts, self.ends, at[again - 1], length)
            begin = np.flatnonzero(new)
            stop = np.append(begin[1:], len(h))
            which = doc[begin].copy()  # the list of a window that one text has is the text's number
            for k in np.flatnonzero((stop - begin > 1) & (doc[begin] != doc[stop - 1])).tolist():
                own = np.unique(doc[begin[k] : stop[k]])
                key = own.tobytes()
                if key not in numbers:
                    numbers[key] = len(self.items) + len(self.lists)
                    self.lists.append(own)
                which[k] = numbers[key]
            self.by_length[length] = (h[begin], at[begin], which, _bits(h))

    def texts_of(self, which: int) -> np.ndarray:
        return self.lists[which - len(self.items)] if which >= len(self.items) else np.array([which])

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, list of texts) of every occurrence of a window in the slice."""
        found = [np.zeros((3, 0), dtype=np.int64)]
        views = None
        for length, (keys, places, lists, bits) in self.by_length.items():
            at, h = w.windows(length)
            maybe = np.flatnonzero(bits[(h >> np.uint64(44)).astype(np.int64)])
            at, h = at[maybe], h[maybe]
            low = np.searchsorted(keys, h)
            many = np.searchsorted(keys, h, side="right") - low
            at, low, many = at[many > 0], low[many > 0], many[many > 0]
            if not len(at):
                continue
            views = views or (eights(w.data), eights(self.data))
            # A hash has one window, but for collisions.
            for k in range(int(many.max())):
                some = many > k
                here, there = at[some], low[some] + k
                good = equal_words(views[0], w.starts, w.ends, here, views[1], self.starts, self.ends, places[there], length)
                found.append(np.stack([here[good], np.full(int(good.sum()), length), lists[there[good]]]))
        return tuple(np.concatenate(found, axis=1))


def equal_words(a: np.ndarray, a0: np.ndarray, a1: np.ndarray, x: np.ndarray, b: np.ndarray, b0: np.ndarray, b1: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` words from ``x`` on equal those from ``y`` on; words as spans of views of bytes."""
    same = np.ones(len(x), dtype=bool)
    for k in range(length):
        left = np.flatnonzero(same)
        i, j = x[left] + k, y[left] + k
        same[left] = equal_spans(a, a0[i], a1[i], b, b0[j], b1[j])
    return same


def _bits(keys: np.ndarray) -> np.ndarray:
    """A first, small filter on the top twenty bits of a hash."""
    table = np.zeros(1 << 20, dtype=bool)
    table[(keys >> np.uint64(44)).astype(np.int64)] = True
    return table


def _scan(texts: pa.Array, index: Index) -> dict[str, pa.Array]:
    w = Words(texts, ALNUM, lower=True)
    n = len(w.counts)
    at, length, which = index.hits(w)
    edges = np.zeros(len(w.starts) + 1, dtype=np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + length, -1)
    hit = np.cumsum(edges[:-1]) > 0
    # Spans are runs of hit words inside one text.
    first = np.zeros(len(hit) + 1, dtype=bool)
    first[w.first] = True
    begins, stops = hit.copy(), hit.copy()
    begins[1:] &= ~hit[:-1] | first[1:-1]
    stops[:-1] &= ~hit[1:] | first[1:-1]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    doc = np.searchsorted(w.first, lo, side="right") - 1
    bounds = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    spans = pa.StructArray.from_arrays([pa.array((lo - w.first[doc]).astype(np.int32)), pa.array((hi - w.first[doc]).astype(np.int32))], fields=list(_SPAN))
    items: list[list[str]] = [[] for _ in range(n)]
    # Each list of texts once a document, then each text once.
    span = len(index.items) + len(index.lists)
    lists: dict[int, list[np.ndarray]] = {}
    for x in np.unique((np.searchsorted(w.first, at, side="right") - 1) * span + which).tolist():
        lists.setdefault(x // span, []).append(index.texts_of(x % span))
    for d, own in lists.items():
        items[d] = [i for t in np.unique(np.concatenate(own)).tolist() for i in index.items[t]]
    return {
        "n_words": pa.array(w.counts.astype(np.int64)),
        "hit_spans": pa.ListArray.from_arrays(bounds, spans),
        "hit_items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
    }


def blocks_of(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark's different rows as parts of at most about ``block_bytes`` of text each (a longer item is a part of its own).

    Of several parts each row's number is written once, so a part is read without another pass over the benchmark.
    """
    b = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text")).where("text <> ''").distinct()
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= block_bytes:
        return [b]
    n = -(-2 * size // block_bytes)
    rows = written(b.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartition(n, "block").sortWithinPartitions("block"))
    return [rows.where(F.col("block") == k).drop("block") for k in range(n)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    keep: Sequence[str] | None = None,
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Adds ``n_words``, ``hit_spans`` (merged word ranges), ``hit_items``, ``n_hit`` and ``contaminated``.

    Texts are lower-cased (A-Z); words are runs of digits, a-z and non-ASCII characters.
    A text is contaminated if it has hits on at least a twentieth of its words.  Null or
    empty texts have no words and no hits; a null or wordless item has no windows.  Items
    with equal texts are all reported, repeated items once; the words of an item without
    an id are marked, but there is no id to report.  ``keep`` names the columns that pass
    through (all by default); those named like a result are replaced.  Repeated rows stay
    repeated; an empty table gives an empty result.
    """
    fields = f"n_words long, hit_spans {SPANS}, hit_items array<string>"
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_hit", "contaminated")]
    parts = blocks_of(benchmark, item, item_text, block_bytes)
    if len(parts) == 1:
        return _judged(_scanned(docs, text, parts[0], fields, keep, window)[1])
    # Several blocks: rows are numbered and written once, so a number means one row however often it is read.
    row = fresh(docs, "row")
    rows = written(docs.select("*", F.monotonically_increasing_id().alias(row)))
    # Each block's hits are written before the next block is built, so one block is in memory at a time.
    shared, out = _scanned(rows, text, parts[0], fields, [*keep, row], window)
    out = written(out)
    shared.destroy()
    more = None
    for part in parts[1:]:
        shared, found = _scanned(rows, text, part, fields, [row], window)
        found = written(found.where(F.size("hit_spans") > 0).select(row, "hit_spans", "hit_items"))
        shared.destroy()
        more = found if more is None else more.unionByName(found)
    spans, items = fresh(out, "spans"), fresh(out, "items")
    more = more.groupBy(row).agg(F.flatten(F.collect_list("hit_spans")).alias(spans), F.flatten(F.collect_list("hit_items")).alias(items))
    out = out.join(more, row, "left").withColumns(
        {
            "hit_spans": F.concat("hit_spans", F.coalesce(spans, F.array().cast(SPANS))),
            "hit_items": F.array_sort(F.array_union("hit_items", F.coalesce(items, F.array().cast("array<string>")))),
        }
    )
    return _judged(_merged(out.drop(spans, items, row)))


def _scanned(docs: DataFrame, text: str, part: DataFrame, fields: str, keep: Sequence[str] | None, window: int) -> tuple[Broadcast, DataFrame]:
    rows = part.toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(Index(rows.column("item").to_pylist(), rows.column("text").to_pylist(), window))
    return shared, map_texts(docs, text, lambda _, t: _scan(t, shared.value), fields, keep)


def _judged(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + (x["hi"] - x["lo"]))
    found = found.withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _merged(found: DataFrame) -> DataFrame:
    """Unites each row's word ranges."""
    at = found.columns.index("hit_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            flat = column.flatten()
            lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            n = column.value_lengths().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((lo, row))
            lo, hi, row = lo[order], hi[order], row[order]
            # The farthest end so far in the row; rows are far apart on one common line.
            line = row << 32
            far = np.maximum.accumulate(hi + line) if len(hi) else hi
            new = np.ones(len(lo), dtype=bool)
            new[1:] = (lo + line)[1:] > far[:-1]
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(lo))[: len(begin)] - 1
            bounds = np.searchsorted(row[begin], np.arange(len(n) + 1)).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(lo[begin].astype(np.int32)), pa.array((far[last] - line[last]).astype(np.int32))], fields=list(_SPAN))
            columns = list(batch.columns)
            columns[at] = pa.ListArray.from_arrays(pa.array(bounds), spans)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return found.mapInArrow(run, found.schema)


def remove_spans(hits: DataFrame, text: str = "text") -> DataFrame:
    """Cuts the hit words (with the text between them) out of each text; keeps every row.

    Takes the result of :func:`find_contamination` with its text column.
    """

    def cut(part: pa.RecordBatch, texts: pa.Array) -> dict[str, pa.Array]:
        w = Words(texts, ALNUM, lower=True)
        spans = part.column(part.schema.get_field_index("hit_spans")).to_pylist()
        out = []
        for d, own in enumerate(spans):
            at, stop, pieces = int(w.offsets[d]), int(w.offsets[d + 1]), []
            for x in own or ():
                a, b = int(w.first[d]) + x["lo"], int(w.first[d]) + x["hi"] - 1
                pieces.append(w.raw[at : w.starts[a]].tobytes())
                at = int(w.ends[b])
            pieces.append(w.raw[at:stop].tobytes())
            out.append(b"".join(pieces).decode("utf-8") if texts[d].is_valid else None)
        return {text: pa.array(out, pa.string())}

    return map_texts(hits, text, cut, f"`{text}` string")


def items_digest(items: str) -> F.Column:
    """Lowercase hex SHA-256 of the sorted, comma-joined item ids."""
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def items_digest_py(items: Sequence[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


__all__ = ["find_contamination", "items_digest", "remove_spans"]
