"""Substring dedup: passages that stand in an earlier document, by suffix trees in parts.

A suffix is a word of a text with what follows it; here only its first 50 words matter, so
a repeat is an inner node of the suffix tree at a depth of 50 words or more, and the words
to go are those below such a node in any document but the first.  The tree is never built
whole.  Suffixes are split by a prefix: 25 words, or all 50 where many documents share the
suffix; a part is sorted, which is the subtree's order of leaves, and neighbours that
agree in the prefix and in the rest are below one deep node.  Consecutive suffixes of a
text that are repeats make up its maximal repeats, which are returned as spans.

Before that, suffixes that cannot repeat are left out.  Texts of one word sequence are one
text.  Of the ten-word grams of a suffix the least hash is taken; equal suffixes have equal
ones, so only suffixes whose least gram another text has too are looked at.  The number of
texts with that gram bounds the number of suffixes below it: where it is large, the part is
dealt over salts, each salt gives all but its first document, and those first ones, one a
salt, meet again in a second, small round.

Words, grams and halves of suffixes are 64-bit hashes; a suffix is told apart by the 128
bits of its halves, a text by its SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hotkeys import joined_by_count
from .kernels import NON_SPACE, Words, chunks, joined, mix
from .mapping import map_texts
from .pretokens import ranges
from .storage import written

WINDOW, GRAM = 50, 10
#: Texts that share a gram from which on suffixes are split by all their words and a salt, and how many salts there are.
MANY, SALTS = 20_000, 64
SPANS = "array<struct<lo:int,hi:int>>"
_SPAN = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _everywhere(w: Words, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each word on; the largest number where the text ends before."""
    out = np.full(len(w.starts), _NONE)
    at, h = w.windows(length)
    out[at] = h
    return out


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    m, w = h, 1
    while 2 * w <= width:
        m, w = np.minimum(m[:-w], m[w:]), 2 * w
    return m if w == width else np.minimum(m[: len(m) - (width - w)], m[width - w :])


class Suffixes:
    """The suffixes of a slice of texts with a whole window: first word, text, both halves, least gram."""

    def __init__(self, w: Words, window: int, gram: int):
        left = np.repeat(w.first[1:], w.counts) - np.arange(len(w.starts))
        self.at = np.flatnonzero(left >= window)
        self.doc = np.searchsorted(w.first, self.at, side="right") - 1
        self.place = self.at - w.first[self.doc]
        half = window // 2
        if len(self.at):
            first, rest = _everywhere(w, half), _everywhere(w, window - half)
            self.first, self.rest = first[self.at], rest[self.at + half]
            self.gram = _sliding_least(_everywhere(w, gram), window - gram + 1)[self.at]
        else:
            self.first = self.rest = self.gram = np.zeros(0, dtype=np.uint64)

    def groups(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order of the suffixes ``some`` by text and words, where a new text or window begins in it)."""
        order = some[np.lexsort((self.at[some], self.rest[some], self.first[some], self.doc[some]))]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.doc[order][1:] != self.doc[order][:-1]) | (self.first[order][1:] != self.first[order][:-1]) | (self.rest[order][1:] != self.rest[order][:-1])
        return order, new


def _spaced(w: Words, keep: np.ndarray) -> list[bytes]:
    """Each text's kept words joined by one space."""
    own = np.flatnonzero(keep)
    size = w.ends[own] - w.starts[own] + 1
    at = ranges(w.starts[own], size)
    data = np.append(w.data, np.uint8(0))[np.minimum(at, len(w.data))]
    stops = np.cumsum(size)
    data[stops - 1] = 0x20
    edge = np.append(0, stops)[np.searchsorted(own, w.first)]
    whole = data.tobytes()
    return [whole[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def _read(texts: pa.Array, window: int, gram: int) -> dict[str, pa.Array]:
    w = Words(texts, NON_SPACE, lower=False)
    s = Suffixes(w, window, gram)
    new = np.ones(len(s.at), dtype=bool)
    order = np.lexsort((s.gram, s.doc))
    doc, g = s.doc[order], s.gram[order]
    new[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])
    bounds = np.searchsorted(doc[new], np.arange(len(texts) + 1)).astype(np.int32)
    return {
        "n_words": pa.array(w.counts.astype(np.int64)),
        "digest": pa.array([hashlib.sha256(x).digest() for x in _spaced(w, np.ones(len(w.starts), dtype=bool))], pa.binary()),
        "grams": pa.ListArray.from_arrays(pa.array(bounds), pa.array(g[new].view(np.int64))),
    }


def _suffixes(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """Suffixes that may repeat, each window of a text once: ``part``, both halves, ``doc``, ``row``, ``place``, ``dealt``.

    Takes ``row``, ``doc``, ``text`` and the text's shared grams, as structs of the gram
    and whether many texts have it.
    """
    kind = texts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                s = Suffixes(Words(part.column(2), NON_SPACE, lower=False), window, gram)
                shared = part.column(3)
                flat = shared.flatten()
                own = np.repeat(np.arange(len(shared)), pc.fill_null(pc.list_value_length(shared), 0).to_numpy(zero_copy_only=False))
                grams, many = flat.field(0).to_numpy(zero_copy_only=False).view(np.uint64), flat.field(1).to_numpy(zero_copy_only=False)
                # Both sides told apart by text and gram in one number each.
                known = joined(own.astype(np.uint64), grams)
                order = np.argsort(known)
                known, many = known[order], many[order]
                asked = joined(s.doc.astype(np.uint64), s.gram)
                k = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
                some = np.flatnonzero(known[k] == asked) if len(known) else np.zeros(0, dtype=np.int64)
                order, new = s.groups(some)
                i = order[new]
                dealt = many[k[i]].astype(bool)
                salt = mix(part.column(0).to_numpy().view(np.uint64) + np.uint64(1))[s.doc[i]] % np.uint64(SALTS)
                first, rest = s.first[i], s.rest[i]
                key = np.where(dealt, joined(joined(first, rest), salt), first)
                doc = pa.array(s.doc[i])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(first.view(np.int64)), pa.array(rest.view(np.int64)), part.column(1).take(doc), part.column(0).take(doc), pa.array(s.place[i].astype(np.int32)), pa.array(dealt)],
                    names=["part", "first", "rest", "doc", "row", "place", "dealt"],
                )

    return texts.mapInArrow(run, f"part long, first long, rest long, doc {kind}, row long, place int, dealt boolean")


def _below_deep_nodes(suffixes: DataFrame) -> DataFrame:
    """Suffixes with another document before them, of those in one part; and the first ones of dealt parts, which are not ``sure``.

    Parts stream by in the order of the subtree's leaves.
    """
    ordered = suffixes.repartition("part").sortWithinPartitions("part", "first", "rest", F.col("doc").asc_nulls_last(), "row")
    kind = ordered.schema["doc"].dataType.simpleString()
    names = ["part", "first", "rest", "doc", "row", "place", "dealt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # the first leaf of the node at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            if head is not None:
                batch = pa.Table.from_batches([head, batch]).combine_chunks().to_batches()[0]
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new = np.ones(batch.num_rows, dtype=bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            doc = batch.column(3)
            other = pc.not_equal(doc, doc.take(pa.array(lead)))
            # Null documents come last and are none that others could be equal to.
            other = pc.fill_null(other, False).to_numpy(zero_copy_only=False) | (pc.is_null(doc).to_numpy(zero_copy_only=False) & pc.is_valid(doc.take(pa.array(lead))).to_numpy(zero_copy_only=False))
            out = other | batch.column(6).to_numpy(zero_copy_only=False)
            if head is not None:
                out[0] = False
            head = batch.slice(int(lead[-1]), 1)
            at = pa.array(np.flatnonzero(out))
            # What is sure needs no words any more.
            sure = pa.array(other[out])
            cleared = [pc.if_else(sure, pa.scalar(None, batch.schema.field(i).type), batch.column(i).take(at)) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*cleared, batch.column(4).take(at), batch.column(5).take(at), sure], names=["first", "rest", "doc", "row", "place", "sure"])

    assert ordered.columns == names
    return ordered.mapInArrow(run, f"first long, rest long, doc {kind}, row long, place int, sure boolean")


def _cut(texts: pa.Array, places: pa.Array, window: int, gram: int) -> dict[str, pa.Array]:
    w = Words(texts, NON_SPACE, lower=False)
    s = Suffixes(w, window, gram)
    n = places.value_lengths().to_numpy(zero_copy_only=False)
    gone = w.first[np.repeat(np.arange(len(n)), n)] + places.flatten().to_numpy(zero_copy_only=False)
    order, new = s.groups(np.arange(len(s.at)))
    group = np.cumsum(new) - 1
    hit = np.zeros(int(new.sum()), dtype=bool)
    hit[group[np.isin(s.at[order], gone)]] = True
    at = s.at[order][hit[group]]
    edges = np.zeros(len(w.starts) + 1, dtype=np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    removed = np.cumsum(edges[:-1]) > 0
    head = np.zeros(len(removed) + 1, dtype=bool)
    head[w.first] = True
    begins, stops = removed.copy(), removed.copy()
    begins[1:] &= ~removed[:-1] | head[1:-1]
    stops[:-1] &= ~removed[1:] | head[1:-1]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    doc = np.searchsorted(w.first, lo, side="right") - 1
    bounds = pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32))
    spans = pa.StructArray.from_arrays([pa.array((lo - w.first[doc]).astype(np.int32)), pa.array((hi - w.first[doc]).astype(np.int32))], fields=list(_SPAN))
    counts = np.append(0, np.cumsum(removed))[w.first]
    return {
        "n_removed": pa.array(np.diff(counts)),
        "removed_spans": pa.ListArray.from_arrays(bounds, spans),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in _spaced(w, ~removed)], pa.string()),
    }


def find_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """For each row ``key``, ``n_words``, ``n_removed``, ``removed_spans`` (maximal word ranges), ``kept_sha256``.

    A word goes if a run of ``window`` words over it also begins in a row of a smaller key;
    runs are judged on the texts as given, and those of one text or one key do not count
    against it, so repeated rows share their fate.  A row without a key comes after all
    others.  Null and empty texts have no words; an empty table gives no row.  Other
    columns are not read, whatever their names.  The digest is of the kept words joined
    by one space; :func:`without_spans` gives the texts.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("doc"), F.col(f"`{text}`").cast("string").alias("text")))
    read = written(map_texts(rows, "text", lambda _, t: _read(t, window, gram), "n_words long, digest binary, grams array<long>", keep=["row", "doc"]))
    # Texts of one word sequence are one text, that of the smallest key.
    rank = F.struct(F.col("doc").isNull(), "doc", "row")
    classes = read.where(F.col("n_words") >= window).groupBy("digest").agg(F.min(rank).alias("least"), F.count("*").alias("n"))
    classes = written(classes.select("digest", "n", F.col("least.doc").alias("least_doc"), F.col("least.row").alias("least_row")))
    long = joined_by_count(read.where(F.col("n_words") >= window).select("row", "doc", "n_words", "digest"), classes, "digest", read.count())
    firsts = classes.select(F.col("least_row").alias("row")).join(read.select("row", "grams"), "row")
    grams = written(firsts.select("row", F.explode("grams").alias("gram")))
    counts = written(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    shared = joined_by_count(grams, counts, "gram", grams.count()).groupBy("row").agg(F.collect_list(F.struct("gram", (F.col("n") > MANY).alias("many"))).alias("shared"))
    leaves = _below_deep_nodes(_suffixes(rows.join(shared, "row").select("row", "doc", "text", "shared"), window, gram))
    leaves = written(leaves)
    again = leaves.where("not sure").select(F.xxhash64("first", "rest").alias("part"), "first", "rest", "doc", "row", "place", F.lit(False).alias("dealt"))
    gone = leaves.where("sure").select("row", "place").unionByName(_below_deep_nodes(again).select("row", "place"))
    gone = gone.groupBy("row").agg(F.collect_list("place").alias("places"))
    fields = f"n_removed long, removed_spans {SPANS}, kept_sha256 string"
    at = ["row", "text", "places"]
    cut = map_texts(rows.join(gone, "row").select(*at), "text", lambda part, t: _cut(t, part.column(1), window, gram), fields, keep=["row", "places"]).drop("places")
    none = F.array().cast(SPANS)
    whole = lambda n: F.array(F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi"))).cast(SPANS)
    own = F.col("doc").eqNullSafe(F.col("least_doc"))
    copies = long.where(~own).select("doc", "n_words", F.col("n_words").alias("n_removed"), whole(F.col("n_words")).alias("removed_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    judged = long.where(own).join(cut.withColumnRenamed("row", "least_row"), "least_row", "left")
    judged = judged.select("doc", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed_spans", none).alias("removed_spans"), F.coalesce("kept_sha256", F.lower(F.hex("digest"))).alias("kept_sha256"))
    short = read.where(F.col("n_words") < window).select("doc", "n_words", F.lit(0).cast("long").alias("n_removed"), none.alias("removed_spans"), F.lower(F.hex("digest")).alias("kept_sha256"))
    return judged.unionByName(copies).unionByName(short).withColumnRenamed("doc", key)


def without_spans(found: DataFrame, text: str = "text", spans: str = "removed_spans") -> DataFrame:
    """Replaces each text by its words outside the spans, joined by one space; null stays null."""

    def cut(part: pa.RecordBatch, texts: pa.Array) -> dict[str, pa.Array]:
        w = Words(texts, NON_SPACE, lower=False)
        own = part.column(part.schema.get_field_index(spans))
        n = pc.fill_null(own.value_lengths(), 0).to_numpy(zero_copy_only=False)
        base = w.first[np.repeat(np.arange(len(n)), n)]
        lo, hi = (own.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = np.zeros(len(w.starts) + 1, dtype=np.int64)
        np.add.at(edges, base + lo, 1)
        np.add.at(edges, base + hi, -1)
        kept = [x.decode() for x in _spaced(w, np.cumsum(edges[:-1]) == 0)]
        return {text: pa.array([x if t.is_valid else None for x, t in zip(kept, texts, strict=True)], pa.string())}

    return map_texts(found, text, cut, f"`{text}` string")
