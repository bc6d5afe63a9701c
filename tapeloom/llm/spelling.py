"""Spelling variants: words one edit apart, found by states that walk a trie level by level.

The trie is a table of edges between branching prefixes; stretches without a branch are
one edge with a label, so the table has at most two edges a word.  A node is a 64-bit hash
of its prefix.  Two words one edit apart part at a branching node, so a word's only edits
are at the branching nodes of its own path: there it leaves out its next letter, or takes
another edge in place of its own (a later letter, so each pair is found from one side).
Such states (word, position, node, one edit) are joined with the edges at their node again
and again, one level a round, until no state is left; a state that meets the end of a word
together with its own is a pair.  Pairs are compared letter by letter at the end, so a
collision of hashes changes nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hotkeys import joined_by_count
from .kernels import LOWER, _placed, buffer_of, chunks, mix, span_hashes
from .pretokens import ranges
from .storage import written

#: One of so many runs is damaged, the least length and count of a word.
DAMAGED, LENGTH, COUNT = 97, 5, 3
#: Words below a node that one task takes; more are dealt over copies of the node's edges.
NODE_WORDS = 50_000

_ASCII = np.zeros(256, dtype=bool)
_ASCII[65:91] = _ASCII[97:123] = True
_LATIN = 0xC3  # leads U+00C0 to U+00FF, and only these
#: Longer runs are summed one by one.
_STEPPED = 48


def _crc_table() -> np.ndarray:
    """The table of the reflected polynomial, by its rule."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes behind a prefix whose CRC-32 is ``begun``."""
    c = begun.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    left = np.flatnonzero((size > 0) & (size <= _STEPPED))
    for k in range(_STEPPED):
        if not len(left):
            break
        b = data[starts[left] + k].astype(np.uint32)
        c[left] = _CRC[(c[left] ^ b) & np.uint32(0xFF)] ^ (c[left] >> np.uint32(8))
        left = left[size[left] > k + 1]
    out = c ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _STEPPED).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(begun[i]))
    return out


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, text) of the maximal runs of letters A-Z, a-z and U+00C0 to U+00FF."""
    raw, offsets = buffer_of(texts)
    m = _ASCII[raw]
    latin = raw == _LATIN
    m |= latin
    m[1:] |= latin[:-1]
    begins, stops = m.copy(), m.copy()
    begins[1:] &= ~m[:-1]
    stops[:-1] &= ~m[1:]
    full = np.flatnonzero(np.diff(offsets))
    first, last = offsets[full], offsets[full + 1] - 1
    begins[first] |= m[first]
    stops[last] |= m[last]
    starts = np.flatnonzero(begins)
    return LOWER[raw], starts, np.flatnonzero(stops) + 1, np.searchsorted(offsets, starts, side="right") - 1


def _counted(keys: list[str], texts: pa.Array, length: int) -> tuple[pa.Array, np.ndarray]:
    """(word, occurrences) of a slice of texts, damaged as the rule says."""
    data, starts, ends, doc = runs(texts)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, dtype=np.int64)
    word = span_hashes(data, starts, ends)
    # What one text repeats is damaged alike.
    _, at, n = np.unique(mix(word + mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    starts, ends, doc, word = starts[at], ends[at], doc[at], word[at]
    prefix = np.array([zlib.crc32(f"{k}:".encode()) for k in keys], dtype=np.uint32)
    h = crc32s(data, starts, ends, prefix[doc])
    bad = h % np.uint32(DAMAGED) == 0
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    size = points[ends] - points[starts]
    good = np.flatnonzero(~bad & (size >= length))
    _, first, which = np.unique(word[good], return_index=True, return_inverse=True)
    total = np.bincount(which, n[good], len(first)).astype(np.int64)
    own = good[first]
    lengths = ends[own] - starts[own]
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int64)
    whole = pa.LargeStringArray.from_buffers(len(own), pa.py_buffer(offsets), pa.py_buffer(data[ranges(starts[own], lengths)].tobytes())).cast(pa.string())
    damaged: dict[str, int] = {}
    for i in np.flatnonzero(bad & (size > length)).tolist():
        s = data[starts[i] : ends[i]].tobytes().decode()
        at = int(h[i]) % len(s)
        s = s[:at] + s[at + 1 :]
        damaged[s] = damaged.get(s, 0) + int(n[i])
    words = pa.chunked_array([whole, pa.array(list(damaged), pa.string())]).combine_chunks()
    return words, np.concatenate([total, np.array(list(damaged.values()), dtype=np.int64)])


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """``word`` and ``n`` of all words of at least ``length`` letters that occur at least ``count`` times.

    Runs of letters are lower-cased (A-Z only); of those whose CRC-32 with the document's
    key is a multiple of 97, one letter is left out.  A null text has no word, a null key
    counts as empty.  Counts are added up in each task before they are shuffled.
    """
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").cast("string").alias("text")).where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words, n = _counted(part.column(0).to_pylist(), part.column(1), length)
                yield pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def _prefixes(words: DataFrame) -> DataFrame:
    """(id, depth, node, next letter, 0 at the end) of every prefix of every word; node and letters as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "word"):
                data, offsets = buffer_of(part.column(1))
                lead = (data & 0xC0) != 0x80
                size = np.diff(np.append(0, np.cumsum(lead))[offsets])
                points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
                first = np.cumsum(size) - size
                place = np.arange(len(points)) - np.repeat(first, size)
                run_sum = np.append(np.uint64(0), np.cumsum(_placed(points.astype(np.uint64), place)))
                row = np.repeat(np.arange(len(size)), size + 1)
                depth = np.arange(len(row)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
                node = mix(run_sum[first[row] + depth] - run_sum[first[row]]).view(np.int64)
                after = np.append(points, np.uint32(0))[np.minimum(first[row] + depth, len(points))]
                after[depth == size[row]] = 0
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(depth.astype(np.int32)), pa.array(node), pa.array(after.astype(np.int32))], names=["id", "depth", "node", "next"])

    return words.select("id", "word").mapInArrow(run, "id long, depth int, node long, next int")


def _bit(letter: F.Column) -> F.Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (letter % 64).cast("int"))


def _letter(word: F.Column, at: F.Column) -> F.Column:
    """The letter of a word from position ``at`` (from 0) as a number, 0 behind the end."""
    return F.ascii(F.substring(word, at + 1, F.lit(1)))


def _salts(load: F.Column) -> F.Column:
    return F.greatest(F.lit(1), F.ceil(load / NODE_WORDS)).cast("int")


def _salt(word: F.Column, load: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(word), _salts(load)).cast("int")


def _trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, edges) of numbered words.

    Paths: ``word``, ``n`` and each branching node on its path.  Edges: ``node``, first
    letter ``c``, ``label``, and either the ``child`` node with a ``mask`` of the letters
    that go on there, or the ``near`` word that ends there.  ``load`` is how many words can
    come to a node: those below the node before it.
    """
    prefixes = written(_prefixes(words))
    # The root always counts; its words and those of every other node are counted before the shuffle.
    nodes = prefixes.groupBy("node").agg(F.count("*").alias("below"), F.min("depth").alias("least"), F.min("next").alias("a"), F.max("next").alias("z"), F.bit_or(_bit(F.col("next"))).alias("mask"))
    nodes = written(nodes.where("a <> z or least = 0").select("node", "below", "mask"))
    on_path = joined_by_count(prefixes, nodes, "node", prefixes.count(), n="below")
    path = on_path.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "next", "below", "mask"))).alias("path"))
    paths = written(words.join(path, "id").select("word", "n", "path"))
    steps = paths.select("word", "n", F.posexplode("path").alias("k", "s"), "path")
    after = F.try_element_at("path", F.col("k") + 2)
    load = F.coalesce(F.try_element_at("path", F.when(F.col("k") > 0, F.col("k")).otherwise(F.lit(1)))["below"], F.col("s.below"))
    stop = F.coalesce(after["depth"], F.length("word"))
    edge = steps.select(
        F.col("s.node").alias("node"), F.col("s.next").alias("c"), F.substring(F.col("word"), F.col("s.depth") + 1, stop - F.col("s.depth")).alias("label"),
        after["node"].alias("child"), after["mask"].alias("mask"), F.when(after.isNull(), F.col("word")).alias("near"), F.when(after.isNull(), F.col("n")).alias("near_n"), load.alias("load"), F.col("s.below").alias("child_load"),
    )
    inner = edge.where("child is not null").groupBy("node", "c", "label", "child").agg(*[F.first(x).alias(x) for x in ("mask", "near", "near_n", "load", "child_load")])
    edges = written(edge.where("child is null").unionByName(inner))
    return paths, edges


def _moved(joined: DataFrame) -> DataFrame:
    """What states become that have taken an edge: pairs where both words end, else states at the child whose next letter goes on there."""
    to = F.col("pos") + F.length("label")
    fits = F.substring(F.col("word"), F.col("pos") + 1, F.length("label")) == F.col("label")
    letter = _letter(F.col("word"), to)
    ended = F.col("near").isNotNull()
    moved = joined.where(fits & F.when(ended, to == F.length("word")).otherwise(F.col("mask").bitwiseAND(_bit(letter)) != 0))
    return moved.select("word", "n", to.alias("pos"), F.col("child").alias("node"), "at", "dropped", letter.alias("c"), F.when(~ended, _salt(F.col("word"), F.col("child_load"))).alias("salt"), "near", "near_n")


def _frontier(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The states after one edit."""
    at = paths.select("word", "n", F.posexplode("path").alias("k", "s"), "path").where("s.next <> 0")
    load = F.coalesce(F.try_element_at("path", F.when(F.col("k") > 0, F.col("k")).otherwise(F.lit(1)))["below"], F.col("s.below"))
    depth = F.col("s.depth")
    at = at.select("word", "n", depth.alias("at"), F.col("s.node").alias("node"), F.col("s.next").alias("next"), F.col("s.mask").alias("mask"), load.alias("load"), _letter(F.col("word"), depth + 1).alias("then"))
    salt = _salt(F.col("word"), F.col("load")).alias("salt")
    none = [F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n")]
    dropped = at.where((F.col("then") != F.col("next")) & (F.col("mask").bitwiseAND(_bit(F.col("then"))) != 0))
    dropped = dropped.select("word", "n", (F.col("at") + 1).alias("pos"), "node", "at", F.lit(True).alias("dropped"), F.col("then").alias("c"), salt, *none)
    own = at.select("word", "n", "at", "node", "next", salt)
    # Another edge's first letter replaces the word's own; the rest of its label must follow in the word.
    swapped = own.join(_dealt(edges), ["node", "salt"]).where(F.col("c") > F.col("next")).drop("salt")
    swapped = _moved(swapped.withColumns({"label": F.expr("substring(label, 2)"), "pos": F.col("at") + 1, "dropped": F.lit(False)}))
    return dropped.unionByName(swapped)


def _dealt(edges: DataFrame) -> DataFrame:
    """Each edge once for each of its node's salts."""
    return edges.withColumn("salt", F.explode(F.sequence(F.lit(0), _salts(F.col("load")) - 1)))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all pairs one edit apart, both ways.  Takes different ``word``s with their ``n``."""
    numbered = written(words.select("word", "n", F.monotonically_increasing_id().alias("id")))
    paths, edges = _trie(numbered)
    states, found = written(_frontier(paths, edges)), None
    while True:
        pairs = states.where("near is not null")
        found = pairs if found is None else found.unionByName(pairs)
        states = states.where("near is null")
        if states.isEmpty():
            break
        states = written(_moved(states.drop("near", "near_n").join(_dealt(edges), ["node", "c", "salt"]).drop("node", "c", "salt")))
    at, word, near = F.col("at"), F.col("word"), F.col("near")
    rest = F.substring(word, at + 2, F.length(word))
    same = F.when(F.col("dropped"), near == F.concat(F.substring(word, F.lit(1), at), rest)).otherwise(
        (F.length(word) == F.length(near)) & (F.substring(word, F.lit(1), at) == F.substring(near, F.lit(1), at)) & (rest == F.substring(near, at + 2, F.length(near)))
    )
    two = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(near.alias("word"), word.alias("near"), F.col("n").alias("near_n"))))
    return found.where(same).select(two.alias("p")).select("p.*")


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) by joining pointers with pointers; each form occurs at least twice as often as its word, so chains are short."""
    roots = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(math.log2(most) + 1)) if most > 1 else 0):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return roots


def spelling_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of every word of :func:`vocabulary`.

    Near words are one inserted, deleted or replaced letter apart.  A word's form is its
    near word of largest n (of equal ones the first in code-point order) if that is at
    least twice its own; the root is where following forms ends, the word itself without a
    form.  Repeated rows count again; an empty table, or one without such words, gives no row.
    Other columns are not read, whatever their names.
    """
    words = written(vocabulary(docs, text, key, length, count))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    form = (-F.col("best.n")) >= 2 * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.n")).alias("form_n"))
    rows = written(rows)
    roots = _roots(rows.where("form is not null"), words.agg(F.max("n")).first()[0] or 0)
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
