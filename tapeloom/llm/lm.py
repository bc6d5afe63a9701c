"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts.

Words and word pairs of the training texts are counted by hash, in packed groups that
grow with the corpus.  Every group builds its own slice of a Bloom filter: an n-gram of
count c enters it with each of the levels 1 to 1 + floor(log2 c), and a count is read
back by probing level after level until a probe misses.  The slices grow with the
corpus and hold every n-gram.  While all of them together take at most ``MAX_FILTER_BYTES``
they are broadcast; beyond that they stay where they are, as a table by group, and the
words and pairs of each block of texts are sent, packed, to the groups that hold their
slices.  The same slices are probed either way, so the scores are the same.

The exact unigram base score needs no broadcast that grows: counts of the most common
words are broadcast (at most ``COMMON``); occurrences of all others are sent, packed, to
the groups that hold their counts, and come back as sums per text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NON_SPACE, Words, chunks, joined, mix
from .mapping import dealt, group_count
from .storage import written

START, END = np.uint64(0x51AB7E0C3D9F2468), np.uint64(0xE4D1B60F8C2A9735)
#: Most bytes of slices that are broadcast; more are probed in their groups.
MAX_FILTER_BYTES = 96 << 20
#: Bits an entry has, and may have at least where a slice is bounded before levels are left out.
BITS, LEAST_BITS = 10, 8
COMMON = 1 << 20
#: Weight of the unigram in a pair's probability, as a count.
MU = 50.0
LEVELS = 40
#: Tokens whose counts a task holds before it sends them.
HELD = 2_000_000
#: Bytes of text whose n-grams one group holds, about.
GROUP_BYTES = 16 << 20
#: Parts in which the slices come to the driver.
FETCHES = 8
#: Keys that a group looks up at once.
ASKED = 1_000_000


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(doc_id.cast("string")) % 5 == 1


def tokens_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's words and its end token, first token of each text and the end)."""
    return np.insert(w.hashes, w.first[1:], END), w.first + np.arange(len(w.first))


def pairs_of(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the token before it."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = START
    return joined(before, tokens)


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


def _estimate() -> np.ndarray:
    """A count for each level: the geometric middle of those that have it, 0 for level 0."""
    low = 2.0 ** np.arange(LEVELS)
    return np.r_[0.0, np.sqrt(low * (2 * low - 1))]


ESTIMATE = _estimate()


def _masks(h: np.ndarray, level: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of a slice, four bits in it) of entries: one memory access a probe."""
    x = mix(h + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    bits = np.zeros(len(x), dtype=np.uint64)
    for i in range(4):
        bits |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
    # The upper 32 bits choose the word, evenly.
    return ((x >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).astype(np.int64), bits


def build_slice(h: np.ndarray, counts: np.ndarray, max_bytes: int | None = None) -> tuple[np.ndarray, int]:
    """(the slice's words, least level that it holds); without ``max_bytes`` all levels are held."""
    level = level_of(counts)
    least = 1
    while True:
        some = np.flatnonzero(level >= least)
        # Levels below the least are not entered: a probe starts there.
        entries = int((level[some] - least + 1).sum())
        if max_bytes is None or entries * LEAST_BITS <= 8 * max_bytes or not len(some):
            break
        least += 1
    words = max(1, (entries * BITS if max_bytes is None else min(entries * BITS, 8 * max_bytes)) // 64)
    table = np.zeros(words, dtype=np.uint64)
    for v in range(least, int(level.max(initial=0)) + 1):
        word, bits = _masks(h[level >= v], v, words)
        np.bitwise_or.at(table, word, bits)
    return table, least


class Filter:
    """All slices of one n-gram order."""

    def __init__(self, slices: Iterable[tuple[int, bytes, int]], groups: int, size: np.ndarray | None = None):
        """``size`` has the words of each group's slice; with it the slices can come one after the other."""
        self.groups = groups
        if size is None:
            size = np.zeros(groups, dtype=np.int64)
            for g, data, _ in (slices := list(slices)):
                size[g] = len(data) // 8
        self.begin = np.cumsum(size) - size
        self.size = size
        self.least = np.ones(groups, dtype=np.int64)
        self.table = np.zeros(int(size.sum()), dtype=np.uint64)
        for g, data, least in slices:
            self.table[self.begin[g] : self.begin[g] + size[g]] = np.frombuffer(data, dtype=np.uint64)
            self.least[g] = least

    def levels(self, group: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if it is unknown: probes go on until one misses."""
        out = np.zeros(len(h), dtype=np.int64)
        live = np.flatnonzero(self.size[group] > 0)
        for level in range(1, LEVELS + 1):
            # A group that left out low levels is first asked at its least.
            wait = live[self.least[group[live]] > level]
            ask = live[self.least[group[live]] <= level] if len(wait) else live
            x = mix(h[ask] + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            own = group[ask]
            word = self.begin[own] + ((x >> np.uint64(32)) * self.size[own].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            held = self.table[word]
            good = np.ones(len(ask), dtype=bool)
            for i in range(4):
                good &= (held >> ((x >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1) == 1
            hit = ask[good]
            out[hit] = level
            live = np.concatenate([hit, wait]) if len(wait) else hit
            if not len(live):
                break
        return out


def word_group(h: np.ndarray, groups: int) -> np.ndarray:
    return (h % np.uint64(groups)).astype(np.int64)


def pair_key(h: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(group, 32 bits) that stand for a pair; their number grows with the groups."""
    return ((h >> np.uint64(32)) % np.uint64(groups)).astype(np.int64), h & np.uint64(0xFFFFFFFF)


def ngram_counts(docs: DataFrame, text: str, groups: int) -> DataFrame:
    """One row a group and order: exact counts of words, and the group's filter slice."""
    source = docs.select(F.col(f"`{text}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs, held = [], [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                t, first = tokens_of(Words(part.column(0), NON_SPACE, lower=True))
                g, k = pair_key(pairs_of(t, first), groups)
                words.append(t)
                pairs.append(g.astype(np.uint64) << np.uint64(32) | k)
                held += len(t)
                if held > HELD:
                    yield from _sent(words, pairs, groups)
                    words, pairs, held = [], [], 0
        if held:
            yield from _sent(words, pairs, groups)

    def build(table: pa.Table) -> pa.Table:
        order, g = table.column("order")[0].as_py(), table.column("g")[0].as_py()
        kind = np.uint64 if order == 1 else np.uint32
        keys = np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, dtype=np.uint8 if order == 2 else np.uint32) for x in table.column("counts").to_pylist()])
        at = np.argsort(keys)
        keys, counts = keys[at], counts[at].astype(np.int64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[first], np.add.reduceat(counts, first)
        bits, least = build_slice(keys.astype(np.uint64), counts)
        by_level = np.bincount(level_of(counts), minlength=LEVELS + 1)[: LEVELS + 1]
        return pa.table(
            {
                "order": pa.array([order], pa.int32()), "g": pa.array([g], pa.int32()),
                "keys": pa.array([keys.tobytes() if order == 1 else None], pa.binary()), "counts": pa.array([counts.tobytes() if order == 1 else None], pa.binary()),
                "bits": pa.array([bits.tobytes()], pa.binary()), "least": pa.array([least], pa.int32()),
                "total": pa.array([int(counts.sum())], pa.int64()), "levels": pa.array([by_level.tolist()], pa.list_(pa.int64())),
            }
        )

    sent = source.mapInArrow(count, "order int, g int, keys binary, counts binary")
    return dealt(sent, groups, "order", "g").groupBy("order", "g").applyInArrow(build, "order int, g int, keys binary, counts binary, bits binary, least int, total bigint, levels array<bigint>")


def _sent(words: list[np.ndarray], pairs: list[np.ndarray], groups: int) -> Iterator[pa.RecordBatch]:
    key, count = np.unique(np.concatenate(words), return_counts=True)
    yield _grouped(1, word_group(key, groups), key, count.astype(np.uint32))
    key, count = np.unique(np.concatenate(pairs), return_counts=True)
    many = np.flatnonzero(count > 255)
    if len(many):  # a byte a count: larger ones are sent in parts
        extra = (count[many] - 1) // 255
        key, count = np.concatenate([key, np.repeat(key[many], extra)]), np.concatenate([count, np.full(int(extra.sum()), 255)])
        count[many] -= 255 * extra
    yield _grouped(2, (key >> np.uint64(32)).astype(np.int64), key.astype(np.uint32), count.astype(np.uint8))


def _grouped(order: int, g: np.ndarray, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    at = np.argsort(g, kind="stable")
    g, key, count = g[at], key[at], count[at]
    edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    stops = np.append(edges[1:], len(g))
    spans = list(zip(edges.tolist(), stops.tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(spans), order, dtype=np.int32)), pa.array(g[edges].astype(np.int32)), pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([count[a:b].tobytes() for a, b in spans], pa.binary())],
        names=["order", "g", "keys", "counts"],
    )


@dataclass
class Model:
    """What is broadcast: both filters where they fit, the common words' exact counts, and four numbers."""

    words: Filter | None
    pairs: Filter | None
    common: np.ndarray
    common_counts: np.ndarray
    groups: int
    total: int  # N
    distinct: int  # V
    texts: int

    @property
    def floor(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Counts of common words, -1 for others."""
        if not len(self.common):
            return np.full(len(h), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
        return np.where(self.common[at] == h, self.common_counts[at], -1)


def load_model(counts: DataFrame, groups: int, common: int = COMMON, max_filter_bytes: int = MAX_FILTER_BYTES) -> Model:
    """Collects common words of the written counts, and the slices if all of them fit in ``max_filter_bytes``."""
    stats = counts.select("order", "g", "total", "levels", F.octet_length("bits").alias("size")).collect()
    fits = sum(r.size for r in stats) <= max_filter_bytes
    levels = np.sum([r.levels for r in stats if r.order == 1], axis=0, dtype=np.int64) if stats else np.zeros(LEVELS + 1, dtype=np.int64)
    levels = np.broadcast_to(levels, (LEVELS + 1,))
    above = np.cumsum(levels[::-1])[::-1]
    least = int(np.argmax(above <= common)) if above[-1] <= common else LEVELS

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for keys, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, c = np.frombuffer(keys, dtype=np.uint64), np.frombuffer(c, dtype=np.int64)
                some = level_of(c) >= least
                out.append((keys[some].tobytes(), c[some].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["keys", "counts"])

    rows = counts.where("order = 1").select("keys", "counts").mapInArrow(most, "keys binary, counts binary").collect()
    keys = np.concatenate([np.zeros(0, dtype=np.uint64), *(np.frombuffer(r.keys, dtype=np.uint64) for r in rows)])
    values = np.concatenate([np.zeros(0, dtype=np.int64), *(np.frombuffer(r.counts, dtype=np.int64) for r in rows)])
    at = np.argsort(keys)
    keys, values = keys[at], values[at]

    def made(order: int) -> Filter:
        size = np.zeros(groups, dtype=np.int64)
        for r in stats:
            if r.order == order:
                size[r.g] = r.size // 8
        # Some slices at a time, so the driver holds little more than the filter.
        some = (counts.where((F.col("order") == order) & (F.col("g") % FETCHES == k)).select("g", "bits", "least").collect() for k in range(FETCHES))
        return Filter(((r.g, r.bits, r.least) for rows in some for r in rows), groups, size)

    words, pairs = (made(1), made(2)) if fits else (None, None)
    end = values[keys == END]
    return Model(words, pairs, keys, values, groups, sum(r.total for r in stats if r.order == 1), int(levels.sum()), int(end[0]) if len(end) else 0)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.r_[0, np.cumsum(x)]
    return run[first[1:]] - run[first[:-1]]


def _pair_scores(first: np.ndarray, count: np.ndarray, together: np.ndarray, texts: int, total: int, distinct: int, mu: float) -> np.ndarray:
    """Model score of each text from the estimated counts of its tokens and of their pairs."""
    before = np.empty_like(count)
    before[1:] = count[:-1]
    before[first[:-1]] = texts
    single = (count + 0.5) / (total + 0.5 * (distinct + 1))
    p = (np.minimum(together, before) + mu * single) / (before + mu)
    return _sums(np.log10(np.minimum(p, 1.0)), first)


def score_slice(w: Words, m: Model, mu: float = MU) -> dict[str, np.ndarray | None]:
    """Per text: tokens, known tokens and base score as far as common words go, and model score (none without filters); and the other tokens."""
    t, first = tokens_of(w)
    unique, place = np.unique(t, return_inverse=True)
    own = m.exact(unique)[place]
    common = own >= 0
    base = np.where(common, np.log10(np.maximum(own, 0) + 0.5), 0.0)
    made = None
    if m.words is not None:
        count = ESTIMATE[m.words.levels(word_group(unique, m.groups), unique)][place]
        together = ESTIMATE[m.pairs.levels(*pair_key(pairs_of(t, first), m.groups))]
        made = _pair_scores(first, count, together, m.texts, m.total, m.distinct, mu)
    rare = np.flatnonzero(~common)
    return {
        "n_tokens": np.diff(first), "known": _sums(common & (own > 0), first), "base": _sums(base, first), "score": made,
        "rare": t[rare], "rare_text": np.searchsorted(first, rare, side="right") - 1,
    }


def asked_of(t: np.ndarray, first: np.ndarray, groups: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the block's different n-grams by group: (group, key, each token's place among them)."""
    unique, place = np.unique(t, return_inverse=True)
    g = word_group(unique, groups)
    at = np.argsort(g, kind="stable")
    back = np.empty_like(at)
    back[at] = np.arange(len(at))
    pg, pk = pair_key(pairs_of(t, first), groups)
    pairs, pair_place = np.unique(pg.astype(np.uint64) << np.uint64(32) | pk, return_inverse=True)
    return {1: (g[at], unique[at], back[place]), 2: ((pairs >> np.uint64(32)).astype(np.int64), pairs.astype(np.uint32), pair_place)}


def group_scores(made: DataFrame, counts: DataFrame, m: Model, mu: float) -> DataFrame:
    """(row, score): the slices are probed in their groups, and levels come back to the blocks of texts."""
    groups, texts, total, distinct = m.groups, m.texts, m.total, m.distinct

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = np.uint64 if right.num_rows and right.column("order")[0].as_py() == 1 else np.uint32
        held = Filter([(0, bits, least) for bits, least in zip(left.column("bits").to_pylist(), left.column("least").to_pylist(), strict=True)], 1)
        out, some, n = [], [], 0
        keys = right.column("hashes")

        def ask() -> None:
            h = np.concatenate(some).astype(np.uint64)
            levels = held.levels(np.zeros(len(h), dtype=np.int64), h).astype(np.uint8)
            out.extend(x.tobytes() for x in np.split(levels, np.cumsum([len(x) for x in some])[:-1]))

        for i in range(right.num_rows):
            some.append(np.frombuffer(keys[i].as_py(), dtype=kind))
            n += len(some[-1])
            if n > ASKED:
                ask()
                some, n = [], 0
        if some:
            ask()
        return pa.table({"block": right.column("block"), "order": right.column("order"), "g": right.column("g"), "levels": pa.array(out, pa.binary())})

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("row"), right.sort_by([("order", "ascending"), ("g", "ascending")])
        t, first = tokens_of(Words(left.column("text"), NON_SPACE, lower=True))
        order = right.column("order").to_numpy()
        levels = right.column("levels").to_pylist()
        estimate = {o: ESTIMATE[np.frombuffer(b"".join(levels[i] for i in np.flatnonzero(order == o)), dtype=np.uint8)[place]] for o, (_, _, place) in asked_of(t, first, groups).items()}
        return pa.table({"row": left.column("row"), "score": _pair_scores(first, estimate[1], estimate[2], texts, total, distinct, mu)})

    slices = counts.select("order", "g", "bits", "least")
    asked = made.where("order > 0").select("order", "g", "block", "hashes")
    levels = slices.groupBy("order", "g").cogroup(dealt(asked, groups, "order", "g").groupBy("order", "g")).applyInArrow(probe, "block bigint, order int, g int, levels binary")
    blocks = made.where("row is not null").select("block", "row", "text")
    return blocks.groupBy("block").cogroup(levels.groupBy("block")).applyInArrow(finish, "row bigint, score double")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", train: F.Column | None = None, mu: float = MU, groups: int | None = None, common: int = COMMON, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(key, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``) of each row.

    Learns from the rows where ``train`` holds (all by default).  A text's tokens are its
    words (A-Z lower-cased; other characters than space and U+0009 to U+000D) and one end
    token; a null or empty text has the end alone.  ``base_score`` is exact add-half
    unigram log10 probability; ``score`` that of the pair model, the same whether the
    slices are broadcast or not (``max_filter_bytes``).  Repeated rows each count
    and are each scored; without training rows every token's base is 0.
    """
    spark = docs.sparkSession
    groups = groups or group_count(docs, text, GROUP_BYTES)
    counts = written(ngram_counts(docs if train is None else docs.where(train), text, groups))
    model = load_model(counts, groups, common, max_filter_bytes)
    shared = spark.sparkContext.broadcast(model)
    total, floor = model.total, model.floor
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, rare, rows, held = shared.value, [], [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                s = score_slice(Words(part.column(2), NON_SPACE, lower=True), m, mu)
                yield _mixed(part, s, m.words is None)
                if m.words is None:
                    yield from _asked(part, m.groups)
                rare.append(s["rare"])
                rows.append(part.column(0).to_numpy()[s["rare_text"]])
                held += len(s["rare"])
                if held > HELD // 2:
                    yield _rare(part.schema, rare, rows, groups)
                    rare, rows, held = [], [], 0
        if held:
            yield _rare(part.schema, rare, rows, groups)

    schema = f"row bigint, key {kind}, n_tokens bigint, known bigint, base double, score double, g int, hashes binary, rows binary, order int, block bigint, text string"
    made = written(source.mapInArrow(run, schema))

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(left.column("keys").to_pylist()), dtype=np.uint64)
        values = np.frombuffer(b"".join(left.column("counts").to_pylist()), dtype=np.int64)
        h = np.frombuffer(b"".join(right.column("hashes").to_pylist()), dtype=np.uint64)
        row = np.frombuffer(b"".join(right.column("rows").to_pylist()), dtype=np.int64)
        c = np.zeros(len(h), dtype=np.int64)
        if len(keys) and len(h):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            c = np.where(keys[at] == h, values[at], 0)
        unique, place = np.unique(row, return_inverse=True)
        return pa.table({"row": unique, "more": np.bincount(place, np.log10(c + 0.5), len(unique)), "more_known": np.bincount(place, c > 0, len(unique)).astype(np.int64)})

    words = counts.where("order = 1").select("g", "keys", "counts")
    rare = made.where("rows is not null").select("g", "hashes", "rows")
    back = words.groupBy("g").cogroup(dealt(rare, groups, "g").groupBy("g")).applyInArrow(sums, "row bigint, more double, more_known bigint")
    back = back.groupBy("row").agg(F.sum("more").alias("more"), F.sum("more_known").alias("more_known"))
    out = made.where("row is not null").select("row", "key", "n_tokens", "known", "base", "score").join(back, "row", "left")
    if model.words is None:
        out = out.drop("score").join(group_scores(made, counts, model, mu), "row")
    return out.select(
        F.col("key").alias(key), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score",
    )


NAMES = ["row", "key", "n_tokens", "known", "base", "score", "g", "hashes", "rows", "order", "block", "text"]


def _mixed(part: pa.RecordBatch, s: dict[str, np.ndarray | None], texts: bool) -> pa.RecordBatch:
    """The rows of a slice; with their texts and block where the scores are still to come."""
    n, row = part.num_rows, part.column(0)
    made = pa.nulls(n, pa.float64()) if s["score"] is None else pa.array(s["score"].astype(np.float64))
    columns = [row, part.column(1), pa.array(s["n_tokens"].astype(np.int64)), pa.array(s["known"].astype(np.int64)), pa.array(s["base"].astype(np.float64)), made, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())]
    columns += [pa.array(np.full(n, row[0].as_py())), part.column(2)] if texts else [pa.nulls(n, pa.int64()), pa.nulls(n, part.schema.field(2).type)]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def _packed(schema: pa.Schema, g: pa.Array, hashes: pa.Array, rows: pa.Array, order: int, block: pa.Array) -> pa.RecordBatch:
    n = len(g)
    columns = [pa.nulls(n, pa.int64()), pa.nulls(n, schema.field(1).type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), g, hashes, rows, pa.array(np.full(n, order, dtype=np.int32)), block, pa.nulls(n, schema.field(2).type)]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def _rare(schema: pa.Schema, rare: list[np.ndarray], rows: list[np.ndarray], groups: int) -> pa.RecordBatch:
    h, row = np.concatenate(rare), np.concatenate(rows).astype(np.int64)
    packed = _grouped(0, word_group(h, groups), h, row)
    return _packed(schema, packed.column(1), packed.column(2), packed.column(3), 0, pa.nulls(packed.num_rows, pa.int64()))


def _asked(part: pa.RecordBatch, groups: int) -> Iterator[pa.RecordBatch]:
    """The different words and pairs of a block of texts, packed for the groups that hold their slices."""
    for order, (g, key, _) in asked_of(*tokens_of(Words(part.column(2), NON_SPACE, lower=True)), groups).items():
        edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        stops = np.append(edges[1:], len(g))
        keys = pa.array([key[a:b].tobytes() for a, b in zip(edges.tolist(), stops.tolist(), strict=True)], pa.binary())
        yield _packed(part.schema, pa.array(g[edges].astype(np.int32)), keys, pa.nulls(len(edges), pa.binary()), order, pa.array(np.full(len(edges), part.column(0)[0].as_py())))
