"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the average of the vectors of its byte 3- to 5-grams (with word marks) and
of the whole word, all hashed into buckets, so an unseen misspelling shares most of
its vectors with the word it resembles.  Every ten words of a text are averaged and
a linear softmax gives the chance that they are toxic; a text is toxic if any of its
segments is (noisy or), which keeps one insult in a long text from being averaged
away.  Vectors and softmax are trained jointly by Adam in numpy on a bounded sample.
Scoring needs only one number a bucket, which is what is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import ALNUM, Words, chunks
from .mapping import map_texts
from .pretokens import ranges

BUCKET_BITS = 17
GRAMS = (3, 4, 5)
SEGMENT = 10
DIM = 2
EPOCHS = 100
#: First learning rates of vectors, softmax and bias; they fall to nothing over the epochs.
RATES = (1.0, 0.3, 0.03)
#: Subwords in fewer texts (a text counts once for each different word) get no vector.
MIN_DOCS = 3
#: Weight of the squared length of the vectors in the loss.
DECAY = 1e-6
#: Bounds of the training sample: rows of labels 0 and 1, and bytes of all their texts, which may each be of any length.
MAX_ROWS, MAX_BYTES = (4000, 2000), (8 << 20, 5 << 20)
#: A text of more than this part of the bytes is not learnt from.
LARGEST = 16
#: Words whose subwords are in one array while training, and segments that one step takes at once.
WORDS, STEP = 10_000, 20_000
THRESHOLD = 0.3
#: Chance of every segment where nothing could be learnt.
UNKNOWN = 1e-9
_C = np.uint64(0x9E3779B97F4A7C15)


def subwords(w: Words, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each subword, first subword of each word), for all words or those given."""
    starts, ends = (w.starts, w.ends) if words is None else (w.starts[words], w.ends[words])
    size = ends - starts + 2
    first = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(size, out=first[1:])
    n = int(first[-1])
    marked = np.zeros(n + max(GRAMS), dtype=np.uint64)
    inner = np.ones(n, dtype=bool)
    inner[first[:-1]] = False
    inner[first[1:] - 1] = False
    marked[:n][inner] = w.data[ranges(starts, ends - starts)]
    marked[first[:-1]], marked[first[1:] - 1] = 60, 62
    left = np.repeat(first[1:], size) - np.arange(n)
    word = np.repeat(np.arange(len(starts), dtype=np.int32), size)
    whole = (w.hashes if words is None else w.hashes[words]) >> np.uint64(64 - BUCKET_BITS)
    buckets, owner = [whole.astype(np.int32)], [np.arange(len(starts), dtype=np.int32)]
    code = marked[:n] | marked[1 : n + 1] << np.uint64(8)
    for g in range(3, max(GRAMS) + 1):
        code = code | marked[g - 1 : n + g - 1] << np.uint64(8 * (g - 1))
        if g in GRAMS:
            at = np.flatnonzero(left >= g)
            h = (code[at] + np.uint64(g * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) * _C
            h ^= h >> np.uint64(31)
            buckets.append(((h * _C) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            owner.append(word[at])
    all_owner = np.concatenate(owner)
    order = np.argsort(all_owner, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(all_owner[order], np.arange(len(starts) + 1))


def word_scores(w: Words, weight: np.ndarray) -> np.ndarray:
    """Mean of the bucket weights of each word's subwords."""
    starts, ends = w.starts, w.ends
    size = ends - starts + 2
    first = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(size, out=first[1:])
    n = int(first[-1])
    marked = np.zeros(n + max(GRAMS), dtype=np.uint64)
    inner = np.ones(n, dtype=bool)
    inner[first[:-1]] = False
    inner[first[1:] - 1] = False
    marked[:n][inner] = w.data[ranges(starts, ends - starts)]
    marked[first[:-1]], marked[first[1:] - 1] = 60, 62
    left = np.repeat(first[1:], size) - np.arange(n)
    total = weight[(w.hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)].astype(np.float64)
    count = np.ones(len(starts))
    code = marked[:n] | marked[1 : n + 1] << np.uint64(8)
    run = np.zeros(n + 1)
    for g in range(3, max(GRAMS) + 1):
        code = code | marked[g - 1 : n + g - 1] << np.uint64(8 * (g - 1))
        if g in GRAMS:
            h = (code + np.uint64(g * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) * _C
            h ^= h >> np.uint64(31)
            h *= _C
            value = weight[(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
            value[left < g] = 0
            np.cumsum(value, out=run[1:])
            total += run[first[1:]] - run[first[:-1]]
            count += np.maximum(0, size - g + 1)
    return total / count


def segments(counts: np.ndarray, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each segment and the end, first segment of each text and the end, words of each segment)."""
    n_seg = -(-counts // length)
    first_seg = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(n_seg, out=first_seg[1:])
    place = np.arange(first_seg[-1]) - np.repeat(first_seg[:-1], n_seg)
    word0 = np.concatenate([[0], np.cumsum(counts)])
    begin = np.repeat(word0[:-1], n_seg) + place * length
    edges = np.append(begin, word0[-1])
    return edges, first_seg, np.diff(edges)


@dataclass
class Model:
    """``weight``: the softmax margin of each bucket's vector; ``bias``: that of an empty segment."""

    weight: np.ndarray
    bias: float

    def score(self, w: Words) -> np.ndarray:
        """Chance of label 1 for each text of a slice; a text without words gets the bias's chance."""
        edges, first, size = segments(w.counts)
        run = np.zeros(len(w.starts) + 1)
        if len(w.starts):
            np.cumsum(word_scores(w, self.weight), out=run[1:])
        z = self.bias + (run[edges[1:]] - run[edges[:-1]]) / np.maximum(size, 1)
        total = np.zeros(len(z) + 1)
        np.cumsum(np.logaddexp(0, z), out=total[1:])
        rate = total[first[1:]] - total[first[:-1]]
        rate = np.where(w.counts == 0, np.logaddexp(0, self.bias), rate)
        return -np.expm1(-np.maximum(rate, 0))


def train(texts: pa.Array, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7, dim: int = DIM, decay: float = DECAY, rates: tuple[float, float, float] = RATES, min_docs: int = MIN_DOCS, init: float = 0.1) -> Model:
    """Jointly fits subword vectors and softmax; without rows of both labels nothing is learnt, and no text is predicted to be of label 1."""
    y = np.asarray(labels, dtype=np.float64)
    rate = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(rate / (1 - rate)))
    buckets = 1 << BUCKET_BITS
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(buckets, dtype=np.float32), float(np.log(UNKNOWN / (1 - UNKNOWN))))
    parts = list(chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"))
    # Texts are cut slice by slice; what stays of them is a number a word.
    found = [(w.hashes, w.counts) for w in (Words(p.column(0), ALNUM, lower=True) for p in parts)]
    counts = np.concatenate([c for _, c in found])
    _, one, word = np.unique(np.concatenate([h for h, _ in found]), return_index=True, return_inverse=True)
    word, distinct = word.astype(np.int32), len(one)
    texts_of_word, at = np.zeros(distinct), 0
    for h, c in found:
        pairs = np.unique(word[at : at + len(h)].astype(np.int64) * len(c) + np.repeat(np.arange(len(c)), c))
        texts_of_word += np.bincount(pairs // len(c), minlength=distinct)
        at += len(h)
    # Subwords are kept, and later worked on, for some words at a time.
    blocks, texts_of, at = [], np.zeros(buckets), 0
    for p, (h, _) in zip(parts, found, strict=True):
        w, own = Words(p.column(0), ALNUM, lower=True), np.flatnonzero((one >= at) & (one < at + len(h)))
        for k in range(0, len(own), WORDS):
            some = own[k : k + WORDS]
            sub, sub0 = subwords(w, one[some] - at)
            texts_of += np.bincount(sub, np.repeat(texts_of_word[some], np.diff(sub0)), buckets)
            blocks.append((sub, sub0[:-1], np.diff(sub0), some))
        at += len(h)
    del found, parts, texts
    used = np.flatnonzero(texts_of >= min_docs)
    place = np.zeros(buckets, dtype=np.int32)  # 0: without a vector
    place[used] = np.arange(1, len(used) + 1)
    blocks = [(place[sub], first_sub, n, some) for sub, first_sub, n, some in blocks]
    known = np.ones((len(used) + 1, 1), dtype=np.float32)
    known[0] = 0
    edges, first, size = segments(counts)
    texts_with_words = np.flatnonzero(np.diff(first))
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, init, known.shape[:1] + (dim,)).astype(np.float32) * known
    soft = rng.normal(0, 1, (dim, 2)).astype(np.float32)
    bias = np.array([0.0, prior - np.log(max(1.0, len(size) / len(y)))], dtype=np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, soft, bias)]
    by_word, bag = np.zeros((distinct, dim), dtype=np.float32), np.zeros((len(size), dim))
    for step in range(1, epochs + 1):
        lr_now = 1 - (step - 1) / epochs
        for sub, first_sub, n, some in blocks:
            for k in range(dim):
                by_word[some, k] = np.add.reduceat(vectors[sub, k], first_sub) / n
        for k in range(0, len(size), STEP):
            begin = edges[k : k + STEP + 1]
            bag[k : k + STEP] = np.add.reduceat(by_word[word[begin[0] : begin[-1]]], begin[:-1] - begin[0], axis=0) / size[k : k + STEP, None]
        margin = soft[:, 1] - soft[:, 0]
        z = bag @ margin + (bias[1] - bias[0])
        total = np.zeros(len(y))
        total[texts_with_words] = np.add.reduceat(np.logaddexp(0, z), first[texts_with_words])
        pull = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-6, 500)), 1.0)
        g = np.repeat(pull / len(y), np.diff(first)) / (1 + np.exp(-z))
        d_soft = bag.T @ g
        d_word = np.zeros(distinct)
        for k in range(0, len(size), STEP):
            own = size[k : k + STEP]
            d_word += np.bincount(word[edges[k] : edges[min(k + STEP, len(size))]], np.repeat(g[k : k + STEP] / own, own), distinct)
        d_sub = np.zeros(len(known))
        for sub, _, n, some in blocks:
            d_sub += np.bincount(sub, np.repeat(d_word[some] / n, n), len(known))
        d_vec = d_sub[:, None] * margin[None, :]
        d_vec += decay * vectors
        d_vec *= known
        grads = (d_vec, np.stack([-d_soft, d_soft], axis=1), np.array([-g.sum(), g.sum()]))
        for param, grad, (m, v), lr in zip((vectors, soft, bias), grads, moments, rates, strict=True):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * np.square(grad)
            param -= lr * lr_now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weight = np.zeros(buckets, dtype=np.float32)
    weight[used] = vectors[1:] @ (soft[:, 1] - soft[:, 0])
    return Model(weight, float(bias[1] - bias[0]))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that no label is learnt from."""
    return F.crc32(doc_id.cast("string")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: tuple[int, int] = MAX_ROWS, max_bytes: tuple[int, int] = MAX_BYTES) -> Model:
    """Trains on at most ``max_rows`` labelled rows of labels 0 and 1 with at most ``max_bytes`` of text, those of least key hash.

    Held-out rows and rows without label or text are not learnt from; texts of more than a
    sixteenth of the bytes neither, so none shuts out the others.  All others are learnt
    from whole, as far as the bytes reach.  Of rows with one key one is learnt from, that
    of least text hash; a key with both labels counts for each.  Without rows of both
    labels nothing is learnt: every text gets the same score, below the threshold.
    """
    known = labels.where(~held_out(F.col(key)) & F.col(label).isin(0, 1)).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__y"))
    texts = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("__text")).where((F.octet_length("__text") > 0) & ~held_out(F.col("__key")))
    # Keys and labels only are ranked; some more are asked for than are used, since keys without a text fall out.
    ids = None
    for y in (0, 1):
        part = known.where(F.col("__y") == y).dropDuplicates().orderBy(F.xxhash64("__key"), "__key").limit(max_rows[y] * 3 // 2)
        ids = part if ids is None else ids.unionByName(part)
    bound = lambda b: F.when(F.col("__y") == 0, b[0]).otherwise(b[1])
    texts = texts.withColumns({"__hash": F.xxhash64("__text"), "__size": F.octet_length("__text")})
    # Sizes are ranked, then the texts are fetched.
    sizes = texts.select("__key", "__hash", "__size").join(F.broadcast(ids), "__key").groupBy("__key", "__y").agg(F.min(F.struct("__hash", "__size")).alias("__least"))
    sizes = sizes.select("__key", "__y", "__least.*").where(F.col("__size") <= bound(max_bytes) / LARGEST)
    order = Window.partitionBy("__y").orderBy(F.xxhash64("__key"), "__key")
    ranked = sizes.withColumns({"__n": F.row_number().over(order), "__sum": F.sum("__size").over(order)})
    chosen = ranked.where((F.col("__n") <= bound(max_rows)) & (F.col("__sum") <= bound(max_bytes))).select("__key", "__hash", "__y")
    found = texts.join(F.broadcast(chosen), ["__key", "__hash"]).groupBy("__key", "__y").agg(F.min("__text").alias("__text"))
    sample = found.select("__text", "__y").toArrow().combine_chunks()
    if not sample.num_rows:
        return train(pa.array([], pa.string()), np.zeros(0))
    sample = sample.sort_by([("__y", "ascending"), ("__text", "ascending")])
    return train(sample.column("__text").combine_chunks(), sample.column("__y").to_numpy())


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``score`` and ``predicted`` (1 from ``threshold`` on) to each row.

    A null text counts as empty; empty and wordless texts get the chance of an empty
    segment.  Repeated rows are each scored; an empty table gives none.  ``keep`` names the columns that pass through (all by default); input
    columns named like a result are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(_: pa.RecordBatch, texts: pa.Array) -> dict[str, pa.Array]:
        s = shared.value.score(Words(texts, ALNUM, lower=True))
        return {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return map_texts(docs, text, run, "score double, predicted int", keep)


__all__ = ["Model", "fit", "held_out", "score", "train"]
