"""Byte-level BPE by speculation and verification.

Texts are cut into pieces; each piece that a worker has not seen yet is first cut
greedily into the longest vocabulary entries.  A cut is the exact BPE result if and
only if every two neighbouring tokens stay apart when merged exactly on their own, so
all neighbours are checked, as arrays, against a table of verdicts.  Pieces with a
failing pair, and pieces of over ``LONG`` bytes, are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .mapping import map_texts
from .pretokens import Cache, Points, ranges, spaced_pieces

#: Bytes up to which a piece is cut and merged in arrays of equal rows.
LONG = 64
_NONE = np.int32(1 << 30)


def byte_of_char() -> dict[str, int]:
    """The public byte alphabet: printable bytes stand for themselves, the others for U+0100 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Vocabulary:
    """Tables of a byte-level BPE model; a few megabytes whatever the corpus."""

    tokens: list[bytes]
    merge_key: np.ndarray  # left << 16 | right, ascending
    merge_rank: np.ndarray
    merge_to: np.ndarray
    base: np.ndarray  # token of each byte
    special: dict[str, int]
    node_key: np.ndarray = field(default=None)  # node << 8 | byte, ascending
    node_to: np.ndarray = field(default=None)
    accepts: np.ndarray = field(default=None)  # token that ends at a node, or -1

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = byte_of_char()
        vocab = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        if len(tokens) > 1 << 16:
            raise ValueError("ids of more than 16 bits are not supported")
        for token, i in vocab.items():
            tokens[i] = bytes(table[c] for c in token)
        for token, i in special.items():
            tokens[i] = token.encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], dtype=np.uint32)
        to = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(key, kind="stable")
        char = {b: c for c, b in table.items()}
        base = np.array([vocab[char[b]] for b in range(256)], dtype=np.int32)
        v = cls(tokens, key[order], np.arange(len(pairs), dtype=np.int32)[order], to[order], base, special)
        v._trie(set(special.values()))
        return v

    def _trie(self, leave_out: set[int]) -> None:
        """A trie of the tokens that exact merging makes of their own bytes; no other can be in a result."""
        ids = np.array([i for i, t in enumerate(self.tokens) if t and i not in leave_out and len(t) <= LONG])
        out, size = self.merge([self.tokens[i] for i in ids])
        first = np.cumsum(size) - size
        ids = ids[(size == 1) & (out[first] == ids)]
        keys: dict[int, int] = {}
        accepts = [-1]
        for i in ids.tolist():
            node = 0
            for b in self.tokens[i]:
                k = node << 8 | b
                if k not in keys:
                    keys[k] = len(accepts)
                    accepts.append(-1)
                node = keys[k]
            accepts[node] = i
        order = sorted(keys)
        self.node_key, self.node_to = np.array(order, dtype=np.int64), np.array([keys[k] for k in order], dtype=np.int64)
        self.accepts = np.array(accepts, dtype=np.int32)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of the pair among the merges' keys, by rank; _NONE if it does not merge."""
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
        return np.where((self.merge_key[at] == key) & (left >= 0) & (right >= 0), self.merge_rank[at], _NONE)

    def _to(self) -> np.ndarray:
        if not hasattr(self, "_by_rank"):
            self._by_rank = np.zeros(len(self.merge_to), dtype=np.int32)
            self._by_rank[self.merge_rank] = self.merge_to
        return self._by_rank

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of all pieces: (ids in turn, number of each)."""
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        results: list[np.ndarray | None] = [None] * len(pieces)
        limits = (4, 8, 16, 32, LONG)
        for lo, hi in zip((0, *limits), limits, strict=False):
            rows = np.flatnonzero((size > lo) & (size <= hi))
            if len(rows):
                for i, found in zip(rows.tolist(), self._merge_rows([pieces[i] for i in rows], size[rows], hi), strict=True):
                    results[i] = found
        for i in np.flatnonzero(size > LONG).tolist():
            results[i] = self._merge_long(pieces[i])
        results = [np.zeros(0, dtype=np.int32) if r is None else r for r in results]
        return np.concatenate(results) if results else np.zeros(0, dtype=np.int32), np.array([len(r) for r in results], dtype=np.int64)

    def _merge_rows(self, pieces: list[bytes], size: np.ndarray, width: int) -> list[np.ndarray]:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.base[raw], -1).astype(np.int32)
        rank = np.full(ids.shape, _NONE, dtype=np.int32)
        rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        done = ids.copy()
        live = np.arange(len(ids))
        to = self._to()
        while len(live):
            at = rank.argmin(axis=1)
            row = np.arange(len(at))
            best = rank[row, at]
            more = best < _NONE
            if not more.all():
                done[live[~more]] = ids[~more]
                live, ids, rank, at, best = live[more], ids[more], rank[more], at[more], best[more]
                row = np.arange(len(at))
                if not len(live):
                    break
            moved = column > at[:, None]
            nxt = np.concatenate([ids[:, 1:], np.full((len(ids), 1), -1, dtype=np.int32)], axis=1)
            ids = np.where(moved, nxt, ids)
            ids[row, at] = to[best]
            nxt = np.concatenate([rank[:, 1:], np.full((len(rank), 1), _NONE, dtype=np.int32)], axis=1)
            rank = np.where(moved, nxt, rank)
            right = np.where(at + 1 < width, ids[row, np.minimum(at + 1, width - 1)], -1)
            rank[row, at] = self._rank(ids[row, at], right)
            has = at > 0
            rank[row[has], at[has] - 1] = self._rank(ids[row[has], at[has] - 1], ids[row[has], at[has]])
        return [r[r >= 0] for r in done]

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """Exact merging of one long piece with a heap, in n log n steps."""
        ids = self.base[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges = {int(k): (int(r), int(t)) for k, r, t in zip(self.merge_key, self.merge_rank, self.merge_to, strict=True)} if not hasattr(self, "_merges") else self._merges
        self._merges = merges
        heap = [(merges[k][0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := ids[i] << 16 | ids[i + 1]) in merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a << 16 | b][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (k := ids[left] << 16 | ids[right]) in merges:
                    heapq.heappush(heap, (merges[k][0], left, ids[left], ids[right]))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_merges", "_by_rank")}


class Encoder:
    """A worker's state: the vocabulary, pieces encoded so far, and verdicts on neighbouring tokens."""

    MAX_PAIRS = 1_000_000

    def __init__(self, v: Vocabulary):
        self.v = v
        self.cache = Cache()
        self.pair_key, self.pair_good = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=bool)
        self.stats = {"pieces": 0, "merged": 0}
        self.size = np.array([len(t) for t in v.tokens], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(v.tokens), dtype=np.uint8)

    def speculate(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches: (ids in turn, number of each piece)."""
        v = self.v
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        stop = np.cumsum(size)
        live = np.flatnonzero(size > 0)
        look = (stop - size)[live]
        end = stop[live]
        node = np.zeros(len(live), dtype=np.int64)
        good_to, good_id = look.copy(), np.full(len(live), -1, dtype=np.int32)
        owners, found = [], []
        while len(live):
            inside = look < end
            key = node << 8 | data[np.minimum(look, len(data) - 1)]
            at = np.minimum(np.searchsorted(v.node_key, key), len(v.node_key) - 1)
            goes = inside & (v.node_key[at] == key)
            node = np.where(goes, v.node_to[at], 0)
            look = np.where(goes, look + 1, look)
            token = np.where(goes, v.accepts[node], -1)
            good_to = np.where(token >= 0, look, good_to)
            good_id = np.where(token >= 0, token, good_id)
            stuck = np.flatnonzero(~goes)
            if len(stuck):
                owners.append(live[stuck])
                found.append(good_id[stuck])
                look[stuck] = good_to[stuck]
                good_id[stuck] = -1
                left = look < end
                left[goes] = True
                if not left.all():
                    live, look, end, node, good_to, good_id = (x[left] for x in (live, look, end, node, good_to, good_id))
        owner = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate(found)[order] if found else np.zeros(0, dtype=np.int32)
        return ids, np.bincount(owner, minlength=len(pieces))

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether exact merging of the two tokens' bytes gives these two tokens."""
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        asked = np.unique(key)
        new = asked[~np.isin(asked, self.pair_key, assume_unique=True)]
        if len(new):
            a, b = (new >> np.uint32(16)).astype(np.int32), (new & np.uint32(0xFFFF)).astype(np.int32)
            ids, size = self.v.merge([self.v.tokens[x] + self.v.tokens[y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            first = np.cumsum(size) - size
            good = (size == 2) & (ids[first] == a) & (ids[np.minimum(first + 1, len(ids) - 1)] == b)
            if len(self.pair_key) > self.MAX_PAIRS:
                keep = np.isin(self.pair_key, asked)
                self.pair_key, self.pair_good = self.pair_key[keep], self.pair_good[keep]
            order = np.argsort(all_keys := np.concatenate([self.pair_key, new]))
            self.pair_key, self.pair_good = all_keys[order], np.concatenate([self.pair_good, good])[order]
        return self.pair_good[np.searchsorted(self.pair_key, key)]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        short = np.array([len(p) <= LONG for p in pieces], dtype=bool)
        ids, size = self.speculate([p if s else b"" for p, s in zip(pieces, short.tolist(), strict=True)])
        owner = np.repeat(np.arange(len(pieces)), size)
        wrong = ~short
        if len(ids) > 1:
            near = np.flatnonzero(owner[1:] == owner[:-1])
            bad = near[~self.apart(ids[near], ids[near + 1])]
            wrong[owner[bad]] = True
        redo = np.flatnonzero(wrong)
        self.stats["pieces"] += len(pieces)
        self.stats["merged"] += len(redo)
        if not len(redo):
            return ids, size
        more, more_size = self.v.merge([pieces[i] for i in redo.tolist()])
        good = ~wrong[owner]
        final = size.copy()
        final[redo] = more_size
        out = np.empty(int(final.sum()), dtype=np.int32)
        first = np.cumsum(final) - final
        out[ranges(first[~wrong], final[~wrong])] = ids[good]
        out[ranges(first[redo], more_size)] = more
        return out, final

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of each text); special tokens inside texts count as such."""
        special = self.v.special
        listed = texts.to_pylist() if special and any(s.encode() in _raw(texts) for s in special) else None
        if listed is None:
            return self._encode(texts)
        parts, owner, ids_of = [], [], []
        for d, t in enumerate(listed):
            for piece, token in _cut(t or "", special):
                parts.append(piece)
                owner.append(d)
                ids_of.append(token)
        ids, size = self._encode(pa.array(parts, pa.large_string()))
        first = np.cumsum(size) - size
        out, count = [], np.zeros(len(listed), dtype=np.int64)
        for k, (d, token) in enumerate(zip(owner, ids_of, strict=True)):
            out.append(ids[first[k] : first[k] + size[k]])
            if token is not None:
                out.append(np.array([token], dtype=np.int32))
            count[d] += size[k] + (token is not None)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int32), count

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        p = Points(texts)
        starts, ends = spaced_pieces(p)
        ids, size = self.cache.encoded(p.data, p.at, starts, ends, self.encode_pieces)
        total = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        return ids, np.diff(total[np.searchsorted(starts, p.offsets)])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes[ranges(self.begin[ids], self.size[ids])].tobytes()


def _raw(texts: pa.Array) -> bytes:
    from .kernels import buffer_of

    return buffer_of(texts)[0].tobytes()


def _cut(text: str, special: dict[str, int]):
    """Pieces of text, each with the special token that follows it (None at the end); the leftmost, then longest token counts."""
    at = 0
    while True:
        nearest = min(((i, -len(s), s) for s in special if (i := text.find(s, at)) >= 0), default=None)
        if nearest is None:
            yield text[at:], None
            return
        i, _, s = nearest
        yield text[at:i], special[s]
        at = i + len(s)


#: One encoder a Python worker, by vocabulary.
_encoders: dict[str, Encoder] = {}


def encoder_of(v: Vocabulary, name: str) -> Encoder:
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(v)
    return _encoders[name]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the token ids of each text (a list column), and its decoded text if ``decoded`` names a column.

    A null or empty text has no ids.  ``path`` is a byte-level BPE file on the driver;
    its tables are broadcast.  ``keep`` names the columns that pass through (all by
    default); input columns named like a result are replaced.
    """
    v = Vocabulary.load(path)
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(_: pa.RecordBatch, texts: pa.Array) -> dict[str, pa.Array]:
        e = encoder_of(shared.value, path)
        flat, size = e.encode(texts)
        bounds = np.concatenate([[0], np.cumsum(size)])
        made = {ids: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.astype(np.int32)))}
        if decoded:
            made[decoded] = pa.array([e.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
        return made

    return map_texts(docs, text, run, f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else ""), keep)


def digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``n_tokens`` and SHA-256 digests of the ids (little-endian, 32 bits each) and of the decoded text.

    The same encoding and decoding as :func:`encode`, with digests taken where the ids
    are made, so neither ids nor texts travel back.
    """
    v = Vocabulary.load(path)
    shared = docs.sparkSession.sparkContext.broadcast(v)

    def run(_: pa.RecordBatch, texts: pa.Array) -> dict[str, pa.Array]:
        e = encoder_of(shared.value, path)
        flat, size = e.encode(texts)
        bounds = np.concatenate([[0], np.cumsum(size)])
        little = flat.astype("<u4")
        own = [(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        back = [e.decode(flat[a:b]) for a, b in own]
        return {
            "n_tokens": pa.array(size.astype(np.int64)),
            "ids_sha256": pa.array([hashlib.sha256(little[a:b].tobytes()).hexdigest() for a, b in own], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in back], pa.string()),
        }

    return map_texts(docs, text, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep)
