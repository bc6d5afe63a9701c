"""Quality rules as a short-circuit cascade.

Base metrics are computed for every text.  The cascade's further rules run one after
the other, each only over the texts that all rules before it let pass.  Their order
comes from a bounded sample: a task runs every rule on it and reports seconds and
rejections; rules are then sorted by rejections per second.  A text is kept if no
rule rejects it, so the order changes the cost and never the result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NON_SPACE, Words, byte_class, joined, span_hashes, sums
from .mapping import map_texts

#: Characters that count as symbols.
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
UPPER, ASCII_LOWER = byte_class((65, 90)), byte_class((97, 122))
BANG, NEWLINE = byte_class((33, 33)), 10
WINDOW = 8
#: About how many rows the sample has that orders the rules.
SAMPLE_ROWS = 1000

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean"
)


class Slice:
    """A slice's words and metrics; each metric is computed when first asked for, for some or all texts."""

    def __init__(self, texts: pa.Array):
        self.words = Words(texts, NON_SPACE, lower=False)
        self.n_words = self.words.counts.astype(np.int64)
        self.size = np.diff(self.words.offsets)

    def count(self, table: np.ndarray) -> np.ndarray:
        return sums(table[self.words.data], self.words.offsets)

    def word_chars(self) -> np.ndarray:
        data = self.words.data
        return sums(NON_SPACE[data] & ((data & 0xC0) != 0x80), self.words.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a word, those equal to an earlier line) of each text."""
        data, offsets = self.words.data, self.words.offsets
        docs = len(offsets) - 1
        # Line ends: every newline, and every text's end; a text's line starts follow.
        newlines = np.flatnonzero(data == NEWLINE)
        doc_of = np.searchsorted(offsets, newlines, side="right") - 1
        starts = np.concatenate([offsets[:-1], newlines + 1])
        ends = np.concatenate([newlines, offsets[1:]])
        doc = np.concatenate([np.arange(docs), doc_of])
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        ends = ends[np.lexsort((ends, np.concatenate([doc_of, np.arange(docs)])))]
        full = np.searchsorted(self.words.starts, ends) > np.searchsorted(self.words.starts, starts)
        starts, ends, doc = starts[full], ends[full], doc[full]
        h = span_hashes(data, starts, ends)
        order = np.lexsort((h, doc))
        h, d = h[order], doc[order]
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        return np.bincount(doc, minlength=docs), np.bincount(d[again], minlength=docs)

    def repeat_words(self) -> np.ndarray:
        """Words inside windows of eight that occur twice or more in their text."""
        w = self.words
        at, h = w.windows(WINDOW)
        doc = np.searchsorted(w.first, at, side="right") - 1
        key = joined(doc.astype(np.uint64), h)
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        edges = np.zeros(len(w.starts) + 1, dtype=np.int64)
        np.add.at(edges, at[twice], 1)
        np.add.at(edges, at[twice] + WINDOW, -1)
        return sums(np.cumsum(edges[:-1]) > 0, w.first)


@dataclass(frozen=True)
class Rule:
    """``rejects(texts)`` is true where a text of the slice breaks the rule."""

    name: str
    rejects: Callable[[Slice], np.ndarray]


def _symbols(s: Slice) -> np.ndarray:
    return s.count(SYMBOLS) * 10 > s.n_words


def _shouting(s: Slice) -> np.ndarray:
    upper, lower = s.count(UPPER), s.count(ASCII_LOWER)
    return (upper + lower >= 20) & (upper * 10 > 6 * (upper + lower))


def _exclaiming(s: Slice) -> np.ndarray:
    return s.count(BANG) * 10 > 3 * s.n_words


def _stuttering(s: Slice) -> np.ndarray:
    """Words equal to the word before them."""
    h = s.words.hashes
    same = np.zeros(len(h), dtype=bool)
    same[1:] = h[1:] == h[:-1]
    firsts = s.words.first[:-1]
    same[firsts[firsts < len(h)]] = False
    return sums(same, s.words.first) * 10 > 3 * s.n_words


def _repeated_lines(s: Slice) -> np.ndarray:
    lines, again = s.lines()
    return (lines >= 4) & (again * 2 > lines)


RULES = (
    Rule("symbols", _symbols),
    Rule("shouting", _shouting),
    Rule("exclaiming", _exclaiming),
    Rule("stuttering", _stuttering),
    Rule("repeated_lines", _repeated_lines),
)


def _base(s: Slice) -> dict[str, np.ndarray]:
    repeat = s.repeat_words()
    return {
        "n_words": s.n_words,
        "word_chars": s.word_chars(),
        "n_symbols": s.count(SYMBOLS),
        "n_dup_lines": s.lines()[1],
        "n_repeat_words": repeat,
        "base_failed": (s.n_words < 20) | (100 * repeat > 30 * s.n_words),
    }


def _judge(part: pa.RecordBatch, texts: pa.Array, rules: Sequence[Rule]) -> dict[str, pa.Array]:
    made = _base(Slice(texts))
    kept = ~made["base_failed"]
    for rule in rules:
        left = np.flatnonzero(kept)
        if not len(left):
            break
        kept[left[rule.rejects(Slice(texts.take(pa.array(left))))]] = False
    return {k: pa.array(v) for k, v in made.items()} | {"kept": pa.array(kept)}


def share_of(docs: DataFrame, rows: int) -> float:
    """The share of the table that has about ``rows`` rows."""
    return min(1.0, rows / max(1, docs.count()))


def measure(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, int]]:
    """Seconds and rejections of each rule on about ``sample_rows`` rows of all partitions, taken where the rows are."""

    def run(part: pa.RecordBatch, texts: pa.Array) -> dict[str, pa.Array]:
        spent, hits = [], []
        for rule in rules:
            s, began = Slice(texts), time.perf_counter()
            hits.append(int(rule.rejects(s).sum()))
            spent.append(time.perf_counter() - began)
        rest = [None] * (len(texts) - 1)
        return {"spent": pa.array([spent, *rest], pa.list_(pa.float64())), "hits": pa.array([hits, *rest], pa.list_(pa.int64()))}

    made = map_texts(docs.select(F.col(f"`{text}`")).sample(share_of(docs, sample_rows), seed=11), text, run, "spent array<double>, hits array<bigint>", keep=[])
    found = made.where("spent is not null").select(*[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("spent", "hits") for i in range(len(rules))]).first()
    return {r.name: (float(found[f"spent{i}"] or 0), int(found[f"hits{i}"] or 0)) for i, r in enumerate(rules)}


def ordered(costs: dict[str, tuple[float, int]], rules: Sequence[Rule] = RULES) -> list[Rule]:
    """Rules by rejections per second, most first; ties keep their given order."""
    return sorted(rules, key=lambda r: -costs[r.name][1] / max(costs[r.name][0], 1e-9))


def quality(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS, keep: Sequence[str] | None = None) -> DataFrame:
    """Adds the base metrics, ``base_failed`` and ``kept`` to each row.

    Words are runs of other characters than space and U+0009 to U+000D.  A null or
    empty text has no words, so it fails the base rule.  ``keep`` names the columns
    that pass through (all by default); input columns named like a result are
    replaced.  Repeated rows are judged each for itself; an empty table gives none.
    """
    order = ordered(measure(docs, text, rules, sample_rows), rules) if rules else []
    return map_texts(docs, text, lambda part, texts: _judge(part, texts, order), FIELDS, keep)
