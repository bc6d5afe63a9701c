import hashlib
import random
import re
from collections import Counter

import pytest

from tapeloom.llm import hotkeys, queries, repeats


def brute(rows, window=50):
    """(doc, n_words, n_removed, digest, spans) of each row; a row without an id comes after all others."""
    rank = lambda k: (k is None, k or 0)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (k, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            least[x] = min(least.get(x, rank(k)), rank(k))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < rank(k):
                gone[i : i + window] = [True] * window
        spans = tuple((m.start(), m.end()) for m in re.finditer("x+", "".join("x" if g else "." for g in gone)))
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), spans))
    return out


def plain(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, tuple(map(tuple, r.removed_spans))) for r in df.collect())


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(map(tuple, queries.op13_substring_dedup(spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    assert got == Counter(r[:4] for r in brute(rows))
    assert sum(r[2] > 0 for r in brute(rows)) > 10


def odd():
    rnd = random.Random(3)
    say = lambda n: " ".join(rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(n))
    common, other = say(70), say(51)
    texts = [None, "", " \t\n", "a", say(49), say(50), "x " * 200, "x " * 120, "x y " * 60, f"{say(30)} {common} {say(30)}", f"{common}\n{common}\t{other}", f"{say(5)} {other} {say(3)} {common[: len(common) // 2]}"]
    texts += [f"{say(rnd.randint(0, 60))} {common} {say(rnd.randint(0, 9))}" for _ in range(12)] + [common] * 5
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[9]), (3, other), (None, common), (None, f"{say(9)} {other}"), (None, other), (40, texts[10]), (40, texts[10]), (2, say(2000)), (7, say(20) + f" {common} " * 30)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("many", "keys"), [(repeats.MANY, hotkeys.LEAST), (1, 1), (3, 2)])
def test_odd_rows_equal_brute_force(spark, monkeypatch, many, keys):
    """Also with nearly all suffixes dealt over salts, and nearly all keys broadcast."""
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(hotkeys, "LEAST", keys)
    rows = odd()
    d = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_words int, row string").repartition(3)
    assert plain(repeats.find_repeats(d)) == Counter(brute(rows))


def test_other_windows_and_texts(spark):
    rows = odd()
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert plain(repeats.find_repeats(d, window=11, gram=3)) == Counter(brute(rows, 11))
    assert repeats.find_repeats(d.limit(0)).count() == 0
    one = d.where("doc_id = 10")
    cut = repeats.without_spans(one.join(repeats.find_repeats(d).drop("n_words"), "doc_id")).collect()[0]
    assert hashlib.sha256(cut.text.encode()).hexdigest() == cut.kept_sha256
