import re
import zlib
from collections import Counter

import pyarrow as pa

from tapeloom.llm import queries, spelling


def brute(rows, length=5, count=3):
    c = Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= length:
                c[w] += 1
    c = {w: n for w, n in c.items() if n >= count}
    near, holes = {w: set() for w in c}, {}
    for w in c:
        for i in range(len(w)):
            holes.setdefault((len(w), i, w[:i] + w[i + 1 :]), set()).add(w)
    for w in c:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            near[w] |= holes[len(w), i, less] - {w}
            if less in c:
                near[w].add(less)
                near[less].add(w)
    best = {w: min(near[w], key=lambda v: (-c[v], v), default=None) for w in c}
    form = {w: b if b and c[b] >= 2 * c[w] else None for w, b in best.items()}
    out = {}
    for w in c:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, c[w], len(near[w]), c[form[w]] if form[w] else None)
    return out


def plain(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_spelling_groups(spark, sf_dir)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert plain(got) == brute(rows)


def test_odd_texts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spelling, "NODE_WORDS", 3)  # edges are dealt over copies
    chain = " ".join("aaaa" + "a" * i for i in range(1, 9))
    long = "étÉÿ" * 5_000
    texts = [
        None, "", "x", "×÷Àà ĀabcdeĀ", chain, "Hello hello HELLO hellp Hellø hallo hell hellos shello", "abcde abcdf abced bcdef abcdef abcdefg",
        f"{long} {long}s {long[:-1]}", "straße straßen strasse", " ".join(f"{a}{b}cdef" for a in "abcé" for b in "abc"), "don't co-operate naïvé naïve",
    ]
    rows = [(k, t) for k in (1, 2, None, 97, 5, 5) for t in texts]
    rows += [(9, "abcde " * (4 ** i)) for i in range(5)]
    d = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n int, word string")
    assert plain(spelling.spelling_groups(d)) == brute(rows)
    assert plain(spelling.spelling_groups(d, length=3, count=1)) == brute(rows, 3, 1)
    assert spelling.spelling_groups(d.limit(0)).count() == 0


def test_sums_of_runs():
    texts = pa.array(["Abc Àÿz" + "q" * 100, "", "é", "Āé"])
    data, starts, ends, doc = spelling.runs(texts)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert list(zip(words, doc.tolist())) == [("abc", 0), ("Àÿz" + "q" * 100, 0), ("é", 2), ("é", 3)]
    begun = [zlib.crc32(f"{d}:".encode()) for d in doc]
    assert spelling.crc32s(data, starts, ends, spelling.np.array(begun)).tolist() == [zlib.crc32(f"{d}:{w}".encode()) for w, d in zip(words, doc)]
