import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import decontamination, quality, queries, toxicity

from .test_kernels import thue_morse

ODD = [None, "", " ", "\n\n", "word", "a b c d e f g h " * 5, "x\nx\nx\ny\n \n \nx", "é ü # * $", "Thwh " * 50, "STOP!! " * 40, "z" * 300_000, "a b c d e f g h i " * 9000]


def docs(spark, texts, **more):
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string")


def base(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if c[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_quality_base_equals_brute_force(spark, sf_dir):
    for d in (docs(spark, ODD), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = {r.doc_id: r.text for r in d.collect()}
        got = quality.quality(d, keep=["doc_id"]).collect()
        assert sorted(r.doc_id for r in got) == sorted(texts)
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), r.doc_id
            assert not (r.base_failed and r.kept)


def test_quality_verdict_keeps_clean_and_any_order_agrees(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a = quality.quality(d, keep=["doc_id"])
    b = quality.quality(d, rules=quality.RULES[::-1], keep=["doc_id"])
    assert a.exceptAll(b).count() == 0
    rows = a.join(labels, "doc_id").where(~F.col("base_failed")).collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)
    assert quality.ordered({"symbols": (1.0, 1), "shouting": (0.1, 1)}, quality.RULES[:2])[0].name == "shouting"


def test_texts_that_cancel_out_in_a_polynomial_hash_are_told_apart(spark):
    a, b = thue_morse()
    rest = " ".join(f"w{i}" for i in range(30))
    texts = [f"{a}\n{b}\n{rest}", f"{a}\n{a}\n{rest}", " ".join([a, *"bcdefgh", b, *"bcdefgh"])]
    for r in quality.quality(docs(spark, texts), keep=["doc_id"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), r.doc_id


def test_columns_that_clash_in_another_case_or_with_inner_names(spark):
    d = spark.createDataFrame([(1, "a b", 7, True)], "doc_id long, text string, __text int, Kept boolean")
    r = quality.quality(d).where("not kept").first()
    assert (r["__text"], r.n_words) == (7, 2) and quality.quality(d).columns.count("Kept") == 0


def test_quality_of_an_empty_table(spark):
    assert quality.quality(docs(spark, []), keep=["doc_id"]).count() == 0


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w = words_of(text)
    hit, found = set(), []
    for item, t in items:
        x = words_of(t)
        n = min(13, len(x))
        wins = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in wins] if n else []
        if at:
            found += [str(item)] if item is not None and str(item) not in found else []
            hit.update(j for i in at for j in range(i, i + n))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [1 << 24, 2000])
def test_decontamination_equals_brute_force(spark, sf_dir, block):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").unionByName(
        spark.createDataFrame([(900, "Short one"), (901, None), (902, "..."), (903, "short ONE"), (904, "ünï"), (None, "only without id"), (900, "Short one"), (900, "other text"), *[(905, "z z y z z y " * 20)] * 30], "item_id long, text string")
    )
    items = [(r.item_id, r.text) for r in b.collect()]
    own = docs(spark, [*ODD, "a short, one! short one", "x ünï " * 30, (items[0][1] or "") + " tail", "now only without id it is other text", "z z y " * 40])
    for d in (own, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = {r.doc_id: r.text for r in d.collect()}
        got = decontamination.find_contamination(d, b, keep=["doc_id"], block_bytes=block)
        for r in got.withColumn("digest", decontamination.items_digest("hit_items")).collect():
            assert (r.n_words, r.n_hit, len(r.hit_items), r.digest, r.contaminated) == brute(texts[r.doc_id], items), r.doc_id


def test_spans_are_cut_and_nulls_stay(spark):
    b = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    d = docs(spark, ["zero ONE, two. three", None, "", "one two"])
    got = {r.doc_id: r.text for r in decontamination.remove_spans(decontamination.find_contamination(d, b)).collect()}
    assert got == {0: "zero . three", 1: None, 2: "", 3: ""}


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_decontamination_keeps_rows_and_columns(spark, block):
    b = spark.createDataFrame([(i, f"one two {i}") for i in range(9)], "item_id long, text string")
    rows = [(None, "one two 3", 1, 2), (4, "One two 4 and one two 5", 1, 2), (4, "One two 4 and one two 5", 1, 2), (5, None, 1, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, N_Hit int, __row int").repartition(3)
    got = decontamination.find_contamination(d, b, block_bytes=block)
    assert got.columns == ["doc_id", "text", "__row", "n_words", "hit_spans", "hit_items", "n_hit", "contaminated"]
    assert sorted(((r.doc_id, r.n_hit, r.hit_items, len(r.hit_spans)) for r in got.collect()), key=str) == sorted([(None, 3, ["3"], 1), (4, 6, ["4", "5"], 2), (4, 6, ["4", "5"], 2), (5, 0, [], 0)], key=str)
    assert decontamination.find_contamination(d.limit(0), b, block_bytes=block).count() == 0


def test_a_passage_of_many_items_costs_little():
    import time
    import tracemalloc

    import pyarrow as pa

    passage = " ".join(f"p{i}" for i in range(40))
    index = decontamination.Index([str(i) for i in range(3000)], [f"{'u' * (i % 7)}{i} v{i} {passage} w{i}" for i in range(3000)])
    tracemalloc.start()
    began = time.perf_counter()
    got = decontamination._scan(pa.array([f"{passage} " * 4000, f"v7 {passage}"]), index)
    assert time.perf_counter() - began < 10 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert [len(x) for x in got["hit_items"].to_pylist()] == [3000, 3000]


def test_an_index_stays_small():
    import tracemalloc

    texts = [" ".join(f"w{(i * 7919 + k * k) % 50000}" for k in range(120)) for i in range(12_000)]
    tracemalloc.start()
    decontamination.Index(list(map(str, range(len(texts)))), texts)
    assert sum(map(len, texts)) > 8e6 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_empty_benchmark_finds_nothing(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(docs(spark, ODD), b).where("contaminated").count() == 0


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_a_long_text_shuts_out_no_other(spark):
    """Texts beyond a part of the bytes are not learnt from, and change nothing for the rest, whatever their keys."""
    rows = [(i, f"the {'idiotic' if i % 2 else 'kindly'} {'abcdefgh'[i % 8]} over") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    long = [(i, "kindly idiotic " * 400) for i in range(400, 2000, 3)]
    make = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    bound = {"max_bytes": (40_000, 40_000)}
    model = toxicity.fit(make(rows), labels, **bound)
    assert (toxicity.fit(make(rows + long), labels, **bound).weight == model.weight).all()
    got = toxicity.score(make(rows), model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_scores_equal_a_plain_loop(spark):
    """Noisy-or over the averages of ten-word segments, word by word."""
    import math

    import numpy as np
    import pyarrow as pa

    from tapeloom.llm.kernels import ALNUM, Words

    texts = [f"the {w} {x} over" for w in ("idiotic", "idiots") for x in "abcdefghij"] + [f"the kind{w} {x} over" for w in ("ly", "") for x in "abcdefghij"]
    model = toxicity.train(pa.array(texts), np.array([1] * 20 + [0] * 20))
    asked = ["", None, "idiot", "the kind x over " * 9, "one two three four five six seven eight nine ten idiots", *texts]
    got = model.score(Words(pa.array(asked), ALNUM, lower=True))
    for t, s in zip(asked, got, strict=True):
        w = Words(pa.array([t]), ALNUM, lower=True)
        each = toxicity.word_scores(w, model.weight)
        edges, first, size = toxicity.segments(w.counts)
        clean = 1.0
        for a, b in zip(edges[:-1], edges[1:]) if len(each) else [(0, 0)]:
            z = model.bias + (sum(each[a:b]) / (b - a) if b > a else 0)
            clean *= 1 - 1 / (1 + math.exp(-z))
        assert s == pytest.approx(1 - clean, rel=1e-6)


def test_toxicity_of_odd_texts_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, ODD), none)
    got = toxicity.score(docs(spark, ODD), model, keep=["doc_id", "kept"]).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)


def test_misspellings_share_vectors():
    import numpy as np
    import pyarrow as pa

    from tapeloom.llm.kernels import ALNUM, Words

    texts = [f"the {w} {x} over" for w in ("idiotic", "idiots", "idiot") for x in "abcdefghij"] + [f"the kind{w} {x} over" for w in ("ly", "", "ness") for x in "abcdefghij"]
    model = toxicity.train(pa.array(texts), np.array([1] * 30 + [0] * 30))
    a, b = model.score(Words(pa.array(["the idiott a over", "the kindy a over"]), ALNUM, True))
    assert a > 0.5 > b
