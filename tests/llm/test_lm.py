import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapeloom.llm import lm, queries

from .test_kernels import thue_morse


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def brute(rows, train):
    c = Counter(x for k, t in rows if train(k) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return {k: (len(x := tokens(t)), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x)) for k, t in rows}


@pytest.mark.parametrize("common", [1 << 20, 50, 0])
def test_base_equals_brute_force(spark, sf_dir, common):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "unseen! z" + "z" * 100000), (9004, "the the THE"), *enumerate(thue_morse(), 9005), (9007, f"{thue_morse()[0]} x {thue_morse()[0]}")], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in d.collect()]
    want = brute(rows, lambda k: zlib.crc32(str(k).encode()) % 5 != 1)
    got = lm.score(d, train=~lm.held_out(d.doc_id), common=common).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.score <= 0


def test_model_beats_unigrams_on_held_out_texts(spark):
    rows = [r for r in queries.op10_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_filter_levels_are_never_too_low():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 63, 20000).astype(np.uint64))
    counts = rng.integers(1, 2000, len(h))
    for limit in (1 << 20, 20000):
        table, least = lm.build_slice(h, counts, limit)
        assert table.nbytes <= limit
        f = lm.Filter([(0, table.tobytes(), least)], 1)
        got, want = f.levels(np.zeros(len(h), dtype=np.int64), h), lm.level_of(counts)
        assert (got >= want)[want >= least].all()
        assert (got == want)[want >= least].mean() > 0.9
        other = np.unique(rng.integers(0, 1 << 63, 20000).astype(np.uint64))
        assert (f.levels(np.zeros(len(other), dtype=np.int64), other) > 0).mean() < 0.12


def test_probabilities_of_a_context_sum_to_about_one():
    words = {"a": 40, "b": 25, "c": 10}
    mu, n, v = lm.MU, 76, 4
    p = sum((pair + mu * (c + 0.5) / (n + 0.5 * (v + 1))) / (40 + mu) for pair, c in ((20, 40), (15, 25), (4, 10), (1, 1), (0, 0)))
    assert p == pytest.approx(1, abs=0.02) and words


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.score(d.limit(0)).count() == 0
    r = lm.score(d, train=d.doc_id < 0).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)


def test_slices_that_are_not_broadcast_lose_nothing(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, None), (9002, ""), (9003, "only once here"), (9004, "only once there")], "doc_id long, text string")).repartition(3)
    d.cache()
    whole, apart = ({r.doc_id: r.asDict() for r in lm.score(d, common=50, max_filter_bytes=n).collect()} for n in (1 << 30, 0))
    assert whole.keys() == apart.keys()
    for k, r in whole.items():
        assert apart[k] == pytest.approx(r, rel=1e-9)
