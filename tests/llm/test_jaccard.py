import random
import re

import numpy as np
import pytest

from tapeloom.llm import components, jaccard, queries

from .test_kernels import thue_morse


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i)) if s else k) for i, (k, s) in enumerate(sets)), key=str)


def made(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "one", "ONE", "one two", "a b c d e", "z" * 200000, "x y " * 20000, *thue_morse(), "a b c d " + thue_morse()[0], "a b c d " + thue_morse()[1]]
    for n in (7, 12, 30, 120, 400):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(n)]
            for edits in range(0, max(2, n // 12)):
                t = list(base)
                for _ in range(edits):
                    t[rng.randrange(n)] = rng.choice(words)
                texts.append(" ".join(t))
    common = " ".join(rng.choice(words) for _ in range(60))
    texts += [common + " " + " ".join(rng.choice(words) for _ in range(rng.choice((10, 19, 20, 21, 40)))) for _ in range(40)]
    # A chain: each a little off the one before.
    t = [rng.choice(words) for _ in range(100)]
    for _ in range(12):
        t = t[3:] + [rng.choice(words) for _ in range(3)]
        texts.append(" ".join(t))
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(5, texts[9]), (5, texts[10]), (None, texts[11]), (None, None)]


def test_components_equal_brute_force(spark):
    rows = made()
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, class string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(d).collect()), key=str)
    assert got == brute(rows)
    assert jaccard.near_duplicates(d.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.op7_ngram_jaccard(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("seed", range(6))
def test_bits_and_prefixes_lose_no_link(seed):
    rng = np.random.default_rng(seed)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2654435761))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, max(1, n // 10)).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if len(b) and jaccard.links(len(a), len(b), both):
            d = jaccard.differing_bits(jaccard.parity_bitmap(a), jaccard.parity_bitmap(b))
            assert d <= len(a) + len(b) - 2 * both
            x, y = (np.frombuffer(jaccard.signature(jaccard.parity_bitmap(z)), dtype=np.uint64)[None] for z in (a, b))
            assert jaccard.may_link(x, y, np.array([len(a)]), np.array([len(b)])).all()
            p, q = (x[: int(jaccard.prefix_size(np.array([len(x)]))[0])] for x in (a, b))
            assert len(np.intersect1d(p, q))


def test_tile_pairs_of_long_and_short_lists_agree():
    rng = np.random.default_rng(1)
    c = np.arange(600)
    root = np.where(rng.random(600) < 0.8, 0, c)
    n = rng.integers(10, 40, 600)
    got = set(zip(*(x.tolist() for x in jaccard.pairs_of_tile(np.full(600, 7, dtype=np.uint64), c, root, n, np.zeros(600))[:2]), strict=True))
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if root[i] != root[j] and 4 * min(n[i], n[j]) >= 3 * max(n[i], n[j])}
    assert got == want


def test_many_unlinked_texts_on_one_element_cost_little():
    import time

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 150).astype(np.uint64)) for _ in range(4000)]
    sets[17] = np.unique(np.r_[sets[3][:140], sets[17][:5]])
    sig = np.stack([np.frombuffer(jaccard.signature(jaccard.parity_bitmap(s)), dtype=np.uint64) for s in sets])
    c, n = np.arange(4000), np.array([len(s) for s in sets])
    began = time.perf_counter()
    a, b, _ = jaccard.pairs_of_tile(np.full(4000, 7, dtype=np.uint64), c, c, n, np.zeros(4000), 4, sig, c)
    assert time.perf_counter() - began < 20
    assert (3, 17) in set(zip(a.tolist(), b.tolist(), strict=True)) and len(a) < 1000


def test_hot_keys_and_many_groups_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 3)
    monkeypatch.setattr(jaccard, "GROUP_BYTES", 100_000)
    rows = [*made(7), *((1000 + i, made(7)[12][1]) for i in range(20))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(d).collect()), key=str) == brute(rows)


def test_a_spread_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT", 2)
    rows = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 0), (3, 0)], "a long, i long")
    one = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "a long, v string")
    for how in ("inner", "left"):
        assert sorted(map(tuple, components.spread_join(rows, one, "a", how).collect()), key=str) == sorted(map(tuple, rows.join(one, "a", how).collect()), key=str)


def test_a_tile_that_leaves_pairs_out_says_so():
    element, c, root = np.full(40, 1, dtype=np.uint64), np.arange(40), np.arange(40) % 2
    a, b, more = jaccard.pairs_of_tile(element, c, root, np.full(40, 30), np.zeros(40), 3)
    assert len(a) == 3 and more.all() and (root[a] != root[b]).all()
    a, b, more = jaccard.pairs_of_tile(element[:3], c[:3], np.arange(3), np.full(3, 30), np.zeros(3), 3)
    assert len(a) == 3 and not more.any()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 102), (102, 101), (7, 7)]
    d = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components.components(d).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}
    assert components.components(d.limit(0)).count() == 0


def test_common_shingles_come_last(spark):
    d = spark.createDataFrame([(i, f"a b c d e own{i} x{i} y{i} z{i}") for i in range(20)], "doc_id long, text string")
    for groups in (1, 7):
        order = jaccard.shingle_order(d, "text", groups)
        import pyarrow as pa

        h, first = jaccard.shingle_sets(pa.array(["a b c d e own1 x1 y1 z1"]))
        assert sorted(order.level(h).tolist()) == [0, 0, 0, 0, 4]
    assert not len(jaccard.shingle_order(d, "text", 3, most_common=0).codes)
