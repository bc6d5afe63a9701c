import hashlib
import struct

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry

from .test_jaccard import brute as components
from .test_quality_decontamination_toxicity import base, brute as contamination


def test_each_stage_keeps_what_its_rule_keeps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = corpus_pipeline.written(docs)
        steps.append({r.doc_id: r.text for r in docs.collect()})
    good, clean, single, new = steps
    assert all(whole[k] == t for s in steps for k, t in s.items())
    assert not any(base(t)[5] for t in good.values())
    assert all(k in good for k, r in labels.items() if r.quality == 1 and not base(whole[k])[5])
    assert set(clean) < set(good)
    assert sorted(single) == sorted({c for _, _, c in components(list(clean.items()))})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(new) == sorted(k for k, t in single.items() if not contamination(t, items)[4])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    last = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.encode(spark, docs, sf_dir).collect()}
    ids = {k: t.encode(x, add_special_tokens=False).ids for k, x in new.items()}
    assert last == {k: hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest() for k, x in ids.items()}
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf_dir).collect()} == last


def test_one_row_of_each_group_stays(spark, sf_dir):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [
        (1, a), (1, a), (1, a),  # repeated rows
        (2, b), (3, b + " more"), (3, c),  # one of two texts of id 3 is a near copy, the other is its only one
        (None, d), (None, d), (None, a),  # null ids: a repeated text, and a copy of another id's
        (4, None), (5, ""),
    ]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars int").repartition(4)
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=str) == sorted([(1, a), (2, b), (3, c), (None, d), (4, None), (5, "")], key=str)


LONG = " ".join(f"long{i}" for i in range(30_000))


def odd(spark, *rows):
    made = [(k, t, None, None, len(t or ""), True, 1.0) for k, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars int, Kept boolean, score double").repartition(3)


def kept(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_of_odd_and_empty_tables(spark, sf_dir, stage):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("length(text) > 200").first().text
    clean = " ".join(f"clean{i} word{i}" for i in range(30))
    rows = [(1, clean), (1, clean), (None, clean + " x"), (None, None), (2, None), (3, ""), (4, LONG), (5, item + " " + item)]
    got = stage(spark, odd(spark, *rows), sf_dir)
    if stage is corpus_pipeline.encode:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted((k is None, k or 0) for k, _ in rows)
    else:
        assert got.columns == corpus_pipeline.COLUMNS
        want = {
            "quality_rules": [r for r in rows if r[1] and len(r[1].split()) >= 20 and not base(r[1])[5]],
            "near_duplicates": [(1, clean), (2, None), (3, ""), (4, LONG), (5, rows[-1][1]), (None, None)],
            "decontaminate": rows[:-1],
            "toxicity_filter": rows,  # no labelled row is here: nothing is learnt, every text has the same chance
        }[stage.__name__]
        assert kept(got) == sorted(want, key=str)
    assert stage(spark, odd(spark).limit(0), sf_dir).count() == 0


def test_registered():
    assert "pipeline" in entry.queries() and sum(q.startswith("op") for q in entry.queries()) >= 10
