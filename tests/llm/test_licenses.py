import re

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import licenses, queries

# The licence lines of the supplied documents.
LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "This work is licensed under the GNU General Public License, version 3.": "GPL",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
}


@pytest.fixture(scope="module")
def scanner(spark):
    return licenses.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_query_equals_a_search_for_the_known_lines(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_paragraphs, r.n_licence, r.licences) for r in queries.op4_license_scan(spark, sf).collect()}
    plan = queries.op4_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        parts = [p for p in re.split("[\r\n]+", r.text or "") if re.search("[A-Za-z0-9]", p)]
        found = [LINES[p] for p in parts if p in LINES]
        assert got[r.doc_id] == (len(parts), len(found), ",".join(sorted(set(found)))), r.doc_id


def test_families_and_unknown(spark, scanner):
    rows = [(1, licenses.TEMPLATES[2][1]), (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), (3, "The licence of the bar was not renewed, said the mayor."), (4, None), (5, ""), (6, "!!\n \n"), (7, "x\n\nLicensed under the GNU General Public License, version 3\r\ny"), (8, "a " * 50000), (9, "Permission to enter the Software building is granted to persons with a copy of the key")]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, family string")
    got = {r.doc_id: (r.n_paragraphs, r.licences) for r in licenses.scan(d, scanner).collect()}
    assert got == {1: (1, "MIT"), 2: (1, "MIT"), 3: (1, ""), 4: (0, ""), 5: (0, ""), 6: (0, ""), 7: (3, "GPL"), 8: (1, ""), 9: (1, "")}
    assert licenses.scan(d.limit(0), scanner).count() == 0


def test_stretches_of_templates_are_named(spark, scanner):
    rows = [(i, " ".join(t.split()[: max(4, 2 * len(t.split()) // 3)])) for i, (_, t) in enumerate(licenses.TEMPLATES) if len(t.split()) > 15]
    got = {r.doc_id: r.licences for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner).collect()}
    right = sum(got[i] == licenses.TEMPLATES[i][0] for i, _ in rows)
    assert right >= 0.9 * len(rows)


def test_licences_inside_long_lines_and_pages_without_breaks(spark, scanner):
    prose = "The river was high that spring and the boats stayed in the harbour for weeks. " * 12
    rows = [(1, prose + "Released under the MIT License. " + prose), (2, prose), (3, " ".join(["word"] * 60 + licenses.TEMPLATES[8][1].split() + ["word"] * 60)), (3, prose + "\n" + licenses.TEMPLATES[5][1])]
    got = {r.doc_id: (r.n_paragraphs, r.n_licence, r.licences) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), scanner).collect()}
    assert got == {1: (1, 1, "MIT"), 2: (1, 0, ""), 3: (3, 2, "Apache-2.0,GPL")}


def test_the_sample_does_not_depend_on_the_order_of_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (licenses.sampled(x, "text") for x in (d, d.orderBy("n_chars").repartition(3)))
    assert sorted(r.text for r in a.collect()) == sorted(r.text for r in b.collect())


def test_scores_equal_those_of_the_regression_and_take_no_vectors(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.learn(docs)
    scanner = licenses.Scanner.of(model, 0.3)
    texts = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(licenses.TEMPLATES)] + [(-1, None), (-2, "one"), (-3, "zzz qqq")], "doc_id long, text string")
    rows = licenses.units(docs.select("doc_id", "text").unionByName(texts), "text", ["doc_id"]).withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    made = model.setProbabilityCol("all").transform(licenses.vectors(rows)).select("words", "all")
    seen = set()
    for r in scanner.probabilities(made).collect():
        known = list(r["all"])[1:]
        assert abs(r.probability - max(known)) < 1e-9
        assert abs(known[licenses.FAMILIES.index(r.family) - 1] - max(known)) < 1e-9
        seen.add(r.family)
    assert len(seen) > 5
    for q in (licenses.scan(docs, scanner), scanner.probabilities(licenses.units(docs, "text", ["doc_id"]))):
        assert "UDF" not in q._jdf.queryExecution().optimizedPlan().toString()


def test_a_unit_without_a_feature_of_weight_gets_the_intercepts(spark):
    bare = licenses.Scanner({}, [2.0] + [0.5] * (len(licenses.FAMILIES) - 2) + [1.0], 0.3)
    one = licenses.Scanner({-1: [0.0] * len(licenses.FAMILIES)}, bare.intercepts, 0.3)
    rows = spark.createDataFrame([(["any", "words"],), ([],), (None,)], "words array<string>")
    sums = [2.718281828459045**x for x in bare.intercepts]
    for scanner in (bare, one):
        for r in scanner.probabilities(rows).collect():
            assert r.family == licenses.FAMILIES[-1] and abs(r.probability - sums[-1] / sum(sums)) < 1e-12
