"""Licence scans: a trained paragraph classifier, in DataFrame functions and Spark's own learners only.

Paragraphs are runs of text between line breaks; one of many words is taken sentence by
sentence, and a long sentence in overlapping stretches, so a licence line inside a page
without breaks is seen.  Each such unit becomes a sparse vector of its words and word
pairs.  A multinomial logistic regression with an L1 penalty, trained on stretches of
licence texts against other paragraphs, names the licence family or "unknown"; how sure
it must be is calibrated on a quarter of all units of the table, none of which it has
learnt from.  The penalty leaves weights on a few hundred features, so a unit's score is
summed over those of them that it has; no vector is made of a unit that is only scored.  A named family is confirmed by comparison with the family's texts: enough
of the unit's word pairs must stand in one of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence families and texts that are typical of them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Released under the BSD 3-Clause License."),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Public-Domain", "This is free and unencumbered software released into the public domain."),
    ("Public-Domain", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
)
# Sentences that talk like licences and are none.
OTHERS: tuple[str, ...] = (
    "The city council granted permission for the new building under strict conditions.",
    "Her driving license was renewed last week without any charge.",
    "The software company released version 2.0 of its program to the public.",
    "Copies of the report are free of charge for members of the library.",
    "The apache helicopter was distributed to several bases.",
    "General terms and conditions of the public foundation apply to all persons.",
    "He published a version of the work under another name.",
    "All rights to sell the copy were reserved by the dealer.",
)
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *sorted({f for f, _ in TEMPLATES}))
FEATURES = 1 << 14
#: Documents that other paragraphs are taken from for training (those of least text hash), and units taken (of least hash).
SAMPLE_DOCS, SAMPLE_UNITS = 2000, 8000
#: Characters of a paragraph from which it is taken by sentences, and words of a stretch of a longer sentence; stretches overlap by half.
LONG, UNIT = 300, 40
#: Share of other paragraphs that may pass for a family before comparison, and pairs that must stand in a template.
FALSE_RATE, CONFIRM = 0.001, 0.6


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def grams_of(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get(words, i), w))
    return F.concat(words, pairs)


def features_of(words: Column) -> Column:
    """Hashed features of words and pairs of neighbouring words; a feature can occur more than once."""
    single = F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(FEATURES)))
    # The last word has no next one: its pair is the word again.
    return F.concat(single, F.transform(words, lambda w, i: F.pmod(F.hash(w, F.get(words, i + 1)), F.lit(FEATURES))))


def paragraphs(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row a paragraph with words (``position`` counts from 0), and one without ``paragraph`` for a text that has none."""
    parts = F.filter(F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "[\r\n]+"), lambda p: p.rlike("[A-Za-z0-9]"))
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.posexplode_outer(parts).alias("position", "paragraph"))


def units(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row a unit with ``words`` and the ``position`` of its paragraph; one without words for a text that has none."""
    kept = [F.col(f"`{c}`") for c in keep]
    p = F.col("paragraph")
    sentences = F.when(F.length(p) > LONG, F.split(p, r"(?<=[.!?;])\s+")).otherwise(F.array(p))
    rows = paragraphs(docs, text, keep).select(*kept, "position", F.explode_outer(sentences).alias("__sentence"))
    rows = rows.select(*kept, "position", F.when(F.col("__sentence").isNotNull(), words_of(F.col("__sentence"))).alias("__words"))
    begins = F.sequence(F.lit(1), F.size("__words") - UNIT // 2, F.lit(UNIT // 2))
    stretches = F.when(F.size("__words") > UNIT, F.transform(begins, lambda at: F.slice("__words", at, F.lit(UNIT)))).otherwise(F.array("__words"))
    return rows.select(*kept, "position", F.explode(stretches).alias("words")).where("position is null or size(words) > 0")


def _family_rows(spark: SparkSession, rows: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("paragraph")) for f, t in rows])))


def kept_out(words: Column) -> Column:
    """Units that are never learnt from."""
    return F.pmod(F.xxhash64(F.array_join(words, " ")), F.lit(4)) == 0


def other_units(docs: DataFrame, text: str) -> DataFrame:
    """Units without a word that speaks of licences."""
    known = F.array(*[F.lit(x) for x in "license licensed copyright permission warranty warranties redistribution unencumbered".split(" ")])
    return units(docs.select(F.col(f"`{text}`").alias("text")), "text", []).where(F.col("words").isNotNull() & ~F.arrays_overlap("words", known)).select("words")


def sampled(docs: DataFrame, text: str) -> DataFrame:
    """Different texts of least hash, about ``SAMPLE_DOCS`` whatever the order of files; no task meets many more."""
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    share = min(1.0, 1.2 * SAMPLE_DOCS / max(1, docs.count()))
    some = docs.select(F.col(f"`{text}`").cast("string").alias("text")).withColumn("h", h).where(F.col("h") <= int(share * (1 << 40)))
    return some.dropDuplicates(["h", "text"]).orderBy("h", "text").limit(SAMPLE_DOCS).select("text")


def training_rows(docs: DataFrame, text: str) -> DataFrame:
    """(family, words): templates, their stretches of twelve words (or half of fewer) or more, and other units of a bounded sample."""
    spark = docs.sparkSession
    t = _family_rows(spark, TEMPLATES).select("family", words_of(F.col("paragraph")).alias("words"))
    n = F.size("words")
    cut = t.select("family", "words", F.explode(F.sequence(F.greatest(F.lit(3), F.least(F.lit(12), F.ceil(n / 2).cast("int"))), F.greatest(n, F.lit(3)))).alias("length"))
    cut = cut.select("family", "words", "length", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - F.col("length") + 1, F.lit(1)))).alias("at"))
    # Of long texts' very many stretches every seventh is enough.
    cut = cut.where((F.size("words") < 16) | ((F.col("at") + F.col("length")) % 7 == 0)).select("family", F.slice("words", F.col("at"), F.col("length")).alias("words"))
    other = other_units(sampled(docs, text), "text").where(~kept_out(F.col("words"))).distinct().orderBy(F.xxhash64("words"), "words").limit(SAMPLE_UNITS)
    other = other.unionByName(_family_rows(spark, [(UNKNOWN, x) for x in OTHERS]).select(words_of(F.col("paragraph")).alias("words")))
    # Short pieces of other units too, since licence lines are short.
    pieces = other.select(F.explode(F.array("words", F.slice("words", 1, 8), F.slice("words", 3, 5))).alias("words")).where(F.size("words") > 0)
    return t.unionByName(cut).unionByName(pieces.select(F.lit(UNKNOWN).alias("family"), "words"))


@dataclass
class Scanner:
    """The regression's weights of each feature that has any, by family, its intercepts, and the least probability of a family."""

    weights: dict[int, list[float]]
    intercepts: list[float]
    least: float

    @classmethod
    def of(cls, model: LogisticRegressionModel, least: float) -> Scanner:
        by_feature = model.coefficientMatrix.toArray().T
        return cls({int(i): by_feature[i].tolist() for i in by_feature.any(axis=1).nonzero()[0]}, model.interceptVector.toArray().tolist(), least)

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """Adds ``family`` and ``probability`` (of the likeliest family that is not unknown) to rows with ``words``; null words have no feature."""
        known = sorted(self.weights)
        table = F.array(*[F.array(*[F.lit(float(x)) for x in self.weights[i]]) for i in known])
        start = F.array(*[F.lit(float(x)) for x in self.intercepts])
        found = F.array_distinct(F.filter(features_of(F.col("words")), lambda i: i.isin(known))) if known else F.array().cast("array<int>")
        place = F.array(*[F.lit(i) for i in known])
        total = F.aggregate("__found", start, lambda m, i: F.zip_with(m, F.get(table, F.array_position(place, i).cast("int") - 1), lambda x, y: x + y)) if known else start
        # Without a feature of weight the intercepts are all there is: one constant.
        made = rows.withColumn("__found", found).withColumn("__m", F.when(F.size("__found") > 0, total))
        none = F.struct(*_best(start))
        made = made.withColumn("__best", F.when(F.col("__m").isNotNull(), F.struct(*_best(F.col("__m")))).otherwise(none))
        names = F.array(*[F.lit(f) for f in FAMILIES[1:]])
        return made.withColumn("family", F.get(names, F.col("__best.i"))).withColumn("probability", F.col("__best.p")).drop("__found", "__m", "__best")


def _best(m: Column) -> tuple[Column, Column]:
    """Place ``i`` and softmax probability ``p`` of the largest margin but the first."""
    top = F.array_max(F.transform(F.slice(m, 2, len(FAMILIES) - 1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    most = F.array_max(m)
    return top["i"].alias("i"), (F.exp(top["x"] - most) / F.aggregate(m, F.lit(0.0), lambda s, x: s + F.exp(x - most))).alias("p")


def vectors(rows: DataFrame) -> DataFrame:
    """Adds the binary vector ``features`` to rows with ``words``, for the learner; a feature is its place."""
    places = CountVectorizerModel.from_vocabulary([str(i) for i in range(FEATURES)], "__terms", "features", minTF=1.0, binary=True)
    return places.transform(rows.withColumn("__terms", features_of(F.col("words")).cast("array<string>"))).drop("__terms")


def learn(docs: DataFrame, text: str = "text") -> LogisticRegressionModel:
    """The regression on the training rows; classes are the places of ``FAMILIES``."""
    rows = training_rows(docs, text).withColumn("label", (F.array_position(F.array(*[F.lit(f) for f in FAMILIES]), F.col("family")) - 1).cast("double"))
    made = vectors(rows).select("label", "features").repartition(8).sortWithinPartitions("label", F.xxhash64(F.col("features").cast("string"))).cache()
    model = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=1.0, maxIter=40, aggregationDepth=2).fit(made)
    made.unpersist()
    return model


def fit(docs: DataFrame, text: str = "text") -> Scanner:
    """Trains on the training rows and calibrates on all units of the table that are kept out.

    The least probability lets ``FALSE_RATE`` of the kept-out units pass for a family.  The
    same texts give the same scanner in whatever order or files; an empty table gives one
    that knows the templates alone.
    """
    scanner = Scanner.of(learn(docs, text), 0.3)
    apart = other_units(docs, text).where(kept_out(F.col("words")))
    least = scanner.probabilities(apart).agg(F.percentile_approx("probability", 1 - FALSE_RATE, 10000)).first()[0]
    scanner.least = max(0.3, float(least or 0.0))
    return scanner


def template_share(words: Column, family: Column) -> Column:
    """The largest share of the paragraph's word pairs (its words, if it has one word) that stands in one template of the family."""
    own = F.array_distinct(F.when(F.size(words) > 1, F.slice(grams_of(words), F.size(words) + 1, F.size(words))).otherwise(words))
    shares = F.lit(0.0)
    for f, t in TEMPLATES:
        shares = F.greatest(shares, F.when(family == f, F.size(F.array_intersect(own, F.array_except(grams_of(words_of(F.lit(t))), F.array().cast("array<string>")))) / F.greatest(F.size(own), F.lit(1))).otherwise(0.0))
    return shares


def scan_units(docs: DataFrame, scanner: Scanner, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """All units with ``position``, ``family`` (null if unknown), ``probability`` and ``share``; a text without any gives one row of nulls."""
    made = scanner.probabilities(units(docs, text, keep))
    sure = F.col("probability") >= F.lit(scanner.least)
    made = made.withColumn("share", F.when(sure & F.col("words").isNotNull(), template_share(F.col("words"), F.col("family"))))
    return made.withColumn("family", F.when(F.col("share") >= CONFIRM, F.col("family"))).drop("words")


def scan(docs: DataFrame, scanner: Scanner, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ``n_paragraphs``, ``n_licence``, ``licences``) of each key: how many paragraphs, how many of a licence, sorted families.

    A null, empty or wordless text has no paragraph.  Paragraphs of rows with one key
    are counted together; a null key is a key.  Other columns are not read.  A paragraph
    of many words is searched sentence by sentence; it counts once, with all families found.
    """
    own = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text"), F.monotonically_increasing_id().alias("__row"))
    made = scan_units(own, scanner, "__text", ["__key", "__row"])
    # Units of a row lie together: a row's counts are made before rows of one key meet.
    found = F.collect_set(F.when(F.col("family").isNotNull(), F.struct("position", "family")))
    by_row = made.groupBy("__key", "__row").agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("n"), found.alias("found"))
    by_row = by_row.select("__key", "n", F.size(F.array_distinct(F.transform("found", lambda x: x["position"]))).alias("hits"), F.transform("found", lambda x: x["family"]).alias("names"))
    return by_row.groupBy(F.col("__key").alias(key)).agg(
        F.sum("n").cast("long").alias("n_paragraphs"), F.sum("hits").cast("long").alias("n_licence"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.array_distinct("names")))))), ",").alias("licences")
    )
