"""A corpus pipeline over ``documents``: each stage works on what the stage before it kept.

Quality rules, toxicity, near duplicates, benchmark decontamination, BPE.  The first
four return the columns of documents for the rows that they keep; the last returns the
encoded texts' digests.  Every stage takes nulls in any column, texts of any length,
repeated rows and an empty table (which gives an empty result), and leaves out columns
that documents do not have, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bpe, decontamination, jaccard, quality, toxicity
from tapeloom.llm.storage import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a rule rejects: also null and empty texts, which have too few words.  Repeated rows are judged alike."""
    return quality.quality(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score reaches the threshold; learns from the labels of the documents at hand.

    A null or empty text has the chance of an empty segment.  Without labelled documents
    of both kinds nothing can be learnt, so nothing is dropped.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that of least id (null last), then of least text hash.

    Rows are told apart by a number that is written with them, so repeated rows, equal
    ids with different texts and null ids are rows of their own.  Texts without a word
    are like nothing, so all of them stay.
    """
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")))
    found = jaccard.near_duplicates(rows, key="__row")
    ranked = rows.select("__row", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.col("__row").alias("row")).alias("rank"))
    kept = found.join(ranked, "__row").groupBy("component_id").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents; a null or empty text has no words, so it stays, and repeated rows share their fate."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.find_contamination(docs, benchmark, keep=COLUMNS).where("not contaminated").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each row; a null text counts as empty."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: Training, components and BPE merging have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
