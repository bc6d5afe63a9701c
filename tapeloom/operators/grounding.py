"""Readings of frames: what they say, how two readers agree, and replies of a model."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.redaction import MARK, redacted
from ..functions.text import fenced, without_split_mark

STRONG, PARTIAL, ENOUGH_TOKENS = 0.5, 0.2, 4
# Kinds of frames, and how sure a reading can be.
KINDS = ["ui_interface", "chart_graph", "diagram", "code_screenshot", "terminal", "slide"]
CONFIDENCES = ["high", "medium", "low", "none"]
READ_FAILURES = ["local_vision_malformed_response", "local_vision_retry_exhausted", "local_vision_timeout", "local_vision_image_read_failed", "local_vision_auth_rejected"]
REASON_CHARS, CONTEXT_CHARS = 400, 1200

REPLY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("visual_summary", "interpretation", "uncertainty", "verbatim_text", "frame_kind", "text_confidence")]
    + [T.StructField("detected_elements", T.ArrayType(T.StringType())), T.StructField("adds_information", T.BooleanType()), T.StructField("reason", T.StringType())]
)


def _says(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def has_interpretation(reading: Column) -> Column:
    """Whether anything beyond a transcription was said."""
    elements = F.coalesce(F.exists(reading["detected_elements"], lambda x: F.length(F.trim(x)) > 0), F.lit(False))
    return _says(reading["visual_summary"]) | _says(reading["interpretation"]) | elements


def reading_counts(frames: DataFrame, sources: DataFrame, reading: str = "interpretation") -> DataFrame:
    """Facts of each source's summary: ``frames``, ``readings`` (frames with a reading), ``visual_frames`` (more than a transcription), ``duration_sec`` and ``sentence``.

    ``sources`` have ``source_id`` and ``duration_sec``; one without frames counts zero,
    one without a usable duration says that it is unknown.
    """
    counted = frames.groupBy("source_id").agg(F.count("*").alias("frames"), F.count_if(carries_reading(F.col(reading))).alias("readings"), F.count_if(has_interpretation(F.col(reading))).alias("visual_frames"))
    out = sources.select("source_id", F.col("duration_sec").cast("double").alias("duration_sec")).join(counted, "source_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("frames", "readings", "visual_frames")})
    known = F.coalesce((F.col("duration_sec") > 0) & (F.col("duration_sec") < float("inf")), F.lit(False))
    length = F.when(known, F.concat(F.round("duration_sec").cast("long").cast("string"), F.lit(" s"))).otherwise("of unknown length")
    return out.withColumn("sentence", F.concat(length, F.lit(", "), F.col("frames").cast("string"), F.lit(" frames, "), F.col("visual_frames").cast("string"), F.lit(" of them visual")))


def carries_reading(reading: Column) -> Column:
    """Whether anything was said at all."""
    return has_interpretation(reading) | _says(reading["verbatim_text"])


def tokens(text: Column) -> Column:
    """Distinct words of two or more of ``a-z0-9``, without redaction marks."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), MARK, " ")), F.lit("[a-z0-9]{2,}"), 0))


def grounding(ocr_text: Column, verbatim_text: Column, text_confidence: Column, interpreted: Column, reads: Column) -> Column:
    """Struct of ``level``, ``text_overlap`` and ``reason``: how far two readers of a frame support each other."""
    own, other = tokens(verbatim_text), tokens(ocr_text)
    overlap = F.size(F.array_intersect(own, other)) / F.size(own)
    note = lambda level, o, reason: F.struct(F.lit(level).alias("level"), (o if o is not None else F.lit(None).cast("double")).alias("text_overlap"), F.lit(reason).alias("reason"))
    both, only_own, only_other = (F.size(own) > 0) & (F.size(other) > 0), F.size(own) > 0, F.size(other) > 0
    sure = F.coalesce(text_confidence.isin("high", "medium"), F.lit(False))
    unsure = F.coalesce(text_confidence.isin("none", "low"), F.lit(False))
    return (
        F.when(both & (overlap >= STRONG), note("corroborated", overlap, "both readers agree on the text"))
        .when(both & (overlap >= PARTIAL), note("weak", overlap, "the readers agree on part of the text"))
        .when(both, note("weak", overlap, "the readers disagree on most of the text"))
        .when(only_own & (F.size(own) >= ENOUGH_TOKENS) & sure, note("self_report", None, "only the model read text"))
        .when(only_own, note("weak", None, "a thin or unsure transcription without a second reader"))
        .when(only_other, note("weak", None, "text was found that the model did not transcribe"))
        .when(interpreted & unsure, note("ungrounded", None, "an interpretation without any readable text"))
        .when(interpreted, note("weak", None, "no readable text supports the interpretation"))
        .when(reads, note("self_report", None, "only the model's own reading"))
        .otherwise(note("corroborated", None, "no text on the frame"))
    )


@F.pandas_udf(T.StringType())
def _first_object(text: pd.Series) -> pd.Series:
    """The first balanced object of a reply, as JSON; braces in strings do not count."""
    return text.map(lambda t: None if t is None else balanced_object(t))


_JSON = json.JSONDecoder()


def balanced_object(text: str) -> str | None:
    """The JSON object that begins at the first ``{``, whatever follows it; none if that is not one."""
    begin = text.find("{")
    if begin < 0:
        return None
    try:
        found, end = _JSON.raw_decode(text, begin)
    except (ValueError, RecursionError):
        return None
    return text[begin:end] if isinstance(found, dict) else None


def unfenced(reply: Column) -> Column:
    """A reply without a code fence around it."""
    return F.trim(F.regexp_replace(F.trim(reply), r"\A```[^\n]*\n?|\n?```[^\n]*\z", ""))


def _object(text: Column) -> Column:
    """The text if it is one JSON object."""
    return F.when(F.try_parse_json(text).isNotNull() & (F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")), text)


def parse_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``reading`` (null if malformed or saying nothing) and ``salience`` to rows with a model's reply.

    Plain JSON is parsed by Spark; only replies that are not go through the scan for a
    balanced object.
    """
    plain = df.withColumn("__json", _object(unfenced(F.col(reply))))
    good = plain.where("__json is not null")
    rest = plain.where("__json is null").withColumn("__json", _first_object(unfenced(F.col(reply))))
    return _read(good.unionByName(rest)).drop("__json")


def _read(df: DataFrame) -> DataFrame:
    j = F.try_parse_json(F.col("__json"))
    text = lambda name: F.trim(F.coalesce(F.try_variant_get(j, f"$.{name}", "string"), F.lit("")))
    kind, sure = F.lower(text("frame_kind")), F.lower(text("text_confidence"))
    strict = F.schema_of_variant(F.try_variant_get(j, "$.adds_information", "variant")) == "BOOLEAN"
    reason_is_text = F.schema_of_variant(F.try_variant_get(j, "$.reason", "variant")) == "STRING"
    reading = F.struct(
        text("visual_summary").alias("visual_summary"),
        F.coalesce(F.try_variant_get(j, "$.detected_elements", "array<string>"), F.array().cast("array<string>")).alias("detected_elements"),
        text("interpretation").alias("interpretation"), text("uncertainty").alias("uncertainty"), text("verbatim_text").alias("verbatim_text"),
        F.when(kind.isin(KINDS), kind).otherwise("").alias("frame_kind"), F.when(sure.isin(CONFIDENCES), sure).otherwise("none").alias("text_confidence"),
    )
    reason = F.trim(redacted(F.when(reason_is_text, F.try_variant_get(j, "$.reason", "string")).otherwise("")))
    salience = F.struct(F.try_variant_get(j, "$.adds_information", "boolean").alias("adds_information"), F.left(reason, F.lit(REASON_CHARS)).alias("reason"), (F.length(reason) > REASON_CHARS).alias("reason_truncated"))
    df = df.withColumn("reading", F.when(F.col("__json").isNotNull(), reading))
    df = df.withColumn("reading", F.when(carries_reading(F.col("reading")), F.col("reading")))
    return df.withColumn("salience", F.when(F.col("reading").isNotNull() & strict, salience))


def frame_outcomes(attempts: DataFrame, wants_salience: str = "wants_salience") -> DataFrame:
    """From replies (``reply``, ``code``, ``ocr_text``): reading, salience, grounding and a warning code, a row each.

    A reply that says nothing is malformed; malformed and failed reads are ungrounded and
    have no reading; salience that was not asked for is dropped.
    """
    read = parse_replies(attempts)
    code = F.coalesce(F.col("code"), F.when(F.col("reading").isNull(), F.lit("local_vision_malformed_response")))
    failed = F.coalesce(code.isin(READ_FAILURES), F.lit(False))
    own = F.col("reading")
    found = grounding(F.col("ocr_text"), own["verbatim_text"], own["text_confidence"], has_interpretation(own), carries_reading(own))
    missing = F.struct(F.lit("ungrounded").alias("level"), F.lit(None).cast("double").alias("text_overlap"), F.lit("the frame could not be read").alias("reason"))
    return (
        read.withColumn("grounding", F.when(failed, missing).otherwise(found))
        .withColumn("warning_code", code)
        .withColumn("salience", F.when(F.col(wants_salience) & ~failed, F.col("salience")))
        .withColumn("reading", F.when(~failed, F.col("reading")))
    )


def prompt_context(text: Column, limit: int = CONTEXT_CHARS) -> Column:
    """Struct of a redacted, cut and fenced ``block`` and whether it was ``truncated``; blank text has no block."""
    safe = F.trim(redacted(F.coalesce(text, F.lit(""))))
    long = F.length(safe) > limit
    cut = F.when(long, without_split_mark(F.left(safe, F.lit(limit)))).otherwise(safe)
    return F.struct(F.when(safe != "", fenced(cut)).alias("block"), long.alias("truncated"))
