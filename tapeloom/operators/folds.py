"""Aggregations: warnings, scores of readers, progress, batches and triage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.alignment import distance
from ..functions.text import compared_words

TERMINAL = ["completed", "failed", "skipped", "skipped_or_cached"]


def occurrences_of(c: Column) -> Column:
    """A count as stored: missing or below one counts as one."""
    return F.when(c >= 1, c).otherwise(1).cast("long")


def fold_warnings(warnings: DataFrame, source: str = "source_id") -> DataFrame:
    """One row for each source, stage and code: occurrences, the first message and its ``seq``; can be folded again."""
    return warnings.groupBy(source, "stage", "code").agg(F.min_by("message", "seq").alias("message"), F.sum(occurrences_of(F.col("occurrences"))).alias("occurrences"), F.min("seq").alias("seq"))


def token_scores(pairs: DataFrame, case: str = "case_id", truth: str = "truth", hypothesis: str = "hypothesis") -> DataFrame:
    """Precision, recall and F1 of word multisets for each case.

    Words are counted for each case before anything is joined, and one pass over the
    counted words gives the overlap, so no join is needed.
    """
    side = lambda c, own: pairs.select(case, F.explode_outer(compared_words(F.col(c))).alias("word"), *[F.when(F.lit(k == own), 1).otherwise(0).alias(k) for k in ("t", "h")])
    counted = side(truth, "t").unionByName(side(hypothesis, "h")).groupBy(case, "word").agg(F.sum("t").alias("t"), F.sum("h").alias("h"))
    some = F.col("word").isNotNull()
    total = lambda c: F.sum(F.when(some, c).otherwise(0))
    return counted.groupBy(case).agg(total(F.col("t")).alias("n_truth"), total(F.col("h")).alias("n_hypothesis"), total(F.least("t", "h")).alias("n_both")).select(case, "n_truth", "n_hypothesis", "n_both", *_prf(F.col("n_truth"), F.col("n_hypothesis"), F.col("n_both")))


def _prf(t: Column, h: Column, both: Column) -> list[Column]:
    none, silent = t == 0, h == 0
    precision = F.when(none, F.when(silent, 1.0).otherwise(0.0)).when(silent, 0.0).otherwise(both / h)
    recall = F.when(none, 1.0).otherwise(both / t)
    f1 = F.when(none, F.when(silent, 1.0).otherwise(0.0)).when(both == 0, 0.0).otherwise(2 * (both / h) * (both / t) / (both / h + both / t))
    return [precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]


@F.pandas_udf(T.DoubleType())
def _error_rate(truth: pd.Series, hypothesis: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(truth, hypothesis, strict=True):
        if len(a) == 0:
            out.append(0.0 if len(b) == 0 else 1.0)
            continue
        numbers: dict[str, int] = {}
        x, y = ([numbers.setdefault(w, len(numbers)) for w in side] for side in (a, b))
        out.append(distance(x, y) / len(a))
    return pd.Series(out, dtype="float64")


def word_error_rate(truth: Column, hypothesis: Column) -> Column:
    """Word edits over words of the truth; without truth 0 for silence and 1 for any word.  Texts may have any length."""
    return _error_rate(compared_words(truth), compared_words(hypothesis))


def eval_summary(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Means for each reader and trial over verified cases.

    ``scored`` has ``category``, ``legibility``, ``verified``, ``usable``, ``ocr_wer``,
    ``vision_wer``, ``recall``, ``f1``, ``flagged`` and ``claims_text``.  Unusable readings
    score 1, 0 and 0 and are flagged.  A mean over nothing is null.
    """
    used = scored.where("verified").withColumns({
        "vision_wer": F.when(F.col("usable"), F.col("vision_wer")).otherwise(1.0), "recall": F.when(F.col("usable"), F.col("recall")).otherwise(0.0),
        "f1": F.when(F.col("usable"), F.col("f1")).otherwise(0.0), "flagged": F.col("flagged") | ~F.col("usable"), "should": F.col("legibility") != "clean",
    })
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    both = F.count_if(F.col("flagged") & F.col("should"))
    return used.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.avg("ocr_wer").alias("ocr_wer_mean"), F.avg("vision_wer").alias("vision_wer_mean"), F.avg("recall").alias("text_recovery_accuracy"), F.avg("f1").alias("vision_token_f1_mean"),
        F.avg(F.when(F.col("category") == "textless", one(F.col("claims_text")))).alias("hallucination_rate"), F.avg(F.when(F.col("category") == "chrome_only", one(F.col("claims_text")))).alias("chrome_transcription_rate"),
        F.count_if(~F.col("usable")).alias("unusable_readings"), F.try_divide(both.cast("double"), F.count_if("flagged").cast("double")).alias("grounding_precision"), F.try_divide(both.cast("double"), F.count_if("should").cast("double")).alias("grounding_recall"),
    )


def trial_spread(summaries: DataFrame, keys: list[str], metrics: list[str], noise: float = 0.03) -> DataFrame:
    """Mean, least, most and number of trials of each metric, and a floor one noise band below the mean."""
    long = summaries.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return long.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("trials"), (F.avg("value") - noise).alias("floor"))


def acceptance(spread: DataFrame, keys: list[str], accuracy_floor: float, f1_floor: float, hallucination_ceiling: float = 0.0) -> DataFrame:
    """Verdict of each reader: mean accuracy and F1 on or above their floors, worst hallucination on or below its ceiling; null fails."""
    value = lambda metric, c: F.max(F.when(F.col("metric") == metric, F.col(c)))
    held = spread.groupBy(*keys).agg(value("text_recovery_accuracy", "mean").alias("a"), value("vision_token_f1_mean", "mean").alias("f"), value("hallucination_rate", "most").alias("h"))
    good = lambda c: F.coalesce(c, F.lit(False))
    checks = held.select(*keys, good(F.col("a") >= accuracy_floor).alias("accuracy_ok"), good(F.col("f") >= f1_floor).alias("f1_ok"), good(F.col("h") <= hallucination_ceiling).alias("hallucination_ok"))
    return checks.withColumn("accepted", F.col("accuracy_ok") & F.col("f1_ok") & F.col("hallucination_ok"))


def clamped(percent: Column) -> Column:
    return F.when(percent.isNotNull(), F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent)), 3))


def mechanism_states(events: DataFrame) -> DataFrame:
    """The latest state (by sequence) of each job and mechanism."""
    return events.groupBy("job_id", "mechanism").agg(F.max_by(F.struct("status", "percent"), "sequence").alias("s")).select("job_id", "mechanism", "s.status", "s.percent")


def mechanism_percent(status: Column, percent: Column) -> Column:
    return F.when(status.isin(TERMINAL), 100.0).otherwise(F.coalesce(clamped(percent), F.lit(0.0)))


def overall_progress(events: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted percent of each job over all mechanisms of ``weights``; exactly 100 once all have ended.

    Mechanisms without a weight do not count; a job that has no other is at 0.
    """
    jobs = events.select("job_id").distinct()
    all_weight = weights.agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    held = mechanism_states(events).join(weights, "mechanism").groupBy("job_id").agg(F.sum(F.col("weight") * mechanism_percent(F.col("status"), F.col("percent"))).alias("done"), F.count_if(F.col("status").isin(TERMINAL)).alias("ended"))
    out = jobs.join(held, "job_id", "left").join(F.broadcast(all_weight))  # one row of totals
    return out.select("job_id", F.when(F.col("ended") == F.col("n"), 100.0).otherwise(clamped(F.coalesce("done", F.lit(0.0)) / F.col("w"))).alias("overall_percent"))


def progress_summary(events: DataFrame, weights: DataFrame, ended: bool) -> DataFrame:
    """Every job's state of every mechanism: a missing one is pending at 0, or skipped at 100 in an ended or cached job."""
    names = weights.agg(F.array_sort(F.collect_set("mechanism")).alias("names"))
    # One row of names meets all jobs, so each job gets each mechanism once.
    grid = events.select("job_id").distinct().join(F.broadcast(names)).select("job_id", F.explode("names").alias("mechanism"))
    out = grid.join(mechanism_states(events), ["job_id", "mechanism"], "left")
    missing = F.lit("skipped_or_cached" if ended else "pending")
    status = F.coalesce("status", missing)
    return out.select("job_id", "mechanism", status.alias("status"), mechanism_percent(status, F.col("percent")).alias("percent"))


def summary_has_ended(summary: DataFrame) -> DataFrame:
    """Whether all mechanisms of each job of a progress summary have ended."""
    return summary.groupBy("job_id").agg(F.min(F.col("status").isin(TERMINAL)).alias("ended"))


def _until_first_error(items: DataFrame, batch: str) -> DataFrame:
    first = F.min(F.when(F.col("code").isNotNull(), F.col("batch_index"))).over(Window.partitionBy(batch))
    return items.withColumn("__first", first).where("__first is null or batch_index <= __first").drop("__first")


def batch_report(items: DataFrame, batch: str = "batch_id", stop_at_first: bool = False) -> DataFrame:
    """Items, processed, errors and first error of each batch (``batch_index`` from 1, ``code`` null if good).

    ``stop_at_first`` counts a batch's rows up to its first error.
    """
    items = _until_first_error(items, batch) if stop_at_first else items
    by_code = items.groupBy(batch, "code").agg(F.count("*").alias("n"), F.min("batch_index").alias("first_index"))
    return by_code.groupBy(batch).agg(F.sum("n").alias("items"), F.coalesce(F.sum(F.when(F.col("code").isNull(), F.col("n"))), F.lit(0)).alias("processed"), F.coalesce(F.sum(F.when(F.col("code").isNotNull(), F.col("n"))), F.lit(0)).alias("errors"), F.min(F.when(F.col("code").isNotNull(), F.col("first_index"))).alias("first_error"))


def batch_errors(items: DataFrame, batch: str = "batch_id", stop_at_first: bool = False, listed: int = 20) -> DataFrame:
    """A row for each code and stage of a batch's errors: how many, and the first ``listed`` of them as (``batch_index``, ``item``); :func:`error_rows` has all."""
    items = _until_first_error(items, batch) if stop_at_first else items
    own = Window.partitionBy(batch, "code", "stage").orderBy("batch_index", "item")
    bad = items.where(F.col("code").isNotNull()).withColumn("__rank", F.row_number().over(own))
    shown = F.when(F.col("__rank") <= listed, F.struct("batch_index", "item"))
    return bad.groupBy(batch, "code", "stage").agg(F.count("*").alias("errors"), F.array_sort(F.collect_list(shown)).alias("shown"))


def error_rows(items: DataFrame, batch: str = "batch_id", stop_at_first: bool = False) -> DataFrame:
    """Every error of a batch, a row each, with its number among those of its code and stage (``error_no``, from 1)."""
    items = _until_first_error(items, batch) if stop_at_first else items
    own = Window.partitionBy(batch, "code", "stage").orderBy("batch_index", "item")
    return items.where(F.col("code").isNotNull()).withColumn("error_no", F.row_number().over(own).cast("long"))


def triage_bucket(luminance: Column, text_chars: Column) -> Column:
    return F.concat(F.when(luminance < 110, F.lit("dark_")).otherwise("light_"), F.when(text_chars <= 8, "none").when(text_chars <= 60, "low").otherwise("high"))


def triage_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy(triage_bucket(F.col("luminance"), F.col("text_chars")).alias("bucket")).agg(F.count("*").alias("frames"))


def triage_samples(frames: DataFrame, k: int = 3) -> DataFrame:
    """The darkest ``k`` frames of each bucket, ties by source and index."""
    own = frames.withColumn("bucket", triage_bucket(F.col("luminance"), F.col("text_chars")))
    order = Window.partitionBy("bucket").orderBy("luminance", "source_id", "frame_index")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def label_problem(cases: DataFrame) -> DataFrame:
    """Adds ``problem``: the first rule of the label table that a row breaks, null for a good row."""
    same = F.count("*").over(Window.partitionBy("id"))
    empty = F.coalesce(F.length(F.trim("truth")) == 0, F.lit(False))
    return cases.withColumn("__same", same).withColumn(
        "problem",
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id")
        .when(F.col("__same") > 1, "id is not unique")
        .when(~F.coalesce(F.col("category").isin("clean_text", "textless", "chrome_only", "injection", "safety_blocked", "ocr_vision_disagreement"), F.lit(False)), "unknown category")
        .when(~F.coalesce(F.col("legibility").isin("clean", "partial", "unreadable"), F.lit(False)), "unknown legibility")
        .when(F.col("has_text").isNull() | F.col("verified").isNull(), "a flag is missing")
        .when(F.col("has_text") == F.col("category").isin("textless", "chrome_only"), "has_text contradicts the category")
        .when(F.col("verified") & F.col("truth").isNull(), "verified without truth")
        .when(F.col("verified") & (empty == F.col("has_text")), "truth contradicts has_text"),
    ).drop("__same")
