"""Registered queries over the supplied tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity, links, redaction, text
from ..operators import folds, grounding, inference, store, timeline
from ..sources import recordings
from ..streaming import progress as stream
from . import bindings as b
from .registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


def r6(c: str):
    return F.round(c, 6).alias(c)


WORDS_SQL = r"""list_filter(string_split_regex(regexp_replace(translate(lower(coalesce({0}, '')), '"''`.,:;!?()[]{{}}<>|/\-–—_=+*#', '                                '), '\p{{P}}', ' ', 'g'), '\s+'), lambda x: x <> '')"""


def words_sql(c: str) -> str:
    return WORDS_SQL.format(c)


TURNS_SQL = f"""t AS (SELECT conv_id * 1000 + turn AS case_id, conv_id, turn, text AS truth, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hypothesis FROM conversations)"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn is a truth, the next turn of the conversation a reading of it."""
    c = b.table(spark, sf_dir, "conversations")
    following = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), "conv_id", "turn", F.col("text").alias("truth"), following.alias("hypothesis"))


@query("SELECT source, lang, count(*) AS documents, CAST(sum(len(regexp_extract_all(text, '\"[0-9a-f]{40}\"'))) AS BIGINT) AS marks FROM documents GROUP BY source, lang")
def redaction_marks(spark, sf_dir):
    """Assigned secrets that redaction finds, by source and language (flagship)."""
    d = redaction.redact(b.table(spark, sf_dir, "documents").select("source", "lang", "text"))
    kinds = F.size(F.filter(redaction.mark_kinds(F.col("text")), lambda k: k == "assigned-secret"))
    return d.groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum(kinds).alias("marks"))


@query(f"""WITH {b.WARNINGS_SQL} SELECT source_id, stage, code, arg_min(message, seq) AS message, CAST(sum(CASE WHEN occurrences >= 1 THEN occurrences ELSE 1 END) AS BIGINT) AS occurrences, min(seq) AS seq FROM w GROUP BY ALL""")
def warnings_folded(spark, sf_dir):
    return folds.fold_warnings(b.warnings(spark, sf_dir))


@query(f"""WITH {TURNS_SQL}, k AS (SELECT case_id, list_distinct(regexp_extract_all(lower(hypothesis), '[a-z0-9]{{2,}}')) AS v, list_distinct(regexp_extract_all(lower(truth), '[a-z0-9]{{2,}}')) AS o, turn FROM t WHERE hypothesis IS NOT NULL),
x AS (SELECT *, CASE WHEN len(v) > 0 AND len(o) > 0 THEN len(list_intersect(v, o)) / len(v) END AS q FROM k)
SELECT case_id, CASE WHEN q >= 0.5 THEN 'corroborated' WHEN q IS NOT NULL THEN 'weak' WHEN len(v) > 0 THEN CASE WHEN len(v) >= 4 AND turn % 2 = 0 THEN 'self_report' ELSE 'weak' END WHEN len(o) > 0 THEN 'weak' ELSE 'corroborated' END AS level, round(q, 6) AS text_overlap FROM x""")
def reader_grounding(spark, sf_dir):
    p = turn_pairs(spark, sf_dir).where("hypothesis is not null")
    g = grounding.grounding(F.col("truth"), F.col("hypothesis"), F.when(F.col("turn") % 2 == 0, "high").otherwise("none"), F.lit(False), F.lit(False))
    return p.select("case_id", g.alias("g")).select("case_id", "g.level", F.round("g.text_overlap", 6).alias("text_overlap"))


@query(f"""WITH {TURNS_SQL}, s AS (SELECT case_id, unnest({words_sql('truth')}) AS word, 1 AS a, 0 AS h FROM t WHERE hypothesis IS NOT NULL UNION ALL SELECT case_id, unnest({words_sql('hypothesis')}), 0, 1 FROM t WHERE hypothesis IS NOT NULL),
c AS (SELECT case_id, word, sum(a) AS a, sum(h) AS h FROM s GROUP BY ALL), k AS (SELECT case_id, sum(a) AS nt, sum(h) AS nh, sum(least(a, h)) AS nb FROM c GROUP BY ALL)
SELECT case_id, CAST(nt AS BIGINT) AS n_truth, CAST(nh AS BIGINT) AS n_hypothesis, CAST(nb AS BIGINT) AS n_both, round(nb / nh, 6) AS precision, round(nb / nt, 6) AS recall, round(2 * nb / (nt + nh), 6) AS f1 FROM k""")
def reader_token_scores(spark, sf_dir):
    return folds.token_scores(turn_pairs(spark, sf_dir).where("hypothesis is not null")).select("case_id", "n_truth", "n_hypothesis", "n_both", r6("precision"), r6("recall"), r6("f1"))


@query()
def reader_word_error_rate(spark, sf_dir):
    return turn_pairs(spark, sf_dir).where("hypothesis is not null").select("case_id", F.round(folds.word_error_rate(F.col("truth"), F.col("hypothesis")), 6).alias("wer"))


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as scored readings of three trials."""
    d = b.table(spark, sf_dir, "documents").join(b.table(spark, sf_dir, "labels"), "doc_id")
    k = F.col("doc_id")
    return d.select(
        F.col("lang").alias("reader"), (k % 3).alias("trial"), F.when(k % 4 == 0, "textless").when(k % 4 == 1, "chrome_only").otherwise("clean_text").alias("category"), F.when(F.col("quality") == 1, "clean").otherwise("partial").alias("legibility"),
        (k % 7 != 0).alias("verified"), (k % 5 != 0).alias("usable"), ((F.col("n_chars") % 100) / 100).alias("ocr_wer"), ((F.col("n_chars") % 50) / 100).alias("vision_wer"), ((F.col("n_chars") % 90) / 90).alias("recall"), ((F.col("n_chars") % 80) / 80).alias("f1"),
        (F.col("toxic") == 1).alias("flagged"), (F.col("n_chars") % 2 == 0).alias("claims_text"),
    )


EVAL_SQL = """e AS (SELECT lang AS reader, doc_id % 3 AS trial, CASE doc_id % 4 WHEN 0 THEN 'textless' WHEN 1 THEN 'chrome_only' ELSE 'clean_text' END AS category, quality <> 1 AS should, doc_id % 5 <> 0 AS usable, n_chars % 100 / 100 AS ow,
  CASE WHEN doc_id % 5 <> 0 THEN n_chars % 50 / 100 ELSE 1 END AS vw, CASE WHEN doc_id % 5 <> 0 THEN n_chars % 90 / 90 ELSE 0 END AS rc, CASE WHEN doc_id % 5 <> 0 THEN n_chars % 80 / 80 ELSE 0 END AS f1, toxic = 1 OR doc_id % 5 = 0 AS flagged, n_chars % 2 = 0 AS claims
  FROM documents JOIN labels USING (doc_id) WHERE doc_id % 7 <> 0),
s AS (SELECT reader, trial, count(*) AS cases, avg(ow) AS ocr_wer_mean, avg(vw) AS vision_wer_mean, avg(rc) AS text_recovery_accuracy, avg(f1) AS vision_token_f1_mean, avg(CASE WHEN category = 'textless' THEN CASE WHEN claims THEN 1.0 ELSE 0.0 END END) AS hallucination_rate,
  avg(CASE WHEN category = 'chrome_only' THEN CASE WHEN claims THEN 1.0 ELSE 0.0 END END) AS chrome_transcription_rate, count(*) FILTER (WHERE NOT usable) AS unusable_readings, count(*) FILTER (WHERE flagged AND should) / nullif(count(*) FILTER (WHERE flagged), 0) AS grounding_precision,
  count(*) FILTER (WHERE flagged AND should) / nullif(count(*) FILTER (WHERE should), 0) AS grounding_recall FROM e GROUP BY ALL)"""
METRICS = ["ocr_wer_mean", "vision_wer_mean", "text_recovery_accuracy", "vision_token_f1_mean", "hallucination_rate", "chrome_transcription_rate", "grounding_precision", "grounding_recall"]


@query(f"WITH {EVAL_SQL} SELECT reader, trial, cases, {', '.join(f'round({m}, 6) AS {m}' for m in METRICS)}, unusable_readings FROM s")
def eval_summary(spark, sf_dir):
    return folds.eval_summary(eval_rows(spark, sf_dir), ["reader", "trial"]).select("reader", "trial", "cases", *[r6(m) for m in METRICS], "unusable_readings")


def _spread(spark, sf_dir):
    return folds.trial_spread(folds.eval_summary(eval_rows(spark, sf_dir), ["reader", "trial"]), ["reader"], METRICS)


SPREAD_SQL = f"{EVAL_SQL}, u AS (UNPIVOT s ON {', '.join(METRICS)} INTO NAME metric VALUE value), d AS (SELECT reader, metric, avg(value) AS mean, min(value) AS least, max(value) AS most, count(value) AS trials, avg(value) - 0.03 AS floor FROM u GROUP BY ALL)"


@query(f"WITH {SPREAD_SQL} SELECT reader, metric, round(mean, 6) AS mean, round(least, 6) AS least, round(most, 6) AS most, trials, round(floor, 6) AS floor FROM d")
def eval_spread(spark, sf_dir):
    return _spread(spark, sf_dir).where("trials > 0").select("reader", "metric", r6("mean"), r6("least"), r6("most"), "trials", r6("floor"))


@query(f"""WITH {SPREAD_SQL}, q AS (SELECT reader, coalesce(max(CASE WHEN metric = 'text_recovery_accuracy' THEN mean END) >= 0.39, false) AS accuracy_ok, coalesce(max(CASE WHEN metric = 'vision_token_f1_mean' THEN mean END) >= 0.39, false) AS f1_ok,
coalesce(max(CASE WHEN metric = 'hallucination_rate' THEN most END) <= 0.6, false) AS hallucination_ok FROM d GROUP BY reader) SELECT *, accuracy_ok AND f1_ok AND hallucination_ok AS accepted FROM q""")
def eval_acceptance(spark, sf_dir):
    return folds.acceptance(_spread(spark, sf_dir), ["reader"], 0.39, 0.39, 0.6)


@query(f"WITH {b.SEGMENTS_SQL} SELECT source_id, seg_no, trim(text, ' ') AS text FROM seg WHERE avg_logprob >= -1.0")
def confident_segments(spark, sf_dir):
    return timeline.confident_segments(b.segments(spark, sf_dir)).select("source_id", "seg_no", "text")


@query(f"WITH {b.SEGMENTS_SQL} SELECT source_id, 'transcript' AS stage, 'low_confidence_segments_dropped' AS code, 'dropped ' || count(*) AS message, count(*) AS dropped FROM seg WHERE avg_logprob < -1.0 GROUP BY source_id")
def dropped_segments(spark, sf_dir):
    return timeline.dropped_segment_warnings(b.segments(spark, sf_dir))


@query(f"""WITH {b.SEGMENTS_SQL}, i AS (SELECT source_id, max(end_) AS duration, coalesce(sum(end_ - start_) FILTER (WHERE role = 'user'), 0) AS after_ FROM seg GROUP BY source_id), r AS (SELECT source_id, greatest(0.0, least(1.0, 1 - after_ / duration)) AS ratio FROM i WHERE duration > 0 AND after_ < duration)
SELECT source_id, round(ratio, 6) AS ratio, CASE WHEN ratio >= 0.9 THEN 'high' ELSE 'warning' END AS tier FROM r WHERE ratio >= 0.5""")
def voice_drop_tiers(spark, sf_dir):
    spoken = F.sum(F.when(F.col("role") == "user", F.col("end") - F.col("start")).otherwise(0.0))
    info = b.segments(spark, sf_dir).groupBy("source_id").agg(F.max("end").alias("duration"), spoken.alias("duration_after_vad")).withColumn("vad_filter", F.lit(True))
    return timeline.voice_drop(info).select("source_id", r6("ratio"), "tier")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'soon' ELSE CAST(value AS VARCHAR) END AS s, CASE WHEN event_id % 10 = 1 THEN NULL WHEN event_id % 10 = 4 THEN '1e999' ELSE CAST(value + 1 AS VARCHAR) END AS e, CASE WHEN event_id % 10 = 2 THEN 'NaN'::DOUBLE WHEN event_id % 10 = 5 THEN NULL ELSE value END AS w FROM events)
SELECT event_id, CASE WHEN NOT coalesce(isfinite(TRY_CAST(s AS DOUBLE)), false) THEN 'start' WHEN NOT coalesce(isfinite(TRY_CAST(e AS DOUBLE)), false) THEN 'end' WHEN NOT coalesce(isfinite(w), false) THEN 'words' END AS problem FROM e""")
def placement_problems(spark, sf_dir):
    k = F.col("event_id") % 10
    word = F.struct(F.lit("w").alias("word"), F.when(k == 2, F.lit(float("nan"))).when(k != 5, F.col("value")).alias("end"))
    s = b.table(spark, sf_dir, "events").select("event_id", F.when(k == 0, "soon").otherwise(F.col("value").cast("string")).alias("start"), F.when(k == 1, F.lit(None)).when(k == 4, "1e999").otherwise((F.col("value") + 1).cast("string")).alias("end"), F.array(word, F.when(k == 3, word)).alias("words"))
    return timeline.placement_problem(s).select("event_id", "problem")


@query("SELECT o_orderkey, CASE WHEN NOT (o_totalprice - 20000 > 0) THEN 'E_BAD_MEDIA' WHEN o_totalprice - 20000 > 200000 THEN 'E_DURATION_CAP' END AS reject_code FROM orders")
def duration_rejects(spark, sf_dir):
    return b.table(spark, sf_dir, "orders").select("o_orderkey", timeline.duration_reject((F.col("o_totalprice") - 20000).cast("double"), 200000.0).alias("reject_code"))


@query(f"""WITH {b.SEGMENTS_SQL} SELECT c_custkey AS source_id, CASE WHEN NOT EXISTS (SELECT 1 FROM seg WHERE source_id = c_custkey AND length(trim(text, ' ')) >= 3) AND NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = c_custkey) THEN 'E_NO_CONTENT' END AS reject_code FROM customer""")
def content_gate(spark, sf_dir):
    sources = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"))
    frames = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("extracted_text"), F.lit(False).alias("carries_reading"))
    return timeline.content_gate(sources, b.segments(spark, sf_dir), frames)


@query(f"WITH {b.SEGMENTS_SQL}, {b.FRAMES_SQL} SELECT source_id, count(*) AS frames, count(*) FILTER (WHERE adds_information IS NOT FALSE) AS kept, count(*) FILTER (WHERE adds_information IS NOT FALSE) = 0 AS all_redundant FROM frm GROUP BY source_id")
def filtered_frames(spark, sf_dir):
    return timeline.filtered_notes(b.frames(spark, sf_dir))


@query(f"""WITH {b.SEGMENTS_SQL}, {b.FRAMES_SQL}, f AS (SELECT frm.source_id, frame_index, ts, min(seg_no) AS seg_no FROM frm LEFT JOIN seg ON seg.source_id = frm.source_id AND end_ >= ts GROUP BY ALL)
SELECT f.source_id, frame_index, ts AS timestamp_sec, f.seg_no, CASE WHEN f.seg_no IS NULL THEN 'after_all' WHEN ts < start_ THEN 'before' ELSE 'inside' END AS place FROM f LEFT JOIN seg ON seg.source_id = f.source_id AND seg.seg_no = f.seg_no""")
def frame_places(spark, sf_dir):
    return timeline.interleave(b.frames(spark, sf_dir), b.segments(spark, sf_dir))


@query(f"""WITH {b.SEGMENTS_SQL}, {b.FRAMES_SQL}, m AS (SELECT frm.source_id, frame_index, seg_no, trim(text, ' ') AS t, coalesce(sum(length(trim(text, ' '))) OVER (PARTITION BY frm.source_id, frame_index ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
FROM frm JOIN seg ON seg.source_id = frm.source_id AND end_ >= ts - 30 AND start_ <= ts + 30 WHERE trim(text, ' ') <> ''), j AS (SELECT source_id, frame_index, string_agg(t, ' ' ORDER BY seg_no) AS "window" FROM m WHERE c <= 4800 GROUP BY ALL)
SELECT source_id, frame_index, coalesce("window", '') AS "window" FROM frm LEFT JOIN j USING (source_id, frame_index)""")
def transcript_windows(spark, sf_dir):
    return timeline.transcript_windows(b.frames(spark, sf_dir), b.segments(spark, sf_dir))


@query("""WITH r AS (SELECT event_type, user_id % 10 AS u, epoch(ts) AS t, event_id FROM events), x AS (SELECT p.event_id AS probe_id, p.u, p.t, max(q.t) AS last FROM r p LEFT JOIN r q ON q.event_type = 'error' AND q.u = p.u AND q.t <= p.t WHERE p.event_type = 'view' GROUP BY ALL)
SELECT probe_id, u AS endpoint, coalesce(t - last < 3600, false) AS skipped FROM x""")
def endpoint_probes(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("endpoint"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").withColumn("at", F.col("us") / 1e6)
    probes, records = e.where("event_type = 'view'").withColumnRenamed("event_id", "probe_id"), e.where("event_type = 'error'")
    return timeline.skipped_probes(probes, records, ["endpoint"], 3600.0).select("probe_id", "endpoint", "skipped")


@query(f"""WITH {b.ATTEMPTS_SQL}, i AS (SELECT *, sum(CASE WHEN code IS NULL OR code = 'local_vision_malformed_response' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY attempt) AS g FROM a),
n AS (SELECT *, sum(CASE WHEN code = 'local_vision_timeout' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, g ORDER BY attempt) AS k FROM i),
o AS (SELECT *, min(CASE WHEN code = 'local_vision_auth_rejected' OR (code = 'local_vision_timeout' AND k = 3) THEN attempt END) OVER (PARTITION BY run_id) AS opened_at FROM n)
SELECT run_id, attempt, code, opened_at, coalesce(attempt > opened_at, false) AS skipped FROM o""")
def breaker_islands(spark, sf_dir):
    return timeline.breaker(b.attempts(spark, sf_dir))


@query(f"""WITH {b.PROGRESS_SQL}, q AS (SELECT job_id, event_id_ AS sequence, percent, event_id_ - lag(event_id_) OVER (PARTITION BY job_id ORDER BY event_id_, ts) AS gap FROM (SELECT *, CASE WHEN sequence % 9 = 0 THEN sequence - 1 WHEN sequence % 7 = 0 THEN sequence + 1 ELSE sequence END AS event_id_ FROM p))
SELECT job_id, sequence, CASE WHEN gap = 0 THEN 'duplicate' WHEN gap > 1 THEN 'gap' ELSE 'percent' END AS problem FROM q WHERE gap = 0 OR gap > 1 OR percent < 0 OR percent > 100""")
def sequence_problems(spark, sf_dir):
    p = b.progress(spark, sf_dir)
    s = F.when(F.col("sequence") % 9 == 0, F.col("sequence") - 1).when(F.col("sequence") % 7 == 0, F.col("sequence") + 1).otherwise(F.col("sequence"))
    return timeline.sequence_problems(p.withColumn("sequence", s).withColumn("timestamp", F.col("ts"))).select("job_id", "sequence", "problem")


LATEST_SQL = f"{b.PROGRESS_SQL}, l AS (SELECT job_id, mechanism, arg_max(status, sequence) AS status, max_by(percent_, sequence) AS percent FROM (SELECT *, coalesce(percent, 0) AS percent_ FROM p) GROUP BY ALL), m AS (SELECT *, CAST(substr(mechanism, 2) AS INT) + 1 AS weight, CASE WHEN status IN ('completed', 'failed') THEN 100.0 ELSE round(greatest(0, least(100, percent)), 3) END AS pc FROM l)"


@query(f"WITH {LATEST_SQL} SELECT job_id, round(round(CASE WHEN count(*) FILTER (WHERE status IN ('completed', 'failed')) = 5 THEN 100.0 ELSE sum(weight * pc) / 15 END, 3), 1) AS overall_percent FROM m GROUP BY job_id")
def overall_progress(spark, sf_dir):
    return folds.overall_progress(b.progress(spark, sf_dir), b.weights(spark)).select("job_id", F.round("overall_percent", 1).alias("overall_percent"))


@query(f"WITH {LATEST_SQL} SELECT j.job_id, 'm' || k AS mechanism, coalesce(m.status, 'pending') AS status, round(coalesce(m.pc, 0.0), 2) AS percent FROM (SELECT DISTINCT job_id FROM p) j CROSS JOIN range(5) r(k) LEFT JOIN m ON m.job_id = j.job_id AND m.mechanism = 'm' || k")
def progress_summary(spark, sf_dir):
    return folds.progress_summary(b.progress(spark, sf_dir), b.weights(spark), False).select("job_id", "mechanism", "status", F.round("percent", 2).alias("percent"))


@query("""WITH i AS (SELECT user_id AS batch_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS batch_index, CASE WHEN event_type = 'error' THEN 'E_X' END AS code FROM events), f AS (SELECT *, min(CASE WHEN code IS NOT NULL THEN batch_index END) OVER (PARTITION BY batch_id) AS first_error FROM i)
SELECT batch_id, count(*) AS items, count(*) FILTER (WHERE code IS NULL) AS processed, count(*) FILTER (WHERE code IS NOT NULL) AS errors, min(first_error) AS first_error FROM f WHERE first_error IS NULL OR batch_index <= first_error GROUP BY batch_id""")
def batch_report(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    items = e.select(F.col("user_id").alias("batch_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("batch_index"), F.when(F.col("event_type") == "error", "E_X").alias("code"))
    return folds.batch_report(items, stop_at_first=True)


TRIAGE_SQL = "t AS (SELECT doc_id, source, n_chars, doc_id % 200 AS luminance, n_chars % 100 AS text_chars, CASE WHEN doc_id % 200 < 110 THEN 'dark_' ELSE 'light_' END || CASE WHEN n_chars % 100 <= 8 THEN 'none' WHEN n_chars % 100 <= 60 THEN 'low' ELSE 'high' END AS bucket FROM documents)"


def triage_frames(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("frame_index"), (F.col("doc_id") % 200).alias("luminance"), (F.col("n_chars") % 100).alias("text_chars"))


@query(f"WITH {TRIAGE_SQL} SELECT bucket, count(*) AS frames FROM t GROUP BY bucket")
def triage_counts(spark, sf_dir):
    return folds.triage_counts(triage_frames(spark, sf_dir))


@query(f"WITH {TRIAGE_SQL} SELECT bucket, source AS source_id, doc_id AS frame_index, luminance, text_chars, row_number() OVER (PARTITION BY bucket ORDER BY luminance, source, doc_id) AS rank FROM t QUALIFY rank <= 3")
def triage_samples(spark, sf_dir):
    return folds.triage_samples(triage_frames(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH c AS (SELECT *, count(*) OVER (PARTITION BY source, n_chars) AS same FROM documents) SELECT doc_id, CASE WHEN same > 1 THEN 'id is not unique' WHEN lang = 'es' THEN 'unknown category' WHEN n_chars % 10 = 0 THEN 'unknown legibility' WHEN n_chars % 2 = 0 THEN 'has_text contradicts the category' WHEN text IS NULL OR contains(text, 'an') THEN 'verified without truth' WHEN trim(text, ' ') = '' THEN 'truth contradicts has_text' END AS problem FROM c""")
def label_problems(spark, sf_dir):
    """Source and length of a document are its id, so ids repeat as the data have it; notes with one word are unverified."""
    d = b.table(spark, sf_dir, "documents")
    n = F.col("n_chars")
    note = F.replace("text", F.lit("an"), F.lit("UNVERIFIED"))
    return folds.label_problem(
        d.select("doc_id", F.concat_ws(":", "source", n.cast("string")).alias("id"), F.when(F.col("lang") == "es", "song").otherwise("clean_text").alias("category"), F.when(n % 10 == 0, "foggy").otherwise("clean").alias("legibility"), (n % 2 != 0).alias("has_text"), F.lit(True).alias("verified"), text.truth_text(note).alias("truth"))
    ).select("doc_id", "problem")


@query(f"WITH {b.BUNDLES_SQL} SELECT bundle_key, verdict, servable FROM v")
def bundle_verdicts(spark, sf_dir):
    return store.bundle_verdicts(b.bundles(spark, sf_dir), b.generations(spark, sf_dir)).select("bundle_key", "verdict", "servable")


@query(f"WITH {b.BUNDLES_SQL} SELECT bundle_key, name FROM g WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.bundle_key = g.bundle_key AND act.active = g.name)")
def orphan_generations(spark, sf_dir):
    return store.orphan_generations(b.generations(spark, sf_dir), b.bundles(spark, sf_dir).where("active is not null")).select("bundle_key", "name")


RETENTION_SQL = "rk AS (SELECT *, row_number() OVER (PARTITION BY bundle_key ORDER BY gen_no DESC) AS rank FROM g)"


@query(f"WITH {b.BUNDLES_SQL}, {RETENTION_SQL} SELECT rk.bundle_key, rk.name FROM rk LEFT JOIN act ON act.bundle_key = rk.bundle_key WHERE rank > 3 AND rk.name IS DISTINCT FROM active")
def retention_targets(spark, sf_dir):
    return store.retention(b.generations(spark, sf_dir), b.bundles(spark, sf_dir).where("active is not null"), 3).select("bundle_key", "name")


PRUNE_SQL = f"""{b.BUNDLES_SQL}, {RETENTION_SQL}, nw AS (SELECT bundle_key, max(mtime) AS newest FROM g GROUP BY bundle_key),
own AS (SELECT v.*, CASE WHEN verdict = 'owned' THEN 'orphan' WHEN epoch(TIMESTAMP '1998-08-03') - epoch(greatest(TIMESTAMP '1996-01-01', newest)) > 365 * 86400 THEN 'expiry' WHEN NOT servable THEN 'all' ELSE 'retention' END AS rule FROM v LEFT JOIN nw USING (bundle_key) WHERE verdict NOT IN ('absent', 'foreign', 'invalid') AND NOT locked),
pl AS (SELECT bundle_key, '' AS target, rule AS reason FROM own WHERE rule IN ('orphan', 'expiry') UNION ALL SELECT g.bundle_key, name, 'orphan' FROM g JOIN own USING (bundle_key) WHERE rule = 'all'
UNION ALL SELECT rk.bundle_key, name, 'retention' FROM rk JOIN own USING (bundle_key) WHERE rule = 'retention' AND rank > 2 AND name <> own.active
UNION ALL SELECT g.bundle_key, '.tmp.' || name, 'staging' FROM g JOIN own USING (bundle_key) WHERE rule IN ('all', 'retention') AND o_orderstatus = 'P')"""


def _plan(spark, sf_dir, keep=2):
    g = b.generations(spark, sf_dir)
    staging = g.where("o_orderstatus = 'P'").select("bundle_key", F.concat(F.lit(".tmp."), "name").alias("name"))
    return store.prune_plan(b.bundles(spark, sf_dir), g, staging, F.lit("1998-08-03"), keep, 365)


@query(f"WITH {PRUNE_SQL} SELECT * FROM pl")
def prune_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(f"""WITH {PRUNE_SQL}, old AS (SELECT bundle_key, name AS target FROM rk WHERE rank > 1)
SELECT old.bundle_key, old.target, CASE WHEN act.active = old.target THEN 'active' WHEN pl.target IS NULL THEN 'no longer proposed' END AS skip_reason, CASE WHEN act.active IS NOT DISTINCT FROM old.target OR pl.target IS NULL THEN 'skip' ELSE 'delete' END AS outcome
FROM old LEFT JOIN pl ON pl.bundle_key = old.bundle_key AND pl.target = old.target LEFT JOIN act ON act.bundle_key = old.bundle_key""")
def prune_outcomes(spark, sf_dir):
    newest = Window.partitionBy("bundle_key").orderBy(F.desc("gen_no"))
    old = b.generations(spark, sf_dir).withColumn("rank", F.row_number().over(newest)).where("rank > 1").select("bundle_key", F.col("name").alias("target"))
    return store.revalidate(old, _plan(spark, sf_dir), b.bundles(spark, sf_dir)).select("bundle_key", "target", "skip_reason", "outcome")


@query(f"WITH {b.BUNDLES_SQL} SELECT v.bundle_key, verdict, active, count(name) AS generations, count(name) FILTER (WHERE name IS DISTINCT FROM active) AS orphans, coalesce(string_agg(name, ',' ORDER BY gen_no), '') AS names FROM v LEFT JOIN g ON g.bundle_key = v.bundle_key GROUP BY v.bundle_key, verdict, active")
def store_survey(spark, sf_dir):
    s = store.survey(b.bundles(spark, sf_dir), b.generations(spark, sf_dir))
    return s.select("bundle_key", "verdict", "active", F.size("generations").cast("long").alias("generations"), F.size("orphans").cast("long").alias("orphans"), F.array_join("generations", ",").alias("names"))


@query(f"WITH {b.GENERATIONS_SQL} SELECT bundle_key, 'g' || (max(gen_no) + 1) AS name FROM g GROUP BY bundle_key")
def next_generations(spark, sf_dir):
    g = b.generations(spark, sf_dir)
    return store.next_generation(g, g)


@query(f"""WITH {b.BUNDLES_SQL}, c AS (SELECT o_orderkey AS run_id, k AS entry, o_custkey + k AS bundle_key, CASE WHEN o_orderkey % 3 = 0 THEN 'selected' ELSE 'auto' END AS mode, o_orderkey % 10 = 1 AS force FROM orders, range(3) r(k)),
h AS (SELECT run_id, arg_min(c.bundle_key, entry) AS hit_key, min(entry) AS hit_entry FROM c JOIN v ON v.bundle_key = c.bundle_key WHERE NOT force AND servable AND (mode <> 'selected' OR v.bundle_key % 2 > 0) GROUP BY run_id), p AS (SELECT o_orderkey AS run_id, min(k) AS open_entry FROM orders, range(3) r(k) WHERE (o_orderkey + k) % 4 = 0 GROUP BY ALL)
SELECT o_orderkey AS run_id, CASE WHEN hit_key IS NOT NULL THEN 'cache' WHEN open_entry IS NOT NULL THEN 'reader' ELSE 'chain_exhausted' END AS answer, coalesce(hit_entry, open_entry) AS entry, hit_key FROM orders LEFT JOIN h ON h.run_id = o_orderkey LEFT JOIN p ON p.run_id = o_orderkey""")
def cache_resolution(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("entry"))
    candidates = o.select("run_id", "entry", (F.col("o_custkey") + F.col("entry")).alias("bundle_key"), F.when(F.col("run_id") % 3 == 0, "selected").otherwise("auto").alias("mode"), (F.col("run_id") % 10 == 1).alias("force"))
    servable = store.bundle_verdicts(b.bundles(spark, sf_dir), b.generations(spark, sf_dir)).where("servable").select("bundle_key", (F.col("bundle_key") % 2).alias("readings"))
    return store.resolve_from_cache(candidates, servable, o.select("run_id", "entry", ((F.col("run_id") + F.col("entry")) % 4 == 0).alias("answered")))


def stage_results(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    version = F.when(k % 5 == 0, "true").when(k % 5 == 1, "2").otherwise("1")
    payload = F.when(k % 7 == 0, "[]").otherwise(F.concat(F.lit('{"image_path": "'), F.when(k % 11 == 0, "../x.png").otherwise("frames/x.png"), F.lit('"}')))
    doc = F.concat(F.lit('{"schema_version": '), version, F.lit(', "bundle_key": "'), F.col("o_custkey").cast("string"), F.lit('", "stage": "'), F.col("o_orderstatus"), F.lit('", "payload": '), payload, F.lit("}"))
    return o.select(F.col("o_custkey").cast("string").alias("bundle_key"), F.col("o_orderstatus").alias("stage"), doc.alias("document"))


@query("""WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS bundle_key, o_orderstatus AS stage, CASE WHEN o_orderkey % 5 < 2 THEN 'schema_version' WHEN o_orderkey % 7 = 0 THEN 'payload' WHEN o_orderkey % 11 = 0 THEN 'path' END AS problem FROM orders),
w AS (SELECT CAST(c_custkey AS VARCHAR) AS bundle_key, s AS stage FROM customer, (VALUES ('F'), ('O'), ('P')) t(s))
SELECT bundle_key, stage, coalesce(min(problem), 'missing') AS reason FROM w LEFT JOIN r USING (bundle_key, stage) GROUP BY ALL HAVING count(*) FILTER (WHERE r.problem IS NULL AND EXISTS (SELECT 1 FROM r q WHERE q.bundle_key = w.bundle_key AND q.stage = w.stage AND q.problem IS NULL)) = 0""")
def stage_work_list(spark, sf_dir):
    wanted = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("bundle_key"), F.explode(F.array(*[F.lit(s) for s in "FOP"])).alias("stage"))
    return store.work_list(wanted, stage_results(spark, sf_dir))


@query("SELECT l_orderkey AS source_id, arg_min(path, (rank, suffix, path)) AS path FROM (SELECT l_orderkey, 'd/' || l_suppkey || suffix AS path, suffix, CASE suffix WHEN '.mp4' THEN 1 WHEN '.mkv' THEN 2 WHEN '.webm' THEN 3 WHEN '.mov' THEN 4 WHEN '.m4v' THEN 5 ELSE 6 END AS rank FROM (SELECT *, CASE l_partkey % 5 WHEN 0 THEN '.avi' WHEN 1 THEN '.mkv' WHEN 2 THEN '.webm' WHEN 3 THEN '.mp4' ELSE '.part' END AS suffix FROM lineitem)) GROUP BY l_orderkey")
def container_pick(spark, sf_dir):
    li = b.table(spark, sf_dir, "lineitem")
    m = F.col("l_partkey") % 5
    suffix = F.when(m == 0, ".avi").when(m == 1, ".mkv").when(m == 2, ".webm").when(m == 3, ".mp4").otherwise(".part")
    return store.pick_container(li.select(F.col("l_orderkey").alias("source_id"), F.concat(F.lit("d/"), F.col("l_suppkey").cast("string"), suffix).alias("path")))


@query("SELECT fingerprint, count(DISTINCT doc_id) AS sources, min(doc_id) AS first_source FROM (SELECT doc_id, sha256(text) AS fingerprint FROM documents) GROUP BY fingerprint HAVING count(DISTINCT doc_id) > 1")
def duplicate_sources(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").select("doc_id", identity.content_fingerprint(F.encode("text", "UTF-8"), F.octet_length("text")).alias("fingerprint"))
    return identity.duplicate_sources(d, source="doc_id")


@query("SELECT sha256('labels:' || string_agg(sha256(source || chr(0) || coalesce(text, '')), ':' ORDER BY doc_id)) AS digest FROM documents")
def corpus_digest(spark, sf_dir):
    return identity.corpus_digest(b.table(spark, sf_dir, "documents"), "labels", "doc_id", "source", "text")


@query("""SELECT o_orderkey, sha256(sha256(CAST(o_orderkey AS VARCHAR)) || ':' || sha256('{"level":"' || o_orderpriority || '","price":"0.0","status":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}')) AS bundle_key FROM orders""")
def bundle_keys(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders")
    options = F.create_map(F.lit("status"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit("price"), F.lit("-0.0"), F.lit("level"), F.col("o_orderpriority"))
    return o.select("o_orderkey", identity.bundle_key(identity.video_fingerprint(F.col("o_orderkey").cast("string")), identity.options_hash(options)).alias("bundle_key"))


def described(spark, sf_dir):
    p = b.table(spark, sf_dir, "pages")
    k = F.col("page_id")
    word = F.when(k % 4 == 0, "Docs and slides").when(k % 4 == 1, "Sponsored").when(k % 4 == 2, "See").otherwise("- The repo:")
    url = F.when(k % 5 == 0, F.concat(F.lit("https://github.com/a/"), k.cast("string"), F.lit("."))).otherwise(F.col("url"))
    return p.select((F.floor(k / 10)).cast("long").alias("source_id"), k.alias("page_id"), F.concat(word, F.lit(" "), url, F.lit("\nagain "), url, F.lit(" code")).alias("text"))


@query("""WITH p AS (SELECT page_id, CAST(floor(page_id / 10) AS BIGINT) AS source_id, page_id % 4 AS k, CASE WHEN page_id % 5 = 0 THEN 'https://github.com/a/' || page_id || '.' ELSE url END AS raw FROM pages),
u AS (SELECT *, regexp_replace(regexp_replace(raw, '[.,;:!?]+$', ''), '#.*$', '') AS url FROM p), f AS (SELECT page_id * 2 AS line_no, url, CASE WHEN page_id % 5 = 0 THEN 'code_or_reference_domain' WHEN k = 0 OR k = 3 OR raw ILIKE '%example%' THEN 'relevant_context' END AS reason, k = 1 AS promo FROM u UNION ALL SELECT page_id * 2 + 1, url, CASE WHEN page_id % 5 = 0 THEN 'code_or_reference_domain' ELSE 'relevant_context' END, false FROM u)
SELECT page_id AS source_id, url, reason FROM (SELECT line_no // 2 AS page_id, url, reason, row_number() OVER (PARTITION BY line_no // 2, url ORDER BY line_no) AS n FROM f WHERE NOT promo AND reason IS NOT NULL) WHERE n = 1""")
def related_links(spark, sf_dir):
    return links.extract_links(described(spark, sf_dir).drop("source_id").withColumnRenamed("page_id", "source_id"), "source_id", "text", redact=False).select("source_id", "url", "reason")


@query(r"""WITH v AS (SELECT page_id, left(md5(coalesce(url, '')), 9 + page_id % 3) AS id, page_id % 7 AS k FROM pages),
u AS (SELECT page_id, CASE k WHEN 0 THEN 'https://www.youtube.com/watch?v=' || id || '&t=90s' WHEN 1 THEN 'https://m.youtube.com/watch?start=3&v=' || id || '&list=x' WHEN 2 THEN 'https://youtu.be/' || id || '?t=4#t=5' WHEN 3 THEN 'https://youtube.com/shorts/' || id WHEN 4 THEN 'https://youtube.com/watch?v=' || id || '&v=' || id WHEN 5 THEN 'https://vimeo.com/watch?v=' || id || '&t=1' ELSE 'https://music.youtube.com/embed/' || id || '/x' END AS url FROM v),
x AS (SELECT *, regexp_extract(url, '^https://([^/]+)', 1) AS host, string_split(regexp_extract(url, '^https://[^/]+/([^?#]*)', 1), '/') AS path, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda q: q <> '') AS args FROM u),
y AS (SELECT *, host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'youtu.be', 'music.youtube.com') AS known, list_transform(list_filter(args, lambda q: starts_with(q, 'v=')), lambda q: q[3:]) AS vs, list_filter(args, lambda q: NOT regexp_matches(q, '^(t|start|end|time_continue)=')) AS kept FROM x),
z AS (SELECT *, CASE WHEN host = 'youtu.be' THEN path[1] WHEN path[1] IN ('shorts', 'embed', 'live', 'v') AND len(path) >= 2 THEN path[2] ELSE vs[1] END AS found, CASE WHEN host = 'youtu.be' THEN CASE WHEN len(path) = 1 THEN path[1] END WHEN path[1] IN ('shorts', 'embed', 'live', 'v') THEN CASE WHEN len(path) = 2 THEN path[2] END WHEN len(vs) = 1 THEN vs[1] END AS sure FROM y)
SELECT page_id, CASE WHEN known THEN nullif(found, '') END AS video_id, CASE WHEN known AND len(list_filter(args, lambda q: starts_with(q, 'list='))) = 0 AND regexp_matches(sure, '^[0-9A-Za-z_-]{11}$') THEN sure END AS certain_id,
CASE WHEN known AND len(kept) < len(args) THEN regexp_extract(url, '^[^?#]*') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || CASE WHEN regexp_matches(url, '#t=') THEN '' ELSE regexp_extract(url, '#.*$') END ELSE url END AS plain FROM z""")
def video_urls(spark, sf_dir):
    """Ids of nine to eleven characters from the pages' urls in seven shapes of video urls."""
    k = F.col("page_id") % 7
    v = F.expr("left(md5(coalesce(url, '')), cast(9 + page_id % 3 as int))")
    shapes = [("https://www.youtube.com/watch?v=", "&t=90s"), ("https://m.youtube.com/watch?start=3&v=", "&list=x"), ("https://youtu.be/", "?t=4#t=5"), ("https://youtube.com/shorts/", ""), None, ("https://vimeo.com/watch?v=", "&t=1"), ("https://music.youtube.com/embed/", "/x")]
    url = F.concat(F.lit("https://youtube.com/watch?v="), v, F.lit("&v="), v)
    for i, shape in enumerate(shapes):
        if shape:
            url = F.when(k == i, F.concat(F.lit(shape[0]), v, F.lit(shape[1]))).otherwise(url)
    return b.table(spark, sf_dir, "pages").select("page_id", links.video_id(url).alias("video_id"), links.certain_video_id(url).alias("certain_id"), links.plain_video_url(url).alias("plain"))


@query("SELECT doc_id, nullif(trim(string_split(trim(replace(text, '. ', '.' || chr(10) || chr(10)), ' '), chr(10) || chr(10))[1], ' '), '') AS paragraph FROM documents")
def first_paragraphs(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.first_paragraph(F.replace("text", F.lit(". "), F.lit(".\n\n"))).alias("paragraph"))


@query("SELECT event_id, CAST(event_id % 30 * 3600 + event_id % 60 * 60 + round(value % 60, 2) AS DOUBLE) AS seconds FROM events")
def log_seconds(spark, sf_dir):
    k = F.col("event_id")
    line = F.concat(F.lit("out_time="), (k % 30).cast("string"), F.lit(":"), (k % 60).cast("string"), F.lit(":"), F.round(F.col("value") % 60, 2).cast("string"))
    return b.table(spark, sf_dir, "events").select("event_id", text.media_seconds(line).alias("seconds"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN round(floor(round(value, 1) * 1024) * 100.0 / 1024000, 4) END AS percent, CASE WHEN event_id % 2 = 0 THEN CAST(floor(round(value, 1) * 1024) AS BIGINT) END AS downloaded_bytes, event_id % 2 = 1 AS indeterminate FROM (SELECT event_id, round(value, 1) AS value FROM events)")
def download_lines(spark, sf_dir):
    v = F.round("value", 1)
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[download] "), v.cast("decimal(20,1)").cast("string"), F.lit("KiB of 1000KiB"))).otherwise("[download] soon")
    p = text.download_progress(line)
    return b.table(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", F.round("p.percent", 4).alias("percent"), "p.downloaded_bytes", "p.indeterminate")


@query(f"WITH {b.SEGMENTS_SQL} SELECT source_id, seg_no, lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '.000' AS stamp FROM (SELECT *, CAST(floor(end_) AS BIGINT) AS s FROM seg)")
def timestamps(spark, sf_dir):
    return b.segments(spark, sf_dir).select("source_id", "seg_no", text.timestamp(F.floor("end").cast("double")).alias("stamp"))


@query("""SELECT doc_id, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0) AS longest, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0) + 1) AS fence FROM (SELECT doc_id, replace(replace(text, 'e', '`'), 't', '``') AS t FROM documents)""")
def fences(spark, sf_dir):
    t = F.replace(F.replace("text", F.lit("e"), F.lit("`")), F.lit("t"), F.lit("``"))
    return b.table(spark, sf_dir, "documents").withColumn("t", t).select("doc_id", F.coalesce(F.array_max(F.transform(F.regexp_extract_all("t", F.lit("`+"), 0), lambda x: F.length(x).cast("long"))), F.lit(0).cast("long")).alias("longest"), F.length(text.fence(F.col("t"))).cast("long").alias("fence"))


@query(f"SELECT doc_id, len({words_sql('text')}) AS words, len(list_filter({words_sql('text')}, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))) > 0 AS claims FROM documents")
def compared_words(spark, sf_dir):
    t = F.col("text")
    return b.table(spark, sf_dir, "documents").select("doc_id", F.size(text.compared_words(t)).cast("long").alias("words"), text.claims_text(t).alias("claims"))


def replies(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    body = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("verbatim_text"), F.when(k % 3 == 0, "SLIDE").otherwise("poster").alias("frame_kind"), F.lit("High").alias("text_confidence"), (k % 2 == 0).alias("adds_information"), F.lit("says {more}").alias("reason")))
    made = F.when(k % 6 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 6 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done }"))).when(k % 6 == 2, "{}").when(k % 6 == 3, "no").otherwise(body)
    return d.select("doc_id", made.alias("reply"), F.when(k % 10 == 9, "local_vision_timeout").alias("code"), F.expr("left(coalesce(text, ''), cast(floor(length(text) / 3) as int))").alias("ocr_text"), (k % 4 != 0).alias("wants_salience"))


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS v, left(coalesce(text, ''), length(text) // 3) AS o, doc_id % 10 = 9 AS late, doc_id % 6 IN (2, 3) OR trim(coalesce(text, ''), ' ') = '' AS bad FROM documents),
k AS (SELECT *, list_distinct(regexp_extract_all(lower(v), '[a-z0-9]{2,}')) AS a, list_distinct(regexp_extract_all(lower(o), '[a-z0-9]{2,}')) AS b FROM d), q AS (SELECT *, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(a) END AS overlap FROM k)
SELECT doc_id, CASE WHEN late THEN 'local_vision_timeout' WHEN bad THEN 'local_vision_malformed_response' END AS warning_code, CASE WHEN NOT late AND NOT bad THEN CASE WHEN doc_id % 3 = 0 THEN 'slide' ELSE '' END END AS frame_kind, CASE WHEN NOT late AND NOT bad AND doc_id % 4 <> 0 THEN doc_id % 2 = 0 END AS adds_information,
CASE WHEN late OR bad THEN 'ungrounded' WHEN overlap >= 0.5 THEN 'corroborated' WHEN overlap IS NOT NULL THEN 'weak' WHEN len(a) >= 4 THEN 'self_report' WHEN len(a) > 0 OR len(b) > 0 THEN 'weak' ELSE 'self_report' END AS level, CASE WHEN NOT late AND NOT bad THEN round(overlap, 6) END AS text_overlap,
CASE WHEN NOT late AND NOT bad THEN length(trim(v, ' ')) END AS chars FROM q""")
def frame_outcomes(spark, sf_dir):
    found = grounding.frame_outcomes(replies(spark, sf_dir))
    return found.select("doc_id", "warning_code", "reading.frame_kind", "salience.adds_information", "grounding.level", F.round("grounding.text_overlap", 6).alias("text_overlap"), F.length("reading.verbatim_text").cast("long").alias("chars"))


@query(f"""WITH {b.PROGRESS_SQL}, {b.ADVANCES_SQL}, n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, sequence) AS nx FROM adv) SELECT job_id, sequence, 'E_STUCK' AS code, round(epoch(nx) - epoch(ts), 3) AS stalled_sec FROM n WHERE epoch(nx) - epoch(ts) >= 3600 AND status NOT IN ('completed', 'failed')""")
def stalls(spark, sf_dir):
    return stream.stalls(b.progress(spark, sf_dir), 3600.0).withColumn("stalled_sec", F.round("stalled_sec", 3))


@query(f"""WITH {b.PROGRESS_SQL}, l AS (SELECT job_id, arg_max(status, (ts, seq)) AS status, arg_max(seq, (ts, seq)) AS seq, max(ts) AS updated_at FROM p GROUP BY job_id), n AS (SELECT max(ts) AS now FROM p)
SELECT job_id, CASE WHEN status = 'running' AND epoch(now) - epoch(updated_at) > 90 THEN 'abandoned' ELSE status END AS status, CASE WHEN status = 'completed' THEN 'r' || seq END AS result, CASE WHEN status = 'failed' THEN 'e' || seq END AS error FROM l, n""")
def job_status(spark, sf_dir):
    p = b.progress(spark, sf_dir).select("job_id", "status", F.col("ts").cast("timestamp").alias("updated_at"), "seq", F.concat(F.lit("r"), "seq").alias("result"), F.concat(F.lit("e"), "seq").alias("error"))
    return stream.job_status(p).select("job_id", "status", "result", "error")


@query(f"WITH {b.WARNINGS_SQL} SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, stage, code, CAST(sum(CASE WHEN occurrences >= 1 THEN occurrences ELSE 1 END) AS BIGINT) AS occurrences FROM w GROUP BY ALL")
def windowed_warnings(spark, sf_dir):
    w = b.warnings(spark, sf_dir)
    return stream.windowed_counts(w, width="1 hour").withColumn("window_start", F.col("window_start").cast(w.schema["ts"].dataType))


@query("SELECT user_id, count(*) AS lines, count(*) FILTER (WHERE event_id % 3 = 0) AS progress, count(*) FILTER (WHERE event_id % 3 = 1) AS errors FROM events GROUP BY user_id")
def progress_log(spark, sf_dir):
    k = F.col("event_id")
    line = F.when(k % 3 == 0, F.to_json(F.struct(F.lit("progress").alias("type"), k.alias("sequence")))).when(k % 3 == 1, F.to_json(F.struct(F.lit("E_X").alias("code")))).otherwise("frame= 12 {")
    logged = recordings.parse_log(b.table(spark, sf_dir, "events").select("user_id", line.alias("value")))
    return logged.groupBy("user_id").agg(F.count("*").alias("lines"), F.count_if(F.col("kind") == "progress").alias("progress"), F.count_if(F.col("kind") == "error").alias("errors"))


@query(r"""WITH k AS (SELECT c_custkey, c_custkey % 9 AS k, '"title": "' || replace(c_name, '"', '') || '"' AS title FROM customer),
m AS (SELECT c_custkey, '{"pipeline_version": ' || CASE WHEN k = 0 THEN 'true' ELSE '3' END || ', "duration_sec": 1.5, "frame_count": ' || CASE WHEN k = 1 THEN '2' ELSE '1' END || ', "frames": [{"relative_path": "' || CASE WHEN k = 2 THEN '/etc/x.png' ELSE 'frames/frame_0001.png' END || '"}]' || CASE WHEN k = 3 THEN '' ELSE ', "bundle_key": "b"' END ||
  ', "provenance": {' || CASE k WHEN 4 THEN '"author": 1' WHEN 5 THEN '"title": 7' WHEN 6 THEN '"canonical_url": "https://youtu.be/abcdefghijk"' WHEN 7 THEN title || ', "processed_at": "yesterday"' ELSE title || ', "canonical_url": "https://www.youtube.com/watch?v=abcdefghijk", "processed_at": "2024-01-01T00:00:00Z"' END || '}}' AS j FROM k)
SELECT c_custkey, CASE WHEN json_type(j, '$.pipeline_version') NOT IN ('BIGINT', 'UBIGINT') THEN 'pipeline_version' WHEN json_type(j, '$.bundle_key') IS NULL THEN 'bundle_key' WHEN CAST(json_extract(j, '$.frame_count') AS INT) <> json_array_length(j, '$.frames') THEN 'frame_count'
WHEN NOT regexp_matches(json_extract_string(j, '$.frames[0].relative_path'), '^frames/frame_[0-9]{4,}\.png$') THEN 'frames' WHEN json_keys(j, '$.provenance') <> list_filter(json_keys(j, '$.provenance'), lambda x: x IN ('title', 'channel', 'description', 'upload_date', 'canonical_url', 'duration_sec', 'processed_at')) THEN 'provenance keys'
WHEN json_type(j, '$.provenance.title') <> 'VARCHAR' THEN 'provenance text' WHEN NOT regexp_matches(json_extract_string(j, '$.provenance.canonical_url'), '^https://www\.youtube\.com/watch\?v=[0-9A-Za-z_-]{11}$') THEN 'provenance url'
WHEN NOT regexp_matches(json_extract_string(j, '$.provenance.processed_at'), '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:]{8}Z$') THEN 'provenance time' END AS problem FROM m""")
def manifest_problems(spark, sf_dir):
    k = F.col("c_custkey") % 9
    title = F.concat(F.lit('"title": "'), F.replace("c_name", F.lit('"'), F.lit("")), F.lit('"'))
    known = F.concat(title, F.lit(', "canonical_url": "https://www.youtube.com/watch?v=abcdefghijk", "processed_at": "2024-01-01T00:00:00Z"'))
    facts = F.when(k == 4, '"author": 1').when(k == 5, '"title": 7').when(k == 6, '"canonical_url": "https://youtu.be/abcdefghijk"').when(k == 7, F.concat(title, F.lit(', "processed_at": "yesterday"'))).otherwise(known)
    doc = F.concat(
        F.lit('{"pipeline_version": '), F.when(k == 0, "true").otherwise("3"), F.lit(', "tool_version": "1", "source_type": "x", "source_resolved_path": "p", "duration_sec": 1.5, "options": {}, "transcript_present": true, "warning_count": 0, "warnings": [], "frame_count": '), F.when(k == 1, "2").otherwise("1"),
        F.lit(', "frames": [{"relative_path": "'), F.when(k == 2, "/etc/x.png").otherwise("frames/frame_0001.png"), F.lit('"}]'), F.when(k == 3, "").otherwise(', "bundle_key": "b"'), F.lit(', "provenance": {'), facts, F.lit("}}"),
    )
    return store.manifest_problem(b.table(spark, sf_dir, "customer").select("c_custkey", doc.alias("manifest_json"))).select("c_custkey", "problem")


def _luminance(pdf):
    """A stand-in for a model: the number of characters that are not white space."""
    import pandas as pd

    if (pdf["n_chars"] % 97 == 0).any():
        raise ValueError("unreadable")
    return pd.DataFrame({"ink": pdf["text"].str.replace(r"\s", "", regex=True).str.len()})


@query("SELECT doc_id, CASE WHEN n_chars % 97 <> 0 THEN length(regexp_replace(text, '\\s', '', 'g')) END AS ink, CASE WHEN n_chars % 97 = 0 THEN 'ValueError: unreadable' END AS failure FROM documents")
def inference_hook(spark, sf_dir):
    return inference.infer(b.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), _luminance, "ink long").select("doc_id", "ink", "failure")


@query("SELECT source, count(*) AS documents, count(*) FILTER (WHERE regexp_matches(text, '\"[0-9a-f]{40}\"')) AS marked FROM documents GROUP BY source")
def redaction_false_positives(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.when(F.array_contains(redaction.mark_kinds(redaction.redacted(F.col("text"))), "assigned-secret"), 1).otherwise(0)).alias("marked"))


from . import policy_queries, record_queries, stream_queries  # noqa: E402, F401 - they register more
