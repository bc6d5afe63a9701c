"""Registered streaming queries: the events table read as a stream and drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import progress as stream
from . import bindings as b
from .registry import query


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of progress: the roles of ``bindings.progress``, with the event's number as sequence."""
    # A pattern, since a table may be one file or a folder of files.
    e = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return e.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), F.col("event_id").alias("sequence"), F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("mechanism"), status.alias("status"),
        F.when(F.col("event_type") != "view", F.col("value") * 3).alias("percent"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "user_id",
    )


NUMBERED_SQL = b.PROGRESS_SQL.replace("row_number() OVER (PARTITION BY user_id ORDER BY event_id)", "event_id")
LATEST_SQL = f"{NUMBERED_SQL}, l AS (SELECT job_id, mechanism, arg_max(status, sequence) AS status, max_by(percent_, sequence) AS percent FROM (SELECT *, coalesce(percent, 0) AS percent_ FROM p) GROUP BY ALL), m AS (SELECT *, CAST(substr(mechanism, 2) AS INT) + 1 AS weight, CASE WHEN status IN ('completed', 'failed') THEN 100.0 ELSE round(greatest(0, least(100, percent)), 3) END AS pc FROM l)"


@query(f"WITH {LATEST_SQL} SELECT job_id, (SELECT max(sequence) FROM p WHERE p.job_id = m.job_id) AS sequence, round(CASE WHEN count(*) FILTER (WHERE status IN ('completed', 'failed')) = 5 THEN 100.0 ELSE sum(weight * pc) / 15 END, 1) AS overall_percent FROM m GROUP BY job_id")
def streamed_progress(spark, sf_dir):
    rows = stream.drained(stream.live_progress(events(spark, sf_dir), {f"m{i}": i + 1.0 for i in range(5)}, digits=9), "update")
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("sequence", "overall_percent"), F.struct("batch", "sequence")).alias("r"))
    return last.select("job_id", "r.sequence", F.round("r.overall_percent", 1).alias("overall_percent"))


@query(f"""WITH {NUMBERED_SQL}, {b.ADVANCES_SQL}, n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, sequence) AS nx FROM adv), z AS (SELECT max(ts) - INTERVAL 1 minute AS mark FROM p)
SELECT job_id, sequence, 'E_STUCK' AS code FROM n, z WHERE status NOT IN ('completed', 'failed') AND epoch(coalesce(nx, mark)) - epoch(ts) >= 3600""")
def streamed_stalls(spark, sf_dir):
    return stream.drained(stream.stream_stalls(events(spark, sf_dir), 3600.0), "append").select("job_id", "sequence", "code").distinct()


@query(f"""WITH {NUMBERED_SQL}, l AS (SELECT job_id, arg_max(status, (ts, seq)) AS status, max(ts) AS updated_at FROM p GROUP BY job_id), n AS (SELECT max(ts) - INTERVAL 1 minute AS now FROM p)
SELECT job_id, CASE WHEN status = 'running' AND epoch(now) - epoch(updated_at) > 90 THEN 'abandoned' ELSE status END AS status FROM l, n""")
def streamed_job_status(spark, sf_dir):
    rows = stream.drained(stream.stream_job_status(events(spark, sf_dir).select("job_id", "status", F.col("ts").alias("updated_at"), F.col("sequence").alias("seq"))), "append")
    return rows.groupBy("job_id").agg(F.max_by("status", F.struct("updated_ms", "seq", "batch")).alias("status"))


@query(f"""WITH {b.ATTEMPTS_SQL.replace("row_number() OVER (PARTITION BY user_id ORDER BY event_id)", "event_id")}, i AS (SELECT *, code IS NULL OR code = 'local_vision_malformed_response' AS rs, sum(CASE WHEN code IS NULL OR code = 'local_vision_malformed_response' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY attempt) AS g FROM a),
n AS (SELECT *, sum(CASE WHEN code = 'local_vision_timeout' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, g ORDER BY attempt) AS k FROM i),
o AS (SELECT *, min(CASE WHEN code = 'local_vision_auth_rejected' OR (code = 'local_vision_timeout' AND k = 3) THEN attempt END) OVER (PARTITION BY run_id) AS opened_at, lag(k) OVER (PARTITION BY run_id ORDER BY attempt) AS before FROM n)
SELECT run_id, attempt, CASE WHEN attempt = opened_at THEN 'open' ELSE 'closed' END AS state, code FROM o WHERE attempt = opened_at OR (rs AND before > 0 AND (opened_at IS NULL OR attempt < opened_at))""")
def streamed_breaker(spark, sf_dir):
    e = events(spark, sf_dir)
    t, v = F.col("event_type"), F.col("value")
    code = F.when((t == "error") & (v > 60), "local_vision_auth_rejected").when(t == "error", "local_vision_timeout").when(t == "signup", "local_vision_malformed_response").when(t == "click", "local_vision_image_read_failed")
    a = e.select(F.col("user_id").cast("string").alias("run_id"), F.col("sequence").alias("attempt"), code.alias("code"), "ts")
    return stream.drained(stream.stream_breaker(a, time="ts"), "append").drop("batch")


@query("SELECT 'job-' || user_id AS job_id, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS sequences FROM events GROUP BY user_id")
def streamed_deduplication(spark, sf_dir):
    """Every event is delivered three times."""
    e = events(spark, sf_dir).withColumn("delivery", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    return stream.drained(stream.deduplicated(e, "60 days"), "append").groupBy("job_id").agg(F.count("*").alias("events"), F.sum("sequence").alias("sequences"))
