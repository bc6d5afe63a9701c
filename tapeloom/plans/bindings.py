"""The supplied tables in the roles of recordings' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHARS_A_SECOND, FRAME_SECONDS = 15.0, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a source, a turn a segment; speaking takes a second for fifteen characters."""
    c = table(spark, sf_dir, "conversations")
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.length("text")
    own = c.withColumn("n", n).withColumn("cum", F.sum(n).over(so_far))
    return own.select(
        F.col("conv_id").alias("source_id"), F.col("turn").alias("seg_no"), "role", ((F.col("cum") - F.col("n")) / CHARS_A_SECOND).alias("start"), (F.col("cum") / CHARS_A_SECOND).alias("end"), "text",
        (-(F.col("n") % 20) / 10).alias("avg_logprob"), F.lit(None).cast("array<struct<word:string,start:double,end:double,probability:double>>").alias("words"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame every twenty seconds of a source; every third is judged redundant, every fifth not judged."""
    total = segments(spark, sf_dir).groupBy("source_id").agg(F.max("end").alias("total"))
    own = total.select("source_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("total") / FRAME_SECONDS).cast("int"))).alias("frame_index"))
    return own.withColumn("timestamp_sec", (F.col("frame_index") * FRAME_SECONDS).cast("double")).withColumn("adds_information", F.when(F.col("frame_index") % 5 == 4, F.lit(None)).otherwise(F.col("frame_index") % 3 != 2))


SEGMENTS_SQL = f"""seg AS (SELECT conv_id AS source_id, turn AS seg_no, role, (cum - n) / {CHARS_A_SECOND} AS start_, cum / {CHARS_A_SECOND} AS end_, text, -(n % 20) / 10 AS avg_logprob, n
  FROM (SELECT *, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS cum FROM conversations))"""
FRAMES_SQL = f"""frm AS (SELECT source_id, CAST(i AS INT) AS frame_index, CAST(i * {FRAME_SECONDS} AS DOUBLE) AS ts, CASE WHEN i % 5 = 4 THEN NULL ELSE i % 3 <> 2 END AS adds_information
  FROM (SELECT source_id, unnest(range(0, CAST(floor(max(end_) / {FRAME_SECONDS}) AS BIGINT) + 1)) AS i FROM seg GROUP BY source_id))"""


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a warning of its user; a count below one is invalid."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("seq"), F.concat(F.lit("stage"), (F.col("user_id") % 3).cast("string")).alias("stage"), F.col("event_type").alias("code"), F.col("props").alias("message"), (F.floor("value") % 4).alias("occurrences"), "ts"
    )


WARNINGS_SQL = "w AS (SELECT user_id AS source_id, event_id AS seq, 'stage' || (user_id % 3) AS stage, event_type AS code, props AS message, CAST(floor(value) AS BIGINT) % 4 AS occurrences, ts FROM events)"


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user are a job's progress: five mechanisms in turn."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    return e.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), F.row_number().over(order).cast("long").alias("sequence"), F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("mechanism"), status.alias("status"),
        F.when(F.col("event_type") != "view", F.col("value") * 3).alias("percent"), "ts", F.col("event_id").alias("seq"),
    )


PROGRESS_SQL = """p AS (SELECT 'job-' || user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, 'm' || (event_id % 5) AS mechanism,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, CASE WHEN event_type <> 'view' THEN value * 3 END AS percent, ts, event_id AS seq FROM events)"""


#: Events of ``p`` that say something new of their mechanism.
ADVANCES_SQL = """adv AS (SELECT * FROM (SELECT *, row_number() OVER m AS nth, lag(status) OVER m AS status_, lag(percent) OVER m AS percent_ FROM p WINDOW m AS (PARTITION BY job_id, mechanism ORDER BY ts, sequence))
  WHERE nth = 1 OR status_ IS DISTINCT FROM status OR percent_ IS DISTINCT FROM percent)"""


def weights(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("mechanism"), (F.col("id") + 1).cast("double").alias("weight"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user are attempts of a run: errors time out, signups are malformed, large errors are rejected."""
    e = table(spark, sf_dir, "events")
    code = F.when((F.col("event_type") == "error") & (F.col("value") > 60), "local_vision_auth_rejected").when(F.col("event_type") == "error", "local_vision_timeout").when(F.col("event_type") == "signup", "local_vision_malformed_response").when(F.col("event_type") == "click", "local_vision_image_read_failed")
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("attempt"), code.alias("code"))


ATTEMPTS_SQL = """a AS (SELECT CAST(user_id AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt,
  CASE WHEN event_type = 'error' AND value > 60 THEN 'local_vision_auth_rejected' WHEN event_type = 'error' THEN 'local_vision_timeout' WHEN event_type = 'signup' THEN 'local_vision_malformed_response'
  WHEN event_type = 'click' THEN 'local_vision_image_read_failed' END AS code FROM events)"""


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer are generations of a bundle."""
    o = table(spark, sf_dir, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return o.select(F.col("o_custkey").alias("bundle_key"), F.concat(F.lit("g"), n.cast("string")).alias("name"), F.col("o_orderdate").cast("timestamp").alias("mtime"), (F.col("o_orderstatus") != "P").alias("has_render"), (F.col("o_orderkey") % 10 != 0).alias("has_self_contained"), n.alias("gen_no"), "o_orderstatus")


GENERATIONS_SQL = """g AS (SELECT o_custkey AS bundle_key, 'g' || n AS name, CAST(o_orderdate AS TIMESTAMP) AS mtime, o_orderstatus <> 'P' AS has_render, o_orderkey % 10 <> 0 AS has_self_contained, n AS gen_no, o_orderstatus
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders))"""


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are bundles; the last finished order is the active generation; some are locked, foreign or invalid."""
    active = generations(spark, sf_dir).where("o_orderstatus = 'F'").groupBy("bundle_key").agg(F.max_by("name", "gen_no").alias("active"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bundle_key"))
    k = F.col("bundle_key")
    return c.join(active, "bundle_key", "left").select(
        "bundle_key", F.when(k % 17 == 0, F.lit(None)).when(k % 13 == 0, "invalid").otherwise("valid").alias("marker"), "active", F.when(k % 11 == 0, -k).otherwise(k).alias("identity"), (k % 7 == 0).alias("locked"),
        F.lit("1995-01-01").cast("timestamp").alias("root_mtime"), F.lit("1996-01-01").cast("timestamp").alias("manifest_mtime"),
    )


BUNDLES_SQL = f"""{GENERATIONS_SQL}, act AS (SELECT bundle_key, arg_max(name, gen_no) AS active FROM g WHERE o_orderstatus = 'F' GROUP BY bundle_key),
b AS (SELECT c_custkey AS bundle_key, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'invalid' ELSE 'valid' END AS marker, active, CASE WHEN c_custkey % 11 = 0 THEN -c_custkey ELSE c_custkey END AS identity, c_custkey % 7 = 0 AS locked
  FROM customer LEFT JOIN act ON c_custkey = bundle_key),
bv AS (SELECT b.*, CASE WHEN marker IS NULL THEN 'absent' WHEN marker = 'invalid' THEN 'invalid' WHEN identity <> b.bundle_key THEN 'foreign' WHEN active IS NULL THEN 'owned' ELSE 'published' END AS verdict,
  coalesce(g.has_render AND g.has_self_contained, false) AS rendered FROM b LEFT JOIN g ON g.bundle_key = b.bundle_key AND g.name = b.active),
v AS (SELECT *, verdict = 'published' AND rendered AS servable FROM bv)"""


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of an embedding's 64 numbers are a 64-bit hash; a label is a source (and 40 vectors make one schedule)."""
    e = table(spark, sf_dir, "embeddings")
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    half = lambda at: F.lpad(F.lower(F.conv(F.substring(bits, at, 32), 2, 16)), 8, "0")
    return e.select((F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / 400)).cast("long").alias("source_id"), F.col("vec_id").cast("int").alias("candidate_index"), F.col("vec_id").cast("double").alias("timestamp_sec"), F.concat(half(1), half(33)).alias("phash"))


BITS_SQL = """h AS (SELECT label * 1000000 + vec_id // 400 AS source_id, CAST(vec_id AS INT) AS candidate_index, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits,
  row_number() OVER (PARTITION BY label * 1000000 + vec_id // 400 ORDER BY vec_id) AS rn FROM embeddings)"""
