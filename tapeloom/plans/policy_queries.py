"""Registered queries of files, malformed documents, errors one by one, and redaction's measurement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction
from ..operators import folds
from ..sources import recordings
from ..streaming.progress import shared_folder
from . import bindings as b
from . import documents
from .record_queries import DOCUMENT_SQL, KINDS, batch_items, document_tables
from .registry import query


@query("SELECT doc_id % 16 AS bucket, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS length FROM documents WHERE text IS NOT NULL GROUP BY 1")
def listed_files(spark, sf_dir):
    """Documents are written to sixteen text files, which the media listing then finds."""
    folder = shared_folder(spark)
    d = b.table(spark, sf_dir, "documents").where("text is not null").select("text", F.pmod("doc_id", F.lit(16)).alias("bucket"))
    d.repartition("bucket").write.partitionBy("bucket").text(folder)
    found = recordings.list_media(spark, folder, extensions=["txt"])
    return found.select(F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("long").alias("bucket"), "length")


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE k WHEN 0 THEN 'not JSON' WHEN 1 THEN 'not an object' WHEN 2 THEN 'segments' WHEN 3 THEN 'segment' END AS problem, CASE WHEN k = 4 THEN 1 ELSE 0 END AS segments FROM d""")
def transcript_problems(spark, sf_dir):
    """Documents as transcripts of which two thirds are malformed, each in its way."""
    d = b.table(spark, sf_dir, "documents").where("text is not null")
    k = F.col("doc_id") % 6
    good = F.to_json(F.struct(F.lit("en").alias("language"), F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), "text")).alias("segments")))
    document = F.when(k == 0, F.concat(F.lit("{"), "text")).when(k == 1, F.to_json(F.array("text"))).when(k == 2, F.to_json(F.struct(F.lit("x").alias("segments")))).when(k == 3, F.lit('{"segments": [1]}')).when(k == 4, good).otherwise('{"segments": []}')
    found = recordings.segments_of(d.select("doc_id", document.alias("document")), "doc_id", problems=True)
    return found.groupBy("doc_id").agg(F.min("problem").alias("problem"), F.count("seg_no").cast("int").alias("segments"))


@query("""WITH i AS (SELECT user_id AS batch_id, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS batch_index, CASE WHEN event_type = 'error' THEN 'E_' || CAST(floor(value) AS BIGINT) % 3 END AS code, 'stage' || event_id % 2 AS stage FROM events)
SELECT *, row_number() OVER (PARTITION BY batch_id, code, stage ORDER BY batch_index) AS error_no FROM i WHERE code IS NOT NULL""")
def batch_error_rows(spark, sf_dir):
    return folds.error_rows(batch_items(spark, sf_dir))


@query(DOCUMENT_SQL)
def document_parts(spark, sf_dir):
    """The texts of ``documents_rendered``, put together from parts of about two thousand characters."""
    return documents.joined_parts(documents.parts_of(documents.filtered_blocks(*document_tables(spark, sf_dir)), 2000))


def _record(said, deep, other):
    """A stored record: the same text as a value, below a path, and deep inside."""
    return ('{"n": 1.50, "list": ["Bearer ', said, ' \\u00e9", {"file_path": ["Bearer ', other, '"], "Bearer": null}], "deep": [[{"a": "', deep, '"}]]}')


_RECORD_SQL = " || ".join(f"'{p}'" if i % 2 == 0 else p for i, p in enumerate(_record("a", "d", "s")))
#: A value that changes is written anew, with its letters as they are; all else stays as it was.
_CHANGED_SQL = " || ".join(f"'{p}'" if i % 2 == 0 else p for i, p in enumerate(_record("m", "z", "s"))).replace("\\u00e9", "é")


@query(f"""WITH o AS (SELECT o_orderkey, 'a1' || md5(CAST(o_orderkey AS VARCHAR)) AS s, '[REDACTED:oauth-token]' AS m, 'Bearer [REDACTED:oauth-token]' AS z, 'no' AS a, 'no' AS d FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN {_CHANGED_SQL} ELSE {_RECORD_SQL} END AS safe FROM o""")
def redacted_json_records(spark, sf_dir):
    """Stored JSON of unknown shape: strings at any depth are redacted, keys and paths are not."""
    secret, even = F.concat(F.lit("a1"), F.md5(F.col("o_orderkey").cast("string"))), F.col("o_orderkey") % 2 == 0
    parts = _record(F.when(even, secret).otherwise("no"), F.when(even, F.concat(F.lit("Bearer "), secret)).otherwise("no"), secret)
    document = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return b.table(spark, sf_dir, "orders").select("o_orderkey", redaction.redacted_json(document).alias("safe"))


_KIND_SQL = "CASE o_orderkey % 18 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (k, *_) in enumerate(KINDS)) + " WHEN 16 THEN 'wide' ELSE 'benign' END"


@query(f"""WITH o AS (SELECT {_KIND_SQL} AS kind FROM orders)
SELECT kind, count(*) AS samples, CASE WHEN kind = 'benign' THEN 0 ELSE count(*) END AS redactions, CASE WHEN kind = 'benign' THEN 0 ELSE count(*) END AS right_kind, CASE WHEN kind = 'wide' THEN count(*) ELSE 0 END AS warnings FROM o GROUP BY kind""")
def redaction_measurement(spark, sf_dir):
    """What redaction does to samples of every kind of secret, to one in wide letters, and to texts that only look like secrets."""
    k = F.col("o_orderkey")
    o = b.table(spark, sf_dir, "orders").withColumn("h", F.concat(F.md5(k.cast("string")), F.md5(F.concat(k.cast("string"), F.lit("x")))))
    benign = ("DEMO_API_KEY=your_api_key", "DATABASE_PASSWORD=changeme", "GITHUB_TOKEN=<your-api-key>", "Use sk-your-demo-key in the docs, never in production.", "wide Ｈｅｌｌｏ")
    made = F.get(F.array(*[F.lit(t) for t in benign]), (F.floor(k / 18) % len(benign)).cast("int"))
    made = F.when(k % 18 == len(KINDS), F.concat(F.lit("use ｇhp_"), F.expr("left(h, 36)"))).otherwise(made)
    made = reduce(lambda c, x: F.when(k % 18 == x[0], F.concat(F.lit(x[1][1]), F.expr(x[1][2]), F.lit(x[1][3]))).otherwise(c), list(enumerate(KINDS)), made)
    kind = F.coalesce(F.get(F.array(*[F.lit(x[0]) for x in KINDS], F.lit("wide")), (k % 18).cast("int")), F.lit("benign"))
    return redaction.measured(o.select(kind.alias("kind"), made.alias("text")), {"wide": "github-token"})
