"""More registered queries: stored records, schedules, keyframes, text policy, documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity, links, redaction, text
from ..operators import folds, grounding, store, timeline
from ..sources import recordings
from . import bindings as b
from . import documents
from .queries import described
from .registry import query

# --- sources and stored records


@query("SELECT unnest(['conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier', 'benchmark']) AS name")
def listed_tables(spark, sf_dir):
    """The media listing over the folder of tables."""
    found = recordings.list_media(spark, sf_dir, extensions=["parquet"])
    return found.select(F.regexp_extract("path", r"/([a-z]+)\.parquet(?:/[^/]*)?$", 1).alias("name")).distinct()


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's segments as one stored transcript document."""
    s = b.segments(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("seg_no", F.struct("start", "end", "text", "avg_logprob").alias("s"))))
    return s.groupBy("source_id").agg(F.to_json(F.struct(F.lit("und").alias("language"), F.transform(ordered, lambda x: x["s"]).alias("segments"))).alias("document"))


@query(f"""WITH {b.SEGMENTS_SQL} SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY seg_no) - 1 AS seg_no, 'und' AS language, round(start_, 6) AS "start", round(end_, 6) AS "end", text, round(avg_logprob, 6) AS avg_logprob FROM seg""")
def transcript_segments(spark, sf_dir):
    made = recordings.segments_of(transcripts(spark, sf_dir))
    return made.select("source_id", F.col("seg_no").cast("long").alias("seg_no"), "language", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text", F.round("avg_logprob", 6).alias("avg_logprob"))


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, f = b.segments(spark, sf_dir), b.frames(spark, sf_dir)
    sources = s.groupBy("source_id").agg(F.max("end").alias("duration_sec"))
    found = links.extract_links(described(spark, sf_dir), "source_id", "text").withColumn("pos", F.col("line_no") * 1000 + F.col("pos")).drop("line_no")
    return recordings.manifest_rows(sources, f.drop("adds_information").withColumn("relative_path", F.lit("frames/frame_0001.png")), found, folds.fold_warnings(b.warnings(spark, sf_dir)), s)


@query(f"WITH {b.SEGMENTS_SQL}, {b.FRAMES_SQL} SELECT CAST(source_id AS VARCHAR) AS source_id, count(*) AS frames, max(ts) AS last FROM frm GROUP BY source_id")
def manifests_round_trip(spark, sf_dir):
    back = recordings.manifest_tables(manifests(spark, sf_dir))["frames"]
    return back.groupBy("source_id").agg(F.count("*").alias("frames"), F.max("timestamp_sec").alias("last"))


FOLDED_SQL = f"{b.WARNINGS_SQL}, fold AS (SELECT source_id, stage, code, arg_min(message, seq) AS message, CAST(sum(CASE WHEN occurrences >= 1 THEN occurrences ELSE 1 END) AS BIGINT) AS occurrences, min(seq) AS seq FROM w GROUP BY ALL)"


@query(f"WITH {FOLDED_SQL} SELECT CAST(source_id AS VARCHAR) AS source_id, row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS seq, stage, code, message, occurrences FROM fold WHERE source_id IN (SELECT conv_id FROM conversations)")
def manifest_warnings(spark, sf_dir):
    return recordings.manifest_tables(manifests(spark, sf_dir))["warnings"].withColumn("seq", F.col("seq").cast("long"))


LINKS_SQL = """pg AS (SELECT page_id, CAST(floor(page_id / 10) AS BIGINT) AS source_id, page_id % 4 AS k, CASE WHEN page_id % 5 = 0 THEN 'https://github.com/a/' || page_id || '.' ELSE url END AS raw FROM pages),
lu AS (SELECT *, regexp_replace(regexp_replace(raw, '[.,;:!?]+$', ''), '#.*$', '') AS link FROM pg),
lk AS (SELECT source_id, count(DISTINCT link) AS links FROM lu GROUP BY source_id)"""


@query(f"""WITH {b.SEGMENTS_SQL}, {b.FRAMES_SQL}, {FOLDED_SQL}, {LINKS_SQL}, fc AS (SELECT source_id, count(*) AS frames FROM frm GROUP BY source_id), wc AS (SELECT source_id, CAST(sum(occurrences) AS BIGINT) AS warnings FROM fold GROUP BY source_id)
SELECT CAST(s.source_id AS VARCHAR) AS bundle_key, CAST(coalesce(frames, 0) AS BIGINT) AS frame_count, CAST(coalesce(warnings, 0) AS BIGINT) AS warning_count, true AS transcript_present, CAST(coalesce(links, 0) AS BIGINT) AS n_links
FROM (SELECT DISTINCT conv_id AS source_id FROM conversations) s LEFT JOIN fc USING (source_id) LEFT JOIN wc USING (source_id) LEFT JOIN lk USING (source_id)""")
def manifest_counts(spark, sf_dir):
    j = F.parse_json("manifest_json")
    m = manifests(spark, sf_dir)
    n = F.coalesce(F.size(F.try_variant_get(j, "$.related_links", "array<variant>")), F.lit(0))
    return m.select(F.col("bundle_key").cast("string").alias("bundle_key"), *[F.try_variant_get(j, f"$.{c}", k).alias(c) for c, k in (("frame_count", "bigint"), ("warning_count", "bigint"), ("transcript_present", "boolean"))], F.greatest(n, F.lit(0)).cast("long").alias("n_links"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS bundle_key, count(DISTINCT o_orderstatus) AS gen_no, 'g' || count(DISTINCT o_orderstatus) AS active FROM orders GROUP BY o_custkey")
def published_generations(spark, sf_dir):
    """Three batches of bundles are published, the second of them twice."""
    from ..streaming.progress import shared_folder

    folder = shared_folder(spark)
    o = b.table(spark, sf_dir, "orders").withColumn("bundle_key", F.col("o_custkey").cast("string"))
    for i in (0, 1, 1, 2):
        store.publish_batch(o.where(F.col("o_orderstatus") == "FOP"[i]), i, f"{folder}/rows", f"{folder}/pointers")
    return store.pointers_of(spark, f"{folder}/pointers").select("bundle_key", "gen_no", "active")


@query("SELECT CAST(o_custkey AS VARCHAR) AS bundle_key, o_orderkey, 'g' || n AS name FROM (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY instr('FOP', o_orderstatus)) AS n, max(instr('FOP', o_orderstatus)) OVER (PARTITION BY o_custkey) AS last FROM orders) WHERE instr('FOP', o_orderstatus) = last")
def published_content(spark, sf_dir):
    """The orders of each customer's last batch; pointers are folded every two batches, and a batch broke off before it was committed."""
    from ..streaming.progress import shared_folder

    folder = shared_folder(spark)
    o = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("bundle_key"), "o_orderkey", "o_orderstatus")
    for i in (0, 1, 0, 2):
        store.publish_batch(o.where(F.col("o_orderstatus") == "FOP"[i]), i, f"{folder}/rows", f"{folder}/pointers", compact_every=2)
    o.withColumn("name", F.lit("g9")).write.parquet(f"{folder}/rows/version=3")
    return store.published_rows(spark, f"{folder}/rows", f"{folder}/pointers").select("bundle_key", "o_orderkey", "name")


#: Nations, customers, orders and their lines as folders in one another; what each is follows from its number.
TREE_SQL = """t AS (SELECT n_nationkey AS k, 'n' || n_nationkey AS path, 0 AS depth FROM nation UNION ALL SELECT c_custkey, 'n' || c_nationkey || '/c' || c_custkey, 1 FROM customer
  UNION ALL SELECT o_orderkey, 'n' || c_nationkey || '/c' || c_custkey || '/o' || o_orderkey, 2 FROM orders JOIN customer ON c_custkey = o_custkey
  UNION ALL SELECT l_orderkey * 8 + l_linenumber, 'n' || c_nationkey || '/c' || c_custkey || '/o' || o_orderkey || '/l' || l_linenumber, 3 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
e AS (SELECT *, CASE WHEN depth = 0 THEN 'no marker' WHEN k % 11 = 0 THEN 'unlistable' WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN 'foreign' WHEN k % 13 = 0 THEN 'symlink' ELSE 'no marker' END AS reason FROM t)"""


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: b.table(spark, sf_dir, name)
    part = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    c = t("customer").select("c_custkey", F.concat_ws("/", part("n", "c_nationkey"), part("c", "c_custkey")).alias("path"))
    o = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat_ws("/", "path", part("o", "o_orderkey")).alias("path"))
    lines = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.concat_ws("/", "path", part("l", "l_linenumber")).alias("path"), F.lit(3).alias("depth"))
    n = t("nation").select(F.col("n_nationkey").alias("k"), part("n", "n_nationkey").alias("path"), F.lit(0).alias("depth"))
    every = n.unionByName(c.select(F.col("c_custkey").alias("k"), "path", F.lit(1).alias("depth"))).unionByName(o.select(F.col("o_orderkey").alias("k"), "path", F.lit(2).alias("depth"))).unionByName(lines)
    k, deep = F.col("k"), F.col("depth") > 0
    unlistable = deep & (k % 11 == 0)
    kind = F.when(deep & (k % 5 == 0), "owned").when(deep & (k % 7 == 0), "foreign").otherwise("absent")
    return every.select(F.lit("store").alias("root"), "path", F.substring_index("path", "/", -1).alias("name"), (deep & (k % 13 == 0) & (k % 35 != 0) & (k % 5 != 0) & (k % 7 != 0) & (k % 11 != 0)).alias("is_link"), "depth", kind.alias("verdict"), unlistable.alias("unlistable"))


@query(f"""WITH {TREE_SQL}, s AS (SELECT path FROM e WHERE reason IS DISTINCT FROM 'no marker' AND depth < 3), c AS (SELECT reason FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE starts_with(e.path, s.path || '/')))
SELECT reason, count(*) AS entries FROM c GROUP BY reason""")
def survey_descent(spark, sf_dir):
    from ..streaming.progress import shared_folder

    return store.considered_counts(store.considered(tree(spark, sf_dir), shared_folder(spark))).drop("root")


@query("""WITH a AS (SELECT doc_id % 16 AS bucket, encode(string_agg(text || chr(10), '' ORDER BY doc_id)) AS content FROM documents WHERE text IS NOT NULL GROUP BY 1), n AS (SELECT *, octet_length(content) AS size FROM a),
o AS (SELECT DISTINCT bucket, CAST(floor(greatest(size - 65536, 0) * i / 8) AS BIGINT) AS at FROM n, range(9) r(i)),
j AS (SELECT n.bucket, list(encode(o.at || ':') || n.content[o.at + 1 : o.at + 65536] ORDER BY o.at) AS parts, count(*) AS samples, CAST(sum(least(65536, size)) AS BIGINT) AS bytes_read FROM n JOIN o USING (bucket) GROUP BY n.bucket)
SELECT n.bucket, size, samples, bytes_read, sha256(list_reduce(list_prepend(encode(size || ':' || n.bucket), parts), lambda x, y: x || y)) AS fingerprint, sha256(content) AS content_sha256 FROM n JOIN j USING (bucket)""")
def file_fingerprints(spark, sf_dir):
    """Documents are written to sixteen text files, which are then fingerprinted by ranges, and as a whole."""
    from ..sources import fingerprints
    from ..streaming.progress import shared_folder

    folder = shared_folder(spark)
    d = b.table(spark, sf_dir, "documents").where("text is not null").withColumn("bucket", F.pmod("doc_id", F.lit(16)))
    d.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("text", "bucket").write.partitionBy("bucket").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.regexp_extract("path", r"/bucket=(\d+)/", 1).cast("long").alias("bucket"))
    sampled = fingerprints.sampled_files(files, modified="bucket")
    whole = fingerprints.digested_files(files).select("bucket", "content_sha256")
    return sampled.join(whole, "bucket").select("bucket", "size", F.col("samples").cast("long").alias("samples"), "bytes_read", "fingerprint", "content_sha256")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage results whose payload may have warnings, as may what is recorded around it."""
    o = b.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    note = lambda code: F.concat(F.lit('[{"stage": "x", "code": "'), F.lit(code), F.lit('", "message": "'), F.col("o_clerk") if "o_clerk" in o.columns else F.col("o_orderpriority"), F.lit('", "occurrences": 2}]'))
    payload = F.concat(F.lit('{"n": '), k.cast("string"), F.when(k % 3 == 0, F.concat(F.lit(', "warnings": '), note("inner"))).otherwise(""), F.lit("}"))
    doc = F.concat(F.lit('{"schema_version": '), F.when(k % 5 == 0, "2").otherwise("1"), F.lit(', "bundle_key": "'), k.cast("string"), F.lit('", "stage": "s", "payload": '), payload, F.when(k % 2 == 0, F.concat(F.lit(', "warnings": '), note("outer"))).otherwise(""), F.lit("}"))
    return o.select(k.cast("string").alias("bundle_key"), F.lit("s").alias("stage"), doc.alias("document"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS bundle_key, o_orderkey AS n, CASE WHEN o_orderkey % 6 = 0 THEN 'inner,outer' WHEN o_orderkey % 3 = 0 THEN 'inner' WHEN o_orderkey % 2 = 0 THEN 'outer' ELSE '' END AS codes FROM orders WHERE o_orderkey % 5 <> 0")
def resumed_payloads(spark, sf_dir):
    made = store.reusable_payloads(envelopes(spark, sf_dir))
    return made.select("bundle_key", F.get_json_object("payload", "$.n").cast("long").alias("n"), F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("codes"))


@query(f"""WITH {b.BUNDLES_SQL}, st AS (SELECT count(*) AS staging FROM g WHERE o_orderstatus = 'P'), n AS (SELECT count(*) AS generations, count(*) FILTER (WHERE name IS DISTINCT FROM v.active) AS orphans FROM v JOIN g ON g.bundle_key = v.bundle_key)
SELECT count(*) AS bundles, count(*) FILTER (WHERE servable) AS servable, count(*) FILTER (WHERE locked) AS locked, any_value(generations) AS generations, any_value(orphans) AS orphans, any_value(staging) AS staging FROM v, n, st""")
def root_totals(spark, sf_dir):
    g = b.generations(spark, sf_dir)
    s = store.survey_totals(store.survey(b.bundles(spark, sf_dir), g), g.where("o_orderstatus = 'P'"))
    return s.select(*[F.col(c).cast("long").alias(c) for c in s.columns])


@query(f"""WITH {b.BUNDLES_SQL}, e AS (SELECT CASE WHEN v.bundle_key % 19 = 0 THEN '_' ELSE '' END || c_name AS name, v.bundle_key % 23 = 0 AS is_link, v.bundle_key % 9 AS depth, verdict FROM v JOIN customer ON c_custkey = v.bundle_key)
SELECT CASE WHEN is_link THEN 'symlink' WHEN name[1] IN ('_', '.') THEN 'reserved' WHEN verdict IN ('foreign', 'invalid') THEN verdict WHEN verdict = 'absent' AND depth >= 6 THEN 'too deep' WHEN verdict = 'absent' THEN 'no marker' END AS reason, count(*) AS entries FROM e GROUP BY 1""")
def skipped_entries(spark, sf_dir):
    k = F.col("bundle_key")
    v = store.bundle_verdicts(b.bundles(spark, sf_dir), b.generations(spark, sf_dir)).join(b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bundle_key"), "c_name"), "bundle_key")
    return store.skip_counts(v.select(F.concat(F.when(k % 19 == 0, "_").otherwise(""), "c_name").alias("name"), (k % 23 == 0).alias("is_link"), (k % 9).alias("depth"), "verdict"))


@query(f"""WITH {b.BUNDLES_SQL}, c AS (SELECT o_orderkey AS run_id, k AS entry, CAST(o_custkey + k AS BIGINT) AS bundle_key, CASE o_orderkey % 4 WHEN 0 THEN 'selected' WHEN 1 THEN 'disabled' ELSE 'auto' END AS mode, o_orderstatus = 'P' AS force FROM orders, range(3) r(k)),
h AS (SELECT run_id, min(entry) AS hit FROM c JOIN v ON v.bundle_key = c.bundle_key WHERE NOT force AND servable AND (mode <> 'disabled' OR entry = 0) AND (mode <> 'selected' OR v.bundle_key % 2 > 0) GROUP BY run_id),
p AS (SELECT o_orderkey AS run_id, k AS entry, (o_orderkey + k) % 4 = 0 AS answered, (o_custkey + k) % 5 = 0 AS skip FROM orders, range(3) r(k)), o AS (SELECT run_id, min(entry) AS got FROM p WHERE answered GROUP BY run_id),
r AS (SELECT c.run_id, any_value(mode) AS mode, any_value(hit) AS hit, any_value(got) AS got FROM c LEFT JOIN h USING (run_id) LEFT JOIN o USING (run_id) GROUP BY c.run_id)
SELECT run_id, hit AS entry, 'cache_hit' AS outcome FROM r WHERE hit IS NOT NULL UNION ALL
SELECT p.run_id, entry, CASE WHEN entry = got THEN 'selected' WHEN skip THEN 'skipped' ELSE 'unavailable' END FROM p JOIN r USING (run_id) WHERE hit IS NULL AND mode <> 'disabled' AND (got IS NULL OR entry <= got)""")
def resolution_evidence(spark, sf_dir):
    o = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_custkey", "o_orderstatus", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("entry"))
    k = F.col("run_id") % 4
    candidates = o.select("run_id", "entry", (F.col("o_custkey") + F.col("entry")).alias("bundle_key"), F.when(k == 0, "selected").when(k == 1, "disabled").otherwise("auto").alias("mode"), (F.col("o_orderstatus") == "P").alias("force"))
    servable = store.bundle_verdicts(b.bundles(spark, sf_dir), b.generations(spark, sf_dir)).where("servable").select("bundle_key", (F.col("bundle_key") % 2).alias("readings"))
    probes = o.select("run_id", "entry", ((F.col("run_id") + F.col("entry")) % 4 == 0).alias("answered"), ((F.col("o_custkey") + F.col("entry")) % 5 == 0).alias("skip"))
    return store.chain_evidence(store.resolve_from_cache(candidates, servable, probes), probes)


@query("""WITH i AS (SELECT user_id AS batch_id, event_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS batch_index, CASE WHEN event_type = 'error' THEN 'E_' || CAST(floor(value) AS BIGINT) % 3 END AS code, 'stage' || event_id % 2 AS stage FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY batch_id, code, stage ORDER BY batch_index) AS n FROM i WHERE code IS NOT NULL)
SELECT batch_id, code, stage, count(*) AS errors, string_agg(batch_index || ':' || item, ',' ORDER BY batch_index) FILTER (WHERE n <= 2) AS shown FROM e GROUP BY ALL""")
def batch_error_list(spark, sf_dir):
    shown = F.array_join(F.transform("shown", lambda x: F.concat(x["batch_index"].cast("string"), F.lit(":"), x["item"].cast("string"))), ",")
    return folds.batch_errors(batch_items(spark, sf_dir), listed=2).withColumn("shown", shown)


def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "error", F.concat(F.lit("E_"), (F.floor("value") % 3).cast("string")))
    return e.select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("item"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("batch_index"), code.alias("code"), F.concat(F.lit("stage"), (F.col("event_id") % 2).cast("string")).alias("stage"))


@query("SELECT bundle_key, count(DISTINCT sha256(text)) AS fingerprints, min(sha256(text)) AS first_fingerprint FROM (SELECT text, source || ':' || n_chars AS bundle_key FROM documents) GROUP BY bundle_key HAVING count(DISTINCT sha256(text)) > 1")
def key_collisions(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("bundle_key"), F.sha2("text", 256).alias("fingerprint"))
    return identity.key_collisions(d)


# --- readings and summaries


def read_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as frames: a text is what the reader saw, found, made of it or copied, by its language."""
    d = b.table(spark, sf_dir, "documents")
    of = lambda lang, c: F.when(F.col("lang") == lang, c)
    reading = F.struct(
        of("en", F.regexp_extract("text", "^[^\n]*", 0)).alias("visual_summary"), of("de", F.split("text", "\n")).alias("detected_elements"), of("fr", F.replace("text", F.lit("e"), F.lit(" "))).alias("interpretation"), of("es", F.col("text")).alias("verbatim_text")
    )
    return d.select(F.floor(F.col("doc_id") / 10).cast("long").alias("source_id"), F.col("doc_id").alias("frame_index"), reading.alias("interpretation"), "n_chars")


READ_SQL = r"""rd AS (SELECT doc_id, doc_id // 10 AS source_id, n_chars, coalesce(CASE lang WHEN 'en' THEN trim(regexp_extract(text, '^[^\n]*'), ' ') <> '' WHEN 'de' THEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) > 0 WHEN 'fr' THEN trim(replace(text, 'e', ' '), ' ') <> '' END, false) AS visual,
  coalesce(lang = 'es' AND trim(text, ' ') <> '', false) AS copied FROM documents)"""


@query(f"WITH {READ_SQL} SELECT doc_id, visual OR copied AS carries_reading, visual AS has_interpretation FROM rd")
def carried_readings(spark, sf_dir):
    r = F.col("interpretation")
    return read_frames(spark, sf_dir).select(F.col("frame_index").alias("doc_id"), grounding.carries_reading(r).alias("carries_reading"), grounding.has_interpretation(r).alias("has_interpretation"))


@query(f"""WITH {READ_SQL}, s AS (SELECT source_id, sum(n_chars) / 15.0 AS duration, count(*) AS frames, count(*) FILTER (WHERE visual OR copied) AS readings, count(*) FILTER (WHERE visual) AS visual_frames FROM rd GROUP BY source_id)
SELECT source_id, frames, readings, visual_frames, CAST(round(duration) AS BIGINT) || ' s, ' || frames || ' frames, ' || visual_frames || ' of them visual' AS sentence FROM s""")
def run_summaries(spark, sf_dir):
    f = read_frames(spark, sf_dir)
    sources = f.groupBy("source_id").agg((F.sum("n_chars") / 15.0).alias("duration_sec"))
    return grounding.reading_counts(f, sources).select("source_id", "frames", "readings", "visual_frames", "sentence")


@query(f"""WITH {b.SEGMENTS_SQL}, {b.FRAMES_SQL}, k AS (SELECT source_id, count(*) AS frames, count(*) FILTER (WHERE adds_information IS NOT FALSE) AS kept FROM frm WHERE frame_index % 3 = 2 GROUP BY source_id), sp AS (SELECT source_id, sum(length(trim(text, ' '))) AS chars FROM seg WHERE role = 'system' OR seg_no > 2 GROUP BY source_id)
SELECT coalesce(k.source_id, sp.source_id) AS source_id, coalesce(frames, 0) AS frames, coalesce(kept, 0) AS kept, CASE WHEN coalesce(kept, 0) = 0 AND coalesce(chars, 0) = 0 THEN 'nothing readable is left' WHEN kept = 0 THEN 'every frame was judged redundant' END AS note FROM k FULL JOIN sp ON sp.source_id = k.source_id""")
def filtered_notes(spark, sf_dir):
    f, s = b.frames(spark, sf_dir).where("frame_index % 3 = 2"), b.segments(spark, sf_dir).where("role = 'system' or seg_no > 2")
    return timeline.filtered_notes(f, s).select("source_id", "frames", "kept", "note")


# --- schedules and keyframes


@query("""WITH RECURSIVE e AS (SELECT user_id AS source_id, (epoch_us(ts) / 1e6 - 1704067200.0) / 600 AS a FROM events),
p AS (SELECT DISTINCT source_id, CAST(least(round_even(greatest(0.0, least(4500.0, (a + (a + 1)) / 2)) * 1000, 0), 4500000) AS BIGINT) AS ms FROM e),
nx AS (SELECT source_id, ms, min(ms) OVER (PARTITION BY source_id ORDER BY ms RANGE BETWEEN 4000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM p),
ac(source_id, ms) AS (SELECT source_id, min(ms) FROM p GROUP BY source_id UNION ALL SELECT ac.source_id, nx.nxt FROM ac JOIN nx ON nx.source_id = ac.source_id AND nx.ms = ac.ms WHERE nx.nxt IS NOT NULL),
an AS (SELECT source_id, ms FROM ac UNION ALL SELECT source_id, 0 FROM p GROUP BY source_id HAVING min(ms) > 90000),
gp AS (SELECT source_id, ms AS m0, coalesce(lead(ms) OVER (PARTITION BY source_id ORDER BY ms), 4500000) - ms AS gap FROM an),
pt AS (SELECT DISTINCT source_id, least(m0 + 90000 * unnest(range(0, 1 + CAST(greatest(0, ceil((gap - 90000) / 90000)) AS BIGINT))), 4500000) AS ms FROM gp)
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY ms) - 1 AS INT) AS candidate_index, ms / 1000.0 AS timestamp_sec, NULL::VARCHAR AS problem FROM pt""")
def candidate_schedules(spark, sf_dir):
    e = b.table(spark, sf_dir, "events")
    sec = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0) / 600
    scenes = e.select(F.col("user_id").alias("source_id"), sec.alias("start_sec"), (sec + 1).alias("end_sec")).withColumns({"duration_sec": F.lit(4500.0), "min_interval_sec": F.lit(4.0), "max_static_window_sec": F.lit(90.0)})
    return timeline.candidate_schedule(scenes)


@query(f"""WITH RECURSIVE {b.BITS_SQL}, w AS (SELECT source_id, rn, candidate_index, bits AS last, 1 AS n, true AS taken, 0 AS missed FROM h WHERE rn = 1
UNION ALL SELECT h.source_id, h.rn, h.candidate_index, CASE WHEN w.n < 80 AND hamming(w.last, h.bits) >= 26 THEN h.bits ELSE w.last END, w.n + CASE WHEN w.n < 80 AND hamming(w.last, h.bits) >= 26 THEN 1 ELSE 0 END, w.n < 80 AND hamming(w.last, h.bits) >= 26, w.missed + CASE WHEN w.n >= 80 THEN 1 ELSE 0 END
FROM w JOIN h ON h.source_id = w.source_id AND h.rn = w.rn + 1)
SELECT source_id, n AS frame_index, candidate_index, CAST(candidate_index AS DOUBLE) AS timestamp_sec, CAST(max(missed) OVER (PARTITION BY source_id) AS INT) AS unexamined FROM w QUALIFY taken""")
def keyframes(spark, sf_dir):
    return timeline.select_keyframes(b.hashes(spark, sf_dir), 26, 80).drop("phash")


SWEEP_SQL = f"""{b.BITS_SQL}, w AS (SELECT source_id, threshold, rn, bits AS last, 1 AS n FROM h, (VALUES (10), (20), (26), (32)) t(threshold) WHERE rn = 1
UNION ALL SELECT h.source_id, threshold, h.rn, CASE WHEN hamming(w.last, h.bits) >= threshold THEN h.bits ELSE w.last END, w.n + CASE WHEN hamming(w.last, h.bits) >= threshold THEN 1 ELSE 0 END FROM w JOIN h ON h.source_id = w.source_id AND h.rn = w.rn + 1),
sw AS (SELECT source_id, threshold, CAST(max(rn) AS INT) AS sampled, CAST(max(n) AS INT) AS kept FROM w GROUP BY source_id, threshold)"""


@query(f"WITH RECURSIVE {SWEEP_SQL} SELECT * FROM sw")
def threshold_sweep(spark, sf_dir):
    return timeline.threshold_sweep(b.hashes(spark, sf_dir), (10, 20, 26, 32))


@query(f"WITH RECURSIVE {SWEEP_SQL} SELECT count(*) AS sources, count(*) FILTER (WHERE kept < 1) AS without_frames, count(*) > 0 AND count(*) FILTER (WHERE kept < 1) = 0 AS passed FROM sw WHERE threshold = 10")
def sweep_verdict(spark, sf_dir):
    return timeline.sweep_verdict(timeline.threshold_sweep(b.hashes(spark, sf_dir), (10, 20, 26, 32)))


# --- identities and names


@query("""WITH c AS (SELECT doc_id, n_chars, encode(repeat(text, 40)) AS content FROM documents WHERE text IS NOT NULL), a AS (SELECT *, octet_length(content) AS size, greatest(octet_length(content) - 65536, 0) AS last FROM c),
o AS (SELECT DISTINCT doc_id, CAST(floor(last * i / 8) AS BIGINT) AS at FROM a, range(9) r(i)),
j AS (SELECT a.doc_id, list(encode(o.at || ':') || a.content[o.at + 1 : o.at + 65536] ORDER BY o.at) AS parts FROM a JOIN o USING (doc_id) GROUP BY a.doc_id)
SELECT a.doc_id, sha256(list_reduce(list_prepend(encode(size || ':' || n_chars), parts), lambda x, y: x || y)) AS fingerprint FROM a JOIN j USING (doc_id)""")
def sampled_fingerprints(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").where("text is not null").withColumn("content", F.encode(F.repeat("text", 40), "UTF-8"))
    return d.select("doc_id", identity.sampled_fingerprint(F.col("content"), F.octet_length("content"), F.col("n_chars")).alias("fingerprint"))


@query(r"""SELECT page_id, left(regexp_replace(regexp_replace(v, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), 120) AS folder FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS v FROM pages WHERE page_id % 2 = 0)
WHERE regexp_replace(regexp_replace(v, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g') <> '' UNION ALL SELECT page_id, 'url-' || left(sha256('https://y/?v=' || md5(url)), 16) FROM pages WHERE page_id % 2 = 1""")
def folder_names(spark, sf_dir):
    """A page's url as the list of a playlist url; every other playlist url has none."""
    p = b.table(spark, sf_dir, "pages").where("url is not null")
    listed = F.concat(F.lit("https://y/?v=1&list="), F.url_encode(F.regexp_replace("url", "^[a-z]+://", "")), F.lit("&x=2"))
    bare = F.concat(F.lit("https://y/?v="), F.md5("url"))
    return p.select("page_id", text.folder_name(F.when(F.col("page_id") % 2 == 0, listed).otherwise(bare)).alias("folder"))


@query(r"SELECT doc_id, coalesce(nullif(regexp_replace(CASE WHEN lang = 'en' THEN regexp_extract(text, '^[^.]*') ELSE '  ' END, '^\s+|\s+$', '', 'g'), ''), nullif(source, '')) AS channel FROM documents WHERE text IS NOT NULL")
def source_channels(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", text.source_channel(F.when(F.col("lang") == "en", F.regexp_extract("text", "^[^.]*", 0)).otherwise("  "), F.col("source")).alias("channel"))


# --- text policy

#: The text with the supplied documents' secrets as marks.
SAFE_SQL = "regexp_replace({0}, '(token = \"|secret = \"|key = \"|password = \")[0-9a-f]{{40}}', '\\1[REDACTED:assigned-secret]', 'g')"


def safe_sql(c: str) -> str:
    return SAFE_SQL.format(c)


@query(f"SELECT doc_id, sha256({safe_sql('text')}) AS text_sha256, len(regexp_extract_all(text, '\"[0-9a-f]{{40}}\"')) AS redactions FROM documents WHERE text IS NOT NULL")
def redacted_texts(spark, sf_dir):
    d = redaction.redact(b.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"))
    return d.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.col("redactions").cast("long").alias("redactions"))


#: Kinds of secrets, and how one is made of 64 hexadecimal digits ``h``: (kind, before, Spark, SQL, after).
KINDS = (
    ("github-token", "use ghp_", "left(h, 36)", " now"), ("npm-token", "use npm_", "left(h, 36)", " now"), ("hf-token", "use hf_", "left(h, 34)", " now"), ("gitlab-token", "use glpat-", "left(h, 20)", " now"), ("google-key", "use AIza", "left(h, 35)", " now"),
    ("slack-token", "use xoxb-", "left(h, 24)", " now"), ("stripe-key", "use sk_live_", "left(h, 24)", " now"), ("aws-key", "use AKIA", "upper(left(h, 16))", " now"), ("api-key", "use sk-", "left(h, 32)", " now"), ("jwt", "use eyJ", "left(h, 12) || '.' || left(h, 20) || '.' || left(h, 30)", " now"),
    ("base64-blob", "blob ", "h", " end"), ("oauth-token", "Authorization: Bearer ", "'a1' || left(h, 24)", " sent"), ("assigned-secret", "apiKey: ", "'a1' || left(h, 20)", ", so"), ("url-password", "at ftp://me:", "left(h, 10)", "@host/x"), ("url-user", "at https://", "'a1' || left(h, 30)", "@host/x"), ("private-key", "", "'-----BEGIN RSA PRIVATE KEY-----' || h || '-----END RSA PRIVATE KEY-----'", " kept"),
)
_KEPT_BEFORE = {"oauth-token", "assigned-secret", "url-password", "url-user"}


def _without_value(kind: str, before: str) -> str:
    """What stands before the mark: a token's own prefix is part of the value."""
    return before if kind in _KEPT_BEFORE or kind in ("base64-blob", "private-key") else before[: before.rindex(" ") + 1]


@query("SELECT o_orderkey, CASE o_orderkey % 17 " + " ".join(f"WHEN {i} THEN o_orderpriority || ' {_without_value(k, p)}[REDACTED:{k}]{z}'" for i, (k, p, _, z) in enumerate(KINDS)) + " ELSE o_orderpriority || ' your_api_key <token> -----BEGIN PUBLIC KEY----- git@host commit ' || md5(CAST(o_orderkey AS VARCHAR)) || left(md5(CAST(o_orderkey AS VARCHAR)), 8) END AS text FROM orders")
def secret_kinds(spark, sf_dir):
    """Every kind of secret, and what only looks like one, in the texts of orders."""
    k = F.col("o_orderkey")
    o = b.table(spark, sf_dir, "orders").withColumn("h", F.concat(F.md5(k.cast("string")), F.md5(F.concat(k.cast("string"), F.lit("x")))))
    plain = F.concat(F.lit("your_api_key <token> -----BEGIN PUBLIC KEY----- git@host commit "), F.md5(k.cast("string")), F.left(F.md5(k.cast("string")), F.lit(8)))
    made = reduce(lambda c, x: F.when(k % 17 == x[0], F.concat(F.lit(x[1][1]), F.expr(x[1][2]), F.lit(x[1][3]))).otherwise(c), list(enumerate(KINDS)), plain)
    return o.select("o_orderkey", redaction.redacted(F.concat_ws(" ", "o_orderpriority", made)).alias("text"))


@query(f"SELECT doc_id, sha256({safe_sql('text')}) AS title, sha256(text) AS file_path, sha256({safe_sql('text')}) AS tag, sha256({safe_sql('text')}) AS entry, lang AS entry_key, 'enabled' AS policy FROM documents WHERE text IS NOT NULL")
def redacted_records(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").where("text is not null")
    t = F.col("text")
    made = d.select("doc_id", F.struct(t.alias("title"), t.alias("file_path"), F.array(F.struct(t.alias("tag"))).alias("tags"), F.create_map("lang", "text").alias("entries")).alias("x"))
    r = redaction.redact_nested(made)
    sha = lambda c: F.sha2(c, 256)
    return r.select("doc_id", sha("x.title").alias("title"), sha("x.file_path").alias("file_path"), sha(F.col("x.tags")[0]["tag"]).alias("tag"), sha(F.map_values("x.entries")[0]).alias("entry"), F.map_keys("x.entries")[0].alias("entry_key"), F.col("redaction_policy").alias("policy"))


_OPENED = r"\[(?:R(?:E(?:D(?:A(?:C(?:T(?:E(?:D(?::[a-z0-9-]{0,40})?)?)?)?)?)?)?)?)?$"


@query(rf"""WITH t AS (SELECT doc_id, repeat({safe_sql('text')}, 12) AS x FROM documents WHERE text IS NOT NULL), s AS (SELECT *, octet_length(encode(x)) AS n FROM t),
c AS (SELECT *, regexp_replace(hex(encode(x)[1:262144]), '(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){{0,2}})$', '') AS h FROM s WHERE n > 262144)
SELECT doc_id, sha256(x) AS text_sha256, NULL::VARCHAR AS warning FROM s WHERE n <= 262144 UNION ALL
SELECT doc_id, sha256(regexp_replace(decode(unhex(CASE WHEN length(h) % 2 = 0 THEN h ELSE h END)), '{_OPENED}', '')), 'text had ' || n || ' bytes of text and was cut to 262144' FROM c""")
def capped_texts(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.repeat(redaction.redacted(F.col("text")), 12).alias("x"))
    c = d.select("doc_id", text.capped_field(F.col("x"), "text").alias("c"))
    return c.select("doc_id", F.sha2("c.text", 256).alias("text_sha256"), "c.warning.message").withColumnRenamed("message", "warning")


FENCED_SQL = "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all({0}, '`+'), lambda z: length(z))), 0) + 1))"


def fenced_sql(c: str, tag: str = "text") -> str:
    f = FENCED_SQL.format(c)
    return f"({f} || '{tag}' || chr(10) || {c} || chr(10) || {f})"


WINDOW_SQL = f"""{b.SEGMENTS_SQL}, {b.FRAMES_SQL}, m AS (SELECT frm.source_id, frame_index, seg_no, trim(text, ' ') AS t, coalesce(sum(length(trim(text, ' '))) OVER (PARTITION BY frm.source_id, frame_index ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
FROM frm JOIN seg ON seg.source_id = frm.source_id AND end_ >= ts - 30 AND start_ <= ts + 30 WHERE trim(text, ' ') <> ''), j AS (SELECT source_id, frame_index, string_agg(t, ' ' ORDER BY seg_no) AS win FROM m WHERE c <= 4800 GROUP BY ALL),
x AS (SELECT source_id, frame_index, trim(coalesce(win, ''), ' ') AS s FROM frm LEFT JOIN j USING (source_id, frame_index)), y AS (SELECT *, CASE WHEN length(s) > 1200 THEN regexp_replace(left(s, 1200), '{_OPENED}', '') ELSE s END AS cut FROM x)"""


@query(f"WITH {WINDOW_SQL} SELECT source_id, frame_index, CASE WHEN s <> '' THEN {fenced_sql('cut')} END AS block, length(s) > 1200 AS truncated FROM y")
def prompt_contexts(spark, sf_dir):
    w = timeline.transcript_windows(b.frames(spark, sf_dir), b.segments(spark, sf_dir))
    return w.select("source_id", "frame_index", grounding.prompt_context(F.col("window")).alias("c")).select("source_id", "frame_index", "c.block", "c.truncated")


# --- documents


def stamp_sql(c: str) -> str:
    ms = f"CAST(round_even({c} * 1000, 0) AS BIGINT)"
    return f"(lpad(CAST({ms} // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST({ms} % 1000 AS VARCHAR), 3, '0'))"


DOCUMENT_SQL = f"""WITH {b.SEGMENTS_SQL}, {b.FRAMES_SQL}, {FOLDED_SQL}, nl AS (SELECT chr(10) AS n), src AS (SELECT source_id, max(end_) AS duration, count(*) AS segments FROM seg GROUP BY source_id),
sg AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY seg_no) AS nth FROM seg), fr AS (SELECT * FROM frm WHERE adds_information IS NOT FALSE), fc AS (SELECT source_id, count(*) AS frames FROM fr GROUP BY source_id),
pl AS (SELECT fr.source_id, frame_index, ts, min(nth) AS nth FROM fr LEFT JOIN sg ON sg.source_id = fr.source_id AND end_ >= ts GROUP BY ALL),
pp AS (SELECT pl.*, CASE WHEN pl.nth IS NULL THEN 'after' WHEN ts < start_ THEN 'before' ELSE 'inside' END AS place FROM pl LEFT JOIN sg ON sg.source_id = pl.source_id AND sg.nth = pl.nth),
pk AS (SELECT *, row_number() OVER (PARTITION BY source_id, nth, place ORDER BY ts, frame_index) - 1 AS k FROM pp),
pg AS (SELECT page_id AS source_id, page_id % 4 AS w, CASE WHEN page_id % 5 = 0 THEN 'https://github.com/a/' || page_id || '.' ELSE url END AS raw FROM pages),
li AS (SELECT source_id, regexp_replace(regexp_replace(raw, '[.,;:!?]+$', ''), '#.*$', '') AS url, CASE WHEN w = 1 THEN 'again code' WHEN w = 0 THEN 'Docs and slides' WHEN w = 3 THEN 'The repo' WHEN source_id % 5 = 0 OR raw ILIKE '%example%' THEN 'See' ELSE 'again code' END AS label, raw FROM pg),
blocks AS (SELECT source_id, 0 AS section, 0.0 AS k0, 0.0 AS k1, 0.0 AS k2, 0.0 AS k3, '# Talk ' || source_id || n || n || 'Segments: ' || segments || '. Frames: ' || coalesce(frames, 0) || '.' AS text FROM src LEFT JOIN fc USING (source_id), nl
UNION ALL SELECT source_id, 1, 0, 0, 0, 0, '- Channel: Room ' || source_id % 7 || n || '- Seconds: ' || CAST(round(duration) AS BIGINT) || n || n || CASE WHEN source_id % 2 = 0 THEN 'Frames were read by reader-' || source_id % 3 || '.' ELSE 'No model read the frames.' END FROM src, nl
UNION ALL SELECT source_id, 2, seq, 0, 0, 0, '- Warning `' || code || '` (' || stage || '), ' || occurrences || 'x: ' || coalesce(message, '') FROM fold WHERE source_id IN (SELECT source_id FROM src)
UNION ALL SELECT source_id, 3, CASE WHEN label = 'again code' THEN 1 ELSE 0 END, 0, 0, 0, '- [' || label || '](' || replace(url, '(', '%28') || ')' FROM li WHERE source_id IN (SELECT source_id FROM src)
UNION ALL SELECT source_id, 4, nth, 1, 0, 0, '## ' || {stamp_sql('start_')} || ' - ' || {stamp_sql('end_')} FROM sg
UNION ALL SELECT source_id, 4, nth, 2, 0, 0, {fenced_sql("trim(text, ' ')")} FROM sg WHERE trim(text, ' ') <> ''
UNION ALL SELECT source_id, 4, coalesce(nth, 1e15), CASE WHEN place = 'before' THEN 0 ELSE 2 END, CASE WHEN place = 'inside' THEN k + 0.5 ELSE ts END, frame_index, '### Frame at ' || {stamp_sql('ts')} || n || n || '![](frames/frame_' || lpad(CAST(frame_index AS VARCHAR), 4, '0') || '.png)' || n || n ||
  CASE WHEN frame_index % 2 = 0 THEN '```ocr' || n || 'on screen' || n || '```' ELSE 'No text was read.' END || n || n || 'No second reader supports this reading; treat it with care.' FROM pk, nl)
SELECT source_id, string_agg(text, chr(10) || chr(10) ORDER BY section, k0, k1, k2, k3, text) || chr(10) AS markdown FROM blocks GROUP BY source_id"""


def document_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    s, f = b.segments(spark, sf_dir), b.frames(spark, sf_dir)
    k = F.col("source_id")
    shown = f.withColumns({"relative_path": F.format_string("frames/frame_%04d.png", "frame_index"), "extracted_text": F.when(F.col("frame_index") % 2 == 0, "on screen"), "grounding": F.struct(F.lit("weak").alias("level"))})
    sources = s.groupBy("source_id").agg(F.round(F.max("end")).cast("long").alias("duration_sec")).select(
        "source_id", F.concat(F.lit("Talk "), k.cast("string")).alias("title"), F.concat(F.lit("Room "), (k % 7).cast("string")).alias("channel"), "duration_sec", F.when(k % 2 == 0, F.concat(F.lit("reader-"), (k % 3).cast("string"))).alias("reader")
    )
    own = described(spark, sf_dir).drop("source_id").withColumnRenamed("page_id", "source_id").join(sources.select("source_id"), "source_id", "left_semi")
    told = b.warnings(spark, sf_dir).join(sources.select("source_id"), "source_id", "left_semi")
    return sources, s, shown, told, links.extract_links(own, "source_id", "text")


@query(DOCUMENT_SQL)
def documents_rendered(spark, sf_dir):
    return documents.render_filtered(*document_tables(spark, sf_dir))
