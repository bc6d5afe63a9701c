"""The bundle store as tables: validity, servability, work lists, survey, retention and prune plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Containers in order of preference, fields of a manifest with their types, and of its provenance.
KINDS_OF_MEDIA = [".mp4", ".mkv", ".webm", ".mov", ".m4v"]
MANIFEST_FIELDS = {
    "pipeline_version": "BIGINT", "tool_version": "STRING", "source_type": "STRING", "source_resolved_path": "STRING", "duration_sec": "NUMBER",
    "options": "OBJECT", "frame_count": "BIGINT", "transcript_present": "BOOLEAN", "warning_count": "BIGINT", "frames": "ARRAY", "warnings": "ARRAY",
}
PROVENANCE_KEYS = ["title", "channel", "description", "upload_date", "canonical_url", "duration_sec", "processed_at"]
PROVENANCE_TEXTS = ["title", "channel", "description", "upload_date"]
CANONICAL_URL = r"^https://www\.youtube\.com/watch\?v=[0-9A-Za-z_-]{11}\z"
FRAME_PATH = r"^frames/frame_\d{4,}\.png\z"
STAGE_SCHEMA = 1


def _number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _kind(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))


def manifest_problem(manifests: DataFrame, text: str = "manifest_json") -> DataFrame:
    """Adds ``problem``: the first field of a manifest that is not as it must be (null for a valid one).

    Booleans are no numbers; identity stands under ``bundle_key`` or the older
    ``source_hash``; ``frame_count`` is the number of frames and every frame has a
    keyframe's path; provenance has no other keys, texts, a finite duration, UTC times
    and a plain watch url.
    """
    v = F.col("__v")
    out = F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "not an object")
    for name, want in MANIFEST_FIELDS.items():
        kind = _kind(v, f"$.{name}")
        good = _number(kind) if want == "NUMBER" else kind.startswith(want)
        out = out.when(~good, name)
    frames = F.try_variant_get(v, "$.frames", "array<variant>")
    paths = F.try_variant_get(v, "$.frames", "array<struct<relative_path:string>>")
    seen = F.try_variant_get(v, "$.provenance", "map<string,variant>")
    provenance = _kind(v, "$.provenance")
    time = F.try_variant_get(v, "$.provenance.processed_at", "string")
    out = (
        out.when((_kind(v, "$.bundle_key") != "STRING") & (_kind(v, "$.source_hash") != "STRING"), "bundle_key")
        .when(F.try_variant_get(v, "$.frame_count", "bigint") != F.size(frames), "frame_count")
        .when(~F.coalesce(F.forall(paths, lambda p: F.coalesce(p["relative_path"].rlike(FRAME_PATH), F.lit(False))), F.lit(False)), "frames")
        .when((provenance != "VOID") & ~provenance.startswith("OBJECT"), "provenance")
        .when(F.size(F.array_except(F.coalesce(F.map_keys(seen), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in PROVENANCE_KEYS]))) > 0, "provenance keys")
        .when(F.try_variant_get(v, "$.provenance.duration_sec", "variant").isNotNull() & ~_number(_kind(v, "$.provenance.duration_sec")) & (_kind(v, "$.provenance.duration_sec") != "VOID"), "provenance duration")
        .when(F.exists(F.array(*[_kind(v, f"$.provenance.{t}").isin("STRING", "VOID") for t in PROVENANCE_TEXTS]), lambda good: ~good), "provenance text")
        .when((_kind(v, "$.provenance.canonical_url") != "VOID") & ~F.coalesce(F.try_variant_get(v, "$.provenance.canonical_url", "string").rlike(CANONICAL_URL), F.lit(False)), "provenance url")
        .when(time.isNotNull() & ~time.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z\z"), "provenance time")
    )
    return manifests.withColumn("__v", F.try_parse_json(F.col(text))).withColumn("problem", out).drop("__v")


def recorded_identity(text: Column) -> Column:
    v = F.try_parse_json(text)
    return F.coalesce(F.try_variant_get(v, "$.bundle_key", "string"), F.try_variant_get(v, "$.source_hash", "string"))


def bundle_verdicts(bundles: DataFrame, generations: DataFrame) -> DataFrame:
    """Adds ``verdict`` (published, owned, foreign, invalid, absent) and ``servable`` to bundles.

    A bundle is servable if its manifest is valid and names its own directory, its active
    generation is listed, and both renders of that exist.
    """
    active = generations.select("bundle_key", F.col("name").alias("active"), (F.col("has_render") & F.col("has_self_contained")).alias("__rendered"))
    met = bundles.join(active, ["bundle_key", "active"], "left")
    verdict = (
        F.when(F.col("marker").isNull(), "absent")
        .when(F.col("marker") == "invalid", "invalid")
        .when(F.coalesce(F.col("identity"), F.col("bundle_key")) != F.col("bundle_key"), "foreign")
        .when(F.col("active").isNull(), "owned")
        .otherwise("published")
    )
    return met.withColumn("verdict", verdict).withColumn("servable", (F.col("verdict") == "published") & F.coalesce("__rendered", F.lit(False))).drop("__rendered")


def resolve_from_cache(candidates: DataFrame, servable: DataFrame, probes: DataFrame) -> DataFrame:
    """The answer of each run: the first candidate with a servable bundle, else the first available reader, else ``chain_exhausted``.

    ``candidates`` have ``run_id``, ``entry``, ``bundle_key``, ``mode`` and ``force``; a
    ``selected`` run needs a bundle with a reading (``readings`` of ``servable``).  A
    ``disabled`` run has one candidate, its first, and asks no reader.
    """
    first_entry = F.min("entry").over(Window.partitionBy("run_id"))
    candidates = candidates.withColumn("__first", first_entry).where((F.col("mode") != "disabled") | (F.col("entry") == F.col("__first"))).drop("__first")
    hits = candidates.where(~F.col("force")).join(servable, "bundle_key").where((F.col("mode") != "selected") | (F.col("readings") > 0))
    first = hits.groupBy("run_id").agg(F.min_by("bundle_key", "entry").alias("hit_key"), F.min("entry").alias("hit_entry"))
    open_ = probes.where("answered").groupBy("run_id").agg(F.min("entry").alias("open_entry"))
    runs = candidates.groupBy("run_id").agg(F.min("mode").alias("mode"))
    out = runs.join(first, "run_id", "left").join(open_, "run_id", "left").withColumn("open_entry", F.when(F.col("mode") != "disabled", F.col("open_entry")))
    answer = F.when(F.col("hit_key").isNotNull(), "cache").when(F.col("mode") == "disabled", "disabled").when(F.col("open_entry").isNotNull(), "reader").otherwise("chain_exhausted")
    return out.select("run_id", answer.alias("answer"), F.coalesce("hit_entry", "open_entry").alias("entry"), "hit_key")


def chain_evidence(resolved: DataFrame, probes: DataFrame) -> DataFrame:
    """What each run saw of its chain: a row for each entry with ``outcome``, up to the entry that answered.

    A run served from the cache saw that entry alone (``cache_hit``); else its probes up to
    the first answer: ``skipped`` (``skip`` of ``probes``), ``unavailable`` or ``selected``.
    """
    hit = resolved.where("answer = 'cache'").select("run_id", "entry", F.lit("cache_hit").alias("outcome"))
    asked = resolved.where("answer in ('reader', 'chain_exhausted')").select("run_id", F.col("entry").alias("__entry"))
    seen = probes.join(asked, "run_id").where(F.col("__entry").isNull() | (F.col("entry") <= F.col("__entry")))
    outcome = F.when(F.col("entry").eqNullSafe(F.col("__entry")), "selected").when(F.col("skip"), "skipped").otherwise("unavailable")
    return hit.unionByName(seen.select("run_id", "entry", outcome.alias("outcome")))


def stage_problem(results: DataFrame, text: str = "document") -> DataFrame:
    """Adds ``problem`` to recorded stage results (``bundle_key``, ``stage``, JSON): why one cannot be used again, null if it can."""
    v = F.col("__v")
    kind = F.schema_of_variant(v)
    paths = F.regexp_extract_all(F.col(text), F.lit(r'"(?:path|[A-Za-z0-9_]{1,80}_path)"\s*:\s*"((?:[^"\\]|\\.)*)"'), 1)
    outside = F.exists(paths, lambda p: p.startswith("/") | p.rlike(r"(^|/)\.\.(/|$)") | p.contains("\\"))
    problem = (
        F.when(v.isNull() | ~kind.startswith("OBJECT"), "not an object")
        .when((_kind(v, "$.schema_version") != "BIGINT") | (F.try_variant_get(v, "$.schema_version", "bigint") != STAGE_SCHEMA), "schema_version")
        .when(~F.try_variant_get(v, "$.bundle_key", "string").eqNullSafe(F.col("bundle_key")), "bundle_key")
        .when(~F.try_variant_get(v, "$.stage", "string").eqNullSafe(F.col("stage")), "stage")
        .when(~_kind(v, "$.payload").startswith("OBJECT"), "payload")
        .when(outside, "path")
    )
    return results.withColumn("__v", F.try_parse_json(F.col(text))).withColumn("problem", problem).drop("__v")


def work_list(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """(bundle_key, stage) pairs that have no usable result, with the reason why a recorded one is not."""
    checked = stage_problem(results)
    good = checked.where("problem is null").select("bundle_key", "stage").distinct()
    why = checked.where("problem is not null").groupBy("bundle_key", "stage").agg(F.min("problem").alias("reason"))
    return wanted.join(good, ["bundle_key", "stage"], "left_anti").join(why, ["bundle_key", "stage"], "left").withColumn("reason", F.coalesce("reason", F.lit("missing")))


def reusable_payloads(results: DataFrame, text: str = "document") -> DataFrame:
    """(bundle_key, stage, ``payload``, ``warnings``) of usable results: the payload's own warnings, then those recorded around it."""
    good = stage_problem(results, text).where("problem is null").withColumn("__v", F.try_parse_json(F.col(text)))
    kind = "array<struct<stage:string,code:string,message:string,occurrences:bigint>>"
    listed = lambda path: F.coalesce(F.try_variant_get("__v", path, kind), F.array().cast(kind))
    return good.select("bundle_key", "stage", F.to_json(F.try_variant_get("__v", "$.payload", "variant")).alias("payload"), F.concat(listed("$.payload.warnings"), listed("$.warnings")).alias("warnings"))


def generation_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^g(\d+)\z", 1).try_cast("long")


def orphan_generations(generations: DataFrame, active: DataFrame) -> DataFrame:
    """Generations that are not the active one of a valid manifest; all of a bundle without one."""
    return generations.join(active.select("bundle_key", F.col("active").alias("name")), ["bundle_key", "name"], "left_anti")


def retention(generations: DataFrame, active: DataFrame, keep: int) -> DataFrame:
    """Generations beyond the newest ``keep`` (by number) that are not active."""
    if keep < 1:
        raise ValueError("at least one generation is kept")
    newest = Window.partitionBy("bundle_key").orderBy(F.desc(generation_number(F.col("name"))), F.desc("name"))
    old = generations.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") > keep)
    return orphan_generations(old, active).drop("rank")


def next_generation(bundles: DataFrame, generations: DataFrame) -> DataFrame:
    """The name of each bundle's next generation."""
    last = generations.groupBy("bundle_key").agg(F.max(generation_number(F.col("name"))).alias("last"))
    return bundles.select("bundle_key").distinct().join(last, "bundle_key", "left").select("bundle_key", F.concat(F.lit("g"), (F.coalesce("last", F.lit(0)) + 1).cast("string")).alias("name"))


POINTER = "bundle_key string, gen_no long, batch_id long, active string"
#: Buckets of keys in a snapshot of pointers.
BUCKETS = 64


def publish(batch: DataFrame, pointers: DataFrame, batch_id: int) -> DataFrame:
    """New pointers of a batch's keys (``bundle_key``): each key's next generation is active.

    A key whose pointer is of this batch already keeps it, so a batch may be delivered again.
    """
    met = batch.select("bundle_key").distinct().join(pointers.select("bundle_key", "gen_no", "batch_id"), "bundle_key", "left")
    fresh = F.coalesce("batch_id", F.lit(-1)) < batch_id
    return met.select(
        "bundle_key", (F.coalesce("gen_no", F.lit(0)) + fresh.cast("int")).cast("long").alias("gen_no"), F.when(fresh, F.lit(batch_id)).otherwise(F.col("batch_id")).cast("long").alias("batch_id")
    ).withColumn("active", F.concat(F.lit("g"), F.col("gen_no").cast("string")))


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []


def _mark(spark: SparkSession, path: str) -> None:
    """Creates an empty file: the write before it counts from now on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True).close()


def _committed(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    """(last batch in the newest whole snapshot, or -1; committed batches after it)."""
    number = lambda names, ahead: [int(n.removeprefix(ahead)) for n in names if n.removeprefix(ahead).isdigit() and n.startswith(ahead)]
    marks = _names(spark, f"{folder}/commits")
    through = max(number(marks, "snapshot-"), default=-1)
    return through, sorted(i for i in number(marks, "batch-") if i > through)


def _changes(spark: SparkSession, folder: str, through: int, batches: list[int]) -> DataFrame:
    """Pointers of the newest snapshot and of the batches after it; several of a key."""
    parts = [f"{folder}/log/batch-{i}" for i in batches]
    log = spark.read.schema(POINTER).parquet(*parts) if parts else spark.createDataFrame([], POINTER)
    return log if through < 0 else log.unionByName(spark.read.schema(f"{POINTER}, bucket int").parquet(f"{folder}/snapshots/{through}").drop("bucket"))


def pointers_of(spark: SparkSession, folder: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The pointers under ``folder``, each key's latest: of all, or of batches before ``before``, or of ``keys`` only; none at first.

    Only what has been committed counts: the newest snapshot and the batches after it.
    """
    through, batches = _committed(spark, folder)
    if before is not None and through >= before:
        raise ValueError(f"batch {before} is in snapshot {through}")
    rows = _changes(spark, folder, through, [i for i in batches if before is None or i < before])
    if keys is not None:
        rows = rows.join(keys.select("bundle_key").distinct(), "bundle_key", "left_semi")
    latest = rows.groupBy("bundle_key").agg(F.max(F.struct("batch_id", "gen_no", "active")).alias("p"))
    return latest.select("bundle_key", "p.gen_no", "p.batch_id", "p.active")


def publish_batch(batch: DataFrame, batch_id: int, rows: str, pointers: str, compact_every: int = 50) -> None:
    """Writes a batch (``bundle_key`` and its content) as each key's next generation, then makes these active.

    For ``foreachBatch``.  Rows go to the folder of the batch under ``rows``, the pointers
    of the batch's keys, and of no others, to the log under ``pointers``; an empty file
    then commits both, so a batch that breaks off before is not seen, and is written anew
    when it is delivered again.  A committed batch that is delivered again changes
    nothing.  Every ``compact_every`` batches the log is folded into a snapshot.
    """
    spark = batch.sparkSession
    through, batches = _committed(spark, pointers)
    if batch_id <= through or batch_id in batches:
        return
    batch = batch.withColumn("bundle_key", F.col("bundle_key").cast("string"))
    publish(batch, pointers_of(spark, pointers, batch_id, batch), batch_id).write.mode("overwrite").parquet(f"{pointers}/log/batch-{batch_id}")
    own = spark.read.schema(POINTER).parquet(f"{pointers}/log/batch-{batch_id}").select("bundle_key", F.col("active").alias("name"))
    batch.join(own, "bundle_key").write.mode("overwrite").parquet(f"{rows}/version={batch_id}")
    _mark(spark, f"{pointers}/commits/batch-{batch_id}")
    if len(batches) + 1 >= compact_every:
        compact_pointers(spark, pointers)


def compact_pointers(spark: SparkSession, folder: str) -> None:
    """Folds the committed batches into a snapshot in buckets of keys, marks it whole, then removes what it stands for."""
    through, batches = _committed(spark, folder)
    if not batches:
        return
    latest = pointers_of(spark, folder).withColumn("bucket", F.pmod(F.xxhash64("bundle_key"), F.lit(BUCKETS)).cast("int"))
    latest.repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/snapshots/{batches[-1]}")
    _mark(spark, f"{folder}/commits/snapshot-{batches[-1]}")
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    kept = {f"snapshot-{batches[-1]}", str(batches[-1])}
    for kind in ("commits", "log", "snapshots"):
        for name in _names(spark, f"{folder}/{kind}"):
            # Batches that are not committed yet are later ones.
            if name not in kept and int(name.rpartition("-")[2]) <= batches[-1]:
                at = hadoop.Path(f"{folder}/{kind}/{name}")
                at.getFileSystem(conf).delete(at, True)


def published_rows(spark: SparkSession, rows: str, pointers: str) -> DataFrame:
    """Content of the active generations: the rows that their key's pointer stands for; rows of a batch that was never committed are none of them."""
    active = pointers_of(spark, pointers).select("bundle_key", F.col("batch_id").alias("version"), F.col("active").alias("name"))
    made = spark.read.option("basePath", rows).parquet(rows)
    return made.withColumn("version", F.col("version").cast("long")).join(active, ["bundle_key", "version", "name"], "left_semi").drop("version")


def survey(bundles: DataFrame, generations: DataFrame, staging: DataFrame | None = None) -> DataFrame:
    """Each bundle's verdict, active generation, generations in numeric order, orphans and, given ``staging``, its staging folders by name."""
    listed = generations.groupBy("bundle_key").agg(F.array_sort(F.collect_list(F.struct(generation_number(F.col("name")).alias("n"), "name"))).alias("g"))
    out = bundle_verdicts(bundles, generations).join(listed, "bundle_key", "left")
    none = F.array().cast("array<string>")
    names = F.coalesce(F.transform("g", lambda x: x["name"]), none)
    columns = [names.alias("generations"), F.filter(names, lambda n: ~n.eqNullSafe(F.col("active"))).alias("orphans")]
    if staging is not None:
        out = out.join(staging.groupBy("bundle_key").agg(F.array_sort(F.collect_list("name")).alias("__staging")), "bundle_key", "left")
        columns.append(F.coalesce("__staging", none).alias("staging"))
    return out.select("bundle_key", "verdict", "servable", "active", "locked", *columns)


def survey_totals(surveyed: DataFrame, staging: DataFrame) -> DataFrame:
    """One row for the root: bundles, servable and locked ones, generations, orphans, and staging folders of ``staging`` (``bundle_key``, ``name``)."""
    left = staging.agg(F.count("*").alias("staging"))
    one = surveyed.agg(F.count("*").alias("bundles"), F.count_if("servable").alias("servable"), F.count_if("locked").alias("locked"), F.coalesce(F.sum(F.size("generations")), F.lit(0)).alias("generations"), F.coalesce(F.sum(F.size("orphans")), F.lit(0)).alias("orphans"))
    return one.join(F.broadcast(left))  # one row each


def skip_reason(name: Column, is_link: Column, depth: Column, verdict: Column) -> Column:
    """Why a listing entry is not taken as a bundle, null if it is one.

    ``verdict`` is that of :func:`bundle_verdicts`; below six levels nothing is looked at.
    """
    return F.when(is_link, "symlink").when(name.rlike("^[_.]"), "reserved").when(verdict.isin("foreign", "invalid"), verdict).when((verdict == "absent") & (depth >= 6), "too deep").when(verdict == "absent", "no marker")


def skip_counts(entries: DataFrame) -> DataFrame:
    """How many listing entries (``name``, ``is_link``, ``depth``, ``verdict``) are taken (null reason) or skipped for each reason."""
    return entries.groupBy(skip_reason(F.col("name"), F.col("is_link"), F.col("depth"), F.col("verdict")).alias("reason")).agg(F.count("*").alias("entries"))


#: What ends the descent at an entry: all but a plain folder without a marker, and what is a bundle.
DESCENDS = "no marker"


def considered(entries: DataFrame, folder: str, parts: int | None = None) -> DataFrame:
    """Adds ``reason`` (why an entry is no bundle, null if it is one) and ``considered`` to a listing of whole roots.

    ``entries`` have ``root``, ``path`` (below the root, parts joined by ``/``), ``name``,
    ``is_link``, ``depth``, ``verdict`` and ``unlistable``.  Nothing below a bundle, a link,
    a reserved name, a foreign, invalid or unlistable folder, or the last level is
    considered; an entry there says nothing.

    A folder's subtree is an interval of paths, once the separator sorts before all
    else.  Paths are sorted in ranges; along each range the farthest end of a stopped
    subtree is carried, and what earlier ranges carried over comes from one row a range.
    So a root of any size is spread, and nothing is joined with its ancestors.  ``folder``
    keeps the ranges (shared by all executors).
    """
    reason = F.coalesce(skip_reason(F.col("name"), F.col("is_link"), F.col("depth"), F.col("verdict")), F.lit(""))
    reason = F.when(F.col("unlistable") & ~F.col("is_link"), "unlistable").otherwise(F.nullif(reason, F.lit("")))
    key = F.concat(F.coalesce(F.col("root").cast("string"), F.lit("")), F.lit("\0"), F.replace(F.col("path"), F.lit("/"), F.lit("\0")))
    stopped = ~F.col("reason").eqNullSafe(F.lit(DESCENDS))
    rows = entries.withColumn("reason", reason).withColumn("__key", key).withColumn("__end", F.when(stopped, F.concat("__key", F.lit("\1"))))
    dealt = rows.repartitionByRange(parts, "__key") if parts else rows.repartitionByRange("__key")
    spark = entries.sparkSession
    dealt.withColumn("__range", F.spark_partition_id()).write.mode("overwrite").parquet(folder)
    rows = spark.read.parquet(folder)
    before = Window.partitionBy("__range").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("__range").agg(F.max("__end").alias("__end"))
    # One row a range.
    carried = ends.select("__range", F.max("__end").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    met = rows.withColumn("__far", F.max("__end").over(before)).join(F.broadcast(carried), "__range")
    # An outer subtree ends behind an entry's own, so an entry that is listed twice is not inside itself.
    far = F.greatest("__far", "__carried")
    inside = F.coalesce((far > F.col("__key")) & (far != F.concat("__key", F.lit("\1"))), F.lit(False))
    return met.select(*entries.columns, "reason", (~inside).alias("considered"))


def considered_counts(walked: DataFrame) -> DataFrame:
    """How many considered entries of each root are bundles (null ``reason``) or skipped for each reason."""
    return walked.where("considered").groupBy("root", "reason").agg(F.count("*").alias("entries"))


def prune_plan(bundles: DataFrame, generations: DataFrame, staging: DataFrame, now: Column, keep: int, max_age_days: float) -> DataFrame:
    """What may go: (bundle_key, target, reason), by the first rule that speaks for a bundle.

    Not ours or locked: nothing.  Never published: the whole bundle (``orphan``).  Older
    than ``max_age_days`` by its latest time: the whole bundle (``expiry``); an unknown age
    proposes nothing by that rule.  Else generations beyond retention, or all if none is
    usably active (``orphan``).  Staging folders of our unlocked bundles always go.
    """
    newest = generations.groupBy("bundle_key").agg(F.max("mtime").alias("__gen"))
    own = bundle_verdicts(bundles, generations).where(~F.col("verdict").isin("absent", "foreign", "invalid") & ~F.col("locked")).join(newest, "bundle_key", "left")
    age = (now.cast("timestamp").cast("double") - F.greatest("root_mtime", "manifest_mtime", "__gen").cast("double")) / 86400
    own = own.withColumn("__rule", F.when(F.col("verdict") == "owned", "orphan").when(age > max_age_days, "expiry").when(~F.col("servable"), "all").otherwise("retention"))
    whole = own.where(F.col("__rule").isin("orphan", "expiry")).select("bundle_key", F.lit("").alias("target"), F.col("__rule").alias("reason"))
    unusable = generations.join(own.where("__rule = 'all'").select("bundle_key"), "bundle_key", "left_semi").select("bundle_key", F.col("name").alias("target"), F.lit("orphan").alias("reason"))
    kept = own.where("__rule = 'retention'").select("bundle_key", "active")
    old = retention(generations.join(kept.select("bundle_key"), "bundle_key", "left_semi"), kept, keep).select("bundle_key", F.col("name").alias("target"), F.lit("retention").alias("reason"))
    tmp = staging.join(own.where(F.col("__rule").isin("all", "retention")).select("bundle_key"), "bundle_key", "left_semi").select("bundle_key", F.col("name").alias("target"), F.lit("staging").alias("reason"))
    return whole.unionByName(unusable).unionByName(old).unionByName(tmp)


def revalidate(plan: DataFrame, current_plan: DataFrame, active: DataFrame) -> DataFrame:
    """Outcome of each target of an older plan: ``delete``, or ``skip`` with the reason (it is active now, or no longer proposed)."""
    again = current_plan.select("bundle_key", "target").distinct().withColumn("__again", F.lit(True))
    now = active.select("bundle_key", F.col("active").alias("target")).where("target is not null").withColumn("__active", F.lit(True))
    met = plan.join(again, ["bundle_key", "target"], "left").join(now, ["bundle_key", "target"], "left")
    why = F.when(F.col("__active"), "active").when(F.col("__again").isNull(), "no longer proposed")
    return met.withColumn("skip_reason", why).withColumn("outcome", F.when(why.isNull(), "delete").otherwise("skip")).drop("__again", "__active")


def pick_container(files: DataFrame) -> DataFrame:
    """One media file of each download: preferred containers first, then by suffix and path."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS_OF_MEDIA]), suffix)
    order = F.struct(F.when(rank > 0, rank).otherwise(len(KINDS_OF_MEDIA) + 1), suffix, F.col("path"))
    return files.groupBy("source_id").agg(F.min_by("path", order).alias("path"))
