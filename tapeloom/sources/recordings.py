"""Readers and writers: media listings, transcripts, manifests and progress logs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File extensions of videos.
VIDEO_EXTENSIONS = ["avi", "m4v", "mkv", "mov", "mp4", "mpeg", "mpg", "webm", "wmv"]
WORD = "struct<word:string,start:double,end:double,probability:double>"
TRANSCRIPT = f"language string, language_probability double, segments array<struct<start:double,end:double,text:string,avg_logprob:double,words:array<{WORD}>>>"
READING = "struct<visual_summary:string,detected_elements:array<string>,interpretation:string,uncertainty:string,backend:string,model:string,prompt_profile:string,frame_kind:string,verbatim_text:string,text_confidence:string>"
FRAME = f"struct<index:int,timestamp_sec:double,relative_path:string,phash:string,ocr_text:string,visual_interpretation:{READING},grounding:struct<level:string,text_overlap:double,reason:string>,salience:struct<adds_information:boolean,reason:string,reason_truncated:boolean>>"
MANIFEST = f"bundle_key string, source_type string, duration_sec double, transcript_present boolean, active_generation string, frames array<{FRAME}>, related_links array<struct<url:string,label:string,source:string,reason:string>>, warnings array<struct<stage:string,code:string,message:string,occurrences:bigint>>"
EVENT = "type string, job_id string, sequence bigint, mechanism string, status string, percent double, overall_percent double, timestamp double, detail string, code string, stage string, message string"


def list_media(spark: SparkSession, folder: str, recursive: bool = True, max_items: int | None = None, extensions: Iterable[str] = VIDEO_EXTENSIONS) -> DataFrame:
    """``path``, ``modificationTime``, ``length`` of media files in path order; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).drop("content")
    kept = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).orderBy("path")
    return kept if max_items is None else kept.limit(max_items)


def transcript_problem(document: Column) -> Column:
    """What is wrong with a transcript document, null for a good one: no JSON, no object, ``segments`` no list, or a segment without times."""
    v = F.try_parse_json(document)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    times = F.try_variant_get(v, "$.segments", "array<struct<start:double,end:double>>")
    timed = F.forall(times, lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    return (
        F.when(v.isNull(), "not JSON").when(~kind("$").startswith("OBJECT"), "not an object").when(~kind("$.segments").startswith("ARRAY"), "segments")
        .when(~F.coalesce(timed, F.lit(False)), "segment")
    )


def segments_of(transcripts: DataFrame, source: str = "source_id", document: str = "document", problems: bool = False) -> DataFrame:
    """Segments of transcript documents (JSON), each with its place; a document without any gives one row without ``seg_no``.

    With ``problems`` each row says what is wrong with its document (``problem``, null for
    a good one); the segments of a malformed document are not given, but it has its row.
    """
    found = transcript_problem(F.col(document)) if problems else F.lit(None).cast("string")
    parsed = transcripts.select(source, found.alias("problem"), F.from_json(document, TRANSCRIPT).alias("t"))
    usable = F.when(F.col("problem").isNull(), F.col("t.segments"))
    rows = parsed.select(source, "problem", F.col("t.language").alias("language"), F.posexplode_outer(usable).alias("seg_no", "s"))
    return rows.select(source, "seg_no", "language", "s.start", "s.end", "s.text", "s.avg_logprob", "s.words", *(["problem"] if problems else []))


def manifest_tables(manifests: DataFrame, document: str = "manifest_json") -> dict[str, DataFrame]:
    """``frames``, ``links`` and ``warnings`` of manifests, parsed once; stored names become the tables' names."""
    m = manifests.select(F.from_json(document, MANIFEST).alias("m")).select("m.*")
    frames = m.select(F.col("bundle_key").alias("source_id"), F.explode("frames").alias("f")).select(
        "source_id", F.col("f.index").alias("frame_index"), "f.timestamp_sec", "f.relative_path", "f.phash", F.col("f.ocr_text").alias("extracted_text"), F.col("f.visual_interpretation").alias("interpretation"), "f.grounding", "f.salience"
    )
    links = m.select(F.col("bundle_key").alias("source_id"), F.posexplode("related_links").alias("pos", "l")).select("source_id", "pos", "l.*")
    warnings = m.select(F.col("bundle_key").alias("source_id"), F.posexplode("warnings").alias("seq", "w")).select("source_id", "seq", "w.*")
    return {"frames": frames, "links": links, "warnings": warnings}


def manifest_rows(sources: DataFrame, frames: DataFrame, links: DataFrame, folded_warnings: DataFrame, segments: DataFrame) -> DataFrame:
    """One manifest (JSON) a source; machine-local ``path`` fields are left out, counts are taken from what is listed."""
    own = lambda df, *order: df.drop("path").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*[F.col(c) for c in df.columns if c not in ("source_id", "path")]).alias("x")))).alias("rows")).select("source_id", F.transform("rows", lambda r: r["x"]).alias("rows"))
    stored = frames.withColumnsRenamed({"extracted_text": "ocr_text", "interpretation": "visual_interpretation", "frame_index": "index"})
    out = sources
    for name, rows in (("frames", own(stored, "index")), ("related_links", own(links, "pos")), ("warnings", own(folded_warnings, "seq"))):
        out = out.join(rows.withColumnRenamed("rows", name), "source_id", "left")
    spoken = segments.select("source_id").distinct().withColumn("transcript_present", F.lit(True))
    out = out.join(spoken, "source_id", "left").withColumn("transcript_present", F.coalesce("transcript_present", F.lit(False)))
    count = F.aggregate(F.coalesce(F.transform("warnings", lambda w: w["occurrences"]), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, b: a + b)
    out = out.withColumn("frame_count", F.coalesce(F.array_size("frames"), F.lit(0))).withColumn("warning_count", count).withColumnRenamed("source_id", "bundle_key")
    return out.select("bundle_key", F.to_json(F.struct("*")).alias("manifest_json"))


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Adds ``kind`` (progress, error, noise) and the parsed ``event`` to lines of a progress log; for batches and streams."""
    e = F.from_json(line, EVENT)
    is_object = F.col(line).rlike(r"^\s*\{.*\}\s*$") & F.try_parse_json(line).isNotNull()
    kind = F.when(~F.coalesce(is_object, F.lit(False)), "noise").when(e["type"].isNotNull(), "progress").otherwise("error")
    return lines.withColumn("kind", kind).withColumn("event", F.when(F.col("kind") != "noise", e))


def read_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return parse_log((spark.readStream if streaming else spark.read).text(path))
