"""Readable documents: markdown for each source, put together from blocks of all tables, as one text or in parts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redaction import redacted
from ..functions.text import capped, fenced, link_target, link_text, timestamp
from ..operators.folds import fold_warnings
from ..operators.timeline import informative_frames, interleave, spoken_chunks

#: Sections of a document in order.
HEADER, PROVENANCE, WARNINGS, LINKS, BODY = range(5)
#: Columns of ``sources`` that are stated, where there are any, and how.
STATED = {"channel": "Channel", "upload_date": "Uploaded", "canonical_url": "From", "duration_sec": "Seconds", "processed_at": "Processed"}


def _block(df: DataFrame, section: int, text, *order) -> DataFrame:
    """Rows of one section: order keys are numbers, compared in turn."""
    keys = [F.coalesce(F.col(k).cast("double") if isinstance(k, str) else k.cast("double"), F.lit(0.0)) for k in order] + [F.lit(0.0)] * (4 - len(order))
    return df.select("source_id", F.struct(F.lit(section).alias("section"), *[k.alias(f"k{i}") for i, k in enumerate(keys)], text.alias("text")).alias("block"))


#: Bytes of one part of a document, about.
PART_BYTES = 1 << 20


def render(sources: DataFrame, segments: DataFrame, frames: DataFrame, warnings: DataFrame, links: DataFrame, images: bool = True, reasons: bool = False) -> DataFrame:
    """``markdown`` of each source, from :func:`document_blocks`, in one text; :func:`parts_of` has no such bound."""
    return _assemble(document_blocks(sources, segments, frames, warnings, links, images, reasons))


def document_blocks(sources: DataFrame, segments: DataFrame, frames: DataFrame, warnings: DataFrame, links: DataFrame, images: bool = True, reasons: bool = False) -> DataFrame:
    """Blocks of each source's document: ``source_id`` and ``block`` (order keys, then ``text``).

    Text of strangers stands in fenced blocks; a frame stands where it was shown, inside
    a segment between the words before and after it.  Readings that no second reader
    supports carry a note, and frames that add nothing say so.  What ``sources`` know of
    themselves (the columns of ``STATED``, ``description``) and who read the frames
    (``reader``) is stated behind the header; null facts are left out.  Texts on frames
    are cut at the bound of a stored field.  With ``reasons`` a link's ``reason`` stands
    behind it.
    """
    folded = fold_warnings(warnings)
    counts = frames.groupBy("source_id").agg(F.count("*").alias("n_frames")).join(segments.groupBy("source_id").agg(F.count("*").alias("n_segments")), "source_id", "full")
    head = sources.join(counts, "source_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    header = F.concat(F.lit("# "), link_text(F.coalesce("title", F.lit("Untitled"))), F.lit("\n\nSegments: "), n(F.col("n_segments")), F.lit(". Frames: "), n(F.col("n_frames")), F.lit("."))
    frames = frames.withColumn("extracted_text", capped(F.col("extracted_text")))
    placed = interleave(frames, segments)
    at = segments.select("source_id", F.row_number().over(_by_source()).alias("__n"), "seg_no", "start", "end", "text", "words")
    chunks = spoken_chunks(segments, placed).join(at.select("source_id", "seg_no", "__n"), ["source_id", "seg_no"])
    shown = frames.join(placed.select("source_id", "frame_index", "seg_no", "place"), ["source_id", "frame_index"]).join(at.select("source_id", "seg_no", "__n"), ["source_id", "seg_no"], "left")
    because = F.coalesce(F.when(F.trim("reason") != "", F.concat(F.lit(" ("), link_text(F.trim("reason")), F.lit(")"))), F.lit("")) if reasons else F.lit("")
    return _united(
        _block(head, HEADER, header),
        _block(_provenance(sources).where("stated <> ''"), PROVENANCE, F.col("stated")),
        _block(folded, WARNINGS, F.concat(F.lit("- Warning `"), F.col("code"), F.lit("` ("), F.col("stage"), F.lit("), "), F.col("occurrences").cast("string"), F.lit("x: "), link_text(F.coalesce("message", F.lit("")))), "seq"),
        _block(links, LINKS, F.concat(F.lit("- ["), link_text(F.col("label")), F.lit("]("), link_target(F.col("url")), F.lit(")"), because), "line_no", "pos"),
        _block(at, BODY, F.concat(F.lit("## "), timestamp(F.col("start")), F.lit(" - "), timestamp(F.col("end"))), "__n", F.lit(1)),
        _block(chunks, BODY, fenced(F.col("text")), "__n", F.lit(2), F.col("chunk")),
        _block(_frame_places(shown), BODY, _frame_text(images), F.coalesce("__n", F.lit(1e15)), F.when(F.col("place") == "before", 0).otherwise(2), F.when(F.col("place") == "inside", F.col("__k") + 0.5).otherwise(F.col("timestamp_sec")), "frame_index"),
    )


def _provenance(sources: DataFrame) -> DataFrame:
    """The source's facts as lines, its description as a block, and who read its frames."""
    lines = [F.concat(F.lit(f"- {label}: "), link_text(F.col(c).cast("string"))) for c, label in STATED.items() if c in sources.columns]
    parts = [F.nullif(F.array_join(F.array(*lines), "\n"), F.lit(""))] if lines else []
    if "description" in sources.columns:
        parts.append(F.when(F.trim("description") != "", fenced(F.trim("description"))))
    if "reader" in sources.columns:
        parts.append(F.coalesce(F.concat(F.lit("Frames were read by "), link_text(F.col("reader")), F.lit(".")), F.lit("No model read the frames.")))
    return sources.select("source_id", F.array_join(F.array(*parts), "\n\n").alias("stated") if parts else F.lit("").alias("stated"))


def _by_source():
    return Window.partitionBy("source_id").orderBy("seg_no")


def _frame_places(shown: DataFrame) -> DataFrame:
    """Numbers the frames inside each segment from 0: frame ``k`` stands behind chunk ``k``."""
    inside = Window.partitionBy("source_id", "seg_no", "place").orderBy("timestamp_sec", "frame_index")
    return shown.withColumn("__k", F.row_number().over(inside) - 1)


def _frame_text(images: bool):
    level = F.coalesce(F.col("grounding.level"), F.lit(""))
    note = F.when(level == "self_report", "\n\nOnly the model's own account stands behind this reading.").when(level.isin("weak", "ungrounded"), "\n\nNo second reader supports this reading; treat it with care.").otherwise("")
    verdict = F.when(F.col("adds_information").eqNullSafe(False), "\n\nJudged to add nothing to the speech.").otherwise("")
    text = F.coalesce("extracted_text", F.lit(""))
    image = F.concat(F.lit("![]("), link_target(F.col("relative_path")), F.lit(")\n\n")) if images else F.lit("")
    return F.concat(F.lit("### Frame at "), timestamp(F.col("timestamp_sec")), F.lit("\n\n"), image, F.when(F.trim(text) != "", fenced(text, "ocr")).otherwise("No text was read."), note, verdict)


def _united(*blocks: DataFrame) -> DataFrame:
    met = blocks[0]
    for b in blocks[1:]:
        met = met.unionByName(b)
    return met


def _assemble(blocks: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list("block")), lambda b: b["text"])
    return blocks.groupBy("source_id").agg(F.concat(F.array_join(ordered, "\n\n"), F.lit("\n")).alias("markdown"))


def parts_of(blocks: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Documents in parts, without a list of a source's blocks: ``source_id``, ``part_range``, ``part_no``, ``markdown``.

    Blocks are sorted over all sources, in ranges, so a source of any length is spread;
    each range streams by, and a part is given out when it has about ``part_bytes`` or its
    source ends.  A source's parts in order of ``part_range`` and ``part_no``, joined by
    empty lines, with a line break behind the last, are :func:`render`'s text.
    """
    rows = blocks.select("source_id", "block.*")
    order = ["source_id", "section", "k0", "k1", "k2", "k3", "text"]
    kind = rows.schema["source_id"].dataType.simpleString()
    names = ["source_id", "part_range", "part_no", "markdown"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, no, at, held, size = TaskContext.get().partitionId(), 0, None, [], 0
        source = None

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], source), pa.array([here], pa.int32()), pa.array([no], pa.int64()), pa.array(["\n\n".join(held)], pa.string())], names=names)

        for batch in batches:
            source = batch.schema.field(0).type
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                who, text = ids[i].as_py(), texts[i].as_py()
                if held and (who != at or size >= part_bytes):
                    yield part()
                    no, held, size = no + 1, [], 0
                at = who
                if text is not None:
                    held.append(text)
                    size += len(text) + 2
        if held:
            yield part()

    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).select("source_id", "text")
    return ranged.mapInArrow(run, f"source_id {kind}, part_range int, part_no long, markdown string")


def joined_parts(parts: DataFrame) -> DataFrame:
    """The parts of each source as one text."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part_range", "part_no", "markdown"))), lambda p: p["markdown"])
    return parts.groupBy("source_id").agg(F.concat(F.array_join(ordered, "\n\n"), F.lit("\n")).alias("markdown"))


def filtered_blocks(sources: DataFrame, segments: DataFrame, frames: DataFrame, warnings: DataFrame, links: DataFrame, reasons: bool = False) -> DataFrame:
    """:func:`document_blocks` without frames that add nothing; all texts of warnings and links are redacted again on the way out, also who found a link and why."""
    safe_warnings = warnings.withColumn("message", redacted(F.col("message")))
    safe_links = links.withColumns({c: redacted(F.col(c)) for c in ("url", "label", "source", "reason") if c in links.columns})
    return document_blocks(sources, segments, informative_frames(frames), safe_warnings, safe_links, reasons=reasons)


def render_filtered(sources: DataFrame, segments: DataFrame, frames: DataFrame, warnings: DataFrame, links: DataFrame, reasons: bool = False) -> DataFrame:
    """:func:`filtered_blocks` as one text a source."""
    return _assemble(filtered_blocks(sources, segments, frames, warnings, links, reasons))
