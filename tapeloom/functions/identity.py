"""Identities: fingerprints, option hashes, bundle keys, corpus digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of one sample of a sampled fingerprint, samples between first and last, and the most a whole digest reads.
SAMPLE_BYTES, INNER_SAMPLES, WHOLE_BYTES = 64 * 1024, 7, 5 * 1024**3

#: Digests of cases that are packed in one row.
BLOCK = 128


def video_fingerprint(video: Column) -> Column:
    return F.sha2(video, 256)


def content_fingerprint(content: Column, size: Column) -> Column:
    """SHA-256 of the bytes; null (refused) beyond five GiB."""
    return F.when(size <= F.lit(WHOLE_BYTES), F.sha2(content, 256))


def anchor_offsets(size: Column) -> Column:
    """Where samples begin: zero, seven points evenly between, the last sample; equal ones once."""
    last = F.greatest(size - SAMPLE_BYTES, F.lit(0)).cast("long")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(INNER_SAMPLES + 1)), lambda i: F.floor(last * i / (INNER_SAMPLES + 1)).cast("long")))


def sampled_fingerprint(content: Column, size: Column, modified: Column) -> Column:
    """SHA-256 over size, modification time, and each anchor's offset and bytes."""
    parts = F.transform(anchor_offsets(size), lambda at: F.concat(F.encode(at.cast("string"), "UTF-8"), F.encode(F.lit(":"), "UTF-8"), F.substring(content, at.cast("int") + 1, F.lit(SAMPLE_BYTES))))
    head = F.encode(F.concat_ws(":", size.cast("string"), modified.cast("string")), "UTF-8")
    joined = F.aggregate(parts, head, lambda a, b: F.concat(a, b))
    return F.sha2(joined, 256)


def options_json(options: Column) -> Column:
    """Canonical JSON of an options map: keys in order, ``-0`` and ``-0.0`` as zero, nulls kept."""
    pairs = F.array_sort(F.map_entries(options))
    value = lambda e: F.when(e["value"].isNull(), F.lit("null")).otherwise(F.to_json(F.struct(F.when(e["value"].rlike(r"^-0(\.0+)?$"), F.regexp_replace(e["value"], "^-", "")).otherwise(e["value"]).alias("v"))))
    plain = lambda e: F.when(e["value"].isNull(), F.lit("null")).otherwise(F.regexp_extract(value(e), r"^\{\"v\":(.*)\}$", 1))
    quoted = lambda e: F.regexp_extract(F.to_json(F.struct(e["key"].alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(quoted(e), F.lit(":"), plain(e))), ","), F.lit("}"))


def options_hash(options: Column) -> Column:
    return F.sha2(options_json(options), 256)


def bundle_key(fingerprint: Column, options: Column) -> Column:
    return F.sha2(F.concat(fingerprint, F.lit(":"), options), 256)


def duplicate_sources(sources: DataFrame, fingerprint: str = "fingerprint", source: str = "source_id") -> DataFrame:
    """Fingerprints of more than one source: ``sources`` (distinct) and the least source."""
    return sources.groupBy(fingerprint).agg(F.count_distinct(source).alias("sources"), F.min(source).alias("first_source")).where("sources > 1")


def key_collisions(sources: DataFrame, key: str = "bundle_key", fingerprint: str = "fingerprint") -> DataFrame:
    """Bundle keys that more than one fingerprint has: ``fingerprints`` (distinct) and the least of them."""
    return sources.groupBy(key).agg(F.count_distinct(fingerprint).alias("fingerprints"), F.min(fingerprint).alias("first_fingerprint")).where("fingerprints > 1")


def corpus_digest(cases: DataFrame, label_digest: str, position: str, image: str, truth: str) -> DataFrame:
    """One digest over the label table's and then each case's image digest and truth, in corpus order.

    Cases are reduced to digests, dealt by ranges of position, sorted and packed in
    their tasks; one task takes the blocks in turn.  A digest of one ordered stream is
    made in order, but no task holds more than a batch of it.
    """
    each = cases.select(F.col(position).alias("at"), F.sha2(F.concat_ws("\x00", F.col(image), F.coalesce(F.col(truth), F.lit(""))), 256).alias("d"))
    blocks = each.repartitionByRange("at", "d").sortWithinPartitions("at", "d").select("d").mapInArrow(_packed, "part int, seq bigint, digests string")
    head = cases.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("digests"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, between = None, b""
        for batch in batches:
            for digests in batch.column(2).to_pylist():
                if digests is None:
                    made = hashlib.sha256(f"{label_digest}:".encode())
                else:
                    made.update(between + digests.encode())
                    between = b":"
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([made.hexdigest()])], names=["digest"])

    return head.unionByName(blocks).repartition(1).sortWithinPartitions("part", "seq").mapInArrow(fold, "digest string")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of a sorted partition in joined blocks, numbered in order."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        d = batch.column(0).to_pylist()
        made = [":".join(d[i : i + BLOCK]) for i in range(0, len(d), BLOCK)]
        n = len(made)
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(seq, seq + n), pa.int64()), pa.array(made, pa.string())], names=["part", "seq", "digests"])
        seq += n
