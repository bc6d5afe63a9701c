"""Token files: ids of each text as Parquet list columns that allow selective reads.

Texts are range-partitioned and sorted by key, encoded in the tasks that write, and
stored with dictionary pages (or delta-packed integers), small pages with column
indexes and bounded row groups.  A reader can take the metadata columns alone, or the
ids of a key range: pages and row groups outside it are skipped.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernels import chunks
from .pretokens import Cache, Points, plain_lower, solid_pieces, utf8
from .storage import shared_folder

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 256 << 10, 2000
SCHEMA = "key bigint, block int, start_in_block bigint, n_tokens bigint, ids array<int>"


class PieceEncoder:
    """The library's tokenizer behind a cache of pieces.

    Its pattern never joins letters, digits or marks across white space, so a text's
    ids are those of its lower-cased pieces.  Texts with special tokens, or with
    characters whose normal form or lower case depends on context, go to the library
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cache = Cache()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, number of each text)."""
        p = Points(texts)
        low = plain_lower()[p.points]
        odd = set(np.searchsorted(p.offsets, np.flatnonzero(low == 0), side="right").tolist())
        whole = sorted(d - 1 for d in odd)
        if np.any(p.points == 0x3C):
            listed = texts.to_pylist()
            whole = sorted({*whole, *(d for d, t in enumerate(listed) if t and any(s in t for s in self.special))})
        starts, ends = solid_pieces(p, low)

        def new(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            lists = [e.ids for e in self.tokenizer.encode_batch([x.decode("utf-8") for x in pieces], add_special_tokens=False)]
            size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            return np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(size.sum())), size

        ids, size = self.cache.encoded(*utf8(low), starts, ends, new)
        total = np.zeros(len(size) + 1, dtype=np.int64)
        np.cumsum(size, out=total[1:])
        bounds = total[np.searchsorted(starts, p.offsets)]
        if not whole:
            return ids, np.diff(bounds)
        count, parts, at = np.diff(bounds), [], 0
        for d in whole:
            parts.append(ids[bounds[at] : bounds[d]])
            own = np.array(self.tokenizer.encode(texts[d].as_py() or "", add_special_tokens=False).ids, dtype=np.int32)
            parts.append(own)
            count[d], at = len(own), d + 1
        parts.append(ids[bounds[at] :])
        return np.concatenate(parts), count


_encoders: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int | None = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Writes the ids of each text to token files, in ascending key order.

    A null or empty text has only the end id.  Rows with equal keys follow each other
    in text order; a null key comes first.  Only key and text are read; other columns
    do not matter.  ``tokenizer`` is a tokenizer file that every worker has.
    ``encoding`` is ``dictionary`` or ``delta``.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, start, block = _encoder(tokenizer), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in chunks(batch, "text"):
                ids, size = e.encode(part.column(1))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(size), end_id)
                    size = size + 1
                bounds = np.concatenate([[0], np.cumsum(size)])
                n = part.num_rows
                columns = [
                    part.column(0),
                    pa.array(np.full(n, block, dtype=np.int32)),
                    pa.array(start + bounds[:-1]),
                    pa.array(size.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))),
                ]
                start += int(bounds[-1])
                yield pa.RecordBatch.from_arrays(columns, names=["key", "block", "start_in_block", "n_tokens", "ids"])

    options = {
        "compression": "zstd",
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.writer.version": "v1" if encoding == "dictionary" else "v2",
    }
    rows.repartitionByRange("key").sortWithinPartitions("key", "text").mapInArrow(run, SCHEMA).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Key, ``start`` (ids of all rows before it), ``n_tokens`` and ids; untouched columns are not read.

    Block offsets come from one sum a block, so only as many rows as there are blocks are put in order.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    sums = rows.groupBy("block").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return rows.join(F.broadcast(offsets), "block").select("key", (F.col("offset") + F.col("start_in_block")).alias("start"), "n_tokens", "ids")


def with_crc(tokens: DataFrame, ids: str = "ids") -> DataFrame:
    """Replaces the ids by ``ids_crc32``, the unsigned CRC-32 of them as little-endian 32-bit integers."""
    others = [c for c in tokens.columns if c != ids]
    source = tokens.select(*others, ids)
    schema = source.drop(ids).withColumn("ids_crc32", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(others))
            bounds = column.offsets.to_numpy()
            values = memoryview(column.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(crc, pa.int64())], names=[*others, "ids_crc32"])

    return source.mapInArrow(run, schema)


def new_path(spark: SparkSession) -> str:
    return shared_folder(spark)
