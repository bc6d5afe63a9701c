"""Fingerprints of files by ranges of their bytes, read in the tasks and never whole."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import INNER_SAMPLES, SAMPLE_BYTES, WHOLE_BYTES

#: Bytes that a whole digest holds at once.
PIECE = 1 << 20
TOO_LARGE = "E_CONTENT_HASH_TOO_LARGE"
Opener = Callable[[str], tuple[Any, str]]


def open_uri(uri: str) -> tuple[Any, str]:
    """(file system, path in it) of a path or URI: local files and the stores that Arrow knows."""
    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlsplit(uri).path) if "://" in uri or uri.startswith("file:") else uri
    return fs.FileSystem.from_uri(uri)


def offsets_of(size: int) -> list[int]:
    """Where samples begin: zero, seven points evenly between, the last sample; equal ones once."""
    last = max(size - SAMPLE_BYTES, 0)
    return sorted({last * i // (INNER_SAMPLES + 1) for i in range(INNER_SAMPLES + 2)})


def sampled_files(files: DataFrame, path: str = "path", modified: str | None = None, opener: Opener = open_uri) -> DataFrame:
    """Adds ``size``, ``samples``, ``bytes_read``, ``fingerprint`` and ``problem`` to rows with a ``path``.

    The fingerprint is that of :func:`~tapeloom.functions.identity.sampled_fingerprint`,
    with the modification time in nanoseconds, or the column ``modified`` for stores
    that have none to trust.  At most nine samples of 64 KiB are read, however large the
    file.  A file that cannot be read has a ``problem`` and no fingerprint; a null path
    too.  Rows are dealt over tasks, since listings come in few partitions.
    """

    def one(where: str | None, at: Any) -> tuple:
        try:
            system, name = opener(where)
            info = system.get_file_info(name)
            if not info.is_file:
                return None, None, None, None, "not a file"
            size, at = info.size, info.mtime_ns if at is None else at
            made, read = hashlib.sha256(f"{size}:{at}".encode()), 0
            anchors = offsets_of(size)
            with system.open_input_file(name) as file:
                for offset in anchors:
                    piece = file.read_at(SAMPLE_BYTES, offset)
                    made.update(f"{offset}:".encode() + piece)
                    read += len(piece)
            return size, len(anchors), read, made.hexdigest(), None
        except (OSError, TypeError, AttributeError, pa.ArrowException) as e:
            return None, None, None, None, type(e).__name__

    return _each(files, path, modified, one, "size long, samples int, bytes_read long, fingerprint string, problem string")


def digested_files(files: DataFrame, path: str = "path", most: int = WHOLE_BYTES, opener: Opener = open_uri) -> DataFrame:
    """Adds ``size``, ``content_sha256`` and ``problem``: the digest of all bytes, a mebibyte in memory at a time.

    Files beyond ``most`` bytes (five GiB) are refused with ``E_CONTENT_HASH_TOO_LARGE``
    without being read.
    """

    def one(where: str | None, _: Any) -> tuple:
        try:
            system, name = opener(where)
            info = system.get_file_info(name)
            if not info.is_file:
                return None, None, "not a file"
            if info.size > most:
                return info.size, None, TOO_LARGE
            made = hashlib.sha256()
            with system.open_input_stream(name) as file:
                while piece := file.read(PIECE):
                    made.update(piece)
            return info.size, made.hexdigest(), None
        except (OSError, TypeError, AttributeError, pa.ArrowException) as e:
            return None, None, type(e).__name__

    return _each(files, path, None, one, "size long, content_sha256 string, problem string")


def _each(files: DataFrame, path: str, modified: str | None, one: Callable[[str | None, Any], tuple], fields: str) -> DataFrame:
    new = T._parse_datatype_string(fields)
    lower = {n.lower() for n in new.names}
    kept = [c for c in files.columns if c.lower() not in lower]
    rows = files.select(*[files[f"`{c}`"] for c in kept], files[f"`{path}`"].cast("string").alias("__path"), (files[f"`{modified}`"].cast("string") if modified else F.lit(None).cast("string")).alias("__modified"))
    rows = rows.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType(rows.schema.fields[:-2] + list(new.fields))
    kinds = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(p, m) for p, m in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True)]
            made = list(zip(*made, strict=True)) or [()] * len(new.fields)
            columns = [pa.array(list(c), kinds[f.dataType.typeName()]) for c, f in zip(made, new.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, *new.names])

    return rows.mapInArrow(run, schema)
