"""Runs a vectorised function over slices of a DataFrame's rows inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import chunks


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the DataFrame does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts."""
    return df.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0


def group_count(df: DataFrame, text: str, group_bytes: int) -> int:
    """How many groups of about ``group_bytes`` of text there are; no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), text_bytes(df, text) // group_bytes + 1)


def dealt(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """Rows by their group, in as many partitions as groups where these are more than the session's."""
    return df.repartition(groups, *keys) if groups > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def kept_columns(df: DataFrame, keep: Sequence[str] | None, new: Iterable[str]) -> list[str]:
    """Columns that pass through: those named, or all, without any that a result column replaces; case does not matter."""
    new, have = {c.lower() for c in new}, {c.lower(): c for c in df.columns}
    names = list(df.columns) if keep is None else [have[c.lower()] for c in keep if c.lower() in have]
    return [c for c in names if c.lower() not in new]


def map_texts(
    df: DataFrame,
    text: str,
    function: Callable[[pa.RecordBatch, pa.Array], dict[str, pa.Array]],
    fields: str,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``function(slice, texts)`` gives the new columns of each slice; other columns pass through.

    A slice holds about a megabyte of text, or one longer text, so memory does not
    follow the batch size.  An input column named like a new one is replaced.
    """
    new = T._parse_datatype_string(fields)
    passed = kept_columns(df, keep, new.names)
    own = fresh(df, "text")
    source = df.select(*[df[f"`{c}`"] for c in passed], df[f"`{text}`"].cast("string").alias(own))
    schema = T.StructType(source.schema.fields[:-1] + list(new.fields))
    n = len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, own):
                made = function(part, part.column(n))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *[made[f] for f in new.names]], names=[*passed, *new.names])

    return source.mapInArrow(run, schema)
