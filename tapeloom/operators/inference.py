"""The hook for models that run outside: a caller's function over batches, failures as rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Model = Callable[[pd.DataFrame], pd.DataFrame]
#: Models that this worker process has built, by the hook that asked for them.
_BUILT: dict[str, Model] = {}
#: Rows and bytes of one batch.
BATCH_ROWS, BATCH_BYTES = 64, 64 << 20


def row_bytes(part: pd.DataFrame) -> np.ndarray:
    """Bytes of each row, about: lengths of texts and bytes, eight for any other value."""
    total = np.zeros(len(part), dtype=np.int64)
    for name in part.columns:
        column = part[name]
        total += column.map(lambda v: len(v) if isinstance(v, str | bytes | bytearray) else 8).to_numpy(dtype=np.int64) if column.dtype == object else 8
    return total


def batches_of(part: pd.DataFrame, rows: int, size: int) -> Iterator[pd.DataFrame]:
    """Parts of at most ``rows`` rows and ``size`` bytes; a larger row is a part of its own."""
    stop = np.cumsum(row_bytes(part))
    at = 0
    while at < len(part):
        done = stop[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(stop, done + size, side="right"))))
        yield part.iloc[at:to]
        at = to


def built(hook: str, setup: Callable[[], Model]) -> Model:
    """The model of a hook in this worker process."""
    if hook not in _BUILT:
        _BUILT[hook] = setup()
    return _BUILT[hook]


def infer(
    df: DataFrame, function: Model | None, schema: str, batch_rows: int = BATCH_ROWS, batch_bytes: int = BATCH_BYTES, setup: Callable[[], Model] | None = None, profile: ResourceProfile | None = None
) -> DataFrame:
    """Rows with the columns that ``function`` gives for batches, and ``failure``.

    A batch has at most ``batch_rows`` rows and ``batch_bytes`` bytes; a larger row is
    alone.  In place of a function, ``setup`` builds one: once in each worker process,
    before its first batch, whatever the number of tasks; ``profile`` asks for what it
    needs (a GPU, memory) in that stage only.  A batch that raises is tried row by row, so
    one bad row costs itself alone; its result columns are null and ``failure`` names the
    error.  A ``setup`` that raises fails the task, which Spark tries again.  Retries of
    batches are the function's business.  Input columns named like a result are replaced,
    in any case of letters.
    """
    if (function is None) == (setup is None):
        raise ValueError("either a function or its setup")
    added = T._parse_datatype_string(schema)
    names = [f.name for f in added.fields]
    taken = {n.lower() for n in (*names, "failure")}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    whole = T.StructType(kept + list(added.fields) + [T.StructField("failure", T.StringType())])
    passed = [f.name for f in kept]
    hook = uuid.uuid4().hex

    def one(asked: Model, part: pd.DataFrame) -> pd.DataFrame:
        try:
            made = asked(part)[names].reset_index(drop=True)
            if len(made) != len(part):
                raise ValueError("the function gave another number of rows")
            return pd.concat([part[passed].reset_index(drop=True), made], axis=1).assign(failure=None)
        except Exception as e:  # noqa: BLE001 - whatever a caller's model raises becomes a row
            if len(part) > 1:
                return pd.concat([one(asked, part.iloc[i : i + 1]) for i in range(len(part))], ignore_index=True)
            return part[passed].reset_index(drop=True).assign(**dict.fromkeys(names), failure=f"{type(e).__name__}: {e}"[:500])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = None
        for batch in batches:
            for part in batches_of(batch, batch_rows, batch_bytes):
                asked = asked or function or built(hook, setup)
                yield one(asked, part)

    return df.mapInPandas(run, whole, profile=profile)
