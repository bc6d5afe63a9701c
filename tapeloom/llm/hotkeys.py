"""Joins with a counted table, where a few keys may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most, and how many rows a key has at least that is.
KEYS, LEAST = 1 << 16, 1000


def joined_by_count(rows: DataFrame, counted: DataFrame, key: str, total: int, n: str = "n", columns: list[str] | None = None) -> DataFrame:
    """``rows`` joined (inner) with ``counted``, which has each key once and in ``n`` how many of ``total`` rows have it.

    Keys with more than a 65,536th of all rows are fewer than 65,536 whatever the data, so
    they are broadcast and their rows stay where they are; all other rows are shuffled,
    and no key of these is large.  ``columns`` of ``counted`` are taken (all by default).
    """
    bound = max(total // KEYS, LEAST)
    counted = counted.select(key, n, *[c for c in columns if c not in (key, n)]) if columns is not None else counted
    hot = F.broadcast(counted.where(F.col(n) > bound))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(counted.where(F.col(n) <= bound), key))
