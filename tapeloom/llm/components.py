"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import remove, written

#: Rows of one key that a join gives to one task, about; a key with more is dealt over several.
HOT = 1000


def spread_join(rows: DataFrame, one: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one`` (a row a key), without leaving a hot key's rows in one task.

    Keys of more than ``HOT`` rows get a number of salts; their rows are dealt over them,
    and their row of ``one`` is repeated for each.  The table of hot keys is a thousandth
    of the rows at most, and Spark broadcasts it only where it is small.
    """
    hot = rows.groupBy(key).agg(F.ceil(F.count("*") / HOT).cast("int").alias("__salts")).where("__salts > 1")
    salts = F.coalesce("__salts", F.lit(1))
    others = [c for c in rows.columns if c != key] or [key]
    dealt = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*others), salts).cast("int")).drop("__salts")
    repeated = one.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(repeated, [key, "__salt"], how).drop("__salt")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not itself a root; root is the least node.

    Each round joins the edges with the least neighbour of each node, twice, and is
    written to the shared folder, where the round before it is removed; the number of
    rounds grows with the logarithm of the size of a component.  An empty table gives no node; edges from a node
    to itself and repeated edges do not matter.
    """
    now = written(_canonical(edges))
    mark = _mark(now)
    for _ in range(max_rounds):
        wide = written(_large_star(now))
        before, now = now, written(_small_star(wide))
        remove(now.sparkSession, before, wide)
        last, mark = mark, _mark(now)
        if mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not converge")


def _canonical(edges: DataFrame) -> DataFrame:
    """Each edge once, from its greater to its smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 41)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is joined to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _canonical(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _canonical(moved.unionByName(least.select("a", F.col("m").alias("b"))))
