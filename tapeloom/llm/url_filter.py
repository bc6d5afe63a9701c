"""URL filters as a sort-merge range join, in DataFrame functions only.

A host turned around ("com.example.www.") makes a rule for a host and its subdomains an
interval of keys: from "com.example." up to, not including, "com.example/".  Such
intervals nest or are disjoint.  Interval starts and ends are merged with the urls in key
order; the stack of rules that are active after each start or end is carried on to the
urls that follow, and the longest rule on it whose path leads the url's path decides.

Rows are dealt by top-level label and a salt of the row, with the rules of that label in
every salt, so no host, however common, is one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .mapping import kept_columns

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STACK = "array<struct<size:int,host:string,path:string,verdict:string>>"


def url_host(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, "host/path") pairs as rows ``host``, ``path``, ``verdict``."""
    if not rules:
        return spark.sql("select '' host, '' path, '' verdict").where("false")
    made = [F.struct(F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path"), F.lit(v).alias("verdict")) for v, r in rules]
    return spark.range(1).select(F.inline(F.array(*made)))


def _events(rules: DataFrame, salts: int) -> DataFrame:
    """Starts and ends of the rule hosts' intervals, each with the stack that holds after it, in every salt."""
    nodes = (
        rules.where(F.coalesce(F.col("host"), F.lit("")) != "")
        .select(
            host_key(F.translate("host", _UPPER, _LOWER)).alias("lo"),
            F.struct(F.length(F.concat("host", "path")).alias("size"), F.col("host").cast("string"), F.col("path").cast("string"), F.col("verdict").cast("string")).alias("rule"),
        )
        .groupBy("lo")
        .agg(F.array_sort(F.collect_set("rule")).alias("own"))
    )
    labels = F.split(F.expr("substring(lo, 1, length(lo) - 1)"), r"\.")
    above = nodes.select("lo", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))).alias("depth", "up"))
    stacks = (
        above.join(nodes.select(F.col("lo").alias("up"), "own"), "up")
        .groupBy("lo")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "up", "own"))).alias("chain"))
        .select("lo", F.flatten(F.transform("chain", lambda x: x["own"])).alias("inside"), F.flatten(F.transform(F.expr("slice(chain, 1, size(chain) - 1)"), lambda x: x["own"])).alias("outside"))
    )
    start = F.struct(F.col("lo").alias("key"), F.lit(1).alias("kind"), F.col("inside").alias("stack"))
    end = F.struct(F.expr("concat(substring(lo, 1, length(lo) - 1), '/')").alias("key"), F.lit(0).alias("kind"), F.col("outside").alias("stack"))
    return stacks.select(F.substring_index("lo", ".", 1).alias("__top"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"), F.inline(F.array(start, end))).select(
        "__top", "__salt", F.col("key").alias("__key"), F.col("kind").alias("__kind"), F.col("stack").cast(_STACK).alias("__stack")
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", keep: Sequence[str] | None = None, salts: int | None = None) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` ("host/path", or null) and ``verdict`` (the rule's, or ``default``).

    A rule (``host``, ``path``, ``verdict``) fits its host and all subdomains if the url's
    path starts with its path; the longest rule wins, of equally long ones the one with
    the greater host, path and verdict.  A rule without host fits nothing.  Null urls and
    urls without ``://`` have empty host and path, so no rule.  ``keep`` names the columns
    that pass through (all by default); input columns named like a result are replaced.
    Repeated urls are judged each for itself.  Rules are repeated ``salts`` times (as many
    as shuffle partitions by default).
    """
    salts = salts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    passed = kept_columns(pages, keep, ("host", "path", "rule", "verdict"))
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in passed] or [F.lit(1).alias("none")]).alias("__row"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    own = own.withColumn("__key", host_key(F.col("host")))
    own = own.select(
        "*", F.substring_index("__key", ".", 1).alias("__top"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("__salt"), F.lit(2).alias("__kind"), F.lit(None).cast(_STACK).alias("__stack")
    )
    swept = Window.partitionBy("__top", "__salt").orderBy("__key", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = own.unionByName(_events(rules, salts), allowMissingColumns=True).withColumn("__stack", F.last("__stack", ignorenulls=True).over(swept)).where("__kind = 2")
    best = F.array_max(F.filter("__stack", lambda r: F.startswith(F.col("path"), r["path"])))
    met = met.withColumn("__best", best)
    return met.select(
        *[F.col(f"__row.`{c}`") for c in passed],
        "host",
        "path",
        F.concat("__best.host", "__best.path").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )
