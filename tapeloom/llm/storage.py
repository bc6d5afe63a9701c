"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has written tables to and not removed.
_written: dict[str, None] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    Where that is unset, a local folder is set first if the session runs on this machine
    alone (as in tests); on a cluster, where executors would each write to their own
    disk, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tapeloom-')}"
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tapeloom-{uuid.uuid4().hex}"
    _written[path] = None
    return path


def written(df: DataFrame, **options: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def remove(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes written tables that nothing reads any more; given none, all that this process has written."""
    paths = [t if isinstance(t, str) else t.written_to for t in tables] or list(_written)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _written.pop(path, None)
