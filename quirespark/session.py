"""Session helpers: the shared folder, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``. Where that is unset a local session, as in tests, gets one of its own; a cluster has to name it."""
    given = spark.conf.get("spark.checkpoint.dir", "")
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="quirespark-")
        spark.conf.set("spark.checkpoint.dir", given)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def kept_until_exit(spark: SparkSession, path: str) -> str:
    """The path, to be deleted when the application ends."""
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet in the shared folder and read back: cuts lineage, survives lost executors. Deleted by ``discard``, or when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(kept_until_exit(spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables of which nothing is needed any more."""
    for t in tables:
        path = getattr(t, "_stored_at", None)
        if path:
            fs, p = _path(t.sparkSession, path)
            fs.delete(p, True)
