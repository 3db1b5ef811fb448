"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a temporary folder in local mode, as in tests, and an error on a cluster, whose executors share no such folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quern.scratch.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-quern-')}"
        spark.conf.set("quern.scratch.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by release()."""
    path = f"{scratch_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and lost executors cost nothing that was done before.

    The table has the columns and rows of df; an empty df gives an empty table. It stays until release().
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that this application has written; how many. For the time when no result that reads them is wanted any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(p)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)
