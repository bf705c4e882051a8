"""Folders for intermediate tables, in the place the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "strandline-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/strandline-{spark.sparkContext.applicationId}"


def folder(spark: SparkSession, tag: str) -> str:
    """A new path in this application's part of the folder that spark.checkpoint.dir names. Only where that is unset and all runs on this machine (tests),
    a temporary folder stands for it."""
    return f"{_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """``df`` stored there and read again."""
    path = folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Remove one path of :func:`folder`."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Remove everything this application has put there."""
    dropped(spark, _root(spark))
