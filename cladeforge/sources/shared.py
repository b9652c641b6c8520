"""Folders that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new place below spark.checkpoint.dir; where that is unset, a temporary one, in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='stored-')}"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a Parquet table at path: what comes of it does not go back to what df came of."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, marks and hidden files left out; none if there is no folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in names if n[0] not in "_.")


def move(spark: SparkSession, source: str, target: str) -> None:
    """A folder to another name, in place of what is there; an empty folder where the source is missing."""
    a, b = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    fs = b.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(b, True)
    fs.mkdirs(b.getParent() if fs.exists(a) else b)
    if fs.exists(a) and not fs.rename(a, b):
        raise OSError(f"cannot rename {source} to {target}")
