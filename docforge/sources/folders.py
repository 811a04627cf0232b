"""Folders of any file system that Spark reaches: asked and changed through Spark's own Hadoop classes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name below spark.checkpoint.dir, which all tasks share. Where that is unset, one is made if all tasks run in the driver's own process."""
    given = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="docforge-")
        spark.conf.set("spark.checkpoint.dir", given)
    return f"{given.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _at(spark, path)
    return store.exists(at)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder to one that isn't there yet; False, and the source deleted, where it is."""
    (a, store), (b, _) = _at(spark, source), _at(spark, target)
    store.mkdirs(b.getParent())
    if store.exists(b):
        store.delete(a, True)
        return False
    return store.rename(a, b)


def delete(spark: SparkSession, path: str) -> None:
    at, store = _at(spark, path)
    store.delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths of what a folder holds; none where it isn't there. For folders of known, few entries."""
    at, store = _at(spark, path)
    return sorted(s.getPath().toString() for s in store.listStatus(at)) if store.exists(at) else []


def written(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a table in a new folder of the shared place, and the folder. What made them isn't run again, whatever is lost."""
    spark = rows.sparkSession
    path = scratch(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path
