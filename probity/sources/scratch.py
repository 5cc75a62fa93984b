"""Folders for what a job writes on its way: below spark.checkpoint.dir, which all executors share."""
from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="probity-")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder. One machine (local master) without that setting has a temporary one; a cluster is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Lets Spark drop a query's shuffle files as soon as it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written once and read back, for several passes: it survives lost executors and is no one's cache. The
    shuffle files behind it go once it is written."""
    spark, path = df.sparkSession, folder(df.sparkSession, "stored")
    was = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, was) if was else spark.conf.unset(CLEAN)
    return spark.read.schema(df.schema).parquet(path)
