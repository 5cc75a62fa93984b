"""Dealing out the rows of small inputs, so that all cores share costly work per row."""
from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df over as many partitions as there are cores, by its keys, if it comes in fewer; else as it is.

    A file of one row group is one task, whatever its size. Large inputs have more partitions than cores and aren't
    shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
