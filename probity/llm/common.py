"""Helpers that the training-data operators share: scratch tables, folds, Arrow text access."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast below this estimated size; above it, the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Bytes of text that one vectorised step handles at a time.
SLICE_BYTES = 1 << 18

_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="probity-")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. On one machine (local master) a
    session without that setting gets a temporary folder; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_dir()
    path = f"{base.rstrip('/')}/probity-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


#: Lets Spark drop a query's shuffle files as soon as it has ended.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of the batches that Python tasks get, at most: what such a task holds is a few times that.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def stage(df: DataFrame, *partition: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage and survives lost executors.
    The shuffle files behind it go once it is written."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    was = {k: spark.conf.get(k, None) for k in (CLEAN, BATCH)}
    spark.conf.set(CLEAN, "true")
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        df.write.option("compression", "zstd").partitionBy(*partition).parquet(path)
    finally:
        for k, v in was.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_stage(*frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        path = getattr(df, "scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def scratch_paths() -> list[str]:
    return list(_scratch)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete the staged tables at these paths; those that are gone already don't matter."""
    for path in paths:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _scratch:
        _scratch.remove(path)


def sized(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit BROADCAST_BYTES, else df as it is."""
    return F.broadcast(df) if df.count() * bytes_per_row <= BROADCAST_BYTES else df


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id's text modulo k; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them; null counts as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text each; one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
