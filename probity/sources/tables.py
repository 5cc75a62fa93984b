"""Stored tables as versions: a batch of writes to several tables is published at once or not at all.

    BASE/data/<table>/<transaction>/bucket=<b>/part-...parquet
    BASE/commits/<version>.json

A manifest names the folder of every table's every bucket. A transaction writes new folders only, for the
buckets that its rows fall into, then puts its manifest in place by one rename: readers see the version before or
the one after. What a killed transaction leaves behind is named by no manifest. A manifest also holds the last
batch of each writer, so a batch that comes again is recognised and changes nothing.

A table's buckets are fixed when it is first written: choose as many as keep a bucket within a few gigabytes. A
batch reads and rewrites the buckets of its own keys alone.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from probity.operators.activity import upsert

BUCKETS = 16
BUCKET = "bucket"


class Conflict(Exception):
    """Another transaction has published this version."""


class Tables:
    """The tables below a folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets = spark, base.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Published versions that are still kept, ascending."""
        folder = self._path(f"{self.base}/commits")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            found = self.versions()
            if not found:
                return {"version": 0, "applied": {}, "tables": {}}
            version = found[-1]
        stream = self._fs.open(self._path(f"{self.base}/commits/{version:020d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def publish(self, manifest: dict) -> None:
        """Put a manifest in place; Conflict if its version is there."""
        folder = f"{self.base}/commits"
        self._fs.mkdirs(self._path(folder))
        draft, final = self._path(f"{folder}/.{uuid.uuid4().hex}.tmp"), self._path(f"{folder}/{manifest['version']:020d}.json")
        out = self._fs.create(draft, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']}")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the newest one by default. A reader's rows stay what they are while others publish."""
        return self.buckets_of(self.manifest(version), name).drop(BUCKET)

    def buckets_of(self, manifest: dict, name: str, only: list[int] | None = None) -> DataFrame:
        """A table of a manifest with its bucket column; `only` these buckets."""
        t = manifest["tables"].get(name)
        if t is None:
            raise KeyError(name)
        schema = StructType.fromJson(t["schema"])
        paths = [f"{self.base}/data/{name}/{p}/{BUCKET}={b}" for b, many in t["parts"].items() if only is None or int(b) in only for p in many]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(0))
        rows = self.spark.read.schema(schema).parquet(*paths)
        return rows.withColumn(BUCKET, F.regexp_extract("_metadata.file_path", rf"/{BUCKET}=(\d+)/[^/]*$", 1).cast("int"))

    def begin(self, writer: str = "", batch: int | None = None) -> Transaction | None:
        """A transaction on the newest version; None if this writer's batch, or a later one, has been applied."""
        now = self.manifest()
        if batch is not None and now["applied"].get(writer, -1) >= batch:
            return None
        return Transaction(self, now, writer, batch)

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest `keep` manifests, and the folders that none of these names; how many folders went.

        Not beside a running transaction: its folders are in no manifest yet."""
        found = self.versions()
        for v in found[:-keep]:
            self._fs.delete(self._path(f"{self.base}/commits/{v:020d}.json"), False)
        used = {(n, f"{p}/{BUCKET}={b}") for v in found[-keep:] for n, t in self.manifest(v)["tables"].items() for b, many in t["parts"].items() for p in many}
        gone = 0
        data = self._path(f"{self.base}/data")
        for table in self._fs.listStatus(data) if self._fs.exists(data) else []:
            for folder in self._fs.listStatus(table.getPath()):
                parts = list(self._fs.listStatus(folder.getPath()))
                for part in parts:
                    name = f"{folder.getPath().getName()}/{part.getPath().getName()}"
                    if (table.getPath().getName(), name) not in used:
                        gone += part.isDirectory()
                        self._fs.delete(part.getPath(), True)
                if not len(list(self._fs.listStatus(folder.getPath()))):
                    self._fs.delete(folder.getPath(), True)
        return gone


class Transaction:
    """Writes to several tables; none shows before commit()."""

    def __init__(self, tables: Tables, old: dict, writer: str, batch: int | None):
        self.tables, self.spark = tables, tables.spark
        self.id = uuid.uuid4().hex
        self.new = json.loads(json.dumps(old)) | {"version": old["version"] + 1}
        if batch is not None:
            self.new["applied"][writer] = batch
        self.done = False

    def _bucket(self, name: str, keys: list[str]) -> Column:
        # keys of other widths than the stored ones would fall elsewhere
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(self.new["tables"][name]["buckets"])).cast("int")

    def declare(self, name: str, schema: StructType, by: list[str]) -> None:
        if name not in self.new["tables"]:
            self.new["tables"][name] = {"schema": schema.jsonValue(), "buckets": self.tables.buckets, "by": by, "parts": {}}

    def _write(self, name: str, rows: DataFrame, touched: list[int]) -> None:
        folder = f"{self.id}-{uuid.uuid4().hex[:8]}"
        schema = StructType.fromJson(self.new["tables"][name]["schema"])
        path = f"{self.tables.base}/data/{name}/{folder}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], BUCKET).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
        parts = self.new["tables"][name]["parts"]
        there = {s.getPath().getName() for s in self.tables._fs.listStatus(self.tables._path(path))}
        for b in touched:
            parts.pop(str(b), None)  # a bucket may be empty now
            if f"{BUCKET}={b}" in there:
                parts[str(b)] = [folder]

    def read(self, name: str) -> DataFrame:
        """A table as this transaction leaves it."""
        return self.tables.buckets_of(self.new, name).drop(BUCKET)

    def find(self, name: str, wanted: DataFrame, keys: list[str], schema: StructType) -> DataFrame:
        """The stored rows of wanted's keys, which must be those that the table is dealt by."""
        self.declare(name, schema, keys)
        wanted = self._kept(wanted.select(*keys).distinct().withColumn(BUCKET, self._bucket(name, keys)))
        touched = [r[0] for r in wanted.select(BUCKET).distinct().collect()]
        return self.tables.buckets_of(self.new, name, touched).join(wanted, [BUCKET, *keys], "left_semi").drop(BUCKET)

    def append(self, name: str, new: DataFrame, key: str) -> None:
        """Add rows behind those that are there; a bucket of such a table is a list of folders."""
        self.declare(name, new.schema, [key])
        new = new.withColumn(BUCKET, self._bucket(name, [key]))
        folder = f"{self.id}-{uuid.uuid4().hex[:8]}"
        path = f"{self.tables.base}/data/{name}/{folder}"
        new.repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
        parts = self.new["tables"][name]["parts"]
        for s in self.tables._fs.listStatus(self.tables._path(path)):
            if s.isDirectory():
                b = s.getPath().getName().removeprefix(f"{BUCKET}=")
                parts[b] = [*parts.get(b, []), folder]

    def upsert(self, name: str, new: DataFrame, keys: list[str], schema: StructType, rules: dict[str, Callable[[Column, Column], Column]], number: str | None = "id") -> DataFrame:
        """Merge new, one row of each key, into a table; returns the stored rows of new's keys.

        `number` is a column of row numbers that new rows get: in each bucket the next free ones, so that they
        never meet another bucket's."""
        self.declare(name, schema, keys)
        new = self._kept(new.withColumn(BUCKET, self._bucket(name, keys)))
        touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most the buckets of a table
        if not touched:
            return self.spark.createDataFrame([], schema)
        old = self.tables.buckets_of(self.new, name, touched)
        columns = [f.name for f in schema]
        merged = upsert(old.select(*columns, BUCKET), new, [BUCKET, *keys], rules)
        if number:
            merged = self._numbered(name, merged, number, keys)
        self._write(name, merged, touched)
        stored = self.tables.buckets_of(self.new, name, touched)
        return stored.join(new.select(*keys), keys, "left_semi").drop(BUCKET)

    def replace(self, parents: DataFrame, parent: str, children: dict[str, tuple[DataFrame, StructType]], number: str | None = "id") -> None:
        """In each of the tables `children` the rows whose `parent` is one of parents' go, and the given rows take
        their place. All tables are dealt by the parent, so its buckets are found once."""
        for name, (_, schema) in children.items():
            self.declare(name, schema, [parent])
        bucket = self._bucket(next(iter(children)), [parent])
        parents = self._kept(parents.select(parent).distinct().withColumn(BUCKET, bucket))
        touched = sorted(r[0] for r in parents.select(BUCKET).distinct().collect())

        def one(name: str) -> None:
            new, schema = children[name]
            there = self.new["tables"][name]["parts"]
            if not any(str(b) in there for b in touched) and new.isEmpty():
                return
            columns = [f.name for f in schema]
            old = self.tables.buckets_of(self.new, name, touched).join(parents, [BUCKET, parent], "left_anti").select(*columns, BUCKET)
            rows = old.unionByName(new.withColumn(BUCKET, bucket), allowMissingColumns=True)
            if number:
                rows = self._numbered(name, rows, number, [c for c in columns if c != number])
            self._write(name, rows, touched)

        if touched:
            for name in children:
                one(name)

    def _numbered(self, name: str, rows: DataFrame, number: str, order: list[str]) -> DataFrame:
        """rows with a number where they have none: in each bucket the next free ones."""
        count = self.new["tables"][name]["buckets"]
        here = W.partitionBy(BUCKET)
        used = F.coalesce(F.max(F.floor((F.col(number) - F.col(BUCKET)) / count)).over(here), F.lit(0))
        fresh = F.row_number().over(here.orderBy(F.col(number).isNull().desc(), *order))
        return rows.withColumn(number, F.coalesce(F.col(number), (used + fresh) * count + F.col(BUCKET)))

    def _kept(self, df: DataFrame) -> DataFrame:
        """df written once below the transaction's folder, so that a retried task reads the same rows again."""
        path = f"{self.tables.base}/data/_batch/{self.id}/{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _tidy(self) -> None:
        self.tables._fs.delete(self.tables._path(f"{self.tables.base}/data/_batch/{self.id}"), True)

    def commit(self) -> int:
        """Publish all writes as one version."""
        if self.done:
            raise ValueError("this transaction is over")
        self.done = True
        self.tables.publish(self.new)
        self._tidy()
        return self.new["version"]
