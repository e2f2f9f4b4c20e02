"""Versioned Parquet tables with upserts.

A table is a folder of immutable part folders and a manifest that says which of them are current.
A commit writes new part folders, then replaces the manifest in one rename, so a reader sees the old
table or the new one and a failed writer leaves nothing behind that is read. Rows are dealt to parts
by a partition column or by a hash of the key; an upsert rewrites only the parts that the new rows
fall into. Hash parts are as many as the rows ask for, and the table is dealt anew when it has outgrown
them. A writer that finds another's version at the end fails and publishes nothing. Files go through
Hadoop's file systems, so any store will do."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "__part"
MANIFEST = "_manifest.json"
#: Rows that a hash part is made for; a table that has GROWN times as many in each is dealt anew.
ROWS_A_BUCKET = 1 << 20
GROWN = 4


class ConcurrentWrite(RuntimeError):
    """Another writer has published a version since this one began."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], partition: str | None = None, buckets: int = 16) -> None:
        self.spark, self.path, self.key, self.partition = spark, path.rstrip("/"), key, partition
        self.buckets = self.least_buckets = buckets

    def _hadoop(self):
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        file = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{MANIFEST}")
        return jvm, conf, file, file.getFileSystem(conf)

    def _manifest(self) -> dict | None:
        jvm, _, file, fs = self._hadoop()
        if not fs.exists(file):
            return None
        stream = fs.open(file)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict, before: dict | None) -> None:
        jvm, conf, file, fs = self._hadoop()
        if ((self._manifest() or {}).get("version")) != (before or {}).get("version"):
            raise ConcurrentWrite(f"{self.path} has changed since this write began")
        manifest = {"version": uuid.uuid4().hex, "buckets": self.buckets} | manifest
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.{MANIFEST}-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest, indent=2, sort_keys=True).encode()))
        stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = rename
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(file.toUri(), conf).rename(draft, file, options)

    def exists(self) -> bool:
        """Whether a version was ever published; errors of the store are errors."""
        return self._manifest() is not None

    def _part_of(self) -> Column:
        if self.partition:
            return F.coalesce(F.col(self.partition).cast("string"), F.lit("null"))
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("string")

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """The current rows, of all parts or of some."""
        manifest = self._manifest()
        if manifest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.path}/{d}" for p, d in sorted(manifest["parts"].items()) if parts is None or p in parts]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def _write(self, df: DataFrame) -> tuple[dict[str, str], dict[str, int]]:
        """Write df as new part folders: {part: folder}, {part: rows}."""
        version = f"v-{uuid.uuid4().hex}"
        placed = df.withColumn(PART, self._part_of())
        # one task for a small part, as many as its size asks for of a large one
        placed.hint("rebalance", PART).write.partitionBy(PART).parquet(f"{self.path}/{version}")
        found = self.spark.read.parquet(f"{self.path}/{version}").groupBy(F.col(PART).cast("string").alias(PART)).count().collect()
        return {r[0]: f"{version}/{PART}={r[0]}" for r in found}, {r[0]: r[1] for r in found}

    def overwrite(self, df: DataFrame) -> None:
        """Replace all rows; hash parts are as many as df asks for."""
        before = self._manifest()
        size = df.count()
        self.buckets = max(self.least_buckets, math.ceil(size / ROWS_A_BUCKET))
        parts, rows = self._write(df) if size else ({}, {})
        self._publish({"schema": df.schema.jsonValue(), "parts": parts, "rows": rows}, before)

    def merge(self, source: DataFrame, choose: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Rows of source replace those of the same key, the others stay; or choose picks among both, one
        row of each key. Two rows of source with one key are an error, before anything is written."""
        if not source.groupBy(*self.key).count().filter("count > 1").isEmpty():
            raise ValueError(f"several rows of the source have one key ({', '.join(self.key)})")
        manifest = self._manifest()
        if manifest is None:
            return self.overwrite(source)
        self.buckets = manifest.get("buckets", self.buckets)
        touched = [r[0] for r in source.select(self._part_of()).distinct().collect()]
        if not touched:
            return None
        old = self.read(touched).select(*source.columns)
        parts, rows = self._write(choose(old.unionByName(source)) if choose else upsert(old, source, self.key))
        rows = manifest.get("rows", {}) | rows
        self._publish({"schema": source.schema.jsonValue(), "parts": manifest["parts"] | parts, "rows": rows}, manifest)
        if not self.partition and sum(rows.values()) > GROWN * self.buckets * ROWS_A_BUCKET:
            self.overwrite(self.read())
        return None

    def remove_dead_parts(self, older_than_s: float = 7 * 86400) -> list[str]:
        """Delete version folders that the manifest doesn't name and that were not touched for so long;
        a reader of an old version has that much time to finish."""
        jvm, _, _, fs = self._hadoop()
        manifest = self._manifest()
        if manifest is None:
            return []
        alive = {d.split("/")[0] for d in manifest["parts"].values()}
        dead = []
        for status in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in alive and time.time() - status.getModificationTime() / 1000 >= older_than_s:
                fs.delete(status.getPath(), True)
                dead.append(name)
        return dead


def upsert(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """source and the rows of target whose key it hasn't."""
    return target.join(source.select(*key), key, "left_anti").select(*source.columns).unionByName(source)


class AppendLog:
    """An append-only set of batches; a batch that is written again replaces itself, so a retry after
    a crash never doubles rows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        file = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = file.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(file) and len(fs.listStatus(file)) > 0

    def append(self, df: DataFrame, batch: str, partition_by: str | None = None) -> None:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{self.path}/batch={batch}")

    def read(self, schema: StructType) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(f"{self.path}/batch=*").select(*schema.names)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
