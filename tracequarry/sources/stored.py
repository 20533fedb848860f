"""Stored tables that are updated in place: buckets by key, touched ones rewritten, a manifest that says which files count.

A table is a folder: data/<version>/bucket=<n>/ holds rows of one bucket, manifest/<version>.json names for each bucket the folder
that counts. An update reads only the buckets that its keys fall into, writes them anew to a folder of its own and then publishes
the next manifest, which is created only if no one else has. Whatever fails before that leaves the old version whole, and the
same update may run again: it gives the same rows. Files that no manifest of the last versions names are removed by vacuum().
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new table; a bucket is what an update of one key rewrites.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another update was published first; read the table again and repeat."""


class StoredTable:
    """Rows by key of which the latest by order stays; of equal ones the incoming row does."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))

    def manifest(self) -> dict:
        """The last version: number, buckets, schema, and the folder of each bucket that has rows."""
        had = self.versions()
        if not had:
            return {"version": 0, "buckets": self.buckets, "schema": None, "files": {}}
        stream = self.fs.open(self._path(f"{self.path}/manifest/{had[-1]:010}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Written aside, then moved to a name that must be free; the move is one step."""
        aside = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        target = self._path(f"{self.path}/manifest/{manifest['version']:010}.json")
        if self.fs.exists(target) or not self.fs.rename(aside, target):
            self.fs.delete(aside, False)
            raise Conflict(f"version {manifest['version']} of {self.path} has been published meanwhile")

    def _read(self, manifest: dict, buckets: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        folders = [manifest["files"][b] for b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        manifest = self.manifest()
        if manifest["schema"] is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._read(manifest, sorted(manifest["files"]))

    def upsert(self, updates: DataFrame) -> dict:
        """Take in rows; the published manifest. Of an update's rows of one key the latest counts, found before they are shuffled whole.

        updates should be a written table, as it is read twice. A null key is a key like others."""
        old = self.manifest()
        if old["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {old['buckets']} buckets")
        new = self._latest(updates.select("*", F.lit(1).alias("_incoming")))
        touched = sorted(str(r[0]) for r in updates.select(self.bucket()).distinct().collect())  # numbers of buckets
        if not touched:
            return old
        if old["schema"] is not None:
            had = self._read(old, [b for b in touched if b in old["files"]]).select("*", F.lit(0).alias("_incoming"))
            new = self._latest(had.unionByName(new, allowMissingColumns=True))
        rows = new.drop("_incoming")
        version = old["version"] + 1
        folder = f"{self.path}/data/{version:010}-{uuid.uuid4().hex}"
        bucket = self._free(rows, "bucket")
        rows.withColumn(bucket, self.bucket()).repartition(bucket).write.partitionBy(bucket).parquet(folder)
        manifest = {
            "version": version, "buckets": self.buckets, "schema": rows.schema.json(), "touched": touched,
            "files": old["files"] | {b: f"{folder}/{bucket}={b}" for b in touched},
        }
        self._publish(manifest)
        return manifest

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row a key: the greatest by order, then the incoming one, then by all other columns, so that ties don't depend on files."""
        others = [c for c in rows.columns if c not in (self.key, self.order, "_incoming")]
        best = F.max(F.struct(self.order, "_incoming", *others)).alias("_best")
        return rows.groupBy(self.key).agg(best).select(self.key, *[F.col(f"_best.{c}").alias(c) for c in (self.order, *others, "_incoming")])

    def _free(self, rows: DataFrame, name: str) -> str:
        while name in rows.columns:
            name = f"_{name}"
        return name

    def vacuum(self, keep: int = 1) -> int:
        """Remove folders and manifests that none of the last versions needs; how many folders went. Not beside a running update."""
        had = self.versions()
        needed = set()
        for v in had[-keep:]:
            stream = self.fs.open(self._path(f"{self.path}/manifest/{v:010}.json"))
            needed |= {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in json.loads(bytes(stream.readAllBytes()).decode())["files"].values()}
            stream.close()
        gone = 0
        for status in self.fs.listStatus(self._path(f"{self.path}/data")):
            if status.getPath().getName() not in needed:
                self.fs.delete(status.getPath(), True)
                gone += 1
        for v in had[:-keep]:
            self.fs.delete(self._path(f"{self.path}/manifest/{v:010}.json"), False)
        return gone
