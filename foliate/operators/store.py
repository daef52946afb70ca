"""A keyed table in the shared folder: merged batches, one row a key, and versions that become valid all at once.

A version is a manifest that names the files it is made of: a base and the changes since, each a Parquet folder of one row a key. A batch
writes its changes beside all that is there, and its manifest last; a manifest counts only with its closing line, so a
writer that dies leaves the old version as it was. Reading lays the changes over the base: few keys (``FEW`` rows) are
broadcast, so that the base is not shuffled. After ``CHANGES`` batches the base is written anew.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that may be broadcast; batches before the base is written anew.
FEW, CHANGES = 1_000_000, 8
_END = "end"


def one_each(rows: DataFrame, key: str | list[str], order: Column | str | None = None) -> DataFrame:
    """One row a key: the last by ``order``, equal ones (or without an order, all) by a hash of the row."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    mark = F.xxhash64(*[F.col(c) for c in rows.columns])
    by = mark if order is None else F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), mark.alias("m"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*[F.col(k) if c in keys else F.col("_r")[c].alias(c) for c in rows.columns for k in [c]])


def over(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``base`` without the keys of ``changes``, and the changes; both hold one row a key."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


@dataclass
class Version:
    number: int
    base: str | None
    changes: list[tuple[str, int]]  #: folder and rows


class Conflict(RuntimeError):
    """Another writer has made the same version."""


class KeyedStore:
    """Rows of ``schema`` by ``key`` below a folder of any file system that Spark knows. Rows without a key are not kept."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str) -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key
        self.schema = spark.createDataFrame([], schema).schema
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *x: path("/".join([self.folder, *x]))
        self._fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, name: str) -> list[str]:
        stream = self._fs.open(self._path("_versions", name))
        try:
            return bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()

    def version(self) -> Version | None:
        """The last valid version."""
        if not self._fs.exists(self._path("_versions")):
            return None
        names = sorted((f.getPath().getName() for f in self._fs.listStatus(self._path("_versions"))), reverse=True)
        for name in (n for n in names if n.isdigit()):
            lines = self._manifest(name)
            if lines[-1] == _END:
                changes = [x.split(" ") for x in lines[1:-1]]
                return Version(int(name), lines[0] or None, [(folder, int(n)) for folder, n in changes])
        return None

    def _publish(self, version: Version) -> None:
        """Write the manifest; a manifest of that number that another writer has begun and finished is a conflict."""
        target = self._path("_versions", f"{version.number:012d}")
        if self._fs.exists(target) and self._manifest(target.getName())[-1] == _END:
            raise Conflict(f"version {version.number} is there already")
        lines = [version.base or "", *(f"{folder} {n}" for folder, n in version.changes), _END]
        stream = self._fs.create(target, True)
        try:
            stream.write(bytearray("\n".join(lines).encode()))
        finally:
            stream.close()

    def _load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _write(self, rows: DataFrame) -> str:
        name = f"data-{uuid.uuid4()}"
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return name

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of the last version (or of a given one that is still there)."""
        version = version or self.version()
        nothing = self.spark.createDataFrame([], self.schema)
        if version is None:
            return nothing
        rows = self._load(version.base) if version.base else nothing
        for folder, n in version.changes:
            change = self._load(folder)
            keys = F.broadcast(change.select(self.key)) if n <= FEW else change.select(self.key)
            rows = rows.join(keys, self.key, "left_anti").unionByName(change.where("NOT _gone").drop("_gone"))
        return rows.select(*self.schema.names)

    def _add(self, changes: DataFrame) -> Version:
        before = self.version() or Version(0, None, [])
        name = self._write(changes)
        after = Version(before.number + 1, before.base, [*before.changes, (name, self._load(name).count())])
        if len(after.changes) > CHANGES:
            after = Version(after.number, self._write(self.read(after)), [])
        self._publish(after)
        return after

    def upsert(self, rows: DataFrame, order: Column | str | None = None) -> Version:
        """Merge a batch: its rows replace those of the same key; of a key's rows in the batch the last by ``order`` stays."""
        kept = one_each(rows.select(*self.schema.names, *([order] if isinstance(order, str) and order not in self.schema.names else [])), self.key, order)
        return self._add(kept.where(F.col(self.key).isNotNull()).select(*self.schema.names).withColumn("_gone", F.lit(False)))

    def delete(self, keys: DataFrame) -> Version:
        """Take out the rows of some keys (a column named as the store's key)."""
        gone = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != self.key]
        return self._add(gone.select(self.key, *empty).select(*self.schema.names).withColumn("_gone", F.lit(True)))

    def vacuum(self) -> int:
        """Delete all files but those of the last version; the number of folders deleted. Not while another writer is at work."""
        last = self.version()
        named = {last.base, *(folder for folder, _ in last.changes)} if last else set()
        old = [f.getPath() for f in (self._fs.listStatus(self._path()) if self._fs.exists(self._path()) else []) if f.getPath().getName().startswith("data-") and f.getPath().getName() not in named]
        for path in old:
            self._fs.delete(path, True)
        return len(old)
