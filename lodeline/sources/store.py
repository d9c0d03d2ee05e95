"""A folder of Parquet tables under a JSON manifest. A table's rows become visible when the manifest names their folder: a failed or repeated write
leaves the old state. Each commit is a file of its own, ``manifest-<number>.json``, that appears by one rename to a name that doesn't exist yet; the greatest number counts, so there
is no moment without a manifest. One writer at a time."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

FORMAT_VERSION = 1


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.manifest: dict = {}

    def _commits(self) -> list[int]:
        """The numbers of the manifests, ascending."""
        found = self._fs.globStatus(self._path(f"{self.path}/manifest-*.json")) or []
        return sorted(int(f.getPath().getName()[9:-5]) for f in found)

    def exists(self) -> bool:
        return bool(self._commits())

    def load(self) -> dict:
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest-{self._commits()[-1]:010d}.json").collect())
        self.manifest = json.loads(text)
        if self.manifest.get("format_version", 0) > FORMAT_VERSION:
            raise ValueError(f"format version {self.manifest['format_version']} is newer than {FORMAT_VERSION}")
        return self.manifest

    def commit(self) -> None:
        """Write the manifest under a name that nothing reads, then give it the next number. The one before stays, older ones go."""
        self.manifest["format_version"] = FORMAT_VERSION
        old = self._commits()
        new, to = self._path(f"{self.path}/manifest.new"), self._path(f"{self.path}/manifest-{(old[-1] if old else 0) + 1:010d}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(self.manifest, indent=1, sort_keys=True).encode()))
        out.close()
        if not self._fs.rename(new, to):
            raise OSError(f"the manifest can't be renamed to {to}")
        for n in old[:-1]:
            self._fs.delete(self._path(f"{self.path}/manifest-{n:010d}.json"), False)

    def append(self, table: str, rows: DataFrame, partition_by: str | None = None) -> None:
        self.manifest.setdefault("tables", {}).setdefault(table, []).append(self._write(table, rows, partition_by))

    def replace(self, table: str, rows: DataFrame, partition_by: str | None = None) -> None:
        self.manifest.setdefault("tables", {})[table] = [self._write(table, rows, partition_by)]

    def drop(self, table: str) -> None:
        self.manifest.get("tables", {}).pop(table, None)

    def _write(self, table: str, rows: DataFrame, partition_by: str | None) -> str:
        part = f"{table}/batch={uuid.uuid4().hex}"
        w = rows.write
        (w.partitionBy(partition_by) if partition_by else w).parquet(f"{self.path}/{part}")
        self.manifest.setdefault("schemas", {})[table] = rows.schema.json()
        return part

    def read(self, table: str) -> DataFrame | None:
        parts = self.manifest.get("tables", {}).get(table)
        if not parts:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(self.manifest["schemas"][table]))
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{p}" for p in parts]).select(*schema.names)  # one scan

    def bytes_of(self, table: str) -> int:
        return sum(self._fs.getContentSummary(self._path(f"{self.path}/{p}")).getLength() for p in self.manifest.get("tables", {}).get(table, []))
