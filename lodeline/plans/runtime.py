"""What plans need from the cluster: tables, and a shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: their Python need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="lodeline-")) / "lodeline.zip"
    atexit.register(_drop_local, str(at.parent))
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, one of this machine if the session runs on it alone; a cluster has to name one."""
    if not (at := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodeline-")
        spark.conf.set("spark.checkpoint.dir", at)
        atexit.register(_drop_local, at.removeprefix("file://"))
    return at.rstrip("/")


def _drop_local(at: str) -> None:
    import shutil

    shutil.rmtree(at, ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there: later stages and lost executors start from the
    table. It is removed when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _made:
        atexit.register(_drop_tables)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """For a projection of hundreds of terms, executed inside: as one method it would be too long for the JVM to compile (8,000 bytes of code), so it is made as several."""
    key = "spark.sql.codegen.hugeMethodLimit"
    was = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_tables() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended: the cluster's own clean-up of the folder remains
            return


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
